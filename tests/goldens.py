"""Golden cases: (family, schema, documents that fit, documents that don't)."""

ADDRESS = {"$id": "https://example.com/address", "type": "object", "properties": {"street": {"type": "string"}, "city": {"type": "string"}, "zip": {"type": "string", "pattern": r"^\d{5}$"}}, "required": ["street", "city"]}
USER = {
    "type": "object",
    "properties": {"id": {"type": "integer", "minimum": 1}, "name": {"type": "string", "minLength": 1}, "email": {"type": "string"}, "age": {"type": "integer", "minimum": 0, "maximum": 150}, "role": {"enum": ["admin", "user", "guest"]}, "active": {"type": "boolean"}, "score": {"type": "number", "minimum": 0, "maximum": 100}},
    "required": ["id", "name"],
}
CASES = [
    ("type string", {"type": "string"}, ['"a"', '""'], ["1", "null", "[]", "{}", "true"]),
    ("type integer", {"type": "integer"}, ["1", "1.0", "-3", "1e2", "12345678901234567890"], ["1.5", '"1"', "true", "null", "1e400"]),
    ("type number", {"type": "number"}, ["1", "1.5", "-0.25e3"], ['"5"', "null", "false"]),
    ("type boolean", {"type": "boolean"}, ["true", "false"], ["0", '"true"', "null"]),
    ("type null", {"type": "null"}, ["null"], ["0", '""', "false", "{}"]),
    ("type object", {"type": "object"}, ["{}", '{"a":1}'], ["[]", '"{}"', "null"]),
    ("type array", {"type": "array"}, ["[]", "[1]"], ["{}", '"[]"', "null"]),
    ("type union", {"type": ["string", "null"]}, ['"a"', "null"], ["1", "{}", "true"]),
    ("type union integer", {"type": ["integer", "string"]}, ["3", "3.0", '"a"'], ["3.5", "null", "[]"]),
    ("type union mixed", {"type": ["object", "integer", "null"]}, ["{}", "3", "null"], ["[]", '"x"', "3.5"]),
    ("enum", {"enum": ["a", 1, None, True, {"x": [1, 2]}]}, ['"a"', "1", "1.0", "null", "true", '{"x":[1,2.0]}'], ['"b"', "2", "false", '{"x":[2,1]}', '{"x":[1,2],"y":0}']),
    ("const", {"const": {"b": 1, "a": "x"}}, ['{"a":"x","b":1}', '{"b":1.0,"a":"x"}'], ['{"a":"x"}', '{"a":"x","b":2}', "1", "null"]),
    ("const number", {"const": 42}, ["42", "42.0"], ["41", '"42"']),
    ("const false", {"const": False}, ["false"], ["0", "null", "true"]),
    ("const list", {"const": [1, "a", None]}, ['[1,"a",null]'], ['[1,"a"]', '[1,"a",0]', '"x"']),
    ("true", True, ["1", "null", "{}"], []),
    ("false", False, [], ["1", "null", "{}"]),
    ("empty", {}, ["1", "null", "[]"], []),
    ("minimum", {"minimum": 5}, ["5", "6.5", '"x"'], ["4.9", "-1"]),
    ("maximum", {"maximum": 5}, ["5", "-1", "{}"], ["5.1"]),
    ("exclusive", {"exclusiveMinimum": 0, "exclusiveMaximum": 10}, ["1", "9.99", '"0"'], ["0", "10"]),
    ("multipleOf", {"multipleOf": 0.1}, ["0.3", "1", "-0.7", '"x"'], ["0.35"]),
    ("multipleOf whole", {"multipleOf": 3}, ["9", "-9", "0"], ["7", "-7"]),
    ("lengths", {"minLength": 2, "maxLength": 3}, ['"ab"', '"abc"', "1", '"\\ud83d\\ude00a"'], ['"a"', '"abcd"', '"\\ud83d\\ude00"']),
    ("pattern", {"pattern": "^[a-z]+$"}, ['"abc"', "1"], ['"ABC"', '"abc\\n"', '""']),
    ("pattern inside", {"pattern": r"\d{2}"}, ['"a12b"'], ['"a1b2"']),
    ("pattern quotes", {"pattern": "^'\\w+\\\\?'$"}, ["\"'ab'\""], ['"ab"']),
    ("email", {"format": "email"}, ['"a@b.c"', '"a@@b.c"', "1"], ['"a"', '"@b.c"', '"a@.c"', '"a@b"', '"a@"']),
    ("date", {"format": "date"}, ['"2024-02-31"'], ['"2024-13-01"', '"2024-1-01"', '"2024-01-32"', '"2024-01-01\\n"']),
    ("date-time", {"format": "date-time"}, ['"2024-01-01T10:00:00Z"', '"2024-01-01T10:00:00.5+01:00"'], ['"2024-01-01T10:00:00"', '"2024-01-01 10:00:00Z"', '"2024-01-01T25:00:00Z"']),
    ("time", {"format": "time"}, ['"10:00:00"', '"23:59:59.1Z"'], ['"24:00:00"', '"10:00"']),
    ("duration", {"format": "duration"}, ['"P1D"', '"PT1.5S"', '"P1Y2M3W4DT5H6M7S"'], ['"P"', '"1D"', '"PT1"']),
    ("uri", {"format": "uri"}, ['"https://x"', '"a:"'], ['"//x"', '"1a:b"']),
    ("uri-reference", {"format": "uri-reference"}, ['"/a"', '"a#b"'], ['""', '"a b"', '"a\\u00a0b"']),
    ("ipv4", {"format": "ipv4"}, ['"1.2.3.255"'], ['"1.2.3"', '"1.2.3.256"', '"01.2.3.4"']),
    ("ipv6", {"format": "ipv6"}, ['"::1"', '"1:2:3:4:5:6:7:8"'], ['"1:2"', '"1:2:3:4:5:6:7:8:9"', '"g::1"']),
    ("uuid", {"format": "uuid"}, ['"123e4567-e89b-12d3-a456-426614174000"'], ['"123e4567"']),
    ("hostname", {"format": "hostname"}, ['"a.b-c.d"'], ['"-a.b"', '"a..b"', '"a_b"']),
    ("unknown format", {"format": "no-such"}, ['"x"'], []),
    ("items sizes", {"minItems": 1, "maxItems": 2}, ["[1]", "[1,2]", "1"], ["[]", "[1,2,3]"]),
    ("uniqueItems", {"uniqueItems": True}, ["[]", '[1,"1",true,null]', '[{"a":1},{"a":2}]', '[[1],[1,1]]'], ["[1,1.0]", '[{"a":1,"b":[2]},{"b":[2.0],"a":1}]', '["a","b","a"]', "[null,null]"]),
    ("items", {"items": {"type": "integer"}}, ["[]", "[1,2]", '"x"'], ['[1,"a"]', "[null]"]),
    ("items false", {"prefixItems": [{"type": "integer"}, True], "items": False}, ["[]", "[1]", '[1,"a"]'], ['["a"]', "[1,2,3]"]),
    ("prefixItems", {"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": {"type": "boolean"}}, ['[1,"a",true]', "[1]"], ['["a"]', '[1,"a",3]']),
    ("contains", {"contains": {"minimum": 5}}, ["[1,5]", "{}"], ["[]", "[1]"]),
    ("contains bounds", {"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}, ["[1,2]", '[1,2,3,"a"]'], ["[1]", "[1,2,3,4]"]),
    ("minContains 0", {"contains": {"type": "integer"}, "minContains": 0}, ["[]", '["a"]'], []),
    ("nested arrays", {"items": {"items": {"items": {"type": "integer", "maximum": 3}}}}, ["[[[1,2],[3]],[]]"], ["[[[1,4]]]", '[[["a"]]]']),
    ("properties", USER, ['{"id":1,"name":"a"}', '{"id":2,"name":"b","age":3,"role":"user","active":true,"score":1.5}'], ['{"id":0,"name":""}', '{"id":1}', "[]", '{"id":1,"name":"a","role":"x","age":151,"active":1,"score":-1}']),
    ("required null", {"required": ["a"]}, ['{"a":null}', "[]", "1"], ["{}", '{"b":1}']),
    ("odd keys", {"properties": {"a'b": {"type": "integer"}, "c\\d": {"type": "string"}, "": {"type": "null"}}, "required": ["a'b"]}, ['{"a\'b":1}', '{"a\'b":1,"c\\\\d":"x","":null}'], ['{"a\'b":"x"}', '{"a\'b":1,"c\\\\d":1}', '{"a\'b":1,"":0}']),
    ("additional false", {"properties": {"a": {}}, "additionalProperties": False}, ['{"a":1}', "{}", "3"], ['{"a":1,"b":2}', '{"B":2,"c":1}']),
    ("additional false alone", {"additionalProperties": False}, ["{}"], ['{"a":1}']),
    ("additional all required", {"properties": {"a": {}, "b": {}}, "required": ["a", "b"], "additionalProperties": False}, ['{"a":1,"b":2}'], ['{"a":1,"b":2,"c":3}', '{"a":1}']),
    ("additional schema", {"properties": {"a": {}}, "additionalProperties": {"type": "integer"}}, ['{"a":"x","b":1}'], ['{"b":"x"}']),
    ("patternProperties", {"patternProperties": {"^i_": {"type": "integer"}, "^s_": {"type": "string"}}}, ['{"i_a":1,"s_b":"x","z":null}'], ['{"i_a":"x"}', '{"s_b":1,"i_c":"y"}']),
    ("pattern strict", {"properties": {"name": {"type": "string"}}, "patternProperties": {"^S_": {"type": "string"}, "^I_": {"type": "integer"}}, "additionalProperties": False}, ['{"name":"a","S_x":"y","I_x":1}'], ['{"unknown":1}', '{"I_x":"y"}']),
    ("propertyNames", {"propertyNames": {"maxLength": 5, "pattern": "^[a-z]+$"}}, ['{"abc":1}', "3"], ['{"toolong":1}', '{"A":1}']),
    ("propertyNames enum", {"propertyNames": {"enum": ["a", "b"]}}, ['{"a":1}'], ['{"c":1}']),
    ("prop counts", {"minProperties": 1, "maxProperties": 2}, ['{"a":1}', "[]"], ["{}", '{"a":1,"b":2,"c":3}']),
    ("dependentRequired", {"dependentRequired": {"card": ["name", "address"]}}, ["{}", '{"card":1,"name":2,"address":3}'], ['{"card":1}', '{"card":1,"name":2}']),
    ("dependentSchemas", {"dependentSchemas": {"card": {"required": ["address"], "properties": {"address": {"type": "string"}}}}}, ['{"x":1}', '{"card":1,"address":"a"}'], ['{"card":1}', '{"card":1,"address":2}']),
    ("allOf", {"allOf": [{"minimum": 1}, {"maximum": 5}]}, ["3", '"x"'], ["0", "6"]),
    ("anyOf", {"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"a"', "7", "null"], ["3"]),
    ("oneOf", {"oneOf": [{"multipleOf": 3}, {"multipleOf": 5}]}, ["9", "10"], ["15", "7", '"x"']),
    ("not", {"not": {"type": "string"}}, ["1"], ['"a"']),
    ("if then else", {"if": {"properties": {"type": {"const": "string"}}, "required": ["type"]}, "then": {"properties": {"value": {"type": "string"}}}, "else": {"properties": {"value": {"type": "number"}}}}, ['{"type":"string","value":"a"}', '{"type":"n","value":1}', "{}"], ['{"type":"string","value":1}', '{"value":"a"}']),
    ("if alone", {"if": {"type": "string"}}, ["1", '"a"'], []),
    ("unevaluated", {"properties": {"a": {}}, "unevaluatedProperties": False}, ['{"a":1}', "1"], ['{"a":1,"b":2}']),
    ("unevaluated allOf", {"allOf": [{"properties": {"a": {}}}], "properties": {"b": {}}, "unevaluatedProperties": False}, ['{"a":1,"b":2}'], ['{"c":1}']),
    ("unevaluated anyOf", {"anyOf": [{"properties": {"a": {"type": "integer"}}, "required": ["a"]}, {"properties": {"b": {}}, "required": ["b"]}], "unevaluatedProperties": False}, ['{"a":1}', '{"b":1}', '{"a":1,"b":1}'], ['{"a":"x","b":1}', '{"a":1,"c":1}']),
    ("unevaluated if", {"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"x": {}}}, "else": {"properties": {"y": {}}}, "unevaluatedProperties": False}, ['{"k":1,"x":1}', '{"y":1}'], ['{"k":1,"y":1}', '{"k":2,"x":1}']),
    ("unevaluated schema", {"properties": {"a": {}}, "patternProperties": {"^p": {}}, "unevaluatedProperties": {"type": "integer"}}, ['{"a":"x","pq":"y","z":1}'], ['{"z":"x"}']),
    ("unevaluated dependent", {"dependentSchemas": {"a": {"properties": {"b": {}}}}, "properties": {"a": {}}, "unevaluatedProperties": False}, ['{"a":1,"b":2}'], ['{"b":2}']),
    ("unevaluatedItems", {"prefixItems": [True], "unevaluatedItems": False}, ["[1]", "[]"], ["[1,2]"]),
    ("unevaluatedItems contains", {"contains": {"type": "string"}, "unevaluatedItems": {"type": "integer"}}, ['["a",1,"b"]'], ['["a",null]', "[1]"]),
    ("unevaluatedItems allOf", {"allOf": [{"prefixItems": [True, True]}], "unevaluatedItems": False}, ["[1,2]"], ["[1,2,3]"]),
    ("ref defs", {"$defs": {"pos": {"type": "integer", "minimum": 1}}, "properties": {"a": {"$ref": "#/$defs/pos"}, "b": {"$ref": "#/$defs/pos"}}}, ['{"a":1,"b":2}'], ['{"a":0}', '{"b":"x"}']),
    ("ref pointer", {"properties": {"a/b": {"type": "integer"}, "c": {"$ref": "#/properties/a~1b"}}}, ['{"c":1}'], ['{"c":"x"}']),
    ("ref siblings", {"$defs": {"s": {"type": "string"}}, "$ref": "#/$defs/s", "minLength": 2}, ['"ab"'], ['"a"', "1"]),
    ("ref anchor", {"$defs": {"i": {"$anchor": "item", "type": "string"}}, "items": {"$ref": "#item"}}, ['["foo"]'], ['["foo",42]']),
    ("dynamicRef override", {"$id": "https://example.com/strings", "$ref": "list", "$defs": {"s": {"$dynamicAnchor": "itemType", "type": "string"}, "list": {"$id": "list", "type": "array", "items": {"$dynamicRef": "#itemType"}, "$defs": {"any": {"$dynamicAnchor": "itemType"}}}}}, ['["hello","world"]'], ['["hello",42]']),
    ("draft7", {"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"n": {"type": "number"}}, "items": [{"type": "integer"}, {"$ref": "#/definitions/n", "minimum": 100}], "additionalItems": {"type": "string"}, "dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, ['[1,2.5,"x"]', '{"a":1,"b":2}', '{"c":1,"d":2}'], ['["a"]', "[1,2,3]", '{"a":1}', '{"c":1}']),
    ("nested objects", {"properties": {"users": {"type": "array", "items": USER}}}, ['{"users":[{"id":1,"name":"a"}]}'], ['{"users":[{"id":1,"name":"a"},{"id":0,"name":""}]}', '{"users":[{"name":"a"},{"id":2}]}']),
]
RECURSIVE = [
    ("self", {"type": "object", "properties": {"children": {"type": "array", "items": {"$ref": "#"}}, "v": {"type": "integer"}}}, ['{"v":1,"children":[{"v":2,"children":[]}]}'], ['{"children":[{"children":[{"v":"x"}]}]}', "[]"]),
    ("dynamic tree", {"$id": "https://example.com/tree", "$dynamicAnchor": "node", "type": "object", "properties": {"children": {"type": "array", "items": {"$dynamicRef": "#node"}}}}, ['{"children":[{"children":[]}]}'], ['{"children":[{"children":[42]}]}']),
]
BROKEN = ["{bad", "1 2", "", " ", '{"a":1}}', "1,2", '1, "k":2', "1],[2", "NaN", "[1,]", "01", "'a'", '{"a":1}, junk']
