"""Schemas as SQL that lists every violation: keyword, instance path, schema path, params (JSON), message."""

from __future__ import annotations

from typing import Any

from veridoc.functions.regex import to_java
from veridoc.functions.text import both, fresh, let, negate, quote, spelled
from veridoc.plans.boolean import ARRAYS, NUMERIC, OBJECTS, TEXTUAL, BooleanCompiler, as_array, as_double, as_map, as_text, canonical, has, is_type, member, undeclared
from veridoc.plans.evaluated import evaluated_items, evaluated_keys
from veridoc.schema.resolve import Place

ERROR = "struct<keyword:string,instancePath:string,schemaPath:string,params:string,message:string,parentSchema:string>"
NONE = f"CAST(array() AS array<{ERROR}>)"
_SIGNS = {"minimum": ">=", "maximum": "<=", "exclusiveMinimum": ">", "exclusiveMaximum": "<"}


def concat(parts: list[str]) -> str:
    parts = [p for p in parts if p != NONE]
    if not parts:
        return NONE
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


class ErrorCompiler:
    """Compiles the violations of a schema on a variant; verdicts come from the boolean compiler."""

    def __init__(self, boolean: BooleanCompiler, verbose: bool = False):
        self.boolean, self.resources, self.verbose = boolean, boolean.resources, verbose

    def error(self, place: Place, keyword: str, at: str, path: str, params: str, message: str) -> str:
        parent = quote(spelled(place.schema)) if self.verbose else "CAST(NULL AS STRING)"
        return f"named_struct('keyword', {quote(keyword)}, 'instancePath', {at}, 'schemaPath', {quote(path)}, 'params', {params}, 'message', {message}, 'parentSchema', {parent})"

    def unless(self, holds: str, *errors: str) -> str:
        if holds == "true":
            return NONE
        made = f"array({', '.join(errors)})"
        return made if holds == "false" else f"CASE WHEN {holds} THEN {NONE} ELSE {made} END"

    def compile(self, place: Place, v: str, at: str, sp: str) -> str:
        """SQL of the array of errors of the variant named v; at is SQL of its path, sp the schema's path."""
        schema = place.schema
        if schema is True:
            return NONE
        fixed = lambda keyword, params, message, suffix=None: self.error(place, keyword, at, f"{sp}/{suffix or keyword}", quote(spelled(params)), quote(message))
        if schema is False:
            return f"array({self.error(place, 'false schema', at, sp, quote('{}'), quote('boolean schema is false'))})"
        parts = []
        for key in ("$ref", "$dynamicRef"):
            if key in schema:
                parts.append(self.compile(self.resources.follow(place, key == "$dynamicRef"), v, at, sp))
        alone = lambda part: Place({k: schema[k] for k in part if k in schema}, place.base, place.scope, place.open_refs)
        verdict = lambda *keys: self.boolean.compile(alone(keys), v)
        if "enum" in schema:
            parts.append(self.unless(verdict("enum"), fixed("enum", {"allowedValues": schema["enum"]}, "must be equal to one of the allowed values")))
        if "const" in schema:
            parts.append(self.unless(verdict("const"), fixed("const", {"allowedValue": schema["const"]}, "must be equal to constant")))
        names = schema.get("type")
        names = [names] if isinstance(names, str) else names
        may = lambda *kinds: names is None or bool(set(names) & set(kinds))
        if may("number", "integer") and any(k in schema for k in NUMERIC):
            checks = let(as_double(v), lambda d: concat([self.unless(self.boolean.numeric(k, d, schema[k]), self.numeric(fixed, k, schema[k])) for k in NUMERIC if k in schema]))
            parts.append(f"CASE WHEN {is_type(v, 'number')} THEN {checks} ELSE {NONE} END")
        if may("string") and any(k in schema for k in TEXTUAL):
            checks = let(as_text(v), lambda s: concat([self.unless(self.boolean.textual(k, s, schema[k]), self.textual(fixed, k, schema[k])) for k in TEXTUAL if k in schema]))
            parts.append(f"CASE WHEN {is_type(v, 'string')} THEN {checks} ELSE {NONE} END")
        if may("array") and any(k in schema for k in ARRAYS):
            parts.append(let(as_array(v), lambda a: f"CASE WHEN {a} IS NULL THEN {NONE} ELSE {concat(self.arrays(place, v, a, at, sp, fixed))} END"))
        if may("object") and any(k in schema for k in OBJECTS):
            parts.append(let(as_map(v), lambda m: f"CASE WHEN {m} IS NULL THEN {NONE} ELSE {concat(self.objects(place, v, m, at, sp, fixed))} END"))
        parts += [self.compile(place.sub(s, self.resources), v, at, f"{sp}/allOf/{i}") for i, s in enumerate(schema.get("allOf", []))]
        if "anyOf" in schema:
            parts.append(self.unless(verdict("anyOf"), fixed("anyOf", {}, "must match a schema in anyOf")))
        if "oneOf" in schema:
            parts.append(self.unless(verdict("oneOf"), fixed("oneOf", {}, "must match exactly one schema in oneOf")))
        if "not" in schema:
            parts.append(self.unless(verdict("not"), fixed("not", {}, "must NOT be valid")))
        if "if" in schema and ("then" in schema or "else" in schema):
            branch = lambda k: self.compile(place.sub(schema.get(k, True), self.resources), v, at, f"{sp}/{k}")
            parts.append(f"CASE WHEN {self.boolean.sub(place, schema['if'], v)} THEN {branch('then')} ELSE {branch('else')} END")
        body = concat(parts)
        if names is None:
            return body
        wrong = f"array({fixed('type', {'type': ', '.join(names)}, 'must be ' + ', '.join(names))})"
        return f"CASE WHEN {verdict('type')} THEN {body} ELSE {wrong} END"

    def numeric(self, fixed, keyword: str, limit: float) -> str:
        if keyword == "multipleOf":
            return fixed(keyword, {"multipleOf": limit}, f"must be multiple of {spelled(limit)}")
        return fixed(keyword, {"comparison": _SIGNS[keyword], "limit": limit}, f"must be {_SIGNS[keyword]} {spelled(limit)}")

    def textual(self, fixed, keyword: str, value: Any) -> str:
        if keyword in ("pattern", "format"):
            return fixed(keyword, {keyword: value}, f'must match {keyword} "{value}"')
        return fixed(keyword, {"limit": value}, f"must NOT have {'fewer' if keyword == 'minLength' else 'more'} than {spelled(value)} characters")

    def sized(self, fixed, schema: dict, c: str, what: str) -> list[str]:
        name, out = what.capitalize(), []
        for key, sign, word in ((f"min{name}", ">=", "fewer"), (f"max{name}", "<=", "more")):
            if key in schema:
                out.append(self.unless(f"size({c}) {sign} {int(schema[key])}", fixed(key, {"limit": schema[key]}, f"must NOT have {word} than {spelled(schema[key])} {what}")))
        return out

    def arrays(self, place: Place, v: str, a: str, at: str, sp: str, fixed) -> list[str]:
        schema, out = place.schema, []
        out += self.sized(fixed, schema, a, "items")
        item = lambda i: f"concat({at}, '/', CAST({i} AS STRING))"
        if schema.get("uniqueItems"):
            out.append(self.unique(place, a, at, sp))
        prefix = schema.get("prefixItems", [])
        for i, s in enumerate(prefix):
            inner = let(f"get({a}, {i})", lambda x, i=i, s=s: self.compile(place.sub(s, self.resources), x, item(i), f"{sp}/prefixItems/{i}"))
            out.append(f"CASE WHEN size({a}) <= {i} THEN {NONE} ELSE {inner} END")
        if isinstance(schema.get("items"), (dict, bool)) and schema["items"] is not True:
            x, i = fresh(), fresh("i")
            inner = self.compile(place.sub(schema["items"], self.resources), x, item(i), f"{sp}/items")
            if prefix:
                inner = f"CASE WHEN {i} < {len(prefix)} THEN {NONE} ELSE {inner} END"
            out.append(f"flatten(transform({a}, ({x}, {i}) -> {inner}))")
        if "contains" in schema:
            x = fresh()
            count = f"size(filter({a}, {x} -> {self.boolean.sub(place, schema['contains'], x)}))"
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            checks = [(">=", least, "least")] + ([("<=", most, "most")] if most is not None else [])
            out.append(let(count, lambda n: concat([self.unless(f"{n} {sign} {int(k)}", fixed("contains", {"limit": k}, f"contains: need at {word} {spelled(k)} match(es)")) for sign, k, word in checks])))
        if "unevaluatedItems" in schema and schema["unevaluatedItems"] is not True:
            i = fresh("i")
            done = evaluated_items(self.boolean, place, v, a, beside=True)
            left = f"array_except(CASE WHEN size({a}) = 0 THEN CAST(array() AS ARRAY<INT>) ELSE sequence(0, size({a}) - 1) END, {done})"
            check = let(f"get({a}, {i})", lambda x: self.boolean.sub(place, schema["unevaluatedItems"], x))
            err = self.error(place, "unevaluatedItems", item(i), f"{sp}/unevaluatedItems", quote("{}"), quote("must NOT have unevaluated items"))
            out.append(f"flatten(transform({left}, {i} -> {self.unless(check, err)}))")
        return out

    def unique(self, place: Place, a: str, at: str, sp: str) -> str:
        """The first pair of equal items: the least later one, with the earliest that equals it."""
        x, i = fresh(), fresh("i")

        def found(c: str) -> str:
            return let(
                f"get(filter(transform({c}, ({x}, {i}) -> named_struct('i', CAST(array_position({c}, {x}) AS INT) - 1, 'j', {i})), {x} -> {x}.i < {x}.j), 0)",
                lambda p: f"CASE WHEN {p} IS NULL THEN {NONE} ELSE array({self.error(place, 'uniqueItems', at, f'{sp}/uniqueItems', pair(p), told(p))}) END",
            )

        def pair(p: str) -> str:
            return f"to_json({p})"

        def told(p: str) -> str:
            return f"concat('must NOT have duplicate items (items ## ', CAST({p}.j AS STRING), ' and ', CAST({p}.i AS STRING), ' are identical)')"

        y = fresh()
        return let(f"transform({a}, {y} -> {canonical(y)})", found)

    def objects(self, place: Place, v: str, m: str, at: str, sp: str, fixed) -> list[str]:
        schema, out = place.schema, []
        missing = lambda k, suffix: fixed("required", {"missingProperty": k}, f"must have required property '{k}'", suffix)
        out += [self.unless(has(m, k), missing(k, "required")) for k in dict.fromkeys(schema.get("required", []))]
        out += self.sized(fixed, schema, m, "properties")
        for k, needed in schema.get("dependentRequired", {}).items():
            lists = concat([self.unless(has(m, n), missing(n, "dependentRequired")) for n in needed])
            if lists != NONE:
                out.append(f"CASE WHEN {has(m, k)} THEN {lists} ELSE {NONE} END")
        under = lambda k: f"concat({at}, {quote('/' + k)})"
        for k, s in schema.get("properties", {}).items():
            sub = place.sub(s, self.resources)
            inner = let(member(v, m, k), lambda x, k=k, sub=sub: f"CASE WHEN {x} IS NULL THEN {NONE} ELSE {self.compile(sub, x, under(k), f'{sp}/properties/{k}')} END")
            out.append(inner)
        e = fresh("e")
        key, value = f"{e}.key", f"{e}.value"
        loops = []
        for p, s in schema.get("patternProperties", {}).items():
            bad = both([f"{key} RLIKE {quote(to_java(p))}", negate(let(value, lambda x, s=s: self.boolean.sub(place, s, x)))])
            err = self.error(place, "pattern", at, f"{sp}/patternProperties", quote(spelled({"pattern": p})), f"concat('patternProperties: value invalid for key ', {key})")
            loops.append(self.unless(negate(bad), err))
        extra = schema.get("additionalProperties", True)
        if extra is False:
            err = self.error(place, "additionalProperties", at, f"{sp}/additionalProperties", f"to_json(named_struct('additionalProperty', {key}))", quote("must NOT have additional properties"))
            loops.append(self.unless(negate(undeclared(key, schema)), err))
        elif extra is not True:
            inner = let(value, lambda x: self.compile(place.sub(extra, self.resources), x, f"concat({at}, '/', {key})", f"{sp}/additionalProperties"))
            loops.append(f"CASE WHEN {undeclared(key, schema)} THEN {inner} ELSE {NONE} END")
        if "propertyNames" in schema:
            loops.append(let(f"CAST({key} AS VARIANT)", lambda x: self.compile(place.sub(schema["propertyNames"], self.resources), x, at, f"{sp}/propertyNames")))
        if concat(loops) != NONE:
            out.append(f"flatten(transform(map_entries({m}), {e} -> {concat(loops)}))")
        for k, s in schema.get("dependentSchemas", {}).items():
            out.append(f"CASE WHEN {has(m, k)} THEN {self.compile(place.sub(s, self.resources), v, at, f'{sp}/dependentSchemas/{k}')} ELSE {NONE} END")
        if "unevaluatedProperties" in schema and schema["unevaluatedProperties"] is not True:
            k = fresh("k")
            left = f"array_except(map_keys({m}), {evaluated_keys(self.boolean, place, v, m, beside=True)})"
            check = let(f"element_at({m}, {k})", lambda x: self.boolean.sub(place, schema["unevaluatedProperties"], x))
            err = self.error(place, "unevaluatedProperties", at, f"{sp}/unevaluatedProperties", f"to_json(named_struct('unevaluatedProperty', {k}))", quote("must NOT have unevaluated properties"))
            out.append(f"flatten(transform({left}, {k} -> {self.unless(check, err)}))")
        return out


