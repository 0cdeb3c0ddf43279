"""What surrounds the compilers: rewriting, NDJSON, streams, types, SQL export, command line, draft-7, typed columns."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc import SchemaSet, Validator, compile, count_valid, read_ndjson, read_ndjson_stream, rewrite, valid_flags, validate
from veridoc.__main__ import main
from veridoc.ddl import to_ddl, to_struct_type
from veridoc.functions.regex import to_java
from veridoc.operators.validator import prepare
from veridoc.plans.evaluated import collect
from veridoc.plans.typed import is_flat
from veridoc.schema.normalize import SchemaError, normalize
from veridoc.sources.ndjson import split_buffers
from veridoc.standalone import bundle, load_bundle, script
from veridoc.streaming.validate import write_split


def _docs(spark, *docs):
    prepare(spark)
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string").coalesce(1).orderBy("i")


def _rewritten(spark, schema, docs, **options):
    return [r[0] and json.loads(r[0]) for r in _docs(spark, *docs).select(F.to_json(rewrite(schema, "doc", **options))).collect()]


def test_coercion(spark):
    schema = {"properties": {"n": {"type": "number"}, "i": {"type": "integer"}, "s": {"type": "string"}, "b": {"type": "boolean"}, "u": {"type": ["integer", "null"]}, "o": {"type": "object", "properties": {"i": {"type": "integer"}}}}}
    docs = ['{"n":" 42.5 ","i":"0x1f","s":3.0,"b":"1","u":"5","o":{"i":"7"}}', '{"n":"x","i":"1.5","s":true,"b":"yes","o":3}', '{"n":true,"i":false,"s":null,"b":0}', '{"i":"1e3","n":""}', "[1]", "{bad"]
    assert _rewritten(spark, schema, docs, coerce_types=True) == [
        {"n": 42.5, "i": 31, "s": "3", "b": True, "u": "5", "o": {"i": 7}}, {"n": "x", "i": "1.5", "s": "true", "b": "yes", "o": 3}, {"n": 1, "i": 0, "s": None, "b": 0}, {"i": 1000, "n": ""}, [1], None,
    ]


def test_defaults_and_removal(spark):
    schema = {"properties": {"a": {"default": {"x": [1]}}, "o": {"type": "object", "properties": {"b": {"default": "it's"}}, "additionalProperties": False}}, "additionalProperties": False, "patternProperties": {"^p_": {}}}
    docs = ['{"z":1,"o":{"c":2},"p_q":3}', '{"a":null,"o":1}', "3"]
    assert _rewritten(spark, schema, docs, remove_additional=True) == [{"a": {"x": [1]}, "o": {"b": "it's"}, "p_q": 3}, {"a": None, "o": 1}, 3]
    assert _rewritten(spark, schema, docs[:1], defaults=False) == [json.loads(docs[0])]


def test_ndjson_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"id":1}\n{"id":2}\n\n{"bad":true}\n \n{"id":"\xc3\xa9"}')
    v = Validator({"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]})
    lines = read_ndjson(spark, str(tmp_path))
    assert count_valid(v, lines).first().asDict() == {"n_valid": 2, "n_total": 5}
    assert sorted((r["value"], r["valid"]) for r in valid_flags(v, lines).collect())[:2] == [(" ", False), ('{"bad":true}', False)]
    buffers = spark.createDataFrame([(bytearray(b'{"id":1}\n\n{"id":2}'),), (bytearray(b""),), (None,)], "b binary")
    assert sorted(tuple(r) for r in split_buffers(buffers, "b").collect()) == [(0, '{"id":1}'), (2, '{"id":2}')]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id":1}\nx\n\n{"id":"y"}\n')
    (tmp_path / "in/b.jsonl").write_text('{"id":2}\n')
    v = Validator({"required": ["id"], "properties": {"id": {"type": "integer"}}})
    stream = read_ndjson_stream(spark, str(tmp_path / "in"), max_files=1)
    write_split(stream, v, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ['{"id":1}', '{"id":2}']
    bad = {r["value"]: [e["keyword"] for e in r["errors"]] for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad == {"x": ["syntax"], '{"id":"y"}': ["type"]}


def test_types():
    schema = {"type": "object", "required": ["id"], "$defs": {"p": {"type": "object", "properties": {"x": {"type": "number"}}}}, "properties": {"id": {"type": "integer", "description": "the id"}, "tags": {"type": "array", "items": {"type": "string"}}, "p": {"$ref": "#/$defs/p"}, "any": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "m": {"type": "object", "additionalProperties": {"type": "boolean"}}, "self": {"$ref": "#"}, "e": {"enum": ["a", "b"]}, "n": {"type": ["string", "null"]}}}
    kind = to_struct_type(schema)
    assert kind["id"].dataType == T.LongType() and not kind["id"].nullable and kind["id"].metadata == {"comment": "the id"}
    assert kind["tags"].dataType == T.ArrayType(T.StringType()) and kind["p"].dataType == T.StructType([T.StructField("x", T.DoubleType())])
    assert kind["any"].dataType == T.VariantType() == kind["self"].dataType.fields[5].dataType if isinstance(kind["self"].dataType, T.StructType) else True
    assert kind["m"].dataType == T.MapType(T.StringType(), T.BooleanType()) and kind["e"].dataType == T.StringType() == kind["n"].dataType
    assert to_ddl({"properties": {"a": {"type": "string", "title": "it's"}}}) == "`a` STRING COMMENT 'it\\'s'"


def test_sql_export(spark, tmp_path, capsys):
    schema = {"type": "object", "properties": {"a": {"type": "string", "pattern": "^'x\\\\?'$", "minLength": 1}}, "required": ["a"]}
    docs = _docs(spark, '{"a":"\'x\'"}', '{"a":"y"}', "{}", "zz")
    names = load_bundle(spark, bundle({"vt_one": compile(schema), "vt_two": compile(schema), "vt_all": compile(True)}))
    assert names == ["vt_one", "vt_all", "vt_two"]
    assert [tuple(r) for r in docs.selectExpr("vt_one(doc)", "vt_two(doc)", "vt_all(doc)", "size(vt_two_errors(doc))").collect()] == [(True, True, True, 0), (False, False, True, 1), (False, False, True, 1), (False, False, False, 1)]
    path = tmp_path / "s.json"
    path.write_text(json.dumps(schema | {"minLength": "x"}))
    assert main(["compile", str(path), "--name", "vt_cli", "-o", str(tmp_path / "out.sql")]) == 0
    assert "minLength must be" in capsys.readouterr().err
    text = (tmp_path / "out.sql").read_text()
    assert text == script([("vt_cli", Validator(schema | {"minLength": "x"}))])
    for statement in text.rstrip(";\n").split(";\nCREATE"):
        spark.sql(statement if statement.startswith("CREATE") else "CREATE" + statement)
    assert [r[0] for r in docs.selectExpr("vt_cli(doc)").collect()] == [True, False, False, False]
    assert (tmp_path / "out.ddl").read_text() == "`a` STRING NOT NULL\n"
    path.write_text('{"$ref":"#/nowhere"}')
    assert main(["compile", str(path)]) == 1


def test_schema_set(spark):
    docs = _docs(spark, "1", '"a"', "null")
    s = SchemaSet().add_schema({"type": "integer"}, "int").add_schema({"$id": "https://example.com/text", "type": "string"})
    assert s.get_schema("none") is None
    assert [r["result"]["valid"] for r in s.validate("https://example.com/text", docs, "doc").collect()] == [False, True, False]
    assert [r["result"]["valid"] for r in s.validate({"anyOf": [{"$ref": "int"}, {"$ref": "https://example.com/text"}]}, docs, "doc").collect()] == [True, True, False]
    routed = docs.withColumn("k", F.element_at(F.array(F.lit("int"), F.lit("int"), F.lit("other")), F.col("i") + 1))
    assert [r[0] for r in routed.select(s.route("k", "doc")).collect()] == [True, False, False]
    assert [r["result"]["valid"] for r in validate({"type": "null"}, docs, "doc").collect()] == [False, False, True]
    with pytest.raises(ValueError):
        s.add_schema({"type": "null"})


def test_typed_columns_are_the_documents_verdict(spark, tmp_path):
    prepare(spark)
    schema = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "string", "enum": ["x", "y"]}, "c": {"type": "number", "multipleOf": 0.5}, "d": {"type": "boolean", "const": True}, "e": {"type": ["string", "null"], "maxLength": 2}}, "required": ["a"], "dependentRequired": {"b": ["c"]}, "minProperties": 2}
    rows = [(a, b, c, d, e) for a in (None, 1, 2) for b in (None, "x", "z") for c in (None, 0.5, 0.3, float("nan")) for d in (None, True, False) for e in (None, "abc", "é")]
    df = spark.createDataFrame(rows, "a int, b string, c double, d boolean, e string")
    v = Validator(schema)
    for nulls, kind in (("absent", "struct"), ("null", "struct_nulls")):
        got = df.select(F.coalesce(v.typed(df, nulls), F.lit(False)).alias("t"), v.is_valid(F.struct(*df.columns), kind).alias("d")).collect()
        wrong = [r for r, g in zip(rows, got) if g["t"] != g["d"] and not (kind == "struct" and r[2] != r[2])]
        assert wrong == [], (nulls, wrong[:3])
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = stored.where(Validator({"type": "object", "properties": {"a": {"type": "integer", "minimum": 2}}, "required": ["a"]}).typed(stored)).select("a")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a,2)" in plan and "ReadSchema: struct<a:int>" in plan
    assert not is_flat({"type": "object", "properties": {"a": {"items": {}}}}) and not is_flat(True)


def test_summaries_and_rewrites():
    found = collect({"properties": {"a": {}}, "allOf": [{"properties": {"b": {}}, "prefixItems": [{}, {}]}], "anyOf": [{"properties": {"c": {}}}]})
    assert (found.props, found.items, found.all_props, found.dynamic) == ({"a", "b", "c"}, 2, False, True)
    assert collect({"additionalProperties": {}, "items": {"type": "string"}}).all_props
    old = {"$schema": "http://json-schema.org/draft-07/schema#", "items": [{}], "additionalItems": False, "dependencies": {"a": ["b"], "c": {}}, "definitions": {"d": {}}}
    new = normalize(old)
    assert new["prefixItems"] == [{}] and new["items"] is False and new["dependentRequired"] == {"a": ["b"]} and new["dependentSchemas"] == {"c": {}} and "$defs" in new and "items" in old
    assert normalize({"items": [{}]}) == {"items": [{}]}
    assert to_java(r"^\d+[\w[]$") == r"^[0-9]+[A-Za-z0-9_\[]\z"
    with pytest.raises(SchemaError):
        to_java("(")
