"""Every keyword: golden verdicts, and SQL against the interpreter on all documents."""

import json
from collections import Counter

import pytest
from goldens import ADDRESS, BROKEN, CASES, RECURSIVE
from pyspark.sql import functions as F

from veridoc.functions.text import spelled
from veridoc.operators.validator import Validator, prepare
from veridoc.schema.interpret import parse
from veridoc.schema.normalize import SchemaError

DOCS = sorted({d for _, _, good, bad in CASES + RECURSIVE for d in good + bad})


@pytest.mark.parametrize("family,schema,good,bad", CASES + RECURSIVE, ids=[c[0] for c in CASES + RECURSIVE])
def test_interpreter_goldens(family, schema, good, bad):
    v = Validator(schema)
    assert [d for d in good if v.errors_of(json.loads(d))] == []
    assert [d for d in bad if not v.errors_of(json.loads(d))] == []


def _multiset(errors):
    return Counter((e["keyword"], e["instancePath"], e["schemaPath"], json.dumps(json.loads(e["params"]), sort_keys=True), e["message"]) for e in errors)


@pytest.mark.parametrize("part", range(6))
def test_sql_is_the_interpreter(spark, part):
    prepare(spark)
    cases = CASES[part::6]
    docs = spark.createDataFrame([(d,) for d in DOCS], "doc string").repartition(2)
    validators = [Validator(c[1]).compile() for c in cases]
    assert not any(v.recursive for v in validators)
    columns = [v.validate("doc").alias(f"r{i}") for i, v in enumerate(validators)] + [v.is_valid("doc").alias(f"v{i}") for i, v in enumerate(validators)]
    for row in docs.select("doc", *columns).collect():
        value = parse(row["doc"])
        for i, (v, case) in enumerate(zip(validators, cases)):
            expected = v.errors_of(value)
            got = row[f"r{i}"]
            assert row[f"v{i}"] is (not expected), (case[0], row["doc"], expected)
            assert got["valid"] is (not expected), (case[0], row["doc"], expected)
            want = _multiset([e | {"params": spelled(e["params"])} for e in expected])
            assert _multiset([e.asDict() for e in got["errors"]]) == want, (case[0], row["doc"])


def test_recursive_schemas_run_in_arrow(spark):
    docs = spark.createDataFrame([(d,) for d in DOCS + BROKEN], "doc string")
    for family, schema, good, bad in RECURSIVE:
        v = Validator(schema).compile()
        assert v.recursive
        found = {r["doc"]: r for r in docs.select("doc", v.validate("doc").alias("r"), v.is_valid("doc").alias("ok")).collect()}
        assert all(found[d]["ok"] and found[d]["r"]["valid"] for d in good), family
        assert not any(found[d]["ok"] for d in bad + BROKEN), family


def test_texts_that_are_no_document(spark):
    prepare(spark)
    v = Validator(True)
    docs = spark.createDataFrame([(d,) for d in [*BROKEN, None]], "doc string")
    for row in docs.select("doc", v.validate("doc").alias("r"), v.is_valid("doc").alias("ok")).collect():
        assert row["ok"] is False, row["doc"]
        assert [e["keyword"] for e in row["r"]["errors"]] == ["syntax"], row["doc"]
    assert spark.createDataFrame([('{"a":1,"a":"x"}',)], "doc string").select(Validator({"properties": {"a": {"type": "string"}}}).is_valid("doc")).first()[0]


def test_registry(spark):
    prepare(spark)
    person = {"properties": {"name": {"type": "string"}, "address": {"$ref": "https://example.com/address"}, "zip": {"$ref": "https://example.com/address#/properties/zip"}}}
    v = Validator(person, schemas=[ADDRESS])
    docs = spark.createDataFrame([(d,) for d in ['{"address":{"street":"a","city":"b","zip":"10001"}}', '{"address":{"street":"a"}}', '{"zip":"1"}']], "doc string")
    assert [r[0] for r in docs.select(v.is_valid("doc")).collect()] == [True, False, False]
    a = {"$id": "https://example.com/a", "properties": {"b": {"$ref": "b"}}}
    b = {"$id": "https://example.com/b", "properties": {"a": {"$ref": "a"}, "v": {"type": "integer"}}}
    circular = Validator(a, schemas=[b]).compile()
    assert circular.recursive
    assert circular.errors_of({"b": {"a": {"b": {"v": "x"}}}})
    with pytest.raises(SchemaError):
        Validator({"$ref": "nowhere"}).compile()
    late = Validator({"type": "integer"}).compile()
    with pytest.raises(RuntimeError):
        late.add_schema(ADDRESS)


def test_kinds_of_columns(spark):
    prepare(spark)
    v = Validator({"type": "object", "properties": {"a": {"type": "integer", "minimum": 2}}, "required": ["a"]})
    df = spark.createDataFrame([('{"a":3}', 3), ('{"a":1}', 1)], "j string, a long")
    row = df.select(
        v.is_valid("j"), v.is_valid(F.col("j").cast("binary"), "binary"), v.is_valid(F.parse_json("j"), "variant"), v.is_valid(F.struct("a"), "struct"), v.validate_and_parse("j")["value"].isNotNull()
    ).collect()
    assert [tuple(r) for r in row] == [(True,) * 5, (False,) * 5]


def test_options(spark):
    prepare(spark)
    schema = {"properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}
    df = spark.createDataFrame([('{"a":"x","b":"y"}',)], "j string")
    errors = lambda **o: df.select(Validator(schema, **o).errors("j")).first()[0]
    assert len(errors()) == 2
    assert len(errors(all_errors=False)) == 1
    assert [e["message"] for e in errors(abort_early=True)] == ["validation failed"]
    assert json.loads(errors(verbose=True)[0]["parentSchema"]) == {"type": "integer"}
    issues = df.select(Validator(schema).issues("j")).first()[0]
    assert sorted((i["message"], tuple(i["path"])) for i in issues) == [("must be integer", ("a",)), ("must be integer", ("b",))]
    even = Validator({"format": "even"}, formats={"even": "char_length({}) % 2 = 0"})
    odd = Validator({"format": "odd"}, formats={"odd": lambda s: len(s) % 2 == 1})
    words = spark.createDataFrame([('"ab"',), ('"abc"',), ("1",)], "j string")
    assert [tuple(r) for r in words.select(even.is_valid("j"), odd.is_valid("j")).collect()] == [(True, False), (False, True), (True, True)]


def test_warnings():
    v = Validator({"minLength": "x", "properties": {"a": {"type": "strin"}}})
    assert [w["path"] for w in v.warnings] == ["#/minLength", "#/properties/a/type"]
    assert not v.errors_of("a")
