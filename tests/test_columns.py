"""Typed columns judged by their type, held against the same documents judged as variants; options; long texts; many references."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veridoc import Validator, prepare
from veridoc.functions import formats
from veridoc.harness import answers

DDL = "struct<a: bigint, b: double, c: string, d: boolean, e: array<int>, f: struct<g: string, h: decimal(6,2), i: array<struct<j: int, k: string>>>, x_l: float, m: date>"


def _row(draw):
    maybe = lambda x: None if draw.random() < 0.25 else x
    item = lambda: maybe((maybe(draw.randint(0, 5)), maybe(draw.choice(["p", "qq", "rrr"]))))
    inner = (maybe(draw.choice(["", "g", "gé😀", "2024-01-02"])), maybe(draw.choice([1.0, 2.5, 3.25])), maybe([item() for _ in range(draw.randint(0, 3))]))
    inner = (inner[0], None if inner[1] is None else __import__("decimal").Decimal(str(inner[1])), inner[2])
    import datetime

    return (maybe(draw.randint(-3, 9)), maybe(draw.choice([0.0, 1.5, 2.0, float("nan"), float("inf")])), maybe(draw.choice(["one", "two", "", "a@b.cd"])), maybe(draw.random() < 0.5), maybe([maybe(draw.randint(0, 4)) for _ in range(draw.randint(0, 4))]), maybe(inner), maybe(draw.choice([0.5, 2.0, 0.1])), maybe(datetime.date(2024, 1, 2)))


def _schema(draw, depth=0):
    out = {}
    for _ in range(draw.randint(1, 3)):
        match draw.randint(0, 17 if depth < 2 else 9):
            case 0:
                names = ["object", "array", "string", "number", "integer", "boolean", "null"]
                out["type"] = draw.choice(names) if draw.random() < 0.5 else draw.sample(names, 3)
            case 1:
                out["minimum"], out["maximum"] = draw.choice([0, 1, 2]), draw.choice([2, 3, 8])
            case 2:
                out["multipleOf"] = draw.choice([1, 0.5, 2])
            case 3:
                out["minLength"], out["maxLength"] = draw.randint(0, 2), draw.randint(1, 4)
            case 4:
                out["pattern"] = draw.choice(["^[a-z]*$", "o", "^$"])
            case 5:
                out["enum"] = draw.sample([1, 2, 2.5, "one", "two", "NaN", None, True, False, "p"], 5)
            case 6:
                out["const"] = draw.choice([2, "one", None, True])
            case 7:
                out["required"] = draw.sample("a b c d e f x_l z g j".split(), 2)
            case 8:
                out["minItems"], out["maxItems"], out["uniqueItems"] = 1, 3, draw.random() < 0.5
            case 9:
                out["minProperties"], out["maxProperties"] = draw.randint(0, 4), draw.randint(3, 8)
            case 10:
                out["properties"] = {k: _schema(draw, depth + 1) for k in draw.sample("a b c d e f g h i j k x_l".split(), 3)}
            case 11:
                out["items"] = _schema(draw, depth + 1)
            case 12:
                out["prefixItems"] = [_schema(draw, depth + 1)]
            case 13:
                out["contains"], out["minContains"], out["maxContains"] = _schema(draw, depth + 1), draw.randint(0, 2), 2
            case 14:
                out[draw.choice(["allOf", "anyOf", "oneOf"])] = [_schema(draw, depth + 1) for _ in range(2)]
            case 15:
                out["if"], out["then"], out["else"] = (_schema(draw, depth + 1) for _ in range(3))
            case 16:
                out["patternProperties"], out["additionalProperties"] = {"^x_": _schema(draw, depth + 1)}, draw.choice([True, _schema(draw, depth + 1), False])
            case 17:
                out[draw.choice(["not", "unevaluatedProperties", "propertyNames"])] = _schema(draw, depth + 1)
                out["dependentRequired"] = {"a": ["b"]}
    return out


def test_columns_agree_with_documents(spark):
    prepare(spark)
    draw = random.Random(7)
    df = spark.createDataFrame([(i, _row(draw)) for i in range(150)], f"id int, doc {DDL}").repartition(2)
    schemas = [s for s in (_schema(draw) for _ in range(70)) if len(Validator(s).valid_sql("doc")) < 15_000]
    assert len(schemas) > 40
    schemas += [{"properties": {"x_l": {"maximum": 0.1}}}, {"properties": {"x_l": {"enum": [0.1, 2, "NaN"]}, "b": {"minimum": 1, "type": ["number", "string"]}}}]
    schemas += [{"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"f": {"$ref": "#/$defs/n"}, "a": {"minimum": 0}}}}}, {"properties": {"f": {"properties": {"i": {"items": {"properties": {"j": {"type": "integer"}}, "required": ["j"]}}}}}}]
    seen = 0
    for at in range(0, len(schemas), 4):
        part = [Validator(s, use_defaults=False) for s in schemas[at : at + 4]]
        columns = []
        for n, v in enumerate(part):
            for kind in ("struct", "struct_nulls"):
                columns += [v.verdict(df, "doc", kind).alias(f"c{n}_{kind}"), v.is_valid("doc", kind).alias(f"v{n}_{kind}")]
        rows = df.select("id", *columns).collect()
        for n, v in enumerate(part):
            for kind in ("struct", "struct_nulls"):
                bad = [r["id"] for r in rows if r[f"c{n}_{kind}"] is not r[f"v{n}_{kind}"]]
                assert not bad, (kind, json.dumps(v.schema), df.where(F.col("id") == bad[0]).first())
                seen += 1
    assert seen == 2 * len(schemas)


def test_typed_plan_has_no_documents(spark):
    df = spark.createDataFrame([(1, ((1, 2.0), [3]))], "id int, doc struct<p: struct<q: int, r: double>, s: array<int>>")
    v = Validator({"type": "object", "properties": {"p": {"properties": {"q": {"type": "integer", "maximum": 3}, "r": {"minimum": 1}}, "required": ["q"]}, "s": {"items": {"minimum": 1}}}, "required": ["p"]})
    plan = v.with_valid(df, "doc", "struct")._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan and "to_json" not in plan and "transform" not in plan
    assert v.with_result(df, "doc", "struct").first()["result"] == (True, [])
    assert v.count_valid(df, "doc", "struct").first()["n_valid"] == 1


def test_unique_numbers_of_typed_arrays(spark):
    prepare(spark)
    rows = [[1.0, 2.0], [0.0, -0.0], [None, None], [float("nan"), float("nan")], [1.5, None], [], [float("inf"), float("-inf")]]
    df = spark.createDataFrame([(i, (r,)) for i, r in enumerate(rows)], "id int, doc struct<a: array<double>>")
    v = Validator({"properties": {"a": {"uniqueItems": True}}})
    got = [(r["c"], r["v"]) for r in df.select("id", v.verdict(df, "doc", "struct").alias("c"), v.is_valid("doc", "struct").alias("v")).orderBy("id").collect()]
    assert [c for c, _ in got] == [True, False, False, False, True, True, True] and all(c == x for c, x in got), got


def test_options_take_effect_before_judging(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"default": "x", "type": "string"}}, "required": ["a", "b"], "additionalProperties": False}
    docs = spark.createDataFrame([(1, '{"a":"5"}'), (2, '{"a":"z"}'), (3, '{"a":1,"b":"y","c":2}'), (4, "{")], "id int, doc string")
    prepare(spark)

    def verdicts(kind="json", **options):
        v = Validator(schema, **options)
        column = {"json": F.col("doc"), "binary": F.col("doc").cast("binary"), "variant": F.try_parse_json("doc")}[kind]
        df = docs.withColumn("d", column)
        rows = df.select("id", v.is_valid("d", kind).alias("valid"), v.validate("d", kind).alias("r"), v.validate_and_parse("d", kind).alias("p")).collect()
        assert all(r["valid"] == r["r"]["valid"] == r["p"]["valid"] for r in rows)
        return [r["valid"] for r in sorted(rows)]

    for kind in ("json", "binary", "variant"):
        assert verdicts(kind) == [False, False, False, False]
        assert verdicts(kind, coerce_types=True) == [True, False, False, False]
        assert verdicts(kind, coerce_types=True, use_defaults=False) == [False, False, False, False]
        assert verdicts(kind, remove_additional=True) == [False, False, True, False]
    parsed = docs.where("id = 1").select(F.to_json(Validator(schema, coerce_types=True).validate_and_parse("doc")["value"]).alias("x")).first()["x"]
    assert json.loads(parsed) == {"a": 5, "b": "x"}
    typed = spark.createDataFrame([(("5",),), ((None,),)], "doc struct<a: string>")
    v = Validator(schema, coerce_types=True)
    assert [r["valid"] for r in v.with_valid(typed, "doc", "struct").collect()] == [True, False]
    tree = {"properties": {"n": {"type": "integer"}, "next": {"$ref": "#"}}, "required": ["n"]}
    assert [r[0] for r in spark.createDataFrame([('{"n":"1"}',), ('{"n":"x"}',)], "doc string").select(Validator(tree, coerce_types=True).is_valid("doc")).collect()] == [True, False]


def test_long_texts_need_no_deep_stack(spark):
    prepare(spark)
    long = "ab\\\"c é " * 150_000
    rows = [(1, [("n", long), ("n", long + "x")]), (2, [("n", long), ("n", long)])]
    df = spark.createDataFrame(rows, "id int, doc array<struct<k: string, t: string>>").select("id", F.to_json(F.struct("doc")).alias("doc"))
    v = Validator({"properties": {"doc": {"uniqueItems": True}}})
    assert [r["valid"] for r in df.select("id", v.is_valid("doc").alias("valid")).orderBy("id").collect()] == [True, False]
    names = spark.createDataFrame([("a." * 200_000 + "a",), ("a." * 200_000 + "-",)], "s string").select(F.to_json(F.struct("s")).alias("doc"))
    assert [r[0] for r in names.select(Validator({"properties": {"s": {"format": "hostname"}}}).is_valid("doc")).collect()] == [True, False]
    assert formats.matches("hostname", "a.b-c.d") and not formats.matches("hostname", "a..b")


def test_references_that_fan_out(spark):
    prepare(spark)
    levels = {f"d{i}": {"allOf": [{"$ref": f"#/$defs/d{i + 1}"}, {"properties": {"a": {"$ref": f"#/$defs/d{i + 1}"}}}]} for i in range(20)}
    schema = {"$ref": "#/$defs/d0", "$defs": {**levels, "d20": {"type": ["object", "integer"]}}}
    start = time.time()
    v = Validator(schema).compile()
    assert time.time() - start < 1 and v.recursive
    docs = ['{"a":{"a":{"a":3}}}', '{"a":{"a":"x"}}', "[]", "4"]
    assert [r[0] for r in spark.createDataFrame([(d,) for d in docs], "doc string").select(v.is_valid("doc")).collect()] == [True, False, False, True]
    assert v.errors_of({"a": "x"}) and not v.errors_of({"a": {}})


@pytest.mark.parametrize("case", [({"type": "integer"}, [1, "x", 1.0, None]), ({"items": {"minimum": 2}}, [[2, 3], [1], "s", {}]), ({"$ref": "#/$defs/a", "$defs": {"a": {"required": ["k"]}}}, [{}, {"k": None}, 3])])
def test_harness_runs_the_sql(spark, case):
    """The conformance protocol over the SQL compiler gives what the interpreter gives."""
    schema, instances = case
    lines = [json.dumps({"cmd": "run", "seq": 1, "case": {"schema": schema, "tests": [{"instance": x} for x in instances]}})]
    assert list(answers(lines, spark)) == list(answers(lines))


def test_deep_documents(spark):
    """A conversation of thousands of turns is judged like a short one; what leads nowhere ends."""
    tree = {"type": "object", "properties": {"role": {"enum": ["a"]}, "reply": {"$ref": "#"}}, "required": ["role"]}
    deep = lambda n, last: '{"role":"a","reply":' * n + last + "}" * n
    docs = [deep(900, '{"role":"a"}'), deep(900, "{}"), deep(3000, '{"role":"a"}')]
    v = Validator(tree)
    assert [r[0] for r in spark.createDataFrame([(d,) for d in docs], "doc string").select(v.is_valid("doc")).collect()] == [True, False, True]
    assert Validator({"$ref": "#"}).errors_of(1)


@pytest.mark.parametrize("level, leaf", [
    ({"allOf": [{"$ref": "N"}, {"properties": {"a": {"$ref": "N"}}}]}, {"type": ["object", "integer"]}),
    ({"allOf": [{"$ref": "N"}, {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "N"}}}]}, {"type": "object", "required": ["a"]}),
    ({"required": ["k"], "properties": {"a": {"$ref": "N"}, "k": {"minimum": 5}}, "allOf": [{"$ref": "N"}]}, {"maxLength": 2, "minimum": 3, "not": {"type": "boolean"}}),
    ({"allOf": [{"$ref": "N"}, {"properties": {"a": {"$ref": "N"}, "k": False}}], "dependentRequired": {"a": ["b"]}}, {"anyOf": [{"type": "object"}, {"enum": [None, 1]}]}),
])
def test_merged_references_are_judged_in_sql(spark, level, leaf):
    """Over 400 references that fan out are merged into little SQL, which says what the interpreter says."""
    prepare(spark)
    at = lambda i: json.loads(json.dumps(level).replace('"N"', f'"#/$defs/d{i + 1}"'))
    v = Validator({"$ref": "#/$defs/d0", "$defs": {**{f"d{i}": at(i) for i in range(16)}, "d16": leaf}})
    inner = [1, 4, 2.5, None, True, "x", "long", [], {}, {"k": 4}, {"k": "x", "a": 4}, {"a": {}}, {"a": 1, "b": 1}, {"a": None, "b": {"a": 1}}, {"k": {"k": 5}, "a": {"k": 3}}]
    deep = json.loads('{"a":' * 20 + "{}" + "}" * 20)
    docs = [*inner, *({"a": x} for x in inner), *({"a": x, "k": x, "b": 1} for x in inner), *({"a": {"a": x, "k": 7, "b": 0}, "k": 8, "b": 1} for x in inner), deep]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{",)], "doc string")
    assert v.plan(df, "doc") == "variant"
    want = [not v.errors_of(d) for d in docs] + [False]
    assert [r["valid"] for r in v.with_valid(df, "doc").collect()] == [r[0] for r in df.select(v.is_valid("doc")).collect()] == want
    assert v.filter_valid(df, "doc").count() == sum(want)
