"""The catalogue: one query per operator over the supplied tables, each with the SQL that states the same."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.__main__ import main
from veridoc.ddl import to_ddl, to_struct_type
from veridoc.harness import answers
from veridoc.operators.registry import SchemaSet
from veridoc.operators.transform import rewrite
from veridoc.operators.validator import Validator, compile, prepare
from veridoc.schema.normalize import Schema
from veridoc.sources.ndjson import count_valid, split_buffers, valid_flags
from veridoc.standalone import bundle, load_bundle, to_function

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Verdict:
    """A schema on documents made of a table's columns: the ids and whether each document fits."""

    table: str
    ids: str
    doc: str  # Spark SQL of the document: a struct, or a JSON text
    schema: Any
    oracle: str  # DuckDB SQL of the verdict
    kind: str = "struct"
    options: dict = field(default_factory=dict)
    source: str = ""  # Spark SQL and DuckDB SQL of a derived table in place of the table
    oracle_source: str = ""

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.source:
            df = df.selectExpr(*self.source) if isinstance(self.source, tuple) else _grouped(df, self.source)
        validator = compile(self.schema, **self.options)
        ids = self.ids.split(", ")
        docs = df.select(*ids, F.expr(self.doc).alias("doc"))
        return validator.with_valid(docs, "doc", self.kind).select(*ids, "valid")

    def sql(self) -> str:
        return f"select {self.ids}, ({self.oracle}) as valid from {self.oracle_source or self.table}"


def _grouped(df: DataFrame, spec: str) -> DataFrame:
    """spec: key | aggregates, as SQL."""
    key, _, aggregates = spec.partition(" | ")
    return df.groupBy(key).agg(*(F.expr(a) for a in aggregates.split(" ; ")))


_LINES = "l_orderkey | sort_array(collect_list(named_struct('n', l_linenumber, 'q', l_quantity, 'f', l_returnflag))) AS lines"
_LINES_SQL = "(select l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_returnflag) as qs, list(l_linenumber order by l_linenumber) as ns, list(l_returnflag order by l_linenumber, l_quantity, l_returnflag) as fs from lineitem group by l_orderkey)"
_ORDER = "named_struct('key', o_orderkey, 'price', CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, 'prio', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'status', o_orderstatus)"
_HAS_PRICE, _HAS_PRIO = "o_orderkey % 3 <> 0", "o_orderkey % 2 = 0"
_CUSTOMER = "named_struct('id', c_custkey, 'name', c_name, 'x_seg', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'n_nation', c_nationkey, 'extra', CASE WHEN c_custkey % 5 = 0 THEN 1 END)"
_NESTED = "named_struct('customer', named_struct('name', c_name, 'nation', named_struct('key', c_nationkey, 'bal', c_acctbal)), 'segment', c_mktsegment)"
_EVENT = "named_struct('id', event_id, 'type', event_type, 'value', value, 'user', CASE WHEN event_id % 4 <> 0 THEN user_id END)"
_TEXT_DOC = "concat('{\"s\":\"', {}, '\"}')"
POSITIVE = {"type": "number", "exclusiveMinimum": 0}
NATION_DOC = {"$id": "https://example.com/nation", "type": "object", "properties": {"key": {"type": "integer", "maximum": 12}, "bal": {"type": "number", "minimum": 0}}, "required": ["key"]}
EVENT_SCHEMA = {"type": "object", "properties": {"id": {"type": "integer", "minimum": 1}, "type": {"enum": ["click", "view"]}, "value": {"type": "number", "maximum": 50}, "user": {"type": "integer"}}, "required": ["id", "user"]}
LINE_SCHEMA = {
    "type": "object",
    "properties": {"l_quantity": {"type": "number", "minimum": 1, "maximum": 45}, "l_discount": {"type": "number", "minimum": 0, "maximum": 0.08}, "l_returnflag": {"enum": ["A", "N"]}, "l_linenumber": {"type": "integer", "minimum": 1}},
    "required": ["l_quantity", "l_returnflag"],
}


def _of(name: str, schema: Schema) -> dict:
    return {"type": "object", "properties": {name: schema}}


def _format(name: str, doc: str, oracle: str, table: str = "customer", ids: str = "c_custkey") -> Verdict:
    return Verdict(table, ids, f"named_struct('s', {doc})", _of("s", {"type": "string", "format": name}), oracle)


VERDICTS: dict[str, Verdict] = {
    "type_check": Verdict("events", "event_id", "props", {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}, "coalesce(json_type(props, '$.k') in ('UBIGINT', 'BIGINT', 'HUGEINT'), false)", "json"),
    "type_union": Verdict("orders", "o_orderkey", "named_struct('v', CASE WHEN o_orderkey % 3 = 0 THEN parse_json('null') WHEN o_orderkey % 3 = 1 THEN CAST(o_totalprice AS VARIANT) ELSE CAST(o_orderstatus AS VARIANT) END)", {"properties": {"v": {"type": ["string", "null"]}}, "required": ["v"]}, "o_orderkey % 3 <> 1"),
    "enum_role": Verdict("conversations", "conv_id, turn", "named_struct('role', role)", {"properties": {"role": {"enum": ["user", "system", None, 3]}}}, "role in ('user', 'system')"),
    "const_kind": Verdict("events", "event_id", "named_struct('t', event_type, 'n', 1.0D)", {"properties": {"t": {"const": "click"}, "n": {"const": 1}}}, "event_type = 'click'"),
    "boolean_schema": Verdict("nation", "n_nationkey", "named_struct('a', n_name, 'b', CASE WHEN n_nationkey % 2 = 0 THEN 1 END)", {"properties": {"a": True, "b": False}}, "n_nationkey % 2 <> 0"),
    "empty_schema": Verdict("region", "r_regionkey", "named_struct('a', r_name)", {}, "true"),
    "bounds_min_max": Verdict("lineitem", "l_orderkey, l_linenumber", "named_struct('q', l_quantity, 'd', l_discount)", {"properties": {"q": {"minimum": 10, "maximum": 40}, "d": {"minimum": 0.02, "maximum": 0.08}}}, "l_quantity between 10 and 40 and l_discount between 0.02 and 0.08::double"),
    "bounds_exclusive": Verdict("lineitem", "l_orderkey, l_linenumber", "named_struct('q', l_quantity, 't', l_tax)", {"properties": {"q": {"exclusiveMinimum": 10, "exclusiveMaximum": 40}, "t": {"exclusiveMaximum": 0.05}}}, "l_quantity > 10 and l_quantity < 40 and l_tax < 0.05::double"),
    "multiple_of": Verdict("lineitem", "l_orderkey, l_linenumber", "named_struct('q', l_quantity, 'p', l_extendedprice)", {"properties": {"q": {"multipleOf": 5}, "p": {"multipleOf": 0.5}}}, "l_quantity % 5 = 0 and (abs(l_extendedprice) % 0.5::double <= 1e-8::double or abs(abs(l_extendedprice) % 0.5::double - 0.5::double) <= 1e-8::double)"),
    "str_length": Verdict("part", "p_partkey", "named_struct('n', p_name, 't', p_type)", {"properties": {"n": {"minLength": 8, "maxLength": 14}, "t": {"minLength": 1}}}, "length(p_name) between 8 and 14 and length(p_type) >= 1"),
    "text_length": Verdict("documents", "doc_id", "named_struct('text', text, 'lang', lang)", {"properties": {"text": {"maxLength": 2000}, "lang": {"enum": ["en", "de", "fr"]}}, "required": ["text"]}, "length(text) <= 2000 and lang in ('en', 'de', 'fr')"),
    "pattern": Verdict("customer", "c_custkey", "named_struct('n', c_name)", {"properties": {"n": {"pattern": r"^Customer#\d*[05]$"}}}, "regexp_full_match(c_name, 'Customer#[0-9]*[05]')"),
    "format_uri": Verdict("pages", "page_id", "named_struct('u', CASE WHEN page_id % 3 = 0 THEN substr(url, 6) ELSE url END)", _of("u", {"format": "uri"}), "regexp_matches(case when page_id % 3 = 0 then substr(url, 6) else url end, '^[a-zA-Z][a-zA-Z0-9+.-]*:')"),
    "format_uri_ref": Verdict("pages", "page_id", "named_struct('u', CASE WHEN page_id % 3 = 0 THEN replace(url, '/', ' ') ELSE substr(url, 7) END)", _of("u", {"format": "uri-reference"}), "page_id % 3 <> 0"),
    "format_email": _format("email", "concat(replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '#' ELSE '@' END), CASE WHEN c_custkey % 2 = 0 THEN '.com' ELSE '' END)", "c_custkey % 3 <> 0 and c_custkey % 2 = 0"),
    "format_date": _format("date", "concat('2024-', lpad(c_custkey % 15, 2, '0'), '-', lpad(c_custkey % 33, 2, '0'))", "c_custkey % 15 between 1 and 12 and c_custkey % 33 between 1 and 31"),
    "format_time": _format("time", "concat(lpad(c_custkey % 26, 2, '0'), ':', lpad(c_custkey % 61, 2, '0'), ':30', CASE WHEN c_custkey % 2 = 0 THEN 'Z' ELSE '' END)", "c_custkey % 26 <= 23 and c_custkey % 61 <= 59"),
    "format_datetime": Verdict("events", "event_id", "named_struct('s', concat(date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Z' END))", _of("s", {"format": "date-time"}), "event_id % 3 <> 0"),
    "format_duration": _format("duration", "concat('P', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_custkey, 'D') END, CASE WHEN c_custkey % 3 = 0 THEN 'T5X' ELSE '' END)", "c_custkey % 4 <> 0 and c_custkey % 3 <> 0"),
    "format_ipv4": _format("ipv4", "concat('10.', c_custkey % 300, '.0.', CASE WHEN c_custkey % 7 = 0 THEN '01' ELSE '1' END)", "c_custkey % 300 <= 255 and c_custkey % 7 <> 0"),
    "format_ipv6": _format("ipv6", "concat('fe80:', repeat(':1', CAST(c_custkey % 9 AS INT)))", "c_custkey % 9 between 1 and 6"),
    "format_uuid": _format("uuid", "concat('123e4567-e89b-12d3-a456-', lpad(hex(c_custkey), CASE WHEN c_custkey % 3 = 0 THEN 11 ELSE 12 END, '0'))", "c_custkey % 3 <> 0"),
    "format_hostname": _format("hostname", "concat(CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END, 'host', c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '_' ELSE '' END, '.example.com')", "c_custkey % 3 <> 0 and c_custkey % 5 <> 0"),
    "custom_format": Verdict("part", "p_partkey", "named_struct('b', p_brand)", _of("b", {"format": "brand"}), "regexp_full_match(p_brand, 'Brand#[1-3][0-9]')", options={"formats": {"brand": "{} RLIKE '\\\\A(?:Brand#[1-3][0-9])\\\\z'"}}),
    "items_range": Verdict("embeddings", "vec_id", "named_struct('e', embedding)", _of("e", {"type": "array", "items": {"type": "number", "minimum": -0.35, "maximum": 0.35}}), "list_bool_and(list_transform(embedding, lambda x: x::double between -0.35::double and 0.35::double))", "struct_nulls"),
    "contains_count": Verdict("embeddings", "vec_id", "named_struct('e', embedding)", _of("e", {"contains": {"minimum": 0.2}, "minContains": 2, "maxContains": 4}), "len(list_filter(embedding, lambda x: x::double >= 0.2::double)) between 2 and 4", "struct_nulls"),
    "contains_any": Verdict("embeddings", "vec_id", "named_struct('e', embedding)", _of("e", {"contains": {"exclusiveMinimum": 0.3}}), "len(list_filter(embedding, lambda x: x::double > 0.3::double)) >= 1", "struct_nulls"),
    "min_max_items": Verdict("lineitem", "l_orderkey", "named_struct('lines', lines)", _of("lines", {"minItems": 2, "maxItems": 5}), "len(qs) between 2 and 5", source=_LINES, oracle_source=_LINES_SQL),
    "unique_items": Verdict("lineitem", "l_orderkey", "named_struct('q', transform(lines, x -> x.q))", _of("q", {"uniqueItems": True}), "len(list_distinct(qs)) = len(qs)", source=_LINES, oracle_source=_LINES_SQL),
    "prefix_items": Verdict("lineitem", "l_orderkey", "named_struct('q', transform(lines, x -> x.q))", _of("q", {"prefixItems": [{"minimum": 10}, {"maximum": 40}], "items": {"minimum": 5}}), "qs[1] >= 10 and (len(qs) < 2 or qs[2] <= 40) and coalesce(list_bool_and(list_transform(qs[3:], lambda x: x >= 5)), true)", source=_LINES, oracle_source=_LINES_SQL),
    "items_objects": Verdict("lineitem", "l_orderkey", "named_struct('lines', lines)", _of("lines", {"items": {"type": "object", "properties": {"q": {"minimum": 3}, "f": {"enum": ["N", "R"]}}, "required": ["q"]}}), "list_bool_and(list_transform(qs, lambda x: x >= 3)) and not list_contains(fs, 'A')", source=_LINES, oracle_source=_LINES_SQL),
    "items_false": Verdict("lineitem", "l_orderkey", "named_struct('n', transform(lines, x -> x.n))", _of("n", {"prefixItems": [True, True, True], "items": False}), "len(ns) <= 3", source=_LINES, oracle_source=_LINES_SQL),
    "props_required": Verdict("orders", "o_orderkey", _ORDER, {"required": ["key", "price", "prio"]}, f"{_HAS_PRICE} and {_HAS_PRIO}"),
    "props_additional_false": Verdict("orders", "o_orderkey", _ORDER, {"properties": {"key": {}, "status": {}, "price": {}}, "additionalProperties": False}, f"not ({_HAS_PRIO})"),
    "props_additional_schema": Verdict("orders", "o_orderkey", _ORDER, {"properties": {"key": {}, "status": {}}, "additionalProperties": {"type": "number"}}, f"not ({_HAS_PRIO})"),
    "pattern_props": Verdict("customer", "c_custkey", _CUSTOMER, {"patternProperties": {"^x_": {"enum": ["BUILDING", "MACHINERY"]}, "^n_": {"maximum": 20}}}, "(c_custkey % 2 <> 0 or c_mktsegment in ('BUILDING', 'MACHINERY')) and c_nationkey <= 20"),
    "pattern_strict": Verdict("customer", "c_custkey", _CUSTOMER, {"properties": {"id": {}, "name": {}}, "patternProperties": {"^[xn]_": True}, "additionalProperties": False}, "c_custkey % 5 <> 0"),
    "property_names": Verdict("customer", "c_custkey", _CUSTOMER, {"propertyNames": {"maxLength": 8, "pattern": "^(?!extra)"}}, "c_custkey % 5 <> 0"),
    "prop_counts": Verdict("customer", "c_custkey", _CUSTOMER, {"minProperties": 4, "maxProperties": 4}, "3 + (c_custkey % 2 = 0)::int + (c_custkey % 5 = 0)::int = 4"),
    "dependent_required": Verdict("orders", "o_orderkey", _ORDER, {"dependentRequired": {"prio": ["price"]}}, f"not ({_HAS_PRIO}) or {_HAS_PRICE}"),
    "dependent_schemas": Verdict("orders", "o_orderkey", _ORDER, {"dependentSchemas": {"price": {"properties": {"status": {"enum": ["O", "F"]}, "price": {"minimum": 100000}}}}}, f"not ({_HAS_PRICE}) or (o_orderstatus in ('O', 'F') and o_totalprice >= 100000)"),
    "all_of": Verdict("orders", "o_orderkey", _ORDER, {"allOf": [{"properties": {"price": {"minimum": 50000}}}, {"required": ["prio"]}]}, f"(not ({_HAS_PRICE}) or o_totalprice >= 50000) and {_HAS_PRIO}"),
    "any_of": Verdict("orders", "o_orderkey", _ORDER, {"anyOf": [{"required": ["prio"]}, {"properties": {"status": {"const": "F"}}}]}, f"{_HAS_PRIO} or o_orderstatus = 'F'"),
    "one_of": Verdict("orders", "o_orderkey", _ORDER, {"oneOf": [{"required": ["prio"]}, {"required": ["price"]}, {"properties": {"status": {"const": "F"}}}]}, f"({_HAS_PRIO})::int + ({_HAS_PRICE})::int + (o_orderstatus = 'F')::int = 1"),
    "not_schema": Verdict("orders", "o_orderkey", _ORDER, {"not": {"required": ["price", "prio"]}}, f"not ({_HAS_PRICE} and {_HAS_PRIO})"),
    "if_then_else": Verdict("lineitem", "l_orderkey, l_linenumber", "named_struct('flag', l_returnflag, 'status', l_linestatus, 'q', l_quantity)", {"if": {"properties": {"flag": {"const": "N"}}}, "then": {"properties": {"status": {"const": "O"}}}, "else": {"properties": {"q": {"maximum": 30}}}}, "case when l_returnflag = 'N' then l_linestatus = 'O' else l_quantity <= 30 end"),
    "unevaluated_props": Verdict("orders", "o_orderkey", _ORDER, {"properties": {"key": {}, "status": {}}, "anyOf": [{"required": ["price"], "properties": {"price": {}}}, {"required": ["prio"], "properties": {"prio": {"enum": ["1-URGENT", "2-HIGH", "5-LOW"]}}}], "unevaluatedProperties": False}, f"({_HAS_PRICE} and not ({_HAS_PRIO})) or ({_HAS_PRIO} and o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW'))"),
    "unevaluated_schema": Verdict("orders", "o_orderkey", _ORDER, {"properties": {"key": {}, "status": {}}, "unevaluatedProperties": {"type": "number", "minimum": 100000}}, f"not ({_HAS_PRIO}) and (not ({_HAS_PRICE}) or o_totalprice >= 100000)"),
    "unevaluated_items": Verdict("lineitem", "l_orderkey", "named_struct('q', transform(lines, x -> x.q))", _of("q", {"allOf": [{"prefixItems": [True, True]}], "contains": {"minimum": 25}, "minContains": 0, "unevaluatedItems": False}), "coalesce(list_bool_and(list_transform(qs[3:], lambda x: x >= 25)), true)", source=_LINES, oracle_source=_LINES_SQL),
    "ref_defs": Verdict("customer", "c_custkey", _NESTED, {"$defs": {"customer": {"properties": {"name": {"minLength": 1}, "nation": {"$ref": "#/$defs/nation"}}, "required": ["nation"]}, "nation": {"properties": {"key": {"maximum": 12}, "bal": {"minimum": 0}}}}, "properties": {"customer": {"$ref": "#/$defs/customer"}}}, "c_nationkey <= 12 and c_acctbal >= 0"),
    "ref_pointer": Verdict("customer", "c_custkey", "named_struct('a', c_acctbal, 'b', c_acctbal - 1000)", {"properties": {"a": {"minimum": 0}, "b": {"$ref": "#/properties/a"}}}, "c_acctbal >= 0 and c_acctbal - 1000 >= 0"),
    "ref_cross": Verdict("customer", "c_custkey", _NESTED, {"properties": {"customer": {"properties": {"nation": {"$ref": "https://example.com/nation"}}}}}, "c_nationkey <= 12 and c_acctbal >= 0", options={"schemas": [NATION_DOC]}),
    "ref_anchor": Verdict("customer", "c_custkey", _NESTED, {"$defs": {"n": {"$anchor": "nation", "properties": {"bal": {"minimum": 500}}}}, "properties": {"customer": {"properties": {"nation": {"$ref": "#nation"}}}}}, "c_acctbal >= 500"),
    "dynamic_ref": Verdict("lineitem", "l_orderkey", "transform(lines, x -> x.q)", {"$id": "https://example.com/small", "$ref": "list", "$defs": {"s": {"$dynamicAnchor": "item", "maximum": 45}, "list": {"$id": "list", "type": "array", "items": {"$dynamicRef": "#item"}, "$defs": {"any": {"$dynamicAnchor": "item"}}}}}, "list_bool_and(list_transform(qs, lambda x: x <= 45))", "variant", source=_LINES, oracle_source=_LINES_SQL),
    "draft7_equiv": Verdict("customer", "c_custkey", _NESTED, {"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"nation": {"properties": {"key": {"maximum": 12}, "bal": {"minimum": 0}}}}, "properties": {"customer": {"properties": {"nation": {"$ref": "#/definitions/nation"}}, "dependencies": {"name": ["nation"]}}}}, "c_nationkey <= 12 and c_acctbal >= 0"),
    "typed_documents": Verdict("lineitem", "l_orderkey, l_linenumber", "named_struct('l_quantity', l_quantity, 'l_discount', l_discount, 'l_returnflag', l_returnflag, 'l_linenumber', l_linenumber)", LINE_SCHEMA, "l_quantity between 1 and 45 and l_discount between 0 and 0.08::double and l_returnflag in ('A', 'N') and l_linenumber >= 1"),
    "json_text": Verdict("events", "event_id", f"to_json({_EVENT})", EVENT_SCHEMA, "event_id >= 1 and event_type in ('click', 'view') and value <= 50 and event_id % 4 <> 0", "json"),
    "binary_text": Verdict("events", "event_id", f"CAST(to_json({_EVENT}) AS BINARY)", EVENT_SCHEMA, "event_id >= 1 and event_type in ('click', 'view') and value <= 50 and event_id % 4 <> 0", "binary"),
}
_TWICE = "array(named_struct('t', coalesce(text, ''), 'n', 1), named_struct('t', coalesce(text, ''), 'n', CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END))"
#: Definitions that each refer twice to the next.
_LEVELS = {f"d{i}": {"allOf": [{"$ref": f"#/$defs/d{i + 1}"}, {"properties": {"a": {"$ref": f"#/$defs/d{i + 1}"}}}]} for i in range(20)}
VERDICTS |= {
    "unique_items_texts": Verdict("documents", "doc_id", f"to_json(named_struct('a', {_TWICE}))", _of("a", {"uniqueItems": True}), "doc_id % 2 <> 0", "json"),
    "typed_nested": Verdict(
        "lineitem", "l_orderkey", "named_struct('lines', lines, 'first', lines[0])",
        {"properties": {"lines": {"minItems": 2, "items": {"type": "object", "properties": {"q": {"type": "number", "minimum": 2}, "f": {"type": "string", "maxLength": 1}}, "required": ["n", "q"], "additionalProperties": {"type": "integer"}}}, "first": {"properties": {"q": {"maximum": 40}}, "not": {"properties": {"f": {"const": "A"}}}}}},
        "len(qs) >= 2 and list_bool_and(list_transform(qs, lambda x: x >= 2)) and qs[1] <= 40 and fs[1] <> 'A'", source=_LINES, oracle_source=_LINES_SQL,
    ),
    "ref_fan_out": Verdict("customer", "c_custkey", "to_json(named_struct('a', named_struct('a', CASE WHEN c_custkey % 3 = 0 THEN c_name END)))", {"$ref": "#/$defs/d0", "$defs": {**_LEVELS, "d20": {"type": ["object", "integer"]}}}, "c_custkey % 3 <> 0", "json"),
}
VERDICTS["dynamic_ref"] = Verdict(**{**VERDICTS["dynamic_ref"].__dict__, "doc": "CAST(transform(lines, x -> x.q) AS VARIANT)"})


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.expr(f"to_json({_EVENT})").alias("doc"))


_VIOLATIONS = """
select event_id, 'minimum' as keyword, '/id' as instance_path, '#/properties/id/minimum' as schema_path, 'must be >= 1' as message from events where event_id < 1
union all select event_id, 'enum', '/type', '#/properties/type/enum', 'must be equal to one of the allowed values' from events where event_type not in ('click', 'view')
union all select event_id, 'maximum', '/value', '#/properties/value/maximum', 'must be <= 50' from events where value > 50
union all select event_id, 'required', '', '#/required', 'must have required property ''user''' from events where event_id % 4 = 0"""


def errors_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _events(spark, sf_dir).select("event_id", F.explode(compile(EVENT_SCHEMA).errors("doc")).alias("e"))
    return errors.select("event_id", "e.keyword", F.col("e.instancePath").alias("instance_path"), F.col("e.schemaPath").alias("schema_path"), "e.message")


def errors_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile(EVENT_SCHEMA).error_counts(_events(spark, sf_dir), "doc")


def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(spark, sf_dir).select("event_id", compile(EVENT_SCHEMA, all_errors=False).validate("doc").alias("r"))
    return found.select("event_id", "r.valid", F.size("r.errors").alias("n_errors"))


def issues_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.explode(compile(EVENT_SCHEMA).issues("doc")).alias("i"))
    return rows.select("event_id", "i.message", F.array_join("i.path", ".").alias("path"))


def standard_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with the steps of their paths, keys as texts and places as integers."""
    lines = _grouped(_read(spark, sf_dir, "lineitem"), _LINES).selectExpr("l_orderkey", "to_json(named_struct('lines', lines)) AS doc")
    schema = _of("lines", {"items": {"properties": {"q": {"minimum": 3}}}})
    rows = lines.select("l_orderkey", compile(schema).standard("doc").alias("r"))
    rows = rows.select("l_orderkey", F.to_json("r.value").alias("value"), F.explode_outer("r.issues").alias("i"))
    return rows.select("l_orderkey", F.col("value").isNotNull().alias("fits"), "i.message", F.to_json("i.path").alias("path"))


def abort_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", compile(EVENT_SCHEMA, abort_early=True).errors("doc").alias("e"))
    return rows.select("event_id", F.coalesce(F.get("e", F.lit(0))["message"], F.lit("")).alias("message"))


def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "events").selectExpr("event_id", "to_json(named_struct('n', CAST(event_id AS STRING), 'v', concat(' ', CAST(event_id AS STRING), '.5'), 'b', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '0' END, 's', event_id)) AS doc")
    schema = {"properties": {"n": {"type": "integer"}, "v": {"type": "number"}, "b": {"type": "boolean"}, "s": {"type": "string"}}}
    return docs.select("event_id", F.to_json(rewrite(schema, "doc", coerce_types=True)).alias("doc"))


def apply_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "events").selectExpr("event_id", "to_json(named_struct('id', event_id, 'type', CASE WHEN event_id % 2 = 0 THEN event_type END, 'in', named_struct('a', 1))) AS doc")
    schema = {"properties": {"type": {"default": "none"}, "in": {"type": "object", "properties": {"b": {"default": [1, 2]}}}}}
    return docs.select("event_id", F.to_json(rewrite(schema, "doc")).alias("doc"))


def remove_additional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _events(spark, sf_dir)
    schema = {"properties": {"id": {}, "type": {}}, "additionalProperties": False}
    return docs.select("event_id", F.to_json(rewrite(schema, "doc", remove_additional=True)).alias("doc"))


def _buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of 100 lines, every 20th of them broken."""
    lines = _read(spark, sf_dir, "events").selectExpr("event_id div 100 AS buffer", "event_id", "concat(props, CASE WHEN event_id % 20 = 0 THEN ' 1' ELSE '' END) AS line")
    return lines.groupBy("buffer").agg(F.expr("array_join(transform(sort_array(collect_list(struct(event_id, line))), x -> x.line), '\n')").alias("text"))


_PROPS = {"type": "object", "properties": {"k": {"type": "integer", "maximum": 80}}, "required": ["k"]}


def ndjson_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = valid_flags(compile(_PROPS), split_buffers(_buffers(spark, sf_dir), "text"))
    return flags.groupBy("line", "valid").agg(F.count("*").alias("n"))


def ndjson_count_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_valid(compile(_PROPS), split_buffers(_buffers(spark, sf_dir), "text"))


def batch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_valid(compile(_PROPS), _read(spark, sf_dir, "events").select(F.col("props").cast("binary").cast("string").alias("value")))


def typed_column_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem")
    return df.where(compile(LINE_SCHEMA).typed(df)).select("l_orderkey", "l_linenumber", "l_quantity")


def ref_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested replies, judged by a schema that leads back to itself."""
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.expr("sort_array(collect_list(struct(turn, role)), false)").alias("turns"))
    doc = "aggregate(turns, '', (doc, x) -> concat('{\"role\":', to_json(CAST(x.role AS VARIANT)), CASE WHEN doc = '' THEN '' ELSE concat(',\"reply\":', doc) END, '}'))"
    schema = {"type": "object", "properties": {"role": {"enum": ["user", "assistant"]}, "reply": {"$ref": "#"}}, "required": ["role"]}
    return turns.select("conv_id", F.expr(doc).alias("doc")).select("conv_id", compile(schema).is_valid("doc").alias("valid"))


def schema_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = SchemaSet().add_schema({"properties": {"value": {"maximum": 10}}}, "click").add_schema({"required": ["user"]}, "view")
    rows = _read(spark, sf_dir, "events").selectExpr("event_id", "event_type", f"to_json({_EVENT}) AS doc")
    return rows.select("event_id", schemas.route("event_type", "doc").alias("valid"))


def standalone_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _events(spark, sf_dir)
    for statement in to_function(compile(EVENT_SCHEMA), "veridoc_event"):
        spark.sql(statement)
    return docs.select("event_id", F.expr("veridoc_event(doc)").alias("valid"), F.expr("size(veridoc_event_errors(doc))").alias("n_errors"))


def standalone_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _events(spark, sf_dir)
    load_bundle(spark, bundle({"veridoc_a": compile({"required": ["user"]}), "veridoc_b": compile({"required": ["user"], "$id": "b"}), "veridoc_c": compile({"properties": {"value": {"maximum": 50}}})}))
    return docs.select("event_id", F.expr("veridoc_a(doc)").alias("a"), F.expr("veridoc_b(doc)").alias("b"), F.expr("veridoc_c(doc)").alias("c"))


def ddl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read with the type that their schema gives."""
    kind = to_struct_type(EVENT_SCHEMA)
    return _events(spark, sf_dir).select("event_id", F.from_json("doc", kind).alias("d")).select("event_id", "d.id", "d.value", "d.user")


def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = to_ddl({"type": "object", "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "any": {}}, "required": ["id"]}).split("\n")
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, ddl string")


def validate_and_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", compile(EVENT_SCHEMA).validate_and_parse("doc").alias("r"))
    return rows.select("event_id", "r.valid", F.try_variant_get("r.value", "$.id", "long").alias("id"))


def filter_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile(EVENT_SCHEMA).filter_valid(_events(spark, sf_dir), "doc").select("event_id")


def compile_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Validator({"minLength": "x", "properties": {"a": {"type": "strin"}}}).warnings
    return spark.createDataFrame([(w["path"], w["message"]) for w in found], "path string, message string")


def _kinds(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("event_id", f"to_json(named_struct('k', {key}, 'z', 1)) AS doc")


_SMALL = {"type": "object", "properties": {"k": {"type": "integer", "maximum": 80}}, "required": ["k"], "additionalProperties": False}


def validate_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are removed and texts coerced before the documents are judged."""
    docs = _kinds(spark, sf_dir, "CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 100 AS STRING) END")
    result = compile(_SMALL, coerce_types=True, remove_additional=True).validate("doc")
    return docs.select("event_id", result["valid"].alias("valid"), F.size(result["errors"]).alias("n_errors"))


def validate_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing key that has a default isn't missed."""
    docs = _kinds(spark, sf_dir, "CASE WHEN event_id % 2 = 0 THEN event_id % 100 END")
    schema = {"properties": {"k": {"type": "integer", "maximum": 80, "default": 5}}, "required": ["k"]}
    parsed = compile(schema).validate_and_parse("doc")
    return docs.select("event_id", parsed["valid"].alias("valid"), F.try_variant_get(parsed["value"], "$.k", "long").alias("k"))


def parent_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _events(spark, sf_dir).select("event_id", F.explode(compile(EVENT_SCHEMA, verbose=True).errors("doc")).alias("e"))
    return errors.select("event_id", "e.keyword", F.col("e.parentSchema").alias("parent"))


def added_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema that is added to a validator after it is made, before it is used."""
    validator = Validator({"properties": {"customer": {"properties": {"nation": {"$ref": "https://example.com/nation"}}}}})
    validator.add_schema(NATION_DOC)
    docs = _read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_NESTED} AS doc")
    return validator.with_valid(docs, "doc", "struct").select("c_custkey", "valid")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that the command line writes for a schema file, run over documents."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's own: the statements are text
        schema, out = Path(folder, "event.json"), Path(folder, "event.sql")
        schema.write_text(json.dumps(EVENT_SCHEMA))
        if main(["compile", str(schema), "-o", str(out), "--name", "veridoc_cli", "--abort-early", "--no-types"]):
            raise RuntimeError("the command line failed")
        for statement in filter(str.strip, out.read_text().split(";\n")):
            spark.sql(statement)
    return _events(spark, sf_dir).select("event_id", F.expr("veridoc_cli(doc)").alias("valid"))


def judged_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way to judge the same rows, with the name of the plan chosen."""
    df = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "named_struct('l_quantity', l_quantity, 'l_returnflag', l_returnflag) AS doc")
    tree = {"properties": {"l_quantity": {"maximum": 30}, "next": {"$ref": "#"}}}
    ways = [(Validator(tree), "struct"), (Validator({**tree, "properties": {"l_quantity": {"maximum": 30}}}), "variant"), (Validator(tree), "json")]
    columns = {"struct": F.col("doc"), "variant": F.expr("parse_json(to_json(doc))"), "json": F.to_json("doc")}
    out = [v.with_valid(df.withColumn("d", columns[kind]), "d", kind).select("l_orderkey", "l_linenumber", F.lit(v.plan(df.withColumn("d", columns[kind]), "d", kind)).alias("plan"), "valid") for v, kind in ways]
    return out[0].union(out[1]).union(out[2])


def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conformance protocol over the compiled SQL, its instances the properties of the first events."""
    rows = _read(spark, sf_dir, "events").where("event_id <= 50").select("event_id", "props").orderBy("event_id").collect()  # 50 at most
    case = {"schema": _PROPS, "tests": [{"instance": json.loads(r["props"])} for r in rows]}
    (answer,) = answers([json.dumps({"cmd": "run", "seq": 1, "case": case})], spark)
    found = [(r["event_id"], x["valid"]) for r, x in zip(rows, json.loads(answer)["results"])]
    return spark.createDataFrame(found, "event_id long, valid boolean")


_GOOD_EVENT = "event_id >= 1 and event_type in ('click', 'view') and value <= 50 and event_id % 4 <> 0"
_N_ERRORS = "(event_id < 1)::int + (event_type not in ('click', 'view'))::int + (value > 50)::int + (event_id % 4 = 0)::int"
_GOOD_PROPS = "coalesce(json_type(props, '$.k') in ('UBIGINT', 'BIGINT') and (props->>'$.k')::bigint <= 80, false)"
OTHERS: dict[str, tuple[Query, str]] = {
    "errors_exploded": (errors_exploded, _VIOLATIONS),
    "errors_by_keyword": (errors_by_keyword, f"select keyword, instance_path, count(*) as n_errors from ({_VIOLATIONS}) group by all"),
    "first_error": (first_error, f"select event_id, {_GOOD_EVENT} as valid, case when {_GOOD_EVENT} then 0 else 1 end as n_errors from events"),
    "issues_path": (issues_path, f"select event_id, message, ltrim(instance_path, '/') as path from ({_VIOLATIONS})"),
    "standard_result": (
        standard_result,
        f"""select l_orderkey, false as fits, 'must be >= 3' as message, '["lines",' || i || ',"q"]' as path from (select l_orderkey, qs, unnest(range(len(qs))) as i from {_LINES_SQL}) where qs[i + 1] < 3
        union all select l_orderkey, true, null, null from {_LINES_SQL} where list_bool_and(list_transform(qs, lambda x: x >= 3))""",
    ),
    "abort_early": (abort_early, f"select event_id, case when {_GOOD_EVENT} then '' else 'validation failed' end as message from events"),
    "coerce_types": (coerce_types, "select event_id, '{\"b\":' || (event_id % 2 = 0)::varchar || ',\"n\":' || event_id || ',\"s\":\"' || event_id || '\",\"v\":' || event_id || '.5}' as doc from events"),
    "apply_defaults": (apply_defaults, "select event_id, '{\"id\":' || event_id || ',\"in\":{\"a\":1,\"b\":[1,2]},\"type\":\"' || case when event_id % 2 = 0 then event_type else 'none' end || '\"}' as doc from events"),
    "remove_additional": (remove_additional, "select event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' as doc from events"),
    "ndjson_flags": (ndjson_flags, f"select (row_number() over (partition by event_id // 100 order by event_id) - 1)::int as line, {_GOOD_PROPS} and event_id % 20 <> 0 as valid, event_id from events"),
    "ndjson_count_valid": (ndjson_count_valid, f"select count(*) filter ({_GOOD_PROPS} and event_id % 20 <> 0) as n_valid, count(*) as n_total from events"),
    "batch_count": (batch_count, f"select count(*) filter ({_GOOD_PROPS}) as n_valid, count(*) as n_total from events"),
    "typed_column_path": (typed_column_path, "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 1 and 45 and l_discount between 0 and 0.08::double and l_returnflag in ('A', 'N') and l_linenumber >= 1"),
    "ref_recursive": (ref_recursive, "select conv_id, bool_and(role in ('user', 'assistant')) as valid from conversations group by conv_id"),
    "schema_routing": (schema_routing, "select event_id, case event_type when 'click' then value <= 10 when 'view' then event_id % 4 <> 0 else false end as valid from events"),
    "standalone_function": (standalone_function, f"select event_id, {_GOOD_EVENT} as valid, {_N_ERRORS} as n_errors from events"),
    "standalone_bundle": (standalone_bundle, "select event_id, event_id % 4 <> 0 as a, event_id % 4 <> 0 as b, value <= 50 as c from events"),
    "ddl_roundtrip": (ddl_roundtrip, "select event_id, event_id as id, value, case when event_id % 4 <> 0 then user_id end as \"user\" from events"),
    "ddl_columns": (ddl_columns, "select * from (values (0, '`id` BIGINT NOT NULL,'), (1, '`tags` ARRAY<STRING>,'), (2, '`any` VARIANT')) as t(n, ddl)"),
    "validate_and_parse": (validate_and_parse, f"select event_id, {_GOOD_EVENT} as valid, case when {_GOOD_EVENT} then event_id end as id from events"),
    "filter_valid": (filter_valid, f"select event_id from events where {_GOOD_EVENT}"),
    "validate_coerced": (validate_coerced, "select event_id, event_id % 3 <> 0 and event_id % 100 <= 80 as valid, (event_id % 3 = 0 or event_id % 100 > 80)::int as n_errors from events"),
    "validate_defaults": (validate_defaults, "select event_id, event_id % 2 <> 0 or event_id % 100 <= 80 as valid, case when event_id % 2 <> 0 then 5 when event_id % 100 <= 80 then event_id % 100 end as k from events"),
    "parent_schema": (
        parent_schema,
        f"""select event_id, keyword, case keyword when 'minimum' then '{{"type":"integer","minimum":1}}' when 'enum' then '{{"enum":["click","view"]}}' when 'maximum' then '{{"type":"number","maximum":50}}' """
        f"""else '{json.dumps(EVENT_SCHEMA, separators=(",", ":"))}' end as parent from ({_VIOLATIONS})""",
    ),
    "added_schema": (added_schema, "select c_custkey, c_nationkey <= 12 and c_acctbal >= 0 as valid from customer"),
    "command_line": (command_line, f"select event_id, {_GOOD_EVENT} as valid from events"),
    "judged_by": (judged_by, "select l_orderkey, l_linenumber, p as plan, l_quantity <= 30 as valid from lineitem, (values ('columns'), ('variant'), ('interpreter')) as t(p)"),
    "conformance": (conformance, f"select event_id, {_GOOD_PROPS} as valid from events where event_id <= 50"),
    "compile_warnings": (compile_warnings, "select * from (values ('#/minLength', 'minLength must be a non-negative integer'), ('#/properties/a/type', 'unknown type strin')) as t(path, message)"),
}
OTHERS["ndjson_flags"] = (ndjson_flags, f"select line, valid, count(*) as n from ({OTHERS['ndjson_flags'][1]}) group by all")


def queries() -> dict[str, Query]:
    return {name: v.frame for name, v in VERDICTS.items()} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: v.sql() for name, v in VERDICTS.items()} | {name: sql for name, (_, sql) in OTHERS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events fit their schema, as JSON documents."""
    return count_valid(compile(EVENT_SCHEMA), _events(spark, sf_dir), "doc")
