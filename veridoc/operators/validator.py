"""Validators: a schema with its options, applied to columns of documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import let, quote, restart, spelled
from veridoc.plans.boolean import BooleanCompiler
from veridoc.plans.columns import typed_sql
from veridoc.plans.errors import ERROR, NONE, ErrorCompiler
from veridoc.plans.typed import is_flat, typed_predicate
from veridoc.schema.interpret import Error, Interpreter, check_references, parse
from veridoc.schema.normalize import Schema, warnings
from veridoc.schema.resolve import MOST_MERGED, MOST_REFERENCES, RecursiveSchema, Resources, TooManyReferences

RESULT = f"struct<valid:boolean,errors:array<{ERROR}>>"
_SYNTAX = f"array(named_struct('keyword', 'syntax', 'instancePath', '', 'schemaPath', '#', 'params', '{{}}', 'message', 'invalid JSON', 'parentSchema', CAST(NULL AS STRING)))"
_ABORTED = "array(named_struct('keyword', '', 'instancePath', '', 'schemaPath', '', 'params', '{}', 'message', 'validation failed', 'parentSchema', CAST(NULL AS STRING)))"
#: Keys that occur twice: the last one counts.
LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"


def prepare(spark) -> None:
    """Session settings that documents need."""
    spark.conf.set(LAST_KEY_WINS, "true")


#: Names of the columns that hold a text, it with its hash as a variant, and the document.
_TEXT, _BOTH, _DOC = "veridoc_text", "veridoc_both", "veridoc_doc"


def _parsed_with_hash(text: str) -> str:
    """SQL of the variant of a text and of its hash, as two items of an array."""
    return f"try_parse_json(concat('[', {text}, ',', CAST(xxhash64({text}) AS STRING), ']'))"


def _first_of(w: str, text: str) -> str:
    """SQL of the first of two items, if the second is the text's hash and there is no third."""
    return f"CASE WHEN try_variant_get({w}, '$[1]', 'bigint') = xxhash64({text}) AND try_variant_get({w}, '$[2]', 'variant') IS NULL THEN try_variant_get({w}, '$[0]', 'variant') END"


def parsed(text: str) -> str:
    """SQL of the variant of a JSON text; null unless the text is one whole document.

    ``try_parse_json`` ignores what follows a document, so the text is parsed once, as the first of two
    items of an array. The second is the text's hash: a text that ends the array, or adds items to it,
    would have to hold its own hash to pass.
    """
    return let(_parsed_with_hash(text), lambda w: _first_of(w, text))


class Validator:
    """A compiled schema.

    Options: schemas (a registry of schemas with $id), formats (name to a SQL template with {} for the
    text, or to a Python predicate), verbose (errors carry their schema), abort_early (one error without
    detail), all_errors (False: the first only). Before a document is judged, undeclared keys are removed
    (remove_additional), values coerced (coerce_types) and defaults filled in (use_defaults), in that order,
    whatever the kind of the column; see ``transform``.
    """

    def __init__(self, schema: Schema | str, *, schemas: Iterable[Schema] = (), formats: dict[str, str | Callable[[str], bool]] | None = None, verbose: bool = False, abort_early: bool = False, all_errors: bool = True, coerce_types: bool = False, remove_additional: bool = False, use_defaults: bool = True):
        self.schema: Schema = json.loads(schema) if isinstance(schema, str) else schema
        self.registry, self.formats = list(schemas), dict(formats or {})
        self.verbose, self.abort_early, self.all_errors = verbose, abort_early, all_errors
        self.coerce_types, self.remove_additional, self.use_defaults = coerce_types, remove_additional, use_defaults
        self.warnings = warnings(self.schema)
        self._compiled: tuple[str, str] | None = None
        self._interpreter: Interpreter | None = None
        self._rewritten, self._rewriter = "doc", None
        self._merged: str | None = None
        self.recursive = False

    def add_schema(self, schema: Schema) -> None:
        """Adds a schema to the registry; not after compiling."""
        if self._interpreter is not None:
            raise RuntimeError("add_schema comes before compiling")
        self.registry.append(schema)

    def compile(self) -> Validator:
        """Resolves references and builds the expressions; raises on what has no meaning."""
        if self._interpreter is not None:
            return self
        from veridoc.operators.transform import Rewriter  # which reads documents as this module does

        resources, root = Resources.of(self.schema, self.registry)
        check_references(resources, root)
        self._resources, self._root = resources, root
        if self.coerce_types or self.remove_additional or self.use_defaults and '"default"' in json.dumps([self.schema, self.registry]):
            self._rewriter = Rewriter(self.schema, schemas=self.registry, coerce_types=self.coerce_types, remove_additional=self.remove_additional, defaults=self.use_defaults)
            self._rewritten = self._rewriter.sql("doc")
        python = {k: f for k, f in self.formats.items() if callable(f)}
        self._interpreter = Interpreter(resources, root, python)
        if any(isinstance(f, str) for f in self.formats.values()) and python:
            raise ValueError("formats are all SQL templates or all Python predicates")
        try:
            if python:
                raise RecursiveSchema("Python formats are interpreted")
            restart()
            boolean = BooleanCompiler(resources, {k: f for k, f in self.formats.items() if isinstance(f, str)})
            valid = boolean.compile(root, "doc")
            errors = ErrorCompiler(boolean, self.verbose).compile(root, "doc", "''", "#")
            self._compiled = valid, errors
        except RecursiveSchema as e:
            self.recursive = True
            self._interpreter.compact = isinstance(e, TooManyReferences)
            if self._interpreter.compact and not self.rewrites:
                with suppress(RecursiveSchema):
                    self._merged = self._merge("doc")
        return self

    def _merge(self, name: str) -> str:
        """SQL of the verdict on the variant of that name, for references that fan out."""
        self._resources.followed, self._resources.most = 0, MOST_MERGED
        try:
            restart()
            return str(BooleanCompiler(self._resources, {k: f for k, f in self.formats.items() if isinstance(f, str)}, merge=True).compile(self._root, name))
        finally:
            self._resources.followed, self._resources.most = 0, MOST_REFERENCES

    # Values on the driver.

    def errors_of(self, value: Any) -> list[Error]:
        """The errors of a Python value."""
        self.compile()
        return self._interpreter.errors(self._rewriter.value(value) if self._rewriter else value)

    # SQL of a document's verdict and result; doc is SQL of a variant, which is null where the text is none.

    @property
    def rewrites(self) -> bool:
        """Whether documents may change before they are judged."""
        self.compile()
        return self._rewritten != "doc"

    @property
    def interpreted(self) -> bool:
        """Whether even the verdict takes the interpreter; errors take it for every recursive schema."""
        self.compile()
        return self.recursive and self._merged is None

    def document_sql(self, doc: str) -> str:
        """The document as it is judged: after removing, coercing and filling in."""
        if not self.rewrites:
            return doc
        return let(doc, lambda d: f"CASE WHEN {d} IS NULL THEN NULL ELSE {_renamed(self._rewritten, d)} END")

    def valid_sql(self, doc: str) -> str:
        self.compile()
        valid = self._compiled[0] if self._compiled else self._merged
        if valid is None:
            raise RecursiveSchema("a schema that leads back to itself has no SQL")
        return let(doc, lambda d: f"CASE WHEN {d} IS NULL THEN false ELSE {_renamed(valid, d)} END")

    def errors_sql(self, doc: str) -> str:
        self.compile()
        if self._compiled is None:
            raise RecursiveSchema("a schema that leads back to itself has no SQL")
        valid, errors = self._compiled
        if self.abort_early:
            errors = _ABORTED
        elif not self.all_errors:
            errors = f"slice({errors}, 1, 1)"
        return let(doc, lambda d: f"CASE WHEN {d} IS NULL THEN {_SYNTAX} WHEN {_renamed(valid, d)} THEN {NONE} ELSE {_renamed(errors, d)} END")

    # Columns. kind is what the column holds: "json" (text), "binary" (UTF-8), "variant", "struct" (a null
    # is a missing key) or "struct_nulls" (a null is JSON's).

    def _document(self, column: Column | str, kind: str) -> tuple[str, Callable[[str], str]]:
        c = F.col(column) if isinstance(column, str) else column
        return c, {"json": parsed, "binary": lambda x: parsed(f"decode({x}, 'utf-8')"), "variant": lambda x: x, "struct": lambda x: f"parse_json(to_json({x}))", "struct_nulls": lambda x: f"to_variant_object({x})"}[kind]

    def _with(self, column: Column | str, kind: str, body: Callable[[str], str]) -> Column:
        c, read = self._document(column, kind)
        name = "veridoc_source"
        inner = body(self.document_sql(read(name)))
        # The column is bound once under a name of its own; inside is SQL text only.
        return F.get(F.call_function("transform", F.array(c), F.expr(f"{name} -> {inner}")), F.lit(0))

    def is_valid(self, column: Column | str, kind: str = "json") -> Column:
        """Whether a document fits; a null one, or a text that isn't one JSON document, doesn't."""
        if self.interpreted:
            return self._interpreted(column, kind)["valid"]
        return self._with(column, kind, self.valid_sql)

    def errors(self, column: Column | str, kind: str = "json") -> Column:
        """The array of a document's errors; empty if it fits."""
        self.compile()
        if self.recursive:
            return self._interpreted(column, kind)["errors"]
        return self._with(column, kind, self.errors_sql)

    def validate(self, column: Column | str, kind: str = "json") -> Column:
        """A struct of valid and errors."""
        self.compile()
        if self.recursive:
            return self._interpreted(column, kind)
        return self._with(column, kind, lambda doc: let(self.errors_sql(doc), lambda e: f"named_struct('valid', size({e}) = 0, 'errors', {e})"))

    def validate_and_parse(self, column: Column | str, kind: str = "json") -> Column:
        """A struct of valid, value (the variant, null if the document doesn't fit) and errors."""
        self.compile()
        if self.recursive:
            result = self._interpreted(column, kind)
            value = self._with(column, kind, lambda doc: doc)
            return F.struct(result["valid"].alias("valid"), F.when(result["valid"], value).alias("value"), result["errors"].alias("errors"))
        return self._with(column, kind, lambda doc: let(doc, lambda d: let(self.errors_sql(d), lambda e: f"named_struct('valid', size({e}) = 0, 'value', CASE WHEN size({e}) = 0 THEN {d} END, 'errors', {e})")))

    def issues(self, column: Column | str, kind: str = "json") -> Column:
        """Errors as an array of message and path, the path as an array of its steps."""
        return F.transform(self.errors(column, kind), lambda e: F.struct(e["message"].alias("message"), F.filter(F.split(e["instancePath"], "/"), lambda s, i: i > 0).alias("path")))

    def standard(self, column: Column | str, kind: str = "json") -> Column:
        """A struct of value (the document, if it fits) and issues: message and path, whose steps are keys or integers."""
        result = self.validate_and_parse(column, kind)

        def step(s: Column) -> Column:
            key = F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
            return F.when(s.rlike(r"^(0|[1-9][0-9]{0,17})\z"), s.cast("long").cast("variant")).otherwise(key.cast("variant"))

        path = lambda e: F.transform(F.filter(F.split(e["instancePath"], "/"), lambda s: s != ""), step)
        issues = F.transform(result["errors"], lambda e: F.struct(e["message"].alias("message"), path(e).alias("path")))
        return F.struct(result["value"].alias("value"), issues.alias("issues"))

    def _interpreted(self, column: Column | str, kind: str) -> Column:
        """The result by the interpreter, in an Arrow UDF over JSON text."""
        c = F.col(column) if isinstance(column, str) else column
        text = {"json": lambda: c.cast("string"), "binary": lambda: F.decode(c, "utf-8"), "variant": lambda: F.to_json(c), "struct": lambda: F.to_json(c), "struct_nulls": lambda: F.to_json(F.to_variant_object(c))}[kind]()
        interpreter, rewriter, verbose, early, every = self._interpreter, self._rewriter, self.verbose, self.abort_early, self.all_errors

        @F.pandas_udf(RESULT)
        def judge(docs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in docs:
                found = [_errors_of(interpreter, rewriter, t, verbose, early, every) for t in batch]
                yield pd.DataFrame({"valid": [not e for e in found], "errors": found})

        return judge(text)

    # DataFrames.

    def _typed_sql(self, df: DataFrame, column: str, kind: str) -> Callable[[str], str] | None:
        """SQL of the verdict on a typed column's own fields, from its name; None where there is no such SQL."""
        self.compile()
        if kind not in ("struct", "struct_nulls") or self.rewrites or any(callable(f) for f in self.formats.values()):
            return None
        return typed_sql(self._resources, self._root, self.formats, df.select(F.expr(_name(df, column))).schema[0].dataType, kind == "struct_nulls")

    def plan(self, df: DataFrame, column: str, kind: str = "json") -> str:
        """How a column of df is judged: by its "columns", as a "variant", or by the "interpreter"."""
        return "columns" if self._typed_sql(df, column, kind) else "interpreter" if self.interpreted else "variant"

    def verdict(self, df: DataFrame, column: str, kind: str = "json") -> Column:
        """``is_valid`` for a column of df. A typed one is judged by its type, without documents, wherever that can be."""
        name = _name(df, column)
        if sql := self._typed_sql(df, column, kind):
            return F.expr(f"coalesce({name} IS NOT NULL AND {sql(name)}, false)")
        if kind == "variant" and not self.interpreted and not self.rewrites:
            return F.expr(self._verdict_sql(name))
        return self.is_valid(column, kind)

    def _verdict_sql(self, name: str) -> str:
        """SQL of the verdict on the variant in a column."""
        if self._merged is not None:
            return f"coalesce({name} IS NOT NULL AND {self._merge(name)}, false)"
        self._resources.followed = 0
        sql = BooleanCompiler(self._resources, {k: f for k, f in self.formats.items() if isinstance(f, str)}).compile(self._root, name)
        return f"coalesce({name} IS NOT NULL AND {sql}, false)"

    def _staged(self, df: DataFrame, column: str, kind: str) -> tuple[DataFrame, Column]:
        """df with a text column parsed in columns of their own, each computed once and in generated code, and the verdict."""
        self.compile()
        if kind not in ("json", "binary") or self.interpreted or self.rewrites:
            return df, self.verdict(df, column, kind)
        c = F.col(column).cast("string") if kind == "json" else F.decode(F.col(column), "utf-8")
        both = df.withColumn(_TEXT, c).withColumn(_BOTH, F.expr(_parsed_with_hash(_TEXT)))
        return both.withColumn(_DOC, F.expr(_first_of(_BOTH, _TEXT))), F.expr(self._verdict_sql(_DOC))

    def filter_valid(self, df: DataFrame, column: str, kind: str = "json") -> DataFrame:
        staged, valid = self._staged(df, column, kind)
        return staged.filter(valid).select(*("`" + c.replace("`", "``") + "`" for c in df.columns))

    def with_valid(self, df: DataFrame, column: str, kind: str = "json", name: str = "valid") -> DataFrame:
        """df with the verdict in a column of that name."""
        staged, valid = self._staged(df, column, kind)
        return staged.withColumn(name, valid).drop(_TEXT, _BOTH, _DOC)

    def with_result(self, df: DataFrame, column: str, kind: str = "json", name: str = "result") -> DataFrame:
        """df with a struct of valid and errors; errors are looked for only in what doesn't fit."""
        if kind not in ("struct", "struct_nulls"):
            return df.withColumn(name, self.validate(column, kind))
        fits = F.struct(F.lit(True).alias("valid"), F.expr(NONE).alias("errors"))
        return df.withColumn(name, F.when(self.verdict(df, column, kind), fits).otherwise(self.validate(column, kind)))

    def count_valid(self, df: DataFrame, column: str, kind: str = "json") -> DataFrame:
        """One row with n_valid and n_total: a partial and a final aggregate."""
        staged, valid = self._staged(df, column, kind)
        return staged.select(valid.alias("ok")).agg(F.count_if("ok").alias("n_valid"), F.count("*").alias("n_total"))

    def error_counts(self, df: DataFrame, column: str, kind: str = "json") -> DataFrame:
        """How often each keyword fails at each path."""
        bad = df.where(~self.verdict(df, column, kind)) if kind in ("struct", "struct_nulls") else df
        return bad.select(F.explode(self.errors(column, kind)).alias("e")).groupBy(F.col("e.keyword").alias("keyword"), F.col("e.instancePath").alias("instance_path")).agg(F.count("*").alias("n_errors"))

    def typed(self, df: DataFrame, nulls: str = "absent") -> Column | None:
        """For a flat schema, the verdict on df's own columns as predicates that Spark can push down; else None."""
        return typed_predicate(self.schema, df.schema, nulls) if is_flat(self.schema) and not self.formats else None


def _name(df: DataFrame, column: str) -> str:
    """SQL of a column's name."""
    return "`" + column.replace("`", "``") + "`" if column in df.columns else column


def _renamed(sql: str, name: str) -> str:
    """The compiled SQL over the variable of that name."""
    return sql if name == "doc" else f"get(transform(array({name}), doc -> {sql}), 0)"


def _errors_of(interpreter: Interpreter, rewriter: Any, text: str | None, verbose: bool, early: bool, every: bool) -> list[dict]:
    plain = lambda keyword, message, path: {"keyword": keyword, "instancePath": "", "schemaPath": path, "params": "{}", "message": message, "parentSchema": None}
    try:
        value = parse(text if text is not None else "")
    except (ValueError, RecursionError):
        return [plain("syntax", "invalid JSON", "#")]
    found = interpreter.errors(rewriter.value(value) if rewriter else value)
    if found and early:
        return [plain("", "validation failed", "")]
    found = found if every else found[:1]
    return [e | {"params": spelled(e["params"]), "parentSchema": None} for e in found]


def validate(schema: Schema | str, df: DataFrame, column: str, kind: str = "json", **options: Any) -> DataFrame:
    """df with a column result, by a schema used once."""
    return Validator(schema, **options).with_result(df, column, kind)


_CACHE: dict[str, Validator] = {}


def compile(schema: Schema | str, **options: Any) -> Validator:
    """A compiled validator; the same schema and options give the same one."""
    if any(callable(f) for f in (options.get("formats") or {}).values()):
        return Validator(schema, **options).compile()
    key = json.dumps([schema, {k: list(v) if k == "schemas" else v for k, v in options.items()}], sort_keys=True)
    if key not in _CACHE:
        _CACHE[key] = Validator(schema, **options).compile()
    return _CACHE[key]


__all__ = ["RESULT", "Validator", "compile", "parsed", "prepare", "quote", "validate"]
