"""A facade that keeps schemas by name, and routing of documents to the schema that a column names."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.operators.validator import Validator
from veridoc.schema.normalize import Schema


class SchemaSet:
    """Schemas by identifier: compile, validate, add, get."""

    def __init__(self, **options: Any):
        self.options, self._schemas = options, {}

    def add_schema(self, schema: Schema, key: str | None = None) -> SchemaSet:
        name = key or (schema.get("$id") if isinstance(schema, dict) else None)
        if not name:
            raise ValueError("a schema needs a key or an $id")
        self._schemas[name] = schema
        return self

    def get_schema(self, key: str) -> Validator | None:
        return self.compile(self._schemas[key]) if key in self._schemas else None

    def compile(self, schema: Schema) -> Validator:
        others = [s if isinstance(s, dict) and "$id" in s else {"$id": k, "allOf": [s]} for k, s in self._schemas.items() if s is not schema]
        return Validator(schema, schemas=others, **self.options).compile()

    def validate(self, schema: Schema | str, df: DataFrame, column: str, kind: str = "json") -> DataFrame:
        """df with a column result."""
        found = self.get_schema(schema) if isinstance(schema, str) else self.compile(schema)
        if found is None:
            raise KeyError(schema)
        return df.withColumn("result", found.validate(column, kind))

    def route(self, key: Column | str, column: str, kind: str = "json") -> Column:
        """The verdict by the schema that key names; false where there is none of that name."""
        k = F.col(key) if isinstance(key, str) else key
        branches = [(name, self.compile(s).is_valid(column, kind)) for name, s in self._schemas.items()]
        return reduce(lambda out, b: out.when(k == b[0], b[1]), branches[1:], F.when(k == branches[0][0], branches[0][1])).otherwise(False) if branches else F.lit(False)
