"""Newline-delimited JSON: one document a line, empty lines left out, lines of blanks only being invalid documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.operators.validator import Validator, prepare


def read_ndjson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files, in a column value; files are split, so a large one is read by many tasks."""
    prepare(spark)
    return spark.read.option("lineSep", "\n").text(path).where("value <> ''")


def read_ndjson_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same as a stream of the files that appear at path."""
    prepare(spark)
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).where("value <> ''")


def split_buffers(df: DataFrame, column: str) -> DataFrame:
    """Rows of a binary or text column, each a buffer of lines, as one row a line (value), with the line's place in its buffer (line)."""
    lines = F.split(F.decode(F.col(column), "utf-8") if dict(df.dtypes)[column] == "binary" else F.col(column), "\n")
    return df.select(F.posexplode(lines).alias("line", "value")).where("value <> ''")


def valid_flags(validator: Validator, lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with a column valid."""
    return validator.with_valid(lines, column)


def count_valid(validator: Validator, lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: n_valid and n_total."""
    return validator.count_valid(lines, column)
