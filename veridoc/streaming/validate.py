"""Validation of streams. It keeps no state, so no watermark is needed; each micro-batch is a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veridoc.operators.validator import Validator


def validated(stream: DataFrame, validator: Validator, column: str = "value", kind: str = "json") -> DataFrame:
    """The stream with valid and errors."""
    return stream.withColumn("result", validator.validate(column, kind)).select("*", F.col("result.valid").alias("valid"), F.col("result.errors").alias("errors")).drop("result")


def write_split(stream: DataFrame, validator: Validator, good: str, bad: str, checkpoint: str, column: str = "value", available_now: bool = True) -> StreamingQuery:
    """Writes the documents that fit to one Parquet folder, the others with their errors to another.

    Each micro-batch is judged once: the batch is written to a staging partition of its own, named by its
    number, so a batch that runs again overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = batch.persist()
        try:
            judged.where("valid").drop("errors", "valid").write.mode("overwrite").parquet(f"{good}/batch={number}")
            judged.where("NOT valid").drop("valid").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            judged.unpersist()

    writer = validated(stream, validator, column).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
