"""Regenerate when schema sources change: a file stream whose batches make the outputs anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adtflow.sources.schemas import emit_all


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (schema_id, source), one row for each new file."""
    files = spark.readStream.option("wholetext", True).format("text").load(folder)
    return files.select(F.col("_metadata.file_path").alias("schema_id"), F.col("value").alias("source"))


def watch(stream: DataFrame, languages: list[str], accept: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch's schemas in all languages go to ``accept``, only those without errors: what was made last of a schema that
    is now at fault stays. Batches run one after another."""

    def batch(df: DataFrame, number: int) -> None:
        accept(emit_all(df, languages).where("error is null"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
