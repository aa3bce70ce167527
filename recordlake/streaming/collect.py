"""Resumable collection: page files streamed once each, de-duplicated, and upserted before the checkpoint moves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collect_new(spark: SparkSession, folder: str, schema: str, keys: list[str], out: str, checkpoint: str, max_files: int = 8) -> None:
    """Take in all page files not seen by this checkpoint; rows with known keys are dropped by the stream's state."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    query = pages.dropDuplicates(keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def collect_into(spark: SparkSession, folder: str, schema: str, checkpoint: str, save: Callable[[DataFrame, int], None], max_files: int = 8) -> None:
    """Hands each batch to ``save`` before its offset is committed: a crash replays it, so ``save`` must be idempotent."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    query = pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def stop_reasons(pages: DataFrame, max_records: int, max_pages: int) -> DataFrame:
    """Per source the first page that ends a collection, and why.

    ``pages`` has source, page, returned, fresh (rows not seen before), is_complete and error.
    """
    from pyspark.sql.window import Window

    upto = Window.partitionBy("source").orderBy("page")
    running = pages.withColumn("stored", F.sum("fresh").over(upto))
    reason = (
        F.when(F.col("error").isNotNull(), "provider_error").when(F.col("returned") == 0, "no_results").when(F.col("fresh") == 0, "repeated_page")
        .when(F.col("stored") >= max_records, "max_records").when(F.col("is_complete"), "provider_complete").when(F.col("page") >= max_pages, "max_pages")
    )
    ended = running.withColumn("reason", reason).filter("reason is not null").groupBy("source").agg(F.min(F.struct("page", "reason", "stored")).alias("stop"))
    return ended.select("source", "stop.page", "stop.reason", F.least("stop.stored", F.lit(max_records)).alias("stored"))


def check_resume(checkpoint: dict, source: str, query: dict) -> None:
    """A checkpoint resumes only the source and query (but for the page) that it was made for."""
    rest = lambda q: {k: v for k, v in q.items() if k != "page"}
    if checkpoint.get("source") != source or rest(checkpoint.get("query", {})) != rest(query):
        raise ValueError("the checkpoint belongs to another collection")
