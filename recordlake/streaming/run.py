"""Streamed collection of the events table, as an example over the driver's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.scratch import fresh_path
from recordlake.streaming.collect import collect_new


def collected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (source, id) of all events, taken in by a stream over page files."""
    folder = fresh_path(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), F.col("user_id").alias("id"))
    events.repartition(8).write.parquet(f"{folder}/pages")
    collect_new(spark, f"{folder}/pages", "source string, id long", ["source", "id"], f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("source string, id long").parquet(f"{folder}/out").withColumn("seen", F.lit(True))
