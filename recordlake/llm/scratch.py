"""Shared scratch space: reliable checkpoints and written tables that outlive executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from recordlake.scratch import bound_batches, fresh_path, free_memory, tidy  # noqa: F401

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind it go at once, since nothing else reads them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def integer_key(df: DataFrame, key: str) -> Column:
    """The key as a long; keys of other than integer types are refused."""
    kind = df.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}: the operator takes integer ids")
    return F.col(key).cast("long")


def free_name(name: str, outputs: list[str]) -> str:
    """The name under which a kept column comes out: one that is named like an output gets an underscore."""
    while name in outputs:
        name += "_"
    return name
