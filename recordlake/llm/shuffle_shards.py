"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters each record by seeded hashes of its id: to a shard (a consistent hash, so that one
more shard takes records only into itself) and to one of the shard's memory-sized buckets. Pass 2
sorts each bucket, Fisher-Yates shuffles it (``functions.shuffle``, seeded, one bucket after another
in a fixed partition) and writes it as part of its shard; ``slot`` runs gapless over a shard's buckets.

The shard follows from the id and the shard count alone, the bucket from the whole row, so an id that
occurs very often still spreads over its shard's buckets. Null ids and null texts are ordinary values;
rows that repeat are kept, each with its own slot; an empty table writes no shard. All columns are
written; one named like an output comes out with an underscore behind its name. Columns of map type
have no order and are refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType, StructField
from pyspark.sql.window import Window

from recordlake.llm.scratch import free_name

BUCKET_BYTES = 16 << 20
OUTPUTS = ["shard", "slot", "grown_shard"]


def consistent_shard(key: Column, shards: int, seed: int) -> Column:
    """The last growth step j < shards at which the key moved to shard j; step j moves 1 in j + 1 keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    moves = [F.when(F.pmod(F.xxhash64(key, F.lit(j), F.lit(seed)), F.lit(j + 1)) == 0, F.lit(j)) for j in range(1, shards)]
    return F.greatest(F.lit(0), F.lit(0), *moves)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a whole row: strings and binaries by their length, nested values as JSON, others 8."""

    def one(field: StructField) -> Column:
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        if isinstance(field.dataType, AtomicType):
            return F.lit(8)
        return F.octet_length(F.to_json(F.struct(field.name)))

    return reduce(lambda a, b: a + b, map(one, df.schema.fields), F.lit(8)).cast("long")


def write_shuffled(df: DataFrame, path: str, shards: int, key: str = "doc_id", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``df`` under ``path``, a folder per shard, rows in shuffled order; returns the written table.

    The bucket count follows the bytes of the whole rows. Columns: those of ``df``, slot, grown_shard, shard.
    """
    total = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    names = {c: free_name(c, OUTPUTS) for c in [key, *(c for c in df.columns if c != key)]}
    keyed = df.select(F.struct(*(F.col(c).alias(n) for c, n in names.items())).alias("row")).withColumns({
        "shard": consistent_shard(F.col("row")[names[key]], shards, seed),
        "bucket": F.pmod(F.xxhash64("row", F.lit(seed), F.lit("bucket")), F.lit(per_shard)).cast("int"),
    })
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    buckets = (
        keyed.repartition(shards * per_shard, "shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .sortWithinPartitions("shard", "bucket")
        .withColumn("rows", F.shuffle("rows", seed))
    )
    slotted = (
        buckets.join(offsets, ["shard", "bucket"])
        .select("shard", "offset", F.posexplode("rows").alias("pos", "row"))
        .select("row.*", "shard", (F.col("offset") + F.col("pos")).cast("long").alias("slot"))
        .withColumn("grown_shard", F.greatest("shard", F.when(F.pmod(F.xxhash64(F.col(names[key]), F.lit(shards), F.lit(seed)), F.lit(shards + 1)) == 0, F.lit(shards))))
    )
    slotted.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    schema = slotted.select(*names.values(), "slot", "grown_shard", "shard").schema
    return df.sparkSession.read.schema(schema).parquet(path)
