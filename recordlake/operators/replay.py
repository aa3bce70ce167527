"""Evidence kept by content, and analyses of it that are computed again only where a rule changed.

A body is stored once under the hash of its bytes, in a folder by the hash's first digit, in order of the hashes. A result belongs to a
body, a rule and the rule's version (a hash of what it says); results of other versions are stale. A replay reads
only bodies that lack a result of some present rule, and of their rules only the lacking ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.scratch import written

RESULT_SCHEMA = "content_sha256 string, rule string, version string, found boolean"


def save_bodies(captures: DataFrame, path: str, content: str = "body") -> None:
    """Add the bodies of captured answers that are not there yet, each once."""
    spark = captures.sparkSession
    hashed = captures.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("content_sha256"), F.col(content).cast("binary").alias("content"))
    fresh = hashed.dropDuplicates(["content_sha256"])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select("content_sha256"), "content_sha256", "left_anti")
    fresh.withColumn("bucket", F.left("content_sha256", F.lit(1))).repartition("bucket").sortWithinPartitions("bucket", "content_sha256").write.mode("append").partitionBy("bucket").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and len(fs.listStatus(folder)) > 0


def versioned(rules: DataFrame) -> DataFrame:
    """Rules (rule, pattern) with the version that their pattern makes."""
    return rules.select("rule", "pattern", F.sha2(F.concat_ws("\n", "rule", "pattern"), 256).alias("version"))


def stale(bodies: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """(content_sha256, rule, version, pattern) without a result. The rules are a small table, read by the driver."""
    listed = F.array(*(F.struct(*(F.lit(r[n]).alias(n) for n in ("rule", "version", "pattern"))) for r in versioned(rules).collect()))
    wanted = bodies.select("content_sha256", F.inline(listed))
    return wanted.join(results.select("content_sha256", "rule", "version"), ["content_sha256", "rule", "version"], "left_anti")


def replay(path: str, results: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All present results, and those of them that were computed now."""
    spark = rules.sparkSession
    bodies = spark.read.parquet(path)
    due = written(stale(bodies, results, rules), "stale")
    if due.isEmpty():
        made = spark.createDataFrame([], RESULT_SCHEMA)
    else:
        hashes = due.select("content_sha256", F.left("content_sha256", F.lit(1)).alias("bucket")).distinct()
        read = bodies.join(hashes, ["bucket", "content_sha256"], "left_semi")
        text = F.lower(F.decode("content", "UTF-8"))
        made = written(read.join(due, "content_sha256").select("content_sha256", "rule", "version", F.rlike(text, F.concat(F.lit("(?iuU)"), "pattern")).alias("found")), "replayed")
    kept = results.join(versioned(rules).select("rule", "version"), ["rule", "version"], "left_semi").select("content_sha256", "rule", "version", "found")
    return kept.unionByName(made), made


def signals(observations: DataFrame, results: DataFrame) -> DataFrame:
    """Observations with a map of each rule's finding in their content."""
    by_content = results.groupBy("content_sha256").agg(F.map_from_entries(F.collect_list(F.struct("rule", "found"))).alias("signals"))
    return observations.join(by_content, "content_sha256", "left")

