"""De-duplication, budgets and fingerprints over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, at the place of the first (``first_position``).

    Of rows at one position the one with the largest other columns stays, compared in their order (maps are left out).
    """
    window = Window.partitionBy(*keys)
    others = [F.desc(f.name) for f in df.schema if f.name not in (*keys, position) and "map<" not in f.dataType.simpleString()]
    last = df.withColumn("first_position", F.min(position).over(window)).withColumn("__n", F.row_number().over(window.orderBy(F.desc(position), *others)))
    return last.filter("__n = 1").drop("__n")


def duplicate_counts(df: DataFrame, page: str, identity: str, order: list[Column]) -> DataFrame:
    """Per page: rows, in-page duplicates, and rows seen on an earlier page."""
    numbered = df.withColumn("__in", F.row_number().over(Window.partitionBy(page, identity).orderBy(*order))).withColumn("__first", F.min(page).over(Window.partitionBy(identity)))
    return numbered.groupBy(page).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__in") > 1).alias("page_duplicates"),
        F.count_if((F.col("__in") == 1) & (F.col("__first") < F.col(page))).alias("seen_before"),
    )


def record_cap(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group."""
    return df.withColumn("running", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("running") <= cap)


def byte_budget(df: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows reached before the running size meets the budget; the row that meets it is the last."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("bytes_before", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("bytes_before") < budget)


def sync_counters(df: DataFrame, id_: str) -> DataFrame:
    valid = F.nullif(F.trim(F.col(id_).cast("string")), F.lit("")).isNotNull()
    counted = df.agg(F.count(F.lit(1)).alias("seen"), F.count_if(~valid).alias("invalid"), F.countDistinct(F.when(valid, F.col(id_))).alias("saved"))
    return counted.select("seen", "saved", (F.col("seen") - F.col("invalid") - F.col("saved")).alias("duplicates"), "invalid")


def unsynced(resources: DataFrame, manifest: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Resources to fetch: those without a complete manifest row of equal fingerprint."""
    return resources if force else resources.join(manifest.filter("status = 'complete'").select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def synced(resources: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return resources.join(manifest.filter("status = 'complete'").select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_semi")
