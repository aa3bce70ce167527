"""Exports: ordered CSV columns, JSON lines with sorted keys, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.scratch import written

#: Column orders of the exports (fixed values).
MIXED_CSV = [
    "kind", "id", "source", "court", "case_number", "number", "decision_type", "precedent_type", "subject", "rapporteur", "status", "question", "thesis", "summary",
    "judgment_date", "publication_date", "updated_at", "paradigm_case_count", "source_url", "access_status", "extraction_status", "canonical_key",
]
DECISION_CSV = [
    "id", "source", "court", "case_number", "decision_type", "subject", "judging_body", "rapporteur", "judgment_date", "publication_date", "source_updated_at",
    "summary", "source_url", "document_url", "access_status", "extraction_status", "retrieved_at",
]
PRECEDENT_CSV = ["id", "source", "court", "number", "precedent_type", "status", "question", "thesis", "paradigm_case_count", "rapporteur", "updated_at", "access_status", "extraction_status"]
DOCUMENT_CSV = ["id", "source", "court", "document_type", "content_type", "title", "url", "sha256", "byte_size", "access_status", "extraction_status", "retrieved_at"]
RUN_CSV = [
    "record_kind", "id", "source", "court", "case_number", "registry_number", "decision_type", "precedent_type", "number", "case_class", "subject", "rapporteur", "judging_body",
    "origin_county", "judgment_date", "publication_date", "status", "updated_at", "document_type", "content_type", "title", "url", "document_url", "source_url", "extraction_status",
    "access_status",
]

#: Records of a Markdown page at most.
PAGE_RECORDS = 1000


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns as strings; those that are missing are empty."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def run_rows(records: DataFrame) -> DataFrame:
    """The rows of a run's export; a record with a document type is a document, else one with a precedent type a precedent."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != "" if c in records.columns else F.lit(False)
    kind = F.when(given("document_type"), "document").when(given("precedent_type"), "precedent").otherwise("decision")
    return ordered(records.withColumn("record_kind", kind), RUN_CSV)


def csv_line(columns: list[str]) -> Column:
    """A CSV record: fields with comma, quote or line end are quoted."""
    field = lambda c: F.when(F.col(c).rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return F.concat_ws(",", *map(field, columns))


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    ordered(df, columns).write.csv(path, header=True, quote='"', escape='"')


def json_line(df: DataFrame, columns: list[str]) -> Column:
    """JSON object with sorted keys, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(json_line(df, df.columns).alias("value")).write.text(path)


def markdown_record(title: Column, **sections: Column) -> Column:
    """A heading and those sections that have a value."""
    parts = [F.concat(F.lit("## "), title)] + [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{name}:** "), c)) for name, c in sections.items()]
    return F.concat_ws("\n", *parts)


def markdown_pages(df: DataFrame, group: str, order: str, record: Column, size: int = PAGE_RECORDS) -> DataFrame:
    """(group, page, markdown): per group its records in order, ``size`` to a page, pages from 1.

    Records are dealt by ranges of group and order and written with their range; ranks within a range and the counts
    of the ranges before it make the pages, so no group is gathered whole.
    """
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), record.alias("m"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(partitions, "g", "o").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("g", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("g").alias("og"), F.col("range").alias("orange"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("g", "range").orderBy("o", "m"))
    ranked = ranged.withColumn("rank", rank).join(offsets, F.col("g").eqNullSafe(F.col("og")) & (F.col("range") == F.col("orange")))
    paged = ranked.withColumn("page", F.floor((F.col("rank") + F.col("before") - 1) / size) + 1)
    listed = F.array_sort(F.collect_list(F.struct("o", "m")))
    return paged.groupBy(F.col("g").alias(group), "page").agg(F.array_join(F.transform(listed, lambda r: r["m"]), "\n\n").alias("markdown"))


def document_view(df: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Documents without raw bytes but a note of them, or with the bytes in base64."""
    kept = df.withColumn("raw_bytes_preserved", F.col("raw_bytes").isNotNull())
    return kept.withColumn("raw_bytes", F.base64("raw_bytes")) if with_bytes else kept.drop("raw_bytes")
