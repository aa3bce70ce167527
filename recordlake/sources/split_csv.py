"""Delimited files with quoted line breaks, read in splits.

Whether a line begins inside quotes depends on all quotes before it, so each split counts its quotes, the counts of
the splits before are added up (one row a split), and within a split they run along. A record begins at each
line outside quotes; records are numbered, and bytes summed, in the same two levels. No file is read by one
task, and no window runs over more than a split or the list of splits.
"""

from __future__ import annotations

import csv

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recordlake.scratch import written


def quoted_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, record, bytes_before, text): the records of each file in order, line breaks in quotes kept.

    ``record`` counts from 0, ``bytes_before`` is the place of its first byte in the file. A quote that is never
    closed makes the rest of the file one record. Empty lines outside quotes are records of no text.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"),
        F.decode(F.col("value").cast("binary"), encoding).alias("text"), (F.octet_length("value") + 1).cast("long").alias("bytes"),
    )
    lines = written(lines.withColumn("quotes", (F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))).cast("long")), "lines")
    per_split, earlier = ["file", "split"], Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*per_split).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))

    sums = lines.groupBy(*per_split).agg(F.sum("quotes").alias("quotes"), F.sum("bytes").alias("bytes"))
    bases = sums.select(*per_split, before("quotes", earlier).alias("base_quotes"), before("bytes", earlier).alias("base_bytes"))
    placed = lines.join(bases, per_split).select(*per_split, "line", "text", "bytes", (before("quotes", along) + F.col("base_quotes")).alias("open"), (before("bytes", along) + F.col("base_bytes")).alias("at"))
    begun = placed.withColumn("begins", (F.col("open") % 2 == 0).cast("long"))

    counts = begun.groupBy(*per_split).agg(F.sum("begins").alias("begins"))
    first = counts.select(*per_split, before("begins", earlier).alias("base_record"))
    upto = Window.partitionBy(*per_split).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = begun.join(first, per_split).select("file", "at", "text", (F.sum("begins").over(upto) + F.col("base_record") - 1).alias("record"))
    grouped = numbered.groupBy("file", "record").agg(F.min("at").alias("bytes_before"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    first_of_file = (F.col("record") == 0) & F.col("text").startswith("﻿")
    return grouped.withColumn("text", F.when(first_of_file, F.substring("text", 2, 2**31 - 1)).otherwise(F.col("text")))


def fields_of(text: Column, sep: str) -> Column:
    """The fields of a record: outside quotes cut at ``sep``, quotes undone, a carriage return at the end dropped."""

    def one(record: str) -> list[str]:
        record = record.removesuffix("\r")
        try:
            return next(csv.reader([record], delimiter=sep), [""])
        except csv.Error:  # a carriage return within an unquoted field
            return record.split(sep)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(records: pd.Series) -> pd.Series:
        csv.field_size_limit(2**31 - 1)
        return records.map(one)

    return cut(text)


def read_quoted(spark: SparkSession, path: str, sep: str = "|", encoding: str = "UTF-8") -> DataFrame:
    """(file, record, bytes_before, values by trimmed header); records behind each file's header, but for empty ones."""
    records = quoted_records(spark, path, encoding).filter("trim(text) != ''").withColumn("fields", fields_of(F.col("text"), sep))
    headers = records.groupBy("file").agg(F.min_by("fields", "record").alias("header"), F.min("record").alias("head"))
    names = F.transform("header", lambda h: F.trim(h))
    width = F.size("header")
    padded = F.slice(F.concat("fields", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return records.join(headers, "file").filter("record > head").select("file", "record", "bytes_before", F.map_from_arrays(names, padded).alias("values"))


def scan(records: DataFrame, needle: str, byte_cap: int) -> DataFrame:
    """Records that hold the needle in any value, in any case; those that begin beyond the cap of a file aren't looked at."""
    hay = F.lower(F.array_join(F.map_values("values"), "|"))
    return records.filter((F.col("bytes_before") < byte_cap) & hay.contains(needle.lower()))
