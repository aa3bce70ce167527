"""Readers of captured resources: JSON lists, delimited text, manifests, sheets and catalogues."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LIST_KEYS = ("records", "data", "items", "result")


def decode_text(content: Column) -> Column:
    """UTF-8 without byte order mark; content that isn't UTF-8 is Latin-1."""
    utf8 = F.try_validate_utf8(content)
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), "^﻿", "")


def captured(df: DataFrame, content: str = "content") -> DataFrame:
    """Captures with size and digest of the bytes."""
    return df.withColumns({"byte_size": F.length(content), "content_sha256": F.sha2(content, 256)})


def json_records(body: Column) -> Column:
    """Objects of a JSON list, of the first list under a known key, or the object itself; others are left out."""
    as_list = lambda c: F.from_json(c, "array<string>")
    listed = F.coalesce(F.when(F.ltrim(body).startswith("["), as_list(body)), *(F.when(F.ltrim(F.get_json_object(body, f"$.{k}")).startswith("["), as_list(F.get_json_object(body, f"$.{k}"))) for k in LIST_KEYS), F.array(body))
    return F.filter(listed, lambda r: F.ltrim(r).startswith("{"))


def sniff_delimiter(head: str) -> str:
    """The most frequent of ``; , | tab`` on the first line."""
    line = head.split("\n", 1)[0]
    return max(";,|\t", key=line.count)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited file with header: delimiter and encoding by its first bytes, keys and values trimmed."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096)).first()[0]
    try:
        text, encoding = bytes(head).decode("utf-8-sig", "strict"), "UTF-8"
    except UnicodeDecodeError as e:
        cut = e.start >= len(head) - 3
        text, encoding = bytes(head).decode("utf-8" if cut else "latin-1", "ignore"), "UTF-8" if cut else "ISO-8859-1"
    df = spark.read.csv(path, sep=sniff_delimiter(text), header=True, encoding=encoding, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True)
    return df.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿")) for c in df.columns))


def scan_pipe_csv(df: DataFrame, needle: str, order: list[Column], page: int, size: int, byte_cap: int) -> DataFrame:
    """Rows of a pipe table that hold the needle in any column: the header is skipped, rows beyond the byte cap aren't scanned."""
    line = F.concat_ws("|", *df.columns)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = df.filter(F.col(df.columns[0]) != "KEY").withColumn("scanned_before", F.coalesce(F.sum(F.octet_length(line)).over(before), F.lit(0)))
    return scanned.filter((F.col("scanned_before") < byte_cap) & F.lower(line).contains(needle.lower())).orderBy(*order).offset((page - 1) * size).limit(size)


def read_manifest(lines: Column) -> Column:
    """Rows of a manifest text: the header is the first line with BASE and ARQUIVO; rows without a file are left out."""
    rows = F.transform(F.split(lines, r"\r?\n"), lambda x: F.trim(x))
    header = F.filter(rows, lambda x: F.upper(x).contains("BASE") & F.upper(x).contains("ARQUIVO"))[0]
    body = F.slice(rows, F.array_position(rows, header).cast("int") + 1, F.size(rows))
    names = F.transform(F.split(F.upper(header), r"\|"), lambda n: F.trim(n))
    parsed = F.transform(body, lambda r: F.map_from_arrays(names, F.slice(F.concat(F.transform(F.split(r, r"\|"), lambda v: F.trim(v)), F.array_repeat(F.lit(""), F.size(names))), 1, F.size(names))))
    return F.filter(parsed, lambda m: F.coalesce(m["ARQUIVO"], F.lit("")) != "")


def _sheet_rows(content: bytes | None) -> list[list[str | None]] | None:
    if content is None:
        return None
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        out = []
        for number, row in ((number, row) for number, name in sheets for row in ElementTree.fromstring(z.read(name)).iter(f"{ns}row")):
            cells: dict[int, str | None] = {}
            for cell in row.iter(f"{ns}c"):
                place = 0
                for ch in re.match("[A-Z]+", cell.get("r", "A"))[0]:
                    place = place * 26 + ord(ch) - 64
                value = cell.find(f"{ns}v")
                text = "".join(t.text or "" for t in cell.iter(f"{ns}t")) if cell.get("t") == "inlineStr" else None if value is None else value.text
                cells[place - 1] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
            out.append([str(number), *(cells.get(i) for i in range(max(cells, default=-1) + 1))])
        return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def xlsx_rows(contents: pd.Series) -> pd.Series:
    """Rows of all sheets in order, headers included; the first cell of each is its sheet's number."""
    return contents.map(_sheet_rows)


def sheet_table(df: DataFrame, headers: list[str], content: str = "content") -> DataFrame:
    """Rows of every sheet with these headers as columns, with ``sheet`` and ``position`` (from 0 in it).

    Sheets of other headers give no rows; ``sheet_contracts`` names them.
    """
    rows = _sheets(df, content).withColumn("known", F.slice("header", 2, 1_000_000) == F.array(*map(F.lit, headers)))
    kept = rows.filter("known and position > 0")
    return kept.select("url", "sheet", (F.col("position") - 1).alias("position"), *(F.get("r", F.lit(i + 1)).alias(h) for i, h in enumerate(headers)))


def sheet_contracts(df: DataFrame, headers: list[str], content: str = "content") -> DataFrame:
    """Per sheet whether its headers are others than these (``contract_changed``)."""
    first = _sheets(df, content).filter("position = 0")
    return first.select("url", "sheet", (~F.coalesce(F.slice("header", 2, 1_000_000) == F.array(*map(F.lit, headers)), F.lit(False))).alias("contract_changed"))


def _sheets(df: DataFrame, content: str) -> DataFrame:
    """(url, sheet, position in the sheet, header, row) of all sheets; header and row begin with the sheet's number."""
    parsed = df.select(F.col("url") if "url" in df.columns else F.lit(None).cast("string").alias("url"), xlsx_rows(F.col(content)).alias("rows"))
    numbers = F.array_distinct(F.transform("rows", lambda r: r[0]))
    by_sheet = parsed.select("url", "rows", F.explode(numbers).alias("n"))
    own = by_sheet.select("url", F.col("n").cast("int").alias("sheet"), F.filter("rows", lambda r: r[0] == F.col("n")).alias("own"))
    return own.select("url", "sheet", F.col("own")[0].alias("header"), F.posexplode("own").alias("position", "r"))


def catalog_datasets(body: Column) -> Column:
    """Datasets of a catalogue answer."""
    kind = "struct<result:struct<results:array<struct<id:string,name:string,title:string,license_id:string,metadata_modified:string,resources:array<struct<id:string,name:string,format:string,url:string,size:string,hash:string,last_modified:string>>>>>>"
    return F.from_json(body, kind)["result"]["results"]


def describe_datasets(df: DataFrame) -> DataFrame:
    """Per dataset: sorted distinct formats and the number of resources."""
    one = df.select(F.explode(catalog_datasets(F.col("body"))).alias("d"))
    return one.select("d.id", "d.title", F.array_sort(F.array_distinct(F.transform("d.resources", lambda r: F.upper(r["format"])))).alias("formats"), F.size("d.resources").alias("resource_count"))


def plan_downloads(resources: DataFrame, formats: list[str], cap: int, limit: int) -> DataFrame:
    """Resources of the wanted formats whose declared size is within the cap."""
    size = F.col("size").try_cast("long")
    return resources.filter(F.upper("format").isin([f.upper() for f in formats]) & (size.isNull() | (size <= cap))).orderBy("id").limit(limit)


def bounded(df: DataFrame, cap: int, length: str = "length") -> DataFrame:
    return df.filter(F.col(length) <= cap)


def iter_pages(results: DataFrame, max_records: int) -> DataFrame:
    """Results page by page without ids seen before, up to ``max_records`` in all, per source."""
    unique = results.withColumn("__n", F.row_number().over(Window.partitionBy("source", "id").orderBy("page", "position"))).filter("__n = 1").drop("__n")
    running = F.row_number().over(Window.partitionBy("source").orderBy("page", "position"))
    return unique.withColumn("running", running).filter(F.col("running") <= max_records)
