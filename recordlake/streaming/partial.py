"""Collection of sources page by page, with the progress of each source as the stream's state.

A run takes pages in order until a limit, an end or an error. If the record limit falls inside a page, its first
rows are stored and the page stays the next one: a later run gets it again, and the ids that are known already
make sure that no row is stored twice or lost. Known ids, the next page and the counters live in the state store,
keyed by source, so a restarted stream goes on where the last one committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A page as asked for by a run: ``rows`` are (id, payload); a row without payload can't be made canonical.
PAGE_SCHEMA = "source string, run long, page int, rows array<struct<id: string, payload: string>>, total long, is_complete boolean, error string"
#: Stored rows (``id`` is set) and, behind each page, the progress of its source (``id`` is null).
OUT_SCHEMA = "source string, run long, page int, id string, payload string, next_page int, pages_fetched long, records_seen long, records_saved long, duplicates long, complete boolean, stop_reason string"
_PROGRESS = "run long, next_page int, pages_fetched long, records_seen long, records_saved long, duplicates long, known long, run_pages long, run_records long, complete boolean, stop_reason string"
_NAMES = [f.split()[0] for f in _PROGRESS.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Collector(StatefulProcessor):
    """Takes a source's pages in order and stops a run for the first reason that holds."""

    def __init__(self, max_pages: int, max_records: int, first_page: int):
        self.max_pages, self.max_records, self.first_page = max_pages, max_records, first_page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.seen = handle.getMapState("seen", "id string", "page int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        p = dict(zip(_NAMES, self.progress.get(), strict=True)) if self.progress.exists() else {n: 0 for n in _NAMES} | {"run": None, "next_page": self.first_page, "complete": False, "stop_reason": None}
        pages = pd.concat(list(rows), ignore_index=True).sort_values(["run", "page"], kind="stable")
        out: list[tuple] = []
        for page in pages.itertuples(index=False):
            if page.run != p["run"]:
                p |= {"run": page.run, "run_pages": 0, "run_records": 0, "stop_reason": None}
            if p["stop_reason"] is None and page.page == p["next_page"]:
                out += self._take(key[0], page, p)
        self.progress.update(tuple(p[n] for n in _NAMES))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT_SCHEMA.split(", ")])

    def _take(self, source: str, page, p: dict) -> list[tuple]:
        """One page: its new rows and the progress behind it."""
        stored, found = [], [] if page.rows is None else list(page.rows)
        if isinstance(page.error, str):
            p["stop_reason"] = "provider_error"
        else:
            fresh, here = [], set()
            for row in found:
                if row["id"] in here or self.seen.containsKey((row["id"],)):
                    p["duplicates"] += 1
                else:
                    here.add(row["id"])
                    fresh.append(row)
            room = self.max_records - p["run_records"]
            cut, fresh = len(fresh) > room, fresh[:room]
            p["run_pages"] += 1
            p["pages_fetched"] += 1
            p["records_seen"] += len(found)
            if any(row["payload"] is None for row in fresh):
                p["stop_reason"] = "canonicalization_error"
            else:
                for row in fresh:
                    self.seen.updateValue((row["id"],), (page.page,))
                stored = fresh
                for n in ("records_saved", "known", "run_records"):
                    p[n] += len(fresh)
                p["next_page"] += 0 if cut else 1
                reached = page.total is not None and page.total == page.total and 0 < page.total <= p["known"]
                ended = page.is_complete is True or page.is_complete == 1 or reached
                p["stop_reason"] = (
                    "no_results" if not found else "max_records" if cut else "provider_complete" if ended else "repeated_page" if not fresh
                    else "max_records" if p["run_records"] >= self.max_records else "max_pages" if p["run_pages"] >= self.max_pages else None
                )
                p["complete"] = p["stop_reason"] in ("no_results", "provider_complete")
        counted = (p["next_page"], p["pages_fetched"], p["records_seen"], p["records_saved"], p["duplicates"], p["complete"], p["stop_reason"])
        return [(source, page.run, page.page, row["id"], row["payload"], *[None] * 7) for row in stored] + [(source, page.run, page.page, None, None, *counted)]


def collect_pages(spark: SparkSession, folder: str, out: str, checkpoint: str, max_pages: int = 100, max_records: int = 10_000, first_page: int = 1) -> None:
    """Take in all page files of ``folder`` not seen by this checkpoint; what they give is appended to ``out``."""
    if max_pages < 1 or max_records < 1:
        raise ValueError("max_pages and max_records must be positive")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        pages = spark.readStream.schema(PAGE_SCHEMA).parquet(folder)
        taken = pages.groupBy("source").transformWithStateInPandas(Collector(max_pages, max_records, first_page), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="None")
        query = taken.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)


def stored(spark: SparkSession, out: str) -> DataFrame:
    """The rows stored so far."""
    return spark.read.schema(OUT_SCHEMA).parquet(out).filter("id is not null").select("source", "run", "page", "id", "payload")


def progress(spark: SparkSession, out: str) -> DataFrame:
    """The last progress of each source."""
    rows = spark.read.schema(OUT_SCHEMA).parquet(out).filter("id is null").drop("id", "payload")
    last = rows.groupBy("source").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "source")), F.struct("run", "pages_fetched", "page")).alias("p"))
    return last.select("source", "p.*")


def due(pages: DataFrame, done: DataFrame) -> DataFrame:
    """The pages that a next run asks for: those from each incomplete source's next page on; all of a source not begun."""
    known = done.select(F.col("source").alias("__source"), "next_page", "complete")
    joined = pages.join(known, F.col("source") == F.col("__source"), "left")
    return joined.filter("__source is null or (not complete and page >= next_page)").select(*pages.columns)
