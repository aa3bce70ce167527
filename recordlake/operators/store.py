"""Record store over Parquet snapshots: filters, pages, statistics, runs and upserts."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.functions.dates import normalize_date

FILTERS = ("kind", "source", "court", "case_number", "subject", "rapporteur", "decision_type", "precedent_type", "canonical_key")


LINK_SCHEMA = "run_id string, kind string, record_id string, canonical_key string"
LINK_COLUMNS = [f.split()[0] for f in LINK_SCHEMA.split(", ")]
RUN_SCHEMA = "id string, source string, text string, query string, label string, record_count long, created_at string"


class InvalidFilterError(ValueError):
    """A filter that the store doesn't know, or a date it can't read."""


def iso_filter_date(spark: SparkSession, value: str) -> str:
    found = spark.range(1).select(normalize_date(F.lit(value)).alias("d")).first()["d"]
    if found is None:
        raise InvalidFilterError(f"not a date: {value}")
    return found


def predicate(date_from: str | None = None, date_to: str | None = None, **filters: str | None) -> Column:
    """Equality on each given filter and an inclusive range of publication dates; empty values are ignored."""
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise InvalidFilterError(f"unknown filters: {', '.join(sorted(unknown))}")
    tests = [F.col(k) == v for k, v in filters.items() if v]
    tests += [F.col("publication_date") >= date_from] * bool(date_from) + [F.col("publication_date") <= date_to] * bool(date_to)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def query_records(records: DataFrame, limit: int = 20, offset: int = 0, **filters: str | None) -> DataFrame:
    page = records.filter(predicate(**filters)).orderBy(F.desc("publication_date"), F.desc("updated_at"), F.asc("id"))
    return page.offset(max(0, offset)).limit(max(1, limit))


def list_records(records: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return records.orderBy(F.desc("updated_at"), F.asc("id")).offset(max(0, offset)).limit(max(1, limit))


def count_records(records: DataFrame, **filters: str | None) -> DataFrame:
    return records.filter(predicate(**filters)).agg(F.count(F.lit(1)).alias("total"))


def stats(records: DataFrame) -> DataFrame:
    """Totals over all, by kind and by source in one pass; records without a kind or source have no group."""
    cube = records.groupingSets([[], ["kind"], ["source"]], "kind", "source").agg(F.count(F.lit(1)).alias("total"), F.grouping_id().alias("level"))
    named = cube.select(F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "kind").otherwise("source").alias("grouping"), F.when(F.col("level") == 1, F.col("kind")).when(F.col("level") == 2, F.col("source")).alias("name"), "total")
    return named.filter((F.col("grouping") == "all") | F.col("name").isNotNull())


def run_records(links: DataFrame, records: DataFrame, run_id: Column, limit: int, offset: int = 0) -> DataFrame:
    """Records linked to a run; a link whose record is gone is dropped."""
    joined = links.filter(F.col("run_id") == run_id).select("canonical_key").distinct().join(records, "canonical_key")
    return joined.orderBy(F.desc("publication_date"), F.desc("updated_at"), F.asc("id")).offset(max(0, offset)).limit(max(1, limit))


def count_run_records(links: DataFrame, run_id: Column) -> DataFrame:
    """Distinct links of a run, with or without a record."""
    return links.filter(F.col("run_id") == run_id).agg(F.countDistinct("canonical_key").alias("total"))


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.asc("id"))


def list_manifests(manifests: DataFrame) -> DataFrame:
    return manifests.orderBy(F.desc("synced_at"), F.asc("source"), F.asc("dataset_id"), F.asc("resource_id"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New snapshot: per key the row of largest ``order`` (incoming before existing), ``created_at`` of the oldest."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*existing.columns), F.struct("__new", order))
    kept = both.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys)).agg(last.alias("r"), F.min("created_at").alias("__born"))
    return kept.select(*(F.col("__born").alias(c) if c == "created_at" else F.col(f"r.{c}") for c in existing.columns))


def upsert_records(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert by (kind, id) or canonical key; the later of incoming rows wins.

    Returns the new snapshot and the conflicts: incoming rows that match one stored row by id and
    another by key, which are not stored.
    """
    rows = incoming.withColumn("__n", F.row_number().over(Window.partitionBy("canonical_key").orderBy(F.desc("position")))).filter("__n = 1").drop("__n")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("position")))).filter("__n = 1").drop("__n", "position")
    by_id = existing.select("kind", "id", F.col("canonical_key").alias("__key_of_id"), F.col("created_at").alias("__born_id"))
    by_key = existing.select("canonical_key", F.col("id").alias("__id_of_key"), F.col("created_at").alias("__born_key"))
    matched = rows.join(by_id, ["kind", "id"], "left").join(by_key, "canonical_key", "left")
    clash = F.col("__key_of_id").isNotNull() & F.col("__id_of_key").isNotNull() & (F.col("__key_of_id") != F.col("canonical_key"))
    clean = matched.filter(~clash)
    kept = existing.join(clean.select("canonical_key"), "canonical_key", "left_anti").join(clean.select("kind", "id"), ["kind", "id"], "left_anti")
    columns = existing.columns
    stored = clean.withColumn("created_at", F.coalesce("__born_key", "__born_id", "created_at")).select(*columns)
    return kept.select(*columns).unionByName(stored), matched.filter(clash).select(*columns)


def selector_upsert(memory: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Selector memory: approval once given stays, the last values win."""
    both = memory.unionByName(seen)
    return both.groupBy(*keys).agg(F.max("approved").alias("approved"), F.max(F.struct("position", "confidence", "matches")).alias("__last")).select(*keys, "approved", "__last.confidence", "__last.matches")


def selector_candidates(memory: DataFrame, limit: int = 20, approved_only: bool = False) -> DataFrame:
    rows = memory.filter("approved") if approved_only else memory
    return rows.orderBy(F.desc("approved"), F.desc("confidence"), F.asc("matches"), F.asc("id")).limit(limit)


def approve_selector(memory: DataFrame, id_: int) -> DataFrame:
    if memory.filter(F.col("id") == id_).isEmpty():
        raise KeyError(id_)
    return memory.withColumn("approved", F.col("approved") | (F.col("id") == id_))


def migrate(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Adds missing columns as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns})


# --- snapshots: a log of commits, each naming the tables of a version

class CommitConflictError(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Snapshot:
    """A committed version: its number in the log (-1 before the first) and the folder of each table."""

    spark: SparkSession
    root: str
    seq: int
    tables: dict[str, str]

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table, with the columns of ``schema`` that it lacks as nulls; a missing table is empty if it has a schema."""
        if name in self.tables:
            found = self.spark.read.parquet(self.tables[name])
            return found if schema is None else migrate(found, dict(f.split() for f in schema.split(", ")))
        if schema is None:
            raise KeyError(name)
        return self.spark.createDataFrame([], schema)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> Snapshot:
    """The last committed version."""
    folder, fs = _path(spark, f"{root}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    seq = max((int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n)), default=-1)
    if seq < 0:
        return Snapshot(spark, root, -1, {})
    path, fs = _path(spark, f"{root}/_commits/{seq:012d}.json")
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot(spark, root, seq, json.loads(text)["tables"])


def _publish(spark: SparkSession, root: str, seq: int, entry: dict) -> bool:
    """Put a commit into the log unless there is one of that number: written aside, then moved into place whole."""
    aside, fs = _path(spark, f"{root}/_commits/.{uuid.uuid4().hex}")
    target, _ = _path(spark, f"{root}/_commits/{seq:012d}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    try:
        if fs.getUri().getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())  # a local rename would replace
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(aside, False)


#: Tables that are laid out for lookups, and by what.
CLUSTERED = {"records": ["kind", "id"]}
BLOOM_NDV = 1_000_000


def write_clustered(df: DataFrame, keys: list[str], path: str) -> None:
    """Write ``df`` in ranges of its keys, sorted, with a Bloom filter of the last key, and beside it what each file holds."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write
    writer.option(f"parquet.bloom.filter.enabled#{keys[-1]}", "true").option(f"parquet.bloom.filter.expected.ndv#{keys[-1]}", str(BLOOM_NDV)).parquet(path)
    held = spark.read.schema(df.select(*keys).schema).parquet(path).groupBy(F.input_file_name().alias("file"))
    held.agg(*(f(k).alias(f"{n}_{k}") for k in keys for n, f in (("min", F.min), ("max", F.max))), F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}_files")


def lookup(snapshot: Snapshot, name: str, **values: str) -> tuple[DataFrame, list[str]]:
    """Rows of a clustered table with these key values, and the files that can hold them; no other file is opened."""
    spark, path = snapshot.spark, snapshot.tables[name]
    keys = CLUSTERED[name]
    if set(values) - set(keys):
        raise InvalidFilterError(f"{name} is laid out by {', '.join(keys)}")
    fits = [(F.col(f"min_{k}") <= v) & (F.col(f"max_{k}") >= v) for k, v in values.items()]
    index = spark.read.parquet(f"{path}_files")
    files = [r["file"] for r in index.filter(reduce(lambda a, b: a & b, fits, F.lit(True))).select("file").collect()]
    exact = reduce(lambda a, b: a & b, (F.col(k) == v for k, v in values.items()), F.lit(True))
    rows = spark.read.parquet(*files) if files else spark.read.parquet(path).limit(0)
    return rows.filter(exact), files


def save_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str, base: Snapshot | None = None) -> Snapshot:
    """Write tables as a version on top of ``base`` (the last one, unless given); its other tables stay as they are.

    If another commit came after ``base``, nothing is changed and ``CommitConflictError`` is raised.
    """
    base = latest(spark, root) if base is None else base
    paths = {name: f"{root}/{version}/{name}" for name in tables}
    for name, df in tables.items():
        if set(CLUSTERED.get(name, ["-"])) <= set(df.columns):
            write_clustered(df, CLUSTERED[name], paths[name])
        else:
            df.write.parquet(paths[name])
    after = base.tables | paths
    if not _publish(spark, root, base.seq + 1, {"version": version, "tables": after}):
        raise CommitConflictError(f"{root}: version {base.seq + 1} is there already")
    return Snapshot(spark, root, base.seq + 1, after)


def commit(spark: SparkSession, root: str, build: Callable[[Snapshot], dict[str, DataFrame]], attempts: int = 20) -> Snapshot:
    """Commit what ``build`` makes of the last version; after a conflict it is built anew on the newer one."""
    for _ in range(attempts):
        base = latest(spark, root)
        try:
            return save_snapshot(spark, build(base), root, uuid.uuid4().hex, base)
        except CommitConflictError:
            continue
    raise CommitConflictError(f"{root}: {attempts} attempts failed")


def load_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    return latest(spark, root).table(name)


def run_save(run: str, rows: DataFrame, run_row: DataFrame, record_schema: str) -> Callable[[Snapshot], dict[str, DataFrame]]:
    """A build for ``commit``: records upserted, the run and its links added, rows in conflict kept in ``conflicts``.

    ``rows`` are records with a ``position``; links are made for those that are stored.
    """
    columns = [f.split()[0] for f in record_schema.split(", ")]

    def build(base: Snapshot) -> dict[str, DataFrame]:
        merged, clash = upsert_records(base.table("records", record_schema).select(*columns), rows.select(*columns, "position"))
        marked = clash.withColumn("run_id", F.lit(run))
        linked = rows.select(F.lit(run).alias("run_id"), "kind", F.col("id").alias("record_id"), "canonical_key").distinct().join(clash.select("canonical_key"), "canonical_key", "left_anti")
        return {
            "records": merged, "links": base.table("links", LINK_SCHEMA).select(*LINK_COLUMNS).unionByName(linked.select(*LINK_COLUMNS)), "runs": base.table("runs", RUN_SCHEMA).unionByName(run_row, allowMissingColumns=True),
            "conflicts": base.table("conflicts", record_schema + ", run_id string").select(*columns, "run_id").unionByName(marked),
        }

    return build
