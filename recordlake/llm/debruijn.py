"""Substring deduplication by de Bruijn compaction.

Every run of ``width`` words is an edge between two (width - 1)-word nodes. Only edges that may occur
twice are made: each edge is filed under its minimizer (the least hash of its ``seed`` -word parts), and
equal edges have equal minimizers, so edges whose minimizer occurs once are left out. The rest meet by
128-bit hash; a repeated edge gets the coordinate of an earlier occurrence as source.

An edge's nodes are known by coordinate: the document's position, on the line to its source (source minus
document position). A full outer join of the edges that leave a node with those that enter it gives both
degrees. Where document and source go on alike, one edge enters and one leaves: the node is inner and
compacts away. Where they part or one of them ends, the node has other edges on the source's side, and the
path begins or ends there. What is left are the ends of nonbranching paths (document, start, edges, source
document, source start). The words of every path are compared with those at its source coordinate, by
SHA-256; a path that differs is no repeat. Paths are joined back to the texts.

First means smaller id, or same id and smaller start. Equal rows count as one document; where one id
holds different texts, each is a document of its own, in order of the texts' hashes. Rows with a null id
are kept whole and are nobody's source. Ids are integers; other types are refused. Null or empty texts
have no words. An empty table gives an empty result. A kept column named like an output comes out with
an underscore behind its name, other columns are ignored.

No group is gathered: a batch settles among itself all but its first occurrence of an edge or minimizer,
so a key that occurs everywhere reaches the exchange once a batch. Behind an exchange Spark sorts the
rows, and a task reads them as a stream that remembers the first row of the current key, or the rows of
the current document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.llm.scratch import bound_batches, discard, free_name, integer_key, materialize, tidy
from recordlake.llm.wordcode import SPACE_WORDS, mix, range_hashes, slices, split_words, window_hashes

WIDTH, SEED = 20, 8
#: A text with more spans than this is digested in so many groups.
MANY_SPANS, SPAN_GROUPS = 1_000, 64
_ONLY = 31


def sliding_least(a: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` consecutive values."""
    if len(a) < size:
        return a[:0]
    have = 1
    while have * 2 <= size:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (size - have)], a[size - have :]) if have < size else a


def _edge_mask(first: np.ndarray, width: int) -> np.ndarray:
    """Which positions begin ``width`` words of one text."""
    sizes = np.diff(first)
    total = int(first[-1])
    left = np.repeat(first[1:], sizes) - np.arange(total)
    return left >= width


def _minimizers(width: int, seed: int):
    """Runs of edges with one minimizer: (minimizer, sure, id, start << 31 | edges).

    Runs known to repeat are sure (2) and dealt evenly instead; 1 marks the first of a batch's repeated ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            found = []
            for at, part in slices(batch.column(1)):
                words = split_words(part, SPACE_WORDS, lower=False)
                valid = _edge_mask(words.first, width)
                seeds = window_hashes(words.hashes(), seed)
                least = sliding_least(seeds, width - seed + 1)
                place = np.flatnonzero(valid[: len(least)])
                owner = words.owner()[place]
                least = least[place]
                # a run has one minimizer at one place: it also ends where the least part is the edge's first
                ends = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (seeds[place] == least)[:-1]
                new = np.flatnonzero(np.concatenate([[True], ends])) if len(place) else place
                count = np.diff(np.append(new, len(place)))
                found.append((least[new], ids[at + owner[new]], place[new] - words.first[owner[new]], count))
            if not found:
                continue
            least, doc, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(least, kind="stable")
            least, doc, where = least[order], doc[order], (start << _ONLY | count)[order]
            again = np.concatenate([[False], least[1:] == least[:-1]]) if len(least) else np.zeros(0, bool)
            more = np.append(again[1:], False) if len(least) else again
            sure = np.where(again, 2, np.where(more, 1, 0)).astype(np.int32)
            key = np.where(again, mix(doc.view(np.uint64) + where.view(np.uint64)), least)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sure), pa.array(doc), pa.array(where)], ["key", "sure", "id", "at"])

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by its first one, cut where a document ends."""
    held: list[np.ndarray] = []
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if len(columns[0]) == 0:
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [c[cut:] for c in columns]
        if cut:
            yield [c[:cut] for c in columns]
    if held:
        yield held


def _repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs whose minimizer occurs again, of a stream sorted by key."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    told = np.zeros(0, bool)  # whether the row held is already out
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        settled = columns[1] == 2
        key, sure, ids, at = (np.concatenate([h, c[~settled]]) for h, c in zip(held, columns, strict=True))
        same = key[1:] == key[:-1]
        keep = (np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(key) else np.zeros(0, bool)) | (sure == 1)
        new = keep.copy()
        new[: len(told)] &= ~told
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[settled], y[new]])) for x, y in zip(columns[2:], (ids, at), strict=True)], ["id", "at"])
        held, told = [x[-1:] for x in (key, sure, ids, at)], keep[-1:]


def _merge_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per id the regions of edges ``[start, stop, ...]``, adjoining ones merged; sorted by id and start."""
    for ids, at in _by_document(batches):
        start = at >> _ONLY
        yield from _spans_of(ids, start, start + (at & (2**_ONLY - 1)), "regions")


def _spans_of(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """Unions of intervals that are sorted by id and start, flat, one row per id."""
    border = np.concatenate([[True], ids[1:] != ids[:-1]])
    group = np.cumsum(border) - 1
    shift = group * np.int64(1 << 40)  # apart from one another, so that one running maximum serves all
    reach = np.maximum.accumulate(stop + shift)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]]))
    last = np.append(new[1:], len(ids)) - 1
    flat = np.column_stack([start[new], reach[last] - shift[last]]).ravel()
    owner = ids[new]
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    offsets = np.append(cut, len(new)) * 2
    yield pa.RecordBatch.from_arrays([pa.array(owner[cut]), pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.int64()))], ["id", name])


def _compact(doc: np.ndarray, pos: np.ndarray, size: np.ndarray, source: np.ndarray, source_pos: np.ndarray) -> list[np.ndarray]:
    """Joins pieces that follow one another in the document and in the source."""
    order = np.lexsort((pos, doc))
    doc, pos, size, source, source_pos = (x[order] for x in (doc, pos, size, source, source_pos))
    if not len(doc):
        return [doc, pos, size, source, source_pos]
    follows = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1]) & (pos[1:] == pos[:-1] + size[:-1]) & (source_pos[1:] == source_pos[:-1] + size[:-1])
    new = np.flatnonzero(np.concatenate([[True], ~follows]))
    last = np.append(new[1:], len(doc)) - 1
    return [doc[new], pos[new], pos[last] + size[last] - pos[new], source[new], source_pos[new]]


_EDGE_SCHEMA = "h1 long, h2 long, id long, pos long, size long, source long, source_pos long"
_LINE_SCHEMA = "id long, source long, line long, pos long, stop long"
_LINE = ["id", "source", "line"]


def _edge_batch(h1, h2, doc, pos, size, source, source_pos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (h1, h2, doc, pos, size, source, source_pos)], _EDGE_SCHEMA.replace(" long", "").split(", "))


def _edges(width: int):
    """Edges of the regions: first occurrences in the batch stay open (size 0), others become paths at once, dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            found = []
            for at, part in slices(batch.column(1)):
                words = split_words(part, SPACE_WORDS, lower=False)
                regions = batch.column(2).slice(at, len(part))
                flat = np.asarray(regions.flatten()).reshape(-1, 2)
                of = np.repeat(np.arange(len(part)), np.asarray(pa.compute.list_value_length(regions)) // 2)
                n = flat[:, 1] - flat[:, 0]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = inside + np.repeat(flat[:, 0], n)
                of = np.repeat(of, n)
                where = pos + words.first[of]
                one, two = (window_hashes(range_hashes(words.data, words.start, words.end, which), width, which)[where] for which in (0, 1))
                found.append((one, two, ids[at + of], pos))
            if not found:
                continue
            h1, h2, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((pos, doc, h2, h1))
            h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
            again = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]) if len(h1) else np.zeros(0, bool)
            lead = np.flatnonzero(~again)
            none = np.zeros(len(lead), np.int64)
            yield _edge_batch(h1[lead], h2[lead], doc[lead], pos[lead], none, none, none)
            head = lead[np.cumsum(~again) - 1] if len(h1) else lead
            rest = np.flatnonzero(again & ((doc != doc[head]) | (pos != pos[head])))
            path = _compact(doc[rest], pos[rest], np.ones(len(rest), np.int64), doc[head[rest]], pos[head[rest]])
            none = np.zeros(len(path[0]), np.int64)
            yield _edge_batch(mix(path[0].view(np.uint64) + path[1].view(np.uint64)), none, *path)

    return run


def _close_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated edges and paths on the line to their source, of a stream sorted by hash, document and position."""
    head = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        done = columns[4] > 0
        h1, h2, doc, pos = (np.concatenate([h, c[~done]]) for h, c in zip(head, columns, strict=False))
        first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, bool)
        of = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h1) else np.zeros(0, np.int64)
        rest = np.flatnonzero((doc != doc[of]) | (pos != pos[of]))
        of_rest = of[rest]
        ids, at, size, source, source_at = (
            np.concatenate([c[done], late])
            for c, late in zip(columns[2:], (doc[rest], pos[rest], np.ones(len(rest), np.int64), doc[of_rest], pos[of_rest]), strict=True)
        )
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, source, source_at - at, at, at + size)], _LINE_SCHEMA.replace(" long", "").split(", "))
        head = [x[of[-1:]] for x in (h1, h2, doc, pos)]


def _compacted(edges: DataFrame) -> DataFrame:
    """Maximal paths of edges ``pos`` to ``stop`` that follow one another on a line."""
    leaves = edges.select(*_LINE, F.col("pos").alias("node"), F.lit(True).alias("leaves"))
    enters = edges.select(*_LINE, F.col("stop").alias("node"), F.lit(True).alias("enters"))
    ends = leaves.join(enters, [*_LINE, "node"], "full_outer").filter("leaves IS NULL OR enters IS NULL")
    stop = F.lead("node").over(Window.partitionBy(*_LINE).orderBy("node"))
    paths = ends.withColumn("stop", stop).filter("leaves")
    return paths.select("id", F.col("node").alias("pos"), (F.col("stop") - F.col("node")).alias("size"), "source", (F.col("line") + F.col("node")).alias("source_pos"))


def _row_texts(df: DataFrame, key: str, text: str, keep: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """id and text of the rows with the columns of ``keep`` under new names; and each document once, without null ids.

    Where one id holds different texts, rows are numbered anew so that each text has its own id, in order of ids and the texts' hashes.
    """
    whole = F.col(text).cast("string")
    texts = df.select(*(F.col(c).alias(n) for c, n in (keep or {}).items()), integer_key(df, key).alias("id"), whole.alias("__text"), F.xxhash64(whole).alias("__mark"))
    seen = texts.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), (F.min("__mark") != F.max("__mark")).alias("unlike"))
    most = seen.agg(F.max("n").alias("n"), F.max("unlike").alias("unlike")).first()
    if most["unlike"]:
        distinct = texts.filter("id is not null").select("id", "__mark").distinct()
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = distinct.repartitionByRange(partitions, "id", "__mark").sortWithinPartitions("id", "__mark")
        own = materialize(ordered.withColumn("__row", F.monotonically_increasing_id()), "rows")  # numbers in order of id and text, whatever the ids' size
        texts = texts.join(own, ["id", "__mark"], "left").withColumn("id", F.col("__row")).drop("__row")
    texts = texts.drop("__mark")
    documents = texts.filter("id is not null").select("id", "__text")
    return texts, documents.dropDuplicates(["id"]) if (most["n"] or 0) > 1 else documents


def repeated_paths(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, pos, size, source, source_pos): compacted paths of repeated edges; positions count words, size counts edges."""
    return _paths(_row_texts(df, key, text)[1], width, seed)


def _paths(documents: DataFrame, width: int, seed: int) -> DataFrame:
    if not 1 <= seed <= width:
        raise ValueError("the minimizer's length is from 1 to the width")
    bound_batches(documents.sparkSession)
    texts = documents.withColumnRenamed("__text", "text")
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = texts.mapInArrow(tidy(_minimizers(width, seed)), "key long, sure int, id long, at long")
    repeated = materialize(runs.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(tidy(_repeated_runs), "id long, at long"), "runs")
    regions = materialize(repeated.repartition(partitions, "id").sortWithinPartitions("id", "at").mapInArrow(tidy(_merge_regions), "id long, regions array<long>"), "regions")
    edges = texts.join(regions, "id").select("id", "text", "regions").mapInArrow(tidy(_edges(width)), _EDGE_SCHEMA)
    closed = materialize(edges.repartition(partitions, "h1").sortWithinPartitions("h1", "h2", "id", "pos").mapInArrow(tidy(_close_edges), _LINE_SCHEMA), "closed")
    paths = materialize(_compacted(closed), "paths")
    discard(repeated, regions, closed)
    return paths


def _removed_spans(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, start, size in _by_document(batches):
            yield from _spans_of(ids, start, start + size + width - 1, "spans")

    return run


def _keep(n_keep: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            spans = batch.column(n_keep + 1).to_pylist()
            for at, part in slices(batch.column(n_keep)):
                words = split_words(part, SPACE_WORDS, lower=False)
                body = words.data.tobytes()
                for i in range(len(part)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    keep = np.ones(b - a, bool)
                    cuts = spans[at + i] or []
                    for low, high in zip(cuts[::2], cuts[1::2], strict=True):
                        keep[low:high] = False
                    left = np.flatnonzero(keep) + a
                    kept = b" ".join([body[x:y] for x, y in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)])
                    n_words.append(b - a)
                    n_removed.append(b - a - len(left))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept.decode())
            columns = [*batch.columns[:n_keep], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = [*batch.schema.names[:n_keep], "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row: key, ``keep`` columns, n_words, n_removed, kept_sha256 and, if asked for, the kept words by single spaces."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [key, *(c for c in keep if c != key)]
    names = {c: f"__k{i}" for i, c in enumerate(kept)}
    texts, documents = _row_texts(df, key, text, names)
    found = _paths(documents, width, seed)
    paths = materialize(_verified(documents, found, width), "verified")
    spans = materialize(paths.select("id", "pos", "size").repartition(partitions, "id").sortWithinPartitions("id", "pos").mapInArrow(tidy(_removed_spans(width)), "id long, spans array<long>"), "spans")
    discard(found, paths)
    joined = texts.join(spans, "id", "left").select(*names.values(), "__text", "spans")
    fields = ", ".join([*(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in names.items()), "n_words long, n_removed long, kept_sha256 string"])
    out = joined.mapInArrow(tidy(_keep(len(kept), with_text)), fields + ", kept_text string" * with_text)
    outputs = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    return out.withColumnsRenamed({n: free_name(c, outputs) for c, n in names.items()})


def _digests(width: int):
    """SHA-256 of the words of every piece ``pos, size``, flat in one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = np.asarray(batch.column(0)), batch.column(2).to_pylist()
            for at, part in slices(batch.column(1)):
                words = split_words(part, SPACE_WORDS, lower=False)
                body = words.data.tobytes()
                rows = []
                for i in range(len(part)):
                    a = int(words.first[i])
                    for pos, size in zip(pieces[at + i][::2], pieces[at + i][1::2], strict=True):
                        low, high = a + pos, a + pos + size + width - 1
                        joined = b" ".join([body[x:y] for x, y in zip(words.start[low:high].tolist(), words.end[low:high].tolist(), strict=True)])
                        rows.append((ids[at + i], pos, size, hashlib.sha256(joined).digest()))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["id", "pos", "size", "digest"])

    return run


def _verified(documents: DataFrame, paths: DataFrame, width: int) -> DataFrame:
    """The paths whose words equal those at the source coordinate.

    Each span of a text is digested once, however many paths name it; a text with very many spans gets
    them in several rows.
    """
    spans = paths.select("id", "pos", "size").union(paths.select("source", "source_pos", "size")).distinct()
    group = F.pmod(F.xxhash64("pos", "size"), F.lit(SPAN_GROUPS))
    counts = spans.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    dealt = spans.join(counts, "id").withColumn("part", F.when(F.col("n") > MANY_SPANS, group).otherwise(0))
    pieces = materialize(dealt.groupBy("id", "part").agg(F.flatten(F.collect_list(F.array("pos", "size"))).alias("pieces")).drop("part"), "pieces")
    joined = documents.join(pieces, "id").select("id", "__text", "pieces")
    digests = materialize(joined.mapInArrow(tidy(_digests(width)), "id long, pos long, size long, digest binary"), "digests")
    here = paths.join(digests, ["id", "pos", "size"])
    there = digests.select(F.col("id").alias("source"), F.col("pos").alias("source_pos"), "size", F.col("digest").alias("wanted"))
    return here.join(there, ["source", "source_pos", "size"]).filter("digest = wanted").select(paths.columns)


def verify_paths(df: DataFrame, paths: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Paths whose words equal those at the source coordinate, compared by SHA-256."""
    return _verified(_row_texts(df, key, text)[1], paths, width)
