"""Product codes of vectors: integer codebooks by Lloyd rounds with Hamerly's bounds.

Vectors become integers ``floor(scale * x)`` and are cut into equal consecutive parts. Each part position
has a codebook; a round assigns every part to the nearest entry (squared distance, ties to the lower index)
and replaces each entry by the floor of its parts' mean. A part's state is its entry, an upper bound of the
distance to it and a lower bound of the distance to any other. Entries move, so bounds are widened by the
moves; a part whose upper bound lies strictly below its lower bound, or below half the gap between its entry
and the nearest other one, keeps its entry. The others measure their own entry's distance, and only where
that doesn't settle it all distances. Distances are integers, bounds are rounded outwards, so the result
equals a full scan's.

Vectors travel in blocks of about 1 MB, with their state and the block's sums by entry; a round reads one
written table and writes the next. Only codebooks (parts x entries x part length) reach the driver.

Rows whose vector is null or holds a null, NaN or infinite component are left out. Rows without an id count as
the largest ids; equal ids are ordered by their vectors. Repeated rows count each. Fewer rows than entries
make as many entries as there are rows. An empty table gives no rows. Vectors of unequal lengths, of a length
that the parts don't divide, or too large for exact 64-bit distances stop with a ``ValueError``. Kept columns
that are named like an output get an underscore behind their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.scratch import discard, free_name, materialize, tidy

BLOCK_BYTES = 1 << 20
#: Bounds are widened by this share at each step, far above a double's rounding.
SLACK = 1e-12
STATE = "ints binary, nearest binary, upper binary, lower binary, counts binary, sums binary, scans long"
OUTPUTS = ["code", "error"]


@dataclass
class Codebooks:
    """``entries[part, entry, position]``; ``moves`` by the last round."""

    entries: np.ndarray
    scale: int
    moves: np.ndarray = field(default=None)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.entries.shape

    def replaced(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries by count and sums of their parts; unused ones stay."""
        made = self.entries.copy()
        for (part, entry), (count, total) in sums.items():
            made[part, entry] = [int(s) // count for s in total]
        squares = ((made - self.entries) ** 2).sum(2)
        return Codebooks(made, self.scale, np.sqrt(squares.astype(float)) * (1 + SLACK))

    def half_gaps(self) -> np.ndarray:
        """Half the distance of each entry to its nearest other one, rounded down."""
        out = np.full(self.shape[:2], np.inf)
        for p, book in enumerate(self.entries):
            square = ((book[:, None] - book) ** 2).sum(2).astype(float)
            np.fill_diagonal(square, np.inf)
            out[p] = np.sqrt(square.min(1)) / 2 * (1 - SLACK) if len(book) > 1 else np.inf
        return out


def largest_component(width: int) -> int:
    """Components up to this have squared distances below 2**62 over ``width`` positions."""
    return min((1 << 30) - 1, isqrt((1 << 60) // max(1, width)))


def quantize(vectors: pa.Array, length: int, scale: int, limit: int) -> np.ndarray:
    """Rows of integers of a null-free list<double> array."""
    sizes = np.diff(vectors.offsets.to_numpy())
    if np.any(sizes != length):
        raise ValueError(f"vectors of {set(sizes.tolist())} components, not {length}")
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale))
    if np.any(np.abs(scaled) > limit):
        raise ValueError(f"a component exceeds {limit} after scaling")
    return scaled.astype(np.int64).reshape(len(sizes), length)


def _distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts to all entries."""
    return (parts**2).sum(1)[:, None] - 2 * parts @ book.T + (book**2).sum(1)


def assign(parts: np.ndarray, book: np.ndarray, half_gap: np.ndarray, moves: np.ndarray | None, nearest: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring the state of one part position up to date in place; returns the parts that were scanned."""
    if moves is None:
        doubtful = np.arange(len(parts))
    else:
        order = np.argsort(-moves)
        others = np.full(len(moves), moves[order[0]])
        others[order[0]] = moves[order[1]] if len(order) > 1 else 0.0
        upper[:] = (upper + moves[nearest]) * (1 + SLACK)
        lower[:] = np.maximum(0.0, (lower - others[nearest]) * (1 - SLACK) - SLACK)
        doubtful = np.flatnonzero(upper >= np.maximum(lower, half_gap[nearest]))
        own = ((parts[doubtful] - book[nearest[doubtful]]) ** 2).sum(1)
        upper[doubtful] = np.sqrt(own.astype(float)) * (1 + SLACK)
        doubtful = doubtful[upper[doubtful] >= np.maximum(lower, half_gap[nearest])[doubtful]]
    if len(doubtful):
        all_squares = _distances(parts[doubtful], book)
        best = all_squares.argmin(1)
        rows = np.arange(len(doubtful))
        nearest[doubtful] = best
        upper[doubtful] = np.sqrt(all_squares[rows, best].astype(float)) * (1 + SLACK)
        if len(book) > 1:
            all_squares[rows, best] = np.iinfo(np.int64).max
            lower[doubtful] = np.sqrt(all_squares.min(1).astype(float)) * (1 - SLACK)
        else:
            lower[doubtful] = np.inf
    return len(doubtful)


class _Block:
    """Vectors of one block with the state of their parts."""

    def __init__(self, ints: np.ndarray, books: Codebooks, state: tuple[np.ndarray, ...] | None = None):
        self.n, (self.parts, self.entries, self.width) = len(ints), books.shape
        self.books, self.ints = books, ints.reshape(self.n, self.parts, self.width)
        size = (self.parts, self.n)
        self.fresh = state is None
        self.nearest, self.upper, self.lower = state or (np.zeros(size, np.int32), np.zeros(size), np.zeros(size))

    @classmethod
    def read(cls, row: dict, books: Codebooks) -> _Block:
        parts, _, width = books.shape
        ints = np.frombuffer(row["ints"], "<i4").astype(np.int64).reshape(-1, parts * width)
        size = (parts, len(ints))
        state = (np.frombuffer(row["nearest"], "<i4").reshape(size).copy(), *(np.frombuffer(row[c], "<f8").reshape(size).copy() for c in ("upper", "lower")))
        return cls(ints, books, state)

    def assign(self) -> int:
        gaps, moves = self.books.half_gaps(), self.books.moves
        return sum(assign(self.ints[:, p], self.books.entries[p], gaps[p], None if self.fresh else moves[p], self.nearest[p], self.upper[p], self.lower[p]) for p in range(self.parts))

    def row(self, scans: int) -> list:
        counts, sums = np.zeros((self.parts, self.entries), np.int64), np.zeros((self.parts, self.entries, self.width), np.int64)
        for p in range(self.parts):
            counts[p] = np.bincount(self.nearest[p], minlength=self.entries)
            np.add.at(sums[p], self.nearest[p], self.ints[:, p])
        return [self.ints.astype("<i4").tobytes(), self.nearest.astype("<i4").tobytes(), self.upper.astype("<f8").tobytes(), self.lower.astype("<f8").tobytes(), counts.astype("<i8").tobytes(), sums.astype("<i8").tobytes(), scans]

    def errors(self) -> np.ndarray:
        found = np.zeros(self.n, np.int64)
        for p in range(self.parts):
            found += ((self.ints[:, p] - self.books.entries[p][self.nearest[p]]) ** 2).sum(1)
        return found


_STATE_KINDS = [pa.binary()] * 6 + [pa.int64()]
_STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _state_batch(kept: pa.Array, block: _Block) -> pa.RecordBatch:
    values = [pa.array([v], k) for v, k in zip(block.row(block.assign()), _STATE_KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([kept, *values], ["kept", *_STATE_NAMES])


def _begin(books: Codebooks, keep: list[str]):
    """Blocks with the first assignment, from rows of kept columns and a vector."""
    parts, _, width = books.shape
    length, limit = parts * width, largest_component(width)
    rows = max(1, BLOCK_BYTES // max(4, 4 * length + 20 * parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                kept = pa.StructArray.from_arrays(part.columns[:-1], names=keep)
                listed = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), kept)
                yield _state_batch(listed, _Block(quantize(part.column(len(keep)), length, books.scale, limit), books))

    return run


def _rounds(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield _state_batch(row.column(0), _Block.read(row.select(_STATE_NAMES[:4]).to_pylist()[0], books))

    return run


def _finish(books: Codebooks, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = _Block.read(row.select(_STATE_NAMES[:4]).to_pylist()[0], books)
                block.assign()
                kept = row.column(0).flatten()
                codes = pa.array([c.tobytes() for c in block.nearest.T.astype("<u2" if block.entries > 256 else "u1")], pa.binary())
                yield pa.RecordBatch.from_arrays([*kept.flatten(), codes, pa.array(block.errors(), pa.int64())], [*keep, *OUTPUTS])

    return run


def _sums(parts: int, entries: int, width: int):
    """One row per part position and used entry of all blocks of a task: count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, object), np.zeros((parts * entries, width), object)
        for batch in batches:
            for c, s in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                counts += np.frombuffer(c, "<i8")
                sums += np.frombuffer(s, "<i8").reshape(-1, width)
        used = [i for i in range(parts * entries) if counts[i]]
        at = pa.array(used, pa.int32())
        yield pa.RecordBatch.from_arrays([at, pa.array([str(counts[i]) for i in used], pa.string()), pa.array([list(map(str, sums[i])) for i in used], pa.list_(pa.string()))], ["slot", "n", "total"])

    return run


def _entry_sums(state: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Counts and sums by part position and entry: added up in tasks, then by Spark, in exact decimals."""
    parts, entries, width = books.shape
    number = "decimal(38,0)"
    partial = state.select("counts", "sums").mapInArrow(tidy(_sums(parts, entries, width)), "slot int, n string, total array<string>")
    totals = [F.sum(F.col("total")[i].cast(number)).alias(f"t{i}") for i in range(width)]
    rows = partial.groupBy("slot").agg(F.sum(F.col("n").cast(number)).alias("n"), *totals).collect()
    return {divmod(r["slot"], entries): (int(r["n"]), [int(r[f"t{i}"]) for i in range(width)]) for r in rows}


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and finite, with the vector as doubles."""
    v = F.col(vector).cast("array<double>")
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vector).isNotNull()).withColumn(vector, v).filter(~F.coalesce(broken, F.lit(True)))


def first_codebooks(df: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the ``entries`` vectors of smallest key; ``None`` without vectors."""
    first = usable(df, vector).select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["v"])
    if length % parts:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts")
    width = length // parts
    made = quantize(pa.array([r["v"] for r in first], pa.list_(pa.float64())), length, scale, largest_component(width))
    return Codebooks(made.reshape(len(first), parts, width).transpose(1, 0, 2).copy(), scale)


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, scans: list[int] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """Codes and errors of all usable rows with the final codebooks.

    The rows hold the ``keep`` columns (the key, unless told otherwise), ``code`` (entries by part, a byte each, or
    two beyond 256 entries) and ``error``. ``scans``, if given, gets the number of fully scanned parts of each round.
    """
    keep = [key] if keep is None else keep
    names = [free_name(c, OUTPUTS) for c in keep]
    kinds = [df.schema[c].dataType.simpleString() for c in keep]
    out = ", ".join([*(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)), "code binary, error long"])
    books = first_codebooks(df, key, vector, parts, entries, scale)
    if books is None:
        return df.sparkSession.createDataFrame([], out), None
    inner = [f"c{i}" for i in range(len(keep))]
    kept = "kept array<struct<" + ", ".join(f"{n}: {k}" for n, k in zip(inner, kinds, strict=True)) + ">>"
    rows = usable(df, vector).select(*(F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)), F.col(vector).alias("v"))
    state = materialize(rows.mapInArrow(tidy(_begin(books, inner)), f"{kept}, {STATE}"), "parts")
    for number in range(rounds):
        if scans is not None:
            scans.append(state.agg(F.sum("scans")).first()[0] or 0)
        books = books.replaced(_entry_sums(state, books))
        if number + 1 < rounds:
            after = materialize(state.mapInArrow(tidy(_rounds(books)), f"{kept}, {STATE}"), "parts")
            discard(state)
            state = after
    return state.mapInArrow(tidy(_finish(books, names)), out), books


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Adds ``vector``, the components that the codes stand for; a null code has none."""
    parts, entries, _ = books.shape
    values = F.array(*(F.array(*(F.array(*(F.lit(int(x) / books.scale) for x in entry)) for entry in book)) for book in books.entries))
    wide = 2 if entries > 256 else 1
    byte = lambda at: F.conv(F.hex(F.substring(F.col(code), at + 1, 1)), 16, 10).cast("int")
    chosen = [byte(p) if wide == 1 else byte(2 * p) + 256 * byte(2 * p + 1) for p in range(parts)]
    return codes.withColumn("vector", F.when(F.col(code).isNotNull(), F.flatten(F.array(*(values[p][c] for p, c in enumerate(chosen))))))
