"""Benchmark decontamination with training suffix arrays.

Each shard of documents gets a suffix array over its words: suffixes that begin with a benchmark word
are sorted by tripling their ranks (1, 3, 9, 27 words), words that no test text has being one code.
Every test suffix is binary-searched in it, word by word, all at once, for all locations of its window;
each location's longest verbatim match, of any length, is then searched among all sorted test suffixes.

A window is ``width`` consecutive item words, or all words of a shorter item that has any. The test
texts are sent to the shards in blocks of bounded bytes, so a large test set takes more passes, not
more memory. Null or empty texts have no words; null ids are kept; rows that repeat are judged alike;
items with equal ids are told apart by nothing but their texts and count once; an item without an id hits
words, but names no item; empty tables leave documents unhit. A kept column named like an output comes
out with an underscore behind its name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.llm.scratch import free_memory, free_name, tidy
from recordlake.llm.wordcode import ALNUM_WORDS, mix, powers, slices, split_words

WIDTH = 10
BLOCK_BYTES = 8 << 20
#: Bytes of text of a shard, which gets one suffix array.
SHARD_BYTES = 2 << 20
OUTPUTS = ["n_words", "spans", "items", "longest"]


class Stretches:
    """Hashes of stretches of codes."""

    def __init__(self, codes: np.ndarray):
        self.up, self.down = powers(0, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64)) * self.up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


@dataclass
class TestSuffixes:
    """A block of test items as codes: ``codes[first[i]:first[i + 1]]`` are the words of item ``i``, all from 1 on.

    ``order`` holds all suffixes, each to its item's end, sorted.
    """

    items: list[str]
    vocabulary: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, items: list[str], texts: list[str | None]) -> TestSuffixes:
        hashes, first = [], [0]
        for _, part in slices(pa.array(texts, pa.large_string())):
            words = split_words(part, ALNUM_WORDS, lower=True)
            hashes.append(words.hashes())
            first += (words.first[1:] + first[-1]).tolist()
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        vocabulary = np.unique(flat)
        codes, first = np.searchsorted(vocabulary, flat) + 1, np.array(first)
        return cls(items, vocabulary, codes, first, sorted_suffixes(codes, first))

    def suffixes(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per suffix: its start, its item, and the length of the window it begins (0: none)."""
        sizes = np.diff(self.first)
        start = np.arange(len(self.codes))
        item = np.repeat(np.arange(len(sizes)), sizes)
        left = self.first[1:][item] - start
        window = np.where(left >= width, width, np.where((sizes[item] < width) & (left == sizes[item]), left, 0))
        return start, item, window


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes that begin with a test word, in order of their first 27 codes; ``codes`` ends with 27 zeros."""
    ranks, n = codes.astype(np.int64), len(codes)
    starts = np.flatnonzero(codes)
    reach = 1
    while reach < 27:
        top = np.int64(ranks.max() + 1)
        later = np.minimum(starts + reach, n - 1), np.minimum(starts + 2 * reach, n - 1)
        parts = ranks[starts], ranks[later[0]], ranks[later[1]]
        if int(top) ** 3 < 2**63:
            key = (parts[0] * top + parts[1]) * top + parts[2]
            order = np.argsort(key)
            differs = np.diff(key[order]) != 0
        else:
            order = np.lexsort(parts[::-1])
            differs = np.logical_or.reduce([np.diff(p[order]) != 0 for p in parts])
        dense = np.cumsum(np.concatenate([[1], differs])) if len(order) else order
        new = np.zeros(n, np.int64)
        new[starts[order]] = dense
        ranks, reach = new, reach * 3
    return starts[order]


def match_ranges(codes: np.ndarray, sa: np.ndarray, tests: TestSuffixes, start: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per test suffix the range of the suffix array that matches its whole window; empty where it doesn't match or has no window."""
    m = len(start)
    low, high = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    found_low, found_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    live = np.arange(m)
    for depth in range(int(window.max(initial=0))):
        live = live[window[live] > depth]
        if not len(live):
            break
        wanted = tests.codes[start[live] + depth]
        edge = []
        for right in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                have = codes[sa[np.minimum(mid, len(sa) - 1)] + depth]
                less = open_ & ((have <= wanted) if right else (have < wanted))
                a = np.where(less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            edge.append(a)
        keep = edge[1] > edge[0]
        live = live[keep]
        low[live], high[live] = edge[0][keep], edge[1][keep]
        whole = live[window[live] == depth + 1]
        found_low[whole], found_high[whole] = low[whole], high[whole]
    return found_low, found_high


def sorted_suffixes(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All suffixes of the items, each to its item's end, in order: ranks are doubled until they tell all apart or items end."""
    n, sizes = len(codes), np.diff(first)
    left = np.repeat(first[1:], sizes) - np.arange(n)
    ranks, reach = codes.astype(np.int64), 1
    order = np.argsort(ranks, kind="stable")
    longest = int(sizes.max(initial=0))
    while reach < longest:
        later = np.where(left > reach, ranks[np.minimum(np.arange(n) + reach, n - 1)], 0)
        order = np.lexsort((later, ranks))
        new = np.concatenate([[True], (np.diff(ranks[order]) != 0) | (np.diff(later[order]) != 0)])
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(new)
        if new.all():
            break
        reach *= 2
    return order


def longest_matches(codes: np.ndarray, tests: TestSuffixes, place: np.ndarray) -> np.ndarray:
    """Words of the longest match of the texts at each place with any test suffix.

    It is found beside the place in the order of all test suffixes, by a binary search that compares hashes of
    stretches.
    """
    order, text, test = tests.order, Stretches(codes), Stretches(tests.codes)
    ends = np.repeat(tests.first[1:], np.diff(tests.first))

    def common(at: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(at), np.int64), np.minimum(ends[suffix] - suffix, len(codes) - at)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = text.of(at, mid) == test.of(suffix, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(order), np.int64)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) >> 1, len(order) - 1)
        suffix = order[mid]
        k = common(place, suffix)
        ended = suffix + k >= ends[suffix]
        less = ended | (tests.codes[np.minimum(suffix + k, len(tests.codes) - 1)] < codes[np.minimum(place + k, len(codes) - 1)])
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    best = np.zeros(len(place), np.int64)
    for beside in (low - 1, low):
        there = (beside >= 0) & (beside < len(order))
        best[there] = np.maximum(best[there], common(place[there], order[beside[there]]))
    return best


def shard_matches(codes: np.ndarray, tests: TestSuffixes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, item, whole match) of the windows that occur among ``codes``, each once an item.

    Test suffixes whose windows are equal have one range of the suffix array, which is opened once: pairs of test
    suffix and occurrence are never listed.
    """
    start, item, window = tests.suffixes(width)
    sa = suffix_array(codes) if codes.any() else np.zeros(0, np.int64)
    if not len(sa) or not len(start):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    low, high = match_ranges(codes, sa, tests, start, window)
    hit = np.flatnonzero(high > low)
    ranges = np.unique(np.column_stack([low[hit], high[hit], window[hit], item[hit]]), axis=0)
    many = ranges[:, 1] - ranges[:, 0]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place, length = sa[np.repeat(ranges[:, 0], many) + within], np.repeat(ranges[:, 2], many)
    spots, of = np.unique(place, return_inverse=True)
    whole = longest_matches(codes, tests, spots)[of]
    return place, length, np.repeat(ranges[:, 3], many), np.where(whole >= width, whole, length)


def _doc_codes(words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words, a zero between texts and 27 at the end, and where each text's codes begin."""
    hashes = words.hashes()
    spot = np.minimum(np.searchsorted(tests.vocabulary, hashes), max(0, len(tests.vocabulary) - 1))
    code = np.where(tests.vocabulary[spot] == hashes, spot + 1, 0) if len(tests.vocabulary) else np.zeros(len(hashes), np.int64)
    codes = np.zeros(len(hashes) + len(words.first) + 27, np.int64)
    codes[np.arange(len(hashes)) + words.owner()] = code
    return codes, words.first[:-1] + np.arange(len(words.first) - 1)


def scan_texts(column: pa.Array, blocks: list, width: int) -> Iterator[tuple[list, list, list, list]]:
    """n_words, spans, items and longest match of the texts, shard by shard; one of the broadcast blocks is in memory at a time."""
    for _, part in slices(column, SHARD_BYTES):
        words = split_words(part, ALNUM_WORDS, lower=True)
        found, names = [], []
        for block in blocks:
            tests: TestSuffixes = block.value if len(blocks) == 1 else block.load_from_path(block._path)
            codes, begin = _doc_codes(words, tests)
            place, length, item, best = shard_matches(codes, tests, width)
            owner = np.searchsorted(begin, place, side="right") - 1
            found.append(np.array([owner, place - begin[owner] if len(owner) else place, length, item + len(names), best], dtype=np.int64))
            names += tests.items
        owner, place, length, item, best = np.concatenate(found, axis=1)
        order = np.lexsort((place, owner))
        owner, place, length, item, best = (x[order] for x in (owner, place, length, item, best))
        cut = np.searchsorted(owner, np.arange(len(part) + 1))
        pairs = list(zip(cut, cut[1:], strict=False))
        yield (
            np.diff(words.first).tolist(), [_union(place[a:b], length[a:b]) for a, b in pairs],
            [sorted({names[j] for j in np.unique(item[a:b])} - {None}) for a, b in pairs], [int(best[a:b].max(initial=0)) for a, b in pairs],
        )


def _scan(blocks: list, width: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list, list, list] = ([], [], [], [])
            for part in scan_texts(batch.column(keep), blocks, width):
                for whole, some in zip(columns, part, strict=True):
                    whole += some
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *map(pa.array, columns, kinds)], [*batch.schema.names[:keep], *OUTPUTS])

    return run


def _union(start: np.ndarray, length: np.ndarray) -> list[int]:
    """Disjoint spans ``[start, end, start, end, ...]`` of sorted, overlapping ones."""
    if not len(start):
        return []
    stop = np.maximum.accumulate(start + length)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return np.column_stack([start[new], stop[np.concatenate([new[1:] - 1, [len(start) - 1]])]]).ravel().tolist()


def test_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, item: str = "item_id", text: str = "text") -> Iterator[TestSuffixes]:
    """The test items in blocks of about ``block_bytes``, dealt by hash."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for i in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).toArrow()
        yield TestSuffixes.build(block["item"].to_pylist(), block["text"].to_pylist())


def find_matches(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns with n_words, spans (word positions, flat pairs), items (string ids) and its longest match (0 without a window), per row."""
    if not 0 < width <= 27:
        raise ValueError("suffixes are sorted by their first 27 words")
    context = documents.sparkSession.sparkContext
    blocks = [context.broadcast(tests) for tests in test_blocks(benchmark, block_bytes)]
    names = [free_name(c, OUTPUTS) for c in keep]
    fields = ", ".join([*(f"`{n}` {documents.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)), "n_words long, spans array<long>, items array<string>, longest long"])
    kept = (F.col(c).alias(n) for c, n in zip(keep, names, strict=True))
    return documents.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(tidy(_scan(blocks, width, len(keep))), fields)


def hit_words(spans: Column) -> Column:
    """Words inside flat span pairs."""
    return F.aggregate(F.sequence(F.lit(0), F.size(spans)), F.lit(0).cast("long"), lambda n, i: n + F.when(i < F.size(spans), F.when(i % 2 == 0, -F.get(spans, i)).otherwise(F.get(spans, i))).otherwise(0))


def clean_documents(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` without those that hold a window of a test item; all columns are kept."""
    context = documents.sparkSession.sparkContext
    blocks = [context.broadcast(tests) for tests in test_blocks(benchmark, block_bytes)]

    @F.arrow_udf("boolean")
    def hit(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([bool(s) for _, spans, _, _ in scan_texts(part, blocks, width) for s in spans], pa.bool_())
        free_memory()

    return documents.filter(~hit(F.col(text).cast("string")))
