"""Maximal periodic runs of words, and texts without their repetitions.

A run is a stretch of words with smallest period ``p`` that no neighbouring word extends; asked for are those of
at least ``min_words`` words and ``min_times`` periods. Each run has a Lyndon root: a place in its first period
where, under one of the two orders of words, the longest Lyndon word has the length of the period. So for both
orders a stack is scanned from right to left: it holds the suffixes that are smaller than all between them and
here, and its top tells the longest Lyndon word. Suffixes are compared by the length of their longest common
beginning (LCE), found by binary search over a rolling hash. A Lyndon word that its next period repeats is
extended to both sides in the same way and its words are then compared one by one; if hashes had deceived, the
extension is made by comparing words.

Only stretches of words where a run can lie are scanned: in a run, every window of a few words (nine, for 24 words
and three periods) occurs again in the same text, so windows that occur once in their text lie in no run. Nothing
is lost by that; equal hashes of unlike windows only scan more.

Null and empty texts have no words and no runs. Repeated rows and ids are independent. Very long texts need
memory in proportion to their length. Kept columns that are named like an output get an underscore behind
their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.scratch import free_name, tidy
from recordlake.llm.wordcode import SPACE_WORDS, Words, mix, slices, split_words, window_hashes

MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
#: Words that are compared one by one before hashes are.
NEAR = 4
OUTPUTS = ["n_words", "runs", "collapsed"]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


class Common:
    """Lengths of common extensions of a sequence of small integers from two places on."""

    def __init__(self, codes: list[int]):
        self.codes, self.n = codes, len(codes)
        self.sums, self.powers = [0], [1]
        h, p = 0, 1
        for c in codes:
            h = (h * BASE + c + 1) % MODULUS
            p = p * BASE % MODULUS
            self.sums.append(h)
            self.powers.append(p)

    def _same(self, i: int, j: int, k: int) -> bool:
        s, p = self.sums, self.powers[k]
        return (s[i + k] - s[i] * p - s[j + k] + s[j] * p) % MODULUS == 0

    def right(self, i: int, j: int) -> int:
        """Words from ``i`` and ``j`` (the later) on that are equal."""
        codes, most = self.codes, self.n - max(i, j)
        for k in range(min(NEAR, most)):
            if codes[i + k] != codes[j + k]:
                return k
        low, high = min(NEAR, most), most
        step = NEAR
        while low < high and low + step <= high and self._same(i, j, low + step):  # gallop, then halve
            low += step
            step *= 2
        high = min(high, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self._same(i, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def left(self, i: int, j: int) -> int:
        """Words before ``i`` and ``j`` that are equal."""
        codes, most = self.codes, min(i, j)
        for k in range(min(NEAR, most)):
            if codes[i - 1 - k] != codes[j - 1 - k]:
                return k
        low, high = min(NEAR, most), most
        while low < high:
            mid = (low + high + 1) // 2
            if self._same(i - mid, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        return low


def _lyndon_lengths(common: Common, sign: int, recent: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(place, length of the longest Lyndon word there), from right to left; ``sign`` -1 turns the words' order round.

    ``recent`` holds stretches by a period that they keep: within one, the LCE a period apart is known.
    """
    codes, n = common.codes, common.n
    stack: list[int] = []
    for i in range(n - 1, -1, -1):
        here = codes[i] * sign
        while stack:
            j = stack[-1]
            there = codes[j] * sign
            if there == here:
                start, end = recent.get(j - i, (n, n))
                k = end - j if start <= i else common.right(i, j)
                if j + k == n:  # the later suffix is a beginning of the earlier one, so it is smaller
                    break
                if codes[j + k] * sign < codes[i + k] * sign:
                    break
            elif there < here:
                break
            stack.pop()
        yield i, (stack[-1] if stack else n) - i
        stack.append(i)


def _extended(common: Common, i: int, period: int, direct: bool) -> tuple[int, int]:
    """The stretch around ``i`` that keeps ``period``."""
    if not direct:
        return i - common.left(i, i + period), i + period + common.right(i, i + period)
    codes, start, end = common.codes, i, i + period
    while start and codes[start - 1] == codes[start - 1 + period]:
        start -= 1
    while end < common.n and codes[end] == codes[end - period]:
        end += 1
    return start, end


def _verified(common: Common, start: int, end: int, period: int) -> bool:
    codes = common.codes
    return codes[start : end - period] == codes[start + period : end] and not (start and codes[start - 1] == codes[start - 1 + period]) and not (end < common.n and codes[end] == codes[end - period])


def runs_of(codes: list[int], min_words: int = 24, min_times: int = 3) -> list[Run]:
    """(start, length, smallest period) of all runs, by start, then period. Codes are equal where words are."""
    common = Common(codes)
    found: set[tuple[int, int, int]] = set()  # start, end, period
    for sign in (1, -1):
        recent: dict[int, tuple[int, int]] = {}  # the run of a period that was met last
        for i, period in _lyndon_lengths(common, sign, recent):
            if recent.get(period, (common.n,))[0] <= i:
                continue
            if min_times > 2 and (i + 2 * period > common.n or codes[i] != codes[i + period]):
                continue  # of three periods the root's next one is in the run
            start, end = _extended(common, i, period, False)
            if end - start < 2 * period:
                continue
            if (start, end, period) not in found and not _verified(common, start, end, period):
                start, end = _extended(common, i, period, True)
                if end - start < 2 * period:
                    continue
            recent[period] = start, end
            found.add((start, end, period))
    return sorted((start, end - start, period) for start, end, period in found if end - start >= max(min_words, min_times * period))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """True for each word that no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def window_words(min_words: int, min_times: int) -> int:
    """Every window of this many words in a run occurs again a period before or after it.

    In a run of ``n`` words that holds for up to ``n - 2 * period + 1`` words; the shortest run decides, with the
    longest period that it may have or the next longer run's.
    """
    return min(min_words - 2 * (min_words // min_times) + 1, (min_times - 2) * -(-min_words // min_times) + 1)


def stretches(words: Words, width: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of stretches in which every window of ``width`` words occurs again in its text."""
    n = len(words.start)
    if n < width:
        return []
    owner = words.owner()
    starts = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    if not len(starts):
        return []
    key = window_hashes(words.hashes(), width)[starts] ^ mix(owner[starts].astype(np.uint64), 3)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(starts), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    places = starts[again]
    if not len(places):
        return []
    cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(owner[places]) != 0)) + 1
    first, last = places[np.concatenate([[0], cut])], places[np.concatenate([cut - 1, [len(places) - 1]])]
    base = words.first[owner[first]]
    return list(zip(owner[first].tolist(), (first - base).tolist(), (last + width - base).tolist(), strict=True))


def _codes(words: Words, a: int, b: int) -> list[int]:
    """Numbers of words in order of their bytes: exact, no hashes."""
    data = words.data.tobytes() if b - a > 64 else None
    cut = [(data[x:y] if data else words.data[x:y].tobytes()) for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
    number = {w: i for i, w in enumerate(sorted(set(cut)))}
    return [number[w] for w in cut]


def text_runs(words: Words, min_words: int, min_times: int) -> list[list[Run]]:
    """The runs of each text of a slice."""
    out: list[list[Run]] = [[] for _ in range(len(words.first) - 1)]
    for text, a, b in stretches(words, window_words(min_words, min_times)):
        if b - a >= min_words:
            at = int(words.first[text])
            out[text] += [(a + start, length, period) for start, length, period in runs_of(_codes(words, at + a, at + b), min_words, min_times)]
    return [sorted(r) for r in out]


def _collapsed(words: Words, runs: list[list[Run]]) -> pa.Array:
    """Kept words joined by one space, a text each."""
    keep = np.ones(len(words.start), bool)
    for text, found in enumerate(runs):
        if found:
            a, b = words.first[text], words.first[text + 1]
            keep[a:b] = kept_words(int(b - a), found)
    start, end, owner = words.start[keep], words.end[keep], words.owner()[keep]
    size = end - start + 1  # and a space before the next word
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    at = np.repeat(start - (stop - size), size) + np.arange(total)
    spaces = stop - 1
    body = words.data[np.minimum(at, max(0, len(words.data) - 1))]
    body[spaces] = 0x20
    body = np.delete(body, spaces[last])
    lengths = np.zeros(len(words.first) - 1, np.int64)
    np.add.at(lengths, owner, size)
    lengths[np.unique(owner)] -= 1
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _find(n_kept: int, names: list[str], min_words: int, min_times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(n_kept)):
                words = split_words(texts, SPACE_WORDS, False)
                runs = text_runs(words, min_words, min_times)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], fields=list(RUN)))
                kept = [c.slice(at, len(texts)) for c in batch.columns[:n_kept]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(words.first), pa.int64()), listed, _collapsed(words, runs).cast(pa.string())], names)

    return run


def find_runs(df: DataFrame, keep: list[str], text: str = "text", min_words: int = 24, min_times: int = 3) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``."""
    if min_times < 2:
        raise ValueError("a run has at least two periods")
    names = [free_name(c, OUTPUTS) for c in keep]
    fields = [f"`{n}` {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)]
    fields += ["n_words long", "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"]
    kept = (F.col(c).alias(n) for c, n in zip(keep, names, strict=True))
    return df.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(tidy(_find(len(keep), [*names, *OUTPUTS], min_words, min_times)), ", ".join(fields))
