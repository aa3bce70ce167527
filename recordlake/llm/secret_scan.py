"""Secret scan: fixed patterns, and guess-cost analysis of values in credential context.

The base kinds are pattern matches over whole texts. For each value that follows a credential word,
dynamic programming finds the segmentation into common words, dates, repeats, keyboard walks and
brute-force characters that takes the fewest guesses; values begin at 7 characters, the fewest that
can take ``10**12``, and a value that still needs ``10**min_log_guesses``
is a secret of kind ``guess``. Costs are logarithms, so a segmentation costs the sum of its parts. The
dictionary is the common words of passwords and, behind them, the corpus's own most frequent words.
Repeats are of units that aren't repeats themselves; they are found as the value's maximal periodic runs, so
a long value takes time close to its length.

Null is an empty text. Offsets are code points, ends exclusive. Rows that repeat are scanned alike,
an empty table gives an empty result. A kept column named like an output comes out with an underscore
behind its name, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.periodic_runs import runs_of
from recordlake.llm.scratch import free_name, tidy

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?([^\s"'<>,;]{7,})""",
    re.I | re.A,
)
#: A credential word with its plural, quote and separator is no longer than this.
WORD_REACH = 16
#: Common words of passwords, most frequent first (fixed values).
COMMON_WORDS = (
    "password", "qwerty", "dragon", "monkey", "letmein", "football", "baseball", "master", "welcome", "login",
    "admin", "princess", "sunshine", "shadow", "superman", "michael", "charlie", "secret", "summer", "winter",
    "spring", "autumn", "hello", "freedom", "whatever", "trustno", "access", "love", "test", "user", "root",
    "pass", "token", "example", "changeme", "default", "guest", "server", "system", "public", "private",
    "computer", "internet", "service", "account", "database", "production", "staging", "development", "demo",
    "house", "water", "money", "people", "world", "school", "family", "friend", "company", "number",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "your", "here", "none", "null", "true", "false",
)
_LEET = str.maketrans("@430157$!", "aaeoistsi")
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {a + b for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {a + b for up, down in zip(_ROWS, _ROWS[1:], strict=False) for a, b in zip(up, down, strict=False)}
_NEXT |= {p[::-1] for p in _NEXT}
_LOG_WALK, _LOG_YEAR, _LOG_DATE = math.log10(47), math.log10(130), math.log10(130 * 365)
_DATES = [
    (re.compile(r"(?:19|20)\d\d", re.A), _LOG_YEAR),
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.A), _LOG_DATE),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", re.A), _LOG_DATE),
]


def _alphabet(value: str) -> float:
    size = 0
    size += 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    return math.log10(max(10, size + 33 * any(not (c.isascii() and c.isalnum()) for c in value)))


def ranks(words: Iterable[str]) -> dict[str, int]:
    """Ranks of a list of lower-case words, most common first; of repeated words the first counts."""
    out: dict[str, int] = {}
    for word in words:
        out.setdefault(word, len(out) + 1)
    return out


_COMMON = ranks(COMMON_WORDS)


class _Starts:
    """Least of ``cost + log10(at - start + shift)`` over the starts so far; ``at`` only grows.

    The price of length flattens out, so an older start that has become as cheap as a newer one stays so: starts are
    a stack, newest on top, each with the time from which the one below is no worse.
    """

    def __init__(self, shift: int):
        self.shift = shift
        self.stack: list[tuple[int, float, float]] = []

    def add(self, start: int, cost: float, now: int) -> None:
        """A start that is asked for from ``now`` on."""
        stack = self.stack
        while stack:
            older, paid, since = stack[-1]
            more = cost - paid
            ratio = 10 ** min(more, 15.0) - 1
            overtaken = start - self.shift + (start - older) / ratio if more > 0 else math.inf
            if overtaken <= now:
                return
            if since <= overtaken and len(stack) > 1 or overtaken == math.inf:
                stack.pop()
                continue
            stack.append((start, cost, overtaken))
            return
        stack.append((start, cost, math.inf))

    def least(self, at: int) -> float:
        stack = self.stack
        while len(stack) > 1 and stack[-1][2] <= at:
            stack.pop()
        start, cost, _ = stack[-1]
        return cost + math.log10(at - start + self.shift)


def log_guesses(value: str, words: dict[str, int] = _COMMON) -> float:
    """log10 of the guesses of the cheapest segmentation of all; ``words`` are ranks of lower-case words.

    Every part that a kind allows is tried: each stretch of a keyboard walk or of one character, each dictionary
    word, each date, and each number of repeats of a unit that isn't itself a repeat. Time is close to
    proportional to the length.
    """
    n, single = len(value), _alphabet(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    longest_word = max(map(len, words), default=0)
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[tuple[int, float]]] = {}
    for start in range(n):
        for pattern, price in _DATES:
            m = pattern.match(value, start)
            if m:
                dates.setdefault(m.end(), []).append((start, price))
    repeats = [(start, start + length, unit) for start, length, unit in runs_of([ord(c) for c in value], 2, 2) if unit > 1]
    repeats.sort(key=lambda run: run[0] + run[2])
    active: list[tuple[int, int, int, dict[int, _Starts]]] = []
    same, same_from, walk, walk_from = _Starts(0), 0, _Starts(0), 0
    upcoming = 0
    for end in range(1, n + 1):
        cost = best[end - 1] + single
        if end > 1 and value[end - 1] != value[end - 2]:
            same, same_from = _Starts(0), end - 1
        if end - 3 >= same_from:
            same.add(end - 3, best[end - 3], end)
            cost = min(cost, single + same.least(end))
        if end > 1 and low[end - 2 : end] not in _NEXT:
            walk, walk_from = _Starts(0), end - 1
        if end - 4 >= walk_from:
            walk.add(end - 4, best[end - 4], end)
            cost = min(cost, _LOG_WALK + walk.least(end))
        for size in range(3, min(longest_word, end) + 1):
            rank = words.get(plain[end - size : end]) or words.get(low[end - size : end])
            if rank:
                changed = value[end - size : end] not in words
                cost = min(cost, best[end - size] + math.log10(rank * (size + 1 if changed else 1) + 1))
        while upcoming < len(repeats) and repeats[upcoming][0] + repeats[upcoming][2] <= end:
            active.append((*repeats[upcoming], {}))
            upcoming += 1
        if active and any(stop < end for _, stop, _, _ in active):
            active = [run for run in active if run[1] >= end]
        due = []
        for start, _, unit, ends in active:
            if end >= start + unit:
                at, place = divmod(end - start, unit)
                kept = ends.get(place)
                if kept is not None:
                    cost = min(cost, kept.least(at))
                due.append((ends, place, at))
        for start, price in dates.get(end, ()):
            cost = min(cost, best[start] + price)
        best[end] = cost
        for ends, place, at in due:
            ends.setdefault(place, _Starts(1)).add(at, cost, at + 1)
    return best[n]


def scan_text(text: str, min_log_guesses: float = 12.0, words: dict[str, int] = _COMMON) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all spans, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    at = 0
    while m := CONTEXT.search(text, at):
        if log_guesses(m[1], words) >= min_log_guesses:
            found.append((m.start(1), 3, m.end(1)))
            at = m.end()
        else:  # the value's end may be the credential word of another one
            at = max(m.start(1), m.end(1) - WORD_REACH)
    return sorted(found)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def corpus_words(df: DataFrame, most: int, text: str = "text") -> list[str]:
    """The ``most`` most frequent runs of 3 to 20 letters a-z of all texts, lower-cased; ties in order of the words."""
    found = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit("(?<![a-z])[a-z]{3,20}(?![a-z])"), F.lit(0))).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in counted.collect()]


def scan(df: DataFrame, keep: list[str], text: str = "text", min_log_guesses: float = 12.0, dictionary: list[str] | None = None) -> DataFrame:
    """``keep`` columns, counts by kind, digest of the base spans and all spans of every row.

    ``dictionary`` holds further words, most common first, that rank behind the common words of passwords.
    """
    counts = [f"n_{k}" for k in KINDS]
    outputs = [*counts, "base_sha256", "spans"]
    names = [free_name(c, outputs) for c in keep]
    bound = df.sparkSession.sparkContext.broadcast(ranks([*COMMON_WORDS, *(dictionary or [])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py() or "", min_log_guesses, bound.value) for t in batch.column(len(keep))]
            base = [_join([s for s in spans if s[1] < 3]) for spans in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    *(pa.array([sum(s[1] == k for s in spans) for spans in rows], pa.int64()) for k in range(len(KINDS))),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_join(spans) for spans in rows], pa.string()),
                ],
                [*batch.schema.names[: len(keep)], *outputs],
            )

    fields = [f"`{n}` {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)] + [f"{c} long" for c in counts]
    kept = (F.col(c).alias(n) for c, n in zip(keep, names, strict=True))
    return df.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(tidy(run), ", ".join([*fields, "base_sha256 string, spans string"]))
