"""URL filter over a sorted digest array.

Rules are (host, path) keys. Their 64-bit xxhash digests are stored sorted, with each rule's full
string beside them, in one file that executors memory-map. A URL's candidate keys (its host
suffixes times the path lengths that rules have) are hashed and probed with a vectorised binary
search; a digest hit counts only if the stored string equals the candidate. The longest hit wins.
Only suffixes of as many labels as some rule's host has are candidates, so long hosts cost no more.

Null or malformed URLs have an empty host and path and match nothing; verdict is then ``default``.
Repeated rows are judged alike, an empty table gives an empty result. A kept column named
like an output comes out with an underscore behind its name, further columns are ignored.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm.scratch import free_name, tidy

MAGIC = b"SDA2"
SCHEMA = "host string, path string, rule string, verdict string"


def build_digest_file(rules: Iterable[tuple[str, str]], path: str) -> None:
    """Write ``(verdict, host/path)`` rules: counts, sorted digests, string ends, verdict flags, strings."""
    verdicts = {key: verdict for verdict, key in rules}
    rows = sorted((xxhash.xxh64_intdigest(key.encode()), key.encode(), verdict) for key, verdict in verdicts.items())
    lengths = sorted({len(key.partition(b"/")[2]) for _, key, _ in rows})
    labels = sorted({key.partition(b"/")[0].count(b".") + 1 for _, key, _ in rows})
    with open(path, "wb") as out:
        out.write(MAGIC + np.array([len(rows), len(lengths), len(labels)], "<u4").tobytes())
        out.write(np.array([d for d, _, _ in rows], "<u8").tobytes())
        out.write(np.cumsum([len(k) for _, k, _ in rows], dtype="<u8").tobytes())
        out.write(np.array(lengths + labels, "<u8").tobytes())
        out.write(bytes(v == "block" for _, _, v in rows))
        out.write(b"".join(k for _, k, _ in rows))


class DigestArray:
    """A memory-mapped digest file."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a digest array file")
        n, m, k = (int(x) for x in raw[4:16].view("<u4"))
        at = 16
        self.digests = raw[at : at + 8 * n].view("<u8")
        self.ends = raw[at + 8 * n : at + 16 * n].view("<u8")
        sizes = [int(x) for x in raw[at + 16 * n : at + 16 * n + 8 * (m + k)].view("<u8")]
        self.path_lengths, self.host_labels = sizes[:m], sizes[m:]
        at += 16 * n + 8 * (m + k)
        self.block = raw[at : at + n]
        self.strings = raw[at + n :]

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Index of the rule equal to each key, or -1."""
        if not keys or not len(self.digests):
            return np.full(len(keys), -1)
        wanted = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        low = np.searchsorted(self.digests, wanted, side="left")
        high = np.searchsorted(self.digests, wanted, side="right")
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                if self.string(j) == keys[i]:
                    found[i] = j
        return found

    def string(self, j: int) -> bytes:
        return bytes(self.strings[int(self.ends[j - 1]) if j else 0 : int(self.ends[j])])


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = _PARTS.match(rest)
    return m[1].translate(_LOWER), m[2]


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[bytes]:
    """Keys of rules that could fit: host suffixes of the numbers of labels in use, path prefixes of the lengths in use.

    A rule's path begins with the slash that also separates it from the host.
    """
    body = path[: max(lengths, default=0) + 1].encode()  # a character has at least one byte
    if not host or not labels or not body.startswith(b"/"):
        return []
    last = host.rsplit(".", labels[-1])
    suffixes = [".".join(last[-n:]) for n in labels if n <= len(last)]
    return [s.encode() + body[: n + 1] for s in suffixes if s for n in lengths if n + 1 <= len(body)]


def _judge(file_name: str, default: str, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestArray(SparkFiles.get(file_name))
        for batch in batches:
            hosts, paths, rules, verdicts = [], [], [], []
            keys: list[bytes] = []
            spans = [0]
            for url in batch.column(keep).to_pylist():
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                keys += candidates(host, path, table.path_lengths, table.host_labels)
                spans.append(len(keys))
            hit = table.probe(keys)
            for a, b in zip(spans, spans[1:], strict=False):
                fits = [int(j) for j in hit[a:b] if j >= 0]
                best = max(fits, key=lambda j: len(table.string(j)), default=-1)
                rules.append(table.string(best).decode() if best >= 0 else None)
                verdicts.append(default if best < 0 else "block" if table.block[best] else "allow")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))],
                [*batch.schema.names[:keep], "host", "path", "rule", "verdict"],
            )

    return run


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = (), default: str = "allow") -> DataFrame:
    """``keep`` columns with each row's host, path, longest fitting rule (or null) and verdict."""
    spark: SparkSession = df.sparkSession
    name = f"rules-{uuid.uuid4().hex}.sda"
    local = os.path.join(tempfile.mkdtemp(), name)
    build_digest_file(rules, local)
    spark.sparkContext.addFile(local)
    kept = [df.schema[c] for c in keep]
    names = {c: free_name(c, ["host", "path", "rule", "verdict"]) for c in keep}
    out = ", ".join([*(f"`{names[f.name]}` {f.dataType.simpleString()}" for f in kept), SCHEMA])
    return df.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(url).cast("string").alias("__url")).mapInArrow(tidy(_judge(name, default, len(keep))), out)
