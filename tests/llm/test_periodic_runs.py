"""Periodic runs against trying every period, and edge cases."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from recordlake.llm import periodic_runs
from recordlake.llm.catalog import op13_periodic_runs
from recordlake.llm.wordcode import SPACE_WORDS, split_words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_words=24, min_times=3):
    found = {}
    for q in range(1, len(words) // min_times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(min_words, min_times * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences(n=1500):
    rng = random.Random(2)
    for _ in range(n):
        size, letters = rng.randint(0, 90), rng.choice([1, 2, 3, 6])
        words = [rng.randrange(letters) for _ in range(size)]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(size), rng.randint(1, 9)
            words = [words[min(size - 1, i if i < a else a + (i - a) % p)] for i in range(size)]
        yield words


def test_against_every_period():
    for words in sequences():
        for how in ((24, 3), (4, 2), (6, 3), (10, 4)):
            assert periodic_runs.runs_of(words, *how) == brute(words, *how)


def test_deceiving_hashes_make_no_runs(monkeypatch):
    """With hashes that hardly tell words apart, every stretch found still keeps its period and can't be extended."""
    monkeypatch.setattr(periodic_runs, "MODULUS", 3)
    for words in sequences(400):
        for s, n, q in periodic_runs.runs_of(words, 6, 3):
            assert words[s : s + n - q] == words[s + q : s + n]
            assert (s == 0 or words[s - 1] != words[s - 1 + q]) and (s + n == len(words) or words[s + n] != words[s + n - q])


def test_fibonacci_words_and_long_runs():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    assert periodic_runs.runs_of(b, 2, 2) == brute(b, 2, 2)
    for period in (1, 2, 7, 20_000):
        words = [(i % period) * 7919 % 20_011 for i in range(60_000)]
        assert periodic_runs.runs_of([-1, *words, -2]) == [(1, 60_000, period)]


def test_stretches_hold_every_run():
    rng = random.Random(7)
    texts = [" ".join(f"w{x}" for x in words) for words in sequences(300)] + ["", "x " * 30, "tail"]
    rng.shuffle(texts)
    words = split_words(pa.array(texts, pa.large_string()), SPACE_WORDS, False)
    found = periodic_runs.text_runs(words, 24, 3)
    collapsed = periodic_runs._collapsed(words, found).to_pylist()
    for text, runs, rest in zip(texts, found, collapsed, strict=True):
        w = text.split()
        assert runs == brute(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert rest == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_query_and_edges(spark):
    rng = random.Random(5)
    phrase = "to be or not to be that is the question".split()
    texts = [None, "", " \t\n", "a", " ".join(["ha"] * 24), " ".join(["ha"] * 23), "  ".join(phrase * 3), "\n".join(["x", *phrase * 5, "to", "be", "z"])]
    texts += [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 200))) for _ in range(120)]
    texts += [" ".join(["é"] * 30_000 + ["中"] * 30_000)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(6, texts[6], "again"), (None, "ho " * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    plain = periodic_runs.find_runs(df, ["doc_id", "runs"])
    assert plain.columns == ["doc_id", "runs_", "n_words", "runs", "collapsed"]
    for r in plain.collect():
        words = SPACE.findall(("ho " * 40 if r["doc_id"] is None else texts[r["doc_id"]]) or "")
        if len(words) < 10_000:
            assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(words), brute(words))
        else:
            assert [tuple(x) for x in r["runs"]] == [(0, 30_000, 1), (30_000, 30_000, 1)] and r["collapsed"] == "é 中"
    assert periodic_runs.find_runs(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, [], min_times=1)


def test_query_against_every_period(spark, data, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "one", *(" ".join(rng.choice(["x", "y", "zé"]) for _ in range(rng.randint(1, 150))) for _ in range(200))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "u " * 30)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, f"file://{tmp_path}").collect()}
    assert (got[None]["n_runs"], got[None]["exponent_milli"]) == (1, 30_000)
    planted = 0
    for i, t in enumerate(texts):
        words, h = SPACE.findall(t or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        row = got[i]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()
    assert planted > 5
