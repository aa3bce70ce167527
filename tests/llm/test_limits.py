"""Long values, long hosts and large ids: same results, in bounded time."""

import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recordlake.llm import debruijn, secret_scan, shuffle_shards, toxicity, url_filter
from recordlake.llm.catalog import QUERIES, URL_RULES


@pytest.mark.parametrize("value", ["ab" * 100_000, "a" * 200_000, "qw" * 100_000, "correcthorse" * 17_000, "".join(random.Random(1).choice("abcdefXYZ0123456789") for _ in range(200_000))])
def test_long_values_take_seconds(value):
    began = time.perf_counter()
    cost = secret_scan.log_guesses(value)
    assert time.perf_counter() - began < 40
    assert (cost > 10_000) == (len(set(value)) > 12)


def test_least_over_starts():
    """The stack of starts gives the least over all of them at every time."""
    rng = random.Random(2)
    import math

    for shift, gap in ((0, 3), (1, 0), (0, 4)):
        for _ in range(300):
            costs = [rng.choice([rng.random() * 3, i * 0.05, rng.random() * 0.2 + i * 0.3]) for i in range(40)]
            starts = secret_scan._Starts(shift)
            for at in range(gap, 40):
                if gap:
                    starts.add(at - gap, costs[at - gap], at)
                    seen = range(at - gap + 1)
                else:
                    seen = range(at)
                if len(seen):
                    assert abs(starts.least(at) - min(costs[i] + math.log10(at - i + shift) for i in seen)) < 1e-9
                if not gap:
                    starts.add(at, costs[at], at + 1)


def test_long_hosts(spark):
    labels = ".".join(["x"] * 8_000)
    urls = [f"http://{labels}.example.com/en/{'y' * 100_000}", f"http://{labels}.net/es/", "http://" + "." * 16_000, f"http://{'h' * 1_000_000}.net/fr/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    began = time.perf_counter()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, URL_RULES, keep=("page_id",)).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: ("net/es/", "block"), 2: (None, "allow"), 3: ("net/fr/", "block")}
    assert time.perf_counter() - began < 30
    assert len(url_filter.candidates("a.b.c.d.e", "/en/x", [1, 4], [1, 3])) == 4


def test_large_ids(spark):
    """64-bit ids, with two texts under one of them."""
    long = [" ".join(f"{c}{j}" for j in range(60)) for c in "ab"]
    top = 2**63 - 1
    rows = [(top, long[0]), (top, long[1]), (-(2**62), long[0]), (2**62, "new " + long[1])]
    out = debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in out) == sorted([(-(2**62), 0, long[0]), (2**62, 0, "new " + long[1]), (top, 60, ""), (top, 60, "")])


def hashed(values):
    """A row's 64-bit hash, computed by the hash library: each value's bytes, seeded with the hash so far; nulls are passed over."""
    h = 42
    for v, size in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed=h)
    return h - 2**64 if h >= 2**63 else h


def shard_of(doc_id, shards, seed=17):
    return max([0, *(j for j in range(1, shards) if hashed([(doc_id, 8), (j, 4), (seed, 4)]) % (j + 1) == 0)])


def test_op8_against_a_second_computation(spark, data):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op8_shuffle_shards"](spark, data).collect()
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        assert (r["shard"], r["grown_shard"]) == (shard_of(r["doc_id"], 40), shard_of(r["doc_id"], 41))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8_buckets_are_sized_by_whole_rows(spark, tmp_path):
    """Rows that are large in another column than the text get more buckets; very long texts and nested columns, too."""
    df = spark.createDataFrame([(i, "x", "y" * 20_000, [i] * 3, {"a": i}) for i in range(300)] + [(300, "z" * 500_000, None, None, None), (None, None, None, None, None)], "doc_id long, text string, more string, list array<int>, s struct<a: int>")
    total = df.agg(F.sum(shuffle_shards.row_bytes(df))).first()[0]
    assert 6_500_000 < total < 6_600_000
    written = shuffle_shards.write_shuffled(df, f"file://{tmp_path}/a", 2, bucket_bytes=1 << 20)
    assert written.count() == 302 and sorted(r["slot"] for r in written.filter("shard = 1").collect()) == list(range(written.filter("shard = 1").count()))
    ids = [r["doc_id"] for r in written.filter("shard = 0").orderBy("slot").collect()]
    assert ids != sorted(ids, key=lambda i: (i is None, i))


def test_toxicity_fit_in_the_drivers_memory():
    """Features are counted in blocks, so that the driver holds little beside them."""
    rng = np.random.default_rng(4)
    n, each = 4_000, 1_000
    toxic = (np.arange(n) % 4 == 0).astype(float)
    features = [np.append(rng.integers(10, 1 << toxicity.BITS, each, dtype=np.int32), np.int32(bad)) for bad in toxic.astype(int)]
    tracemalloc.start()
    model = toxicity.fit_rows(features, toxic, [np.zeros(0, np.int32)] * n, steps=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights[1] > 0 > model.weights[0]
    assert peak < 24 * n * each
