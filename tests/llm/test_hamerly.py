"""Vector codes against plain Lloyd rounds with full scans, and their edge cases."""

import numpy as np
import pytest

from recordlake.llm import hamerly

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes and errors in the order of the usable rows, and the codebooks, with Python integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def square(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [[min(range(len(books[p])), key=lambda e: (square(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = nearest()
    errors = [sum(square(c[p], books[p][f[p]]) for p in range(parts)) for c, f in zip(cut, found, strict=True)]
    return sorted(((i is None, i or 0), bytes(f), e) for (i, _), f, e in zip(kept, found, errors, strict=True)), books


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(3)
    scans = []
    coded, books = hamerly.encode(df, keep=["vec_id", "code"], scans=scans, **how)
    want, entries = brute(rows, **how)
    got = coded.collect()
    assert coded.columns == ["vec_id", "code_", "code", "error"] and all(r["code_"] == "clash" for r in got)
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), bytes(r["code"]), r["error"]) for r in got) == want
    assert (books is None and not entries) or books.entries.tolist() == entries
    return scans, coded, books


def test_against_full_scans(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 32)) * 0.4
    rows = [(i, (centres[i % 30] + rng.normal(size=32) * 0.02).tolist()) for i in range(600)]
    scans, coded, books = check(spark, rows)
    assert scans[0] == 600 * 8 and min(scans[1:]) < 600 * 8 / 2  # bounds save scans
    vector = hamerly.decode(coded, books).filter("vec_id = 5").first()
    assert vector["vector"] == [x / 4096 for p, e in enumerate(vector["code"]) for x in books.entries[p, e].tolist()]


def test_ties_and_repeated_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 2, (rng.integers(-2, 3, 16) / 4096).tolist()) for i in range(200)]
    rows += [(i, [0.25] * 16) for i in range(-5, 150)]  # one hot vector, also in the first codebook
    check(spark, rows)
    check(spark, rows, parts=4, entries=3, rounds=2)
    check(spark, rows, parts=16, entries=1, rounds=1)


def test_negative_halves_go_down(spark):
    check(spark, [(i, [(-1) ** i * i * 0.37 / 4096] * 8) for i in range(50)])


def test_edges(spark):
    assert check(spark, [])[0] == []
    bad = [(1, None), (2, [float("nan")] + [0.0] * 7), (3, [float("inf")] * 8), (4, [None] + [0.0] * 7)]
    check(spark, bad)
    check(spark, [*bad, (5, [0.1] * 8), (None, [0.2] * 8), (None, [0.3] * 8), (5, [0.05] * 8)])  # fewer rows than entries
    for rows in ([(1, [0.0] * 8), (2, [0.0] * 16)], [(1, [0.0] * 9)], [(1, [1e9] * 8)]):
        with pytest.raises(Exception, match="components|component"):
            hamerly.encode(spark.createDataFrame([(i, v, None, "") for i, v in rows], SCHEMA))[0].collect()


def test_more_than_256_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, 1, "") for i, v in rows], SCHEMA)
    coded, books = hamerly.encode(df, parts=2, entries=300, rounds=1)
    row = hamerly.decode(coded, books).filter("vec_id = 399").first()
    near = np.frombuffer(bytes(row["code"]), "<u2")
    assert row["vector"] == [x / 4096 for p in range(2) for x in books.entries[p, near[p]].tolist()]
