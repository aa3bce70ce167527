"""The store's log of commits under concurrent writers, and evidence that is replayed only where it must be."""

import threading

import pytest

from recordlake.operators import replay, store

SCHEMA = "kind string, id string, canonical_key string, created_at string"


def rows(spark, *items):
    return spark.createDataFrame([("d", i, k, "t", n) for n, (i, k) in enumerate(items)], SCHEMA + ", position long")


def test_concurrent_runs_are_both_kept(spark, tmp_path):
    root, failed = f"file://{tmp_path}/db", []

    def save(n):
        try:
            part = rows(spark, (f"i{n}", f"k{n}"), ("shared", "ks"))
            store.commit(spark, root, store.run_save(f"run{n}", part, spark.createDataFrame([(f"run{n}",)], "id string"), SCHEMA))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=save, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    now = store.latest(spark, root)
    assert now.seq == 2 and {r["id"] for r in now.table("runs").collect()} == {"run0", "run1", "run2"}
    assert sorted(r["canonical_key"] for r in now.table("records").collect()) == ["k0", "k1", "k2", "ks"]
    assert now.table("links").count() == 6 and now.table("links").filter("canonical_key = 'ks'").count() == 3


def test_a_stale_base_is_refused_and_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    base = store.save_snapshot(spark, {"a": spark.range(1)}, root, "v1")
    store.save_snapshot(spark, {"b": spark.range(2)}, root, "v2")
    with pytest.raises(store.CommitConflictError):
        store.save_snapshot(spark, {"a": spark.range(9)}, root, "v3", base)
    now = store.latest(spark, root)
    assert (now.seq, now.table("a").count(), now.table("b").count()) == (1, 1, 2)
    assert now.table("none", "x int").count() == 0
    with pytest.raises(KeyError):
        now.table("none")
    with pytest.raises(store.CommitConflictError):
        store.commit(spark, root, lambda seen: store.save_snapshot(spark, {"a": spark.range(1)}, root, f"w{seen.seq}") and {"a": spark.range(3)}, attempts=2)


def test_conflicts_are_kept_and_not_linked(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    save = lambda run, part: store.commit(spark, root, store.run_save(run, part, spark.createDataFrame([(run,)], "id string"), SCHEMA))
    save("one", rows(spark, ("1", "k1"), ("2", "k2")))
    now = save("two", rows(spark, ("1", "k2"), ("3", "k3")))
    assert [(r["id"], r["canonical_key"], r["run_id"]) for r in now.table("conflicts").collect()] == [("1", "k2", "two")]
    assert sorted(r["canonical_key"] for r in now.table("records").collect()) == ["k1", "k2", "k3"]
    assert [r["canonical_key"] for r in now.table("links").filter("run_id = 'two'").collect()] == ["k3"]


def test_replay_reads_what_changed(spark, tmp_path):
    path = f"file://{tmp_path}/bodies"
    rules = lambda **r: spark.createDataFrame(list(r.items()), "rule string, pattern string")
    captures = lambda *b: spark.createDataFrame([(x,) for x in b], "body string")
    replay.save_bodies(captures("ementa", "Voto", "ementa", None), path)
    none = spark.createDataFrame([], replay.RESULT_SCHEMA)
    first, made = replay.replay(path, none, rules(a=r"\bementa\b", b="voto"))
    assert made.count() == 4 and first.filter("found").count() == 2
    same, made = replay.replay(path, first, rules(a=r"\bementa\b", b="voto"))
    assert made.count() == 0 and same.count() == 4
    assert not any("bodies" in f for f in made.inputFiles())
    replay.save_bodies(captures("Voto", "novo voto"), path)
    assert spark.read.parquet(path).count() == 3
    more, made = replay.replay(path, same, rules(a=r"\bementas\b", b="voto"))
    assert sorted((r["rule"], r["found"]) for r in made.collect()) == [("a", False)] * 3 + [("b", True)]
    assert more.count() == 6
    seen = spark.read.parquet(path).selectExpr("content_sha256", "decode(content, 'UTF-8') AS t")
    found = {r["t"]: r["signals"] for r in replay.signals(seen, more).collect()}
    assert found["Voto"] == {"a": False, "b": True} and found["ementa"] == {"a": False, "b": False}


def test_lookups_open_few_files(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    rows = spark.range(20_000).selectExpr("case when id % 3 = 0 then 'd' when id % 3 = 1 then 'p' end AS kind", "concat('r', id) AS id", "id AS n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        now = store.save_snapshot(spark, {"records": rows, "other": rows}, root, "v1")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found, files = store.lookup(now, "records", kind="p", id="r7777")
    assert [r["n"] for r in found.collect()] == [7777] and len(files) <= 2 and len(found.inputFiles()) == len(files)
    everything = now.table("records")
    assert everything.count() == 20_000 and len(everything.inputFiles()) >= 10
    none, files = store.lookup(now, "records", kind="p", id="zzz")
    assert none.count() == 0 and files == []
    half, files = store.lookup(now, "records", kind="d")
    assert half.count() == 6667 and 0 < len(files) < 16
    with pytest.raises(store.InvalidFilterError):
        store.lookup(now, "records", court="x")
