"""Collection that stops inside pages, is restarted, and neither loses nor doubles a row."""

import pytest

from recordlake.streaming import partial


@pytest.fixture()
def place(tmp_path):
    return tuple(f"file://{tmp_path}/{n}" for n in ("pages", "out", "checkpoint"))


def send(spark, place, rows, **limits):
    """One run over pages (source, run, page, ids, total, complete, error)."""
    made = [(s, run, page, None if ids is None else [(i, None if i == "bad" else f"{s}{i}") for i in ids], total, done, error) for s, run, page, ids, total, done, error in rows]
    spark.createDataFrame(made, partial.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(place[0])
    partial.collect_pages(spark, *place, **limits)


def state(spark, place):
    return {r["source"]: (r["next_page"], r["pages_fetched"], r["records_seen"], r["records_saved"], r["duplicates"], r["complete"], r["stop_reason"]) for r in partial.progress(spark, place[1]).collect()}


def ids(spark, place):
    return sorted((r["source"], r["page"], r["id"]) for r in partial.stored(spark, place[1]).collect())


def test_limit_inside_a_page_and_restart(spark, place):
    pages = [("a", 1, 1, ["1", "2", "3"], 6, False, None), ("a", 1, 2, ["3", "4", "5"], 6, False, None), ("a", 1, 3, ["6"], 6, False, None), ("b", 1, 1, ["1"], None, True, None)]
    send(spark, place, pages, max_records=4)
    assert ids(spark, place) == [("a", 1, "1"), ("a", 1, "2"), ("a", 1, "3"), ("a", 2, "4"), ("b", 1, "1")]
    assert state(spark, place) == {"a": (2, 2, 6, 4, 1, False, "max_records"), "b": (2, 1, 1, 1, 0, True, "provider_complete")}
    due = partial.due(spark.createDataFrame([(s, r, p, [(i, "x") for i in x], t, d, e) for s, r, p, x, t, d, e in pages] + [("c", 1, 1, [], None, False, None)], partial.PAGE_SCHEMA), partial.progress(spark, place[1]))
    assert sorted((r["source"], r["page"]) for r in due.collect()) == [("a", 2), ("a", 3), ("c", 1)]
    # the same page again, in two more runs with another cut
    send(spark, place, [("a", 2, 2, ["3", "4", "5"], 6, False, None), ("a", 2, 3, ["6"], 6, False, None)], max_records=1)
    assert state(spark, place)["a"] == (3, 3, 9, 5, 3, False, "max_records")
    send(spark, place, [("a", 3, 3, ["6"], 6, False, None), ("a", 3, 4, ["7"], 6, False, None)], max_records=10)
    assert state(spark, place)["a"] == (4, 4, 10, 6, 3, True, "provider_complete")
    assert [i for s, _, i in ids(spark, place) if s == "a"] == list("123456")


def test_stop_reasons(spark, place):
    pages = [
        ("empty", 1, 1, [], None, False, None), ("twice", 1, 1, ["1"], None, False, None), ("twice", 1, 2, ["1"], None, False, None), ("twice", 1, 3, ["2"], None, False, None), ("broken", 1, 1, ["1"], None, False, None), ("broken", 1, 2, None, None, None, "TimeoutError"), ("broken", 1, 3, ["9"], None, False, None),
        ("odd", 1, 1, ["1"], None, False, None), ("odd", 1, 2, ["bad", "3"], None, False, None), ("long", 1, 1, ["1"], None, False, None), ("long", 1, 2, ["2"], None, False, None), ("long", 1, 3, ["3"], None, False, None), ("gap", 1, 2, ["2"], None, False, None), ("full", 1, 1, ["1", "1", "2"], None, False, None),
    ]
    send(spark, place, pages, max_pages=2, max_records=2)
    assert state(spark, place) == {
        "empty": (2, 1, 0, 0, 0, True, "no_results"), "twice": (3, 2, 2, 1, 1, False, "repeated_page"), "broken": (2, 1, 1, 1, 0, False, "provider_error"), "odd": (2, 2, 3, 1, 0, False, "canonicalization_error"),
        "long": (3, 2, 2, 2, 0, False, "max_records"), "full": (2, 1, 3, 2, 1, False, "max_records"),
    }
    assert ("gap", 2, "2") not in ids(spark, place)
    # an error is forgotten by the next run; the page that couldn't be made canonical is taken once it can
    send(spark, place, [("broken", 2, 2, ["1", "2"], None, False, None), ("odd", 2, 2, ["2", "3"], None, True, None)], max_pages=5, max_records=9)
    now = state(spark, place)
    assert now["broken"][3:] == (2, 1, False, None) and now["odd"][-1] == "provider_complete"
    got = ids(spark, place)
    assert len(got) == len({(s, i) for s, _, i in got})


def test_limits_must_be_positive(spark, place):
    with pytest.raises(ValueError):
        partial.collect_pages(spark, *place, max_pages=0)
