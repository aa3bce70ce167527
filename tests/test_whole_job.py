"""Queries read and return every row and the whole of every text; expectations are stated here, not by SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from recordlake import catalog
from recordlake.sinks import export


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables and gives their folder."""

    def write(**rows):
        for name, (schema, values) in rows.items():
            spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_results_are_searched_whole(spark, tables):
    long = "x " * 300
    texts = {11: long + "the and of the thble", 12: "the and of the thble " + long + "trash", 13: "the and of the ouer", 61: "the"}
    path = tables(documents=("doc_id long, text string, lang string, source string", [(i, t, "en", "s") for i, t in texts.items()]))
    assert {r["id"] for r in catalog.QUERIES["word_filter_and_or_not_phrase"](spark, path).collect()} == {"doc-11", "doc-13"}
    boosted = {r["id"]: r["score"] for r in catalog.QUERIES["boosted_search_score"](spark, path).collect()}
    assert boosted == {"doc-11": 9.0, "doc-12": 3.0, "doc-13": 3.0, "doc-61": 1.5}
    # thesis and summary of doc-11 are both its text; doc-61 shares its number
    best = {r["id"]: r["score"] for r in catalog.QUERIES["federated_rank_dedup_all"](spark, path).collect()}
    assert best == {"doc-11": 6, "doc-12": 3, "doc-13": 3}


def test_markdown_exports_all_records(spark, data):
    pages = catalog.QUERIES["export_markdown"](spark, data).collect()
    orders, courts = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "customer"))
    want = {}
    for r in orders.join(courts, orders.o_custkey == courts.c_custkey).select("c_mktsegment", "o_orderkey").collect():
        want.setdefault(r[0], []).append(f"## r{r[1]}")
    found = {}
    for r in sorted(pages, key=lambda r: (r["court"], r["page"])):
        found.setdefault(r["court"], []).extend(x for x in r["markdown"].split("\n") if x.startswith("## "))
    assert found == {court: sorted(titles) for court, titles in want.items()}


def test_markdown_pages_are_bounded_and_in_order(spark):
    rows = [("a" if i % 3 else None, f"k{i % 2500:05d}", i) for i in range(3000)] + [("b", None, 1)]
    df = spark.createDataFrame(rows, "court string, id string, n int").repartition(5)
    pages = export.markdown_pages(df, "court", "id", export.markdown_record(F.coalesce("id", F.lit("none")), N=F.col("n").cast("string")), size=7).collect()
    for court in ("a", "b", None):
        mine = sorted((r for r in pages if r["court"] == court), key=lambda r: r["page"])
        sizes = [r["markdown"].count("## ") for r in mine]
        assert [r["page"] for r in mine] == list(range(1, len(mine) + 1)) and set(sizes[:-1]) <= {7} and 0 < sizes[-1] <= 7
        want = sorted((f"## {k or 'none'}\n**N:** {n}" for c, k, n in rows if c == court), key=lambda m: m)
        assert "\n\n".join(r["markdown"] for r in mine) == "\n\n".join(want)


def test_source_status_reads_all_evidence(spark, tables):
    path = tables(
        supplier=("s_suppkey long, s_nationkey int, s_acctbal double", [(k, 0, 1.0) for k in (1, 2, 3, 4, 5, 9)]),
        nation=("n_nationkey int, n_name string", [(0, "N")]),
        events=("event_id long, user_id long, event_type string, value double, props string", [(e, u, t, v, "{}") for e, u, t, v in ((10, 1, "view", 1.0), (11, 1, "view", 2.0), (22, 4, "error", 1.0), (12, 3, "view", 1.0), (2, 3, "error", 1.0), (23, 2, "view", 3.0), (34, 2, "view", 2.0))]),
    )
    status = {r["source"]: (r["status"], r["count"]) for r in catalog.QUERIES["source_status_view"](spark, path).collect()}
    # s1 failed by its routing; s2 is complete; s3 isn't routed but has rows; s4's last error names a certificate; s5 is incomplete; s9 is skipped
    assert status == {"s1": ("failed", 0), "s2": ("ok", 2), "s3": ("ok", 2), "s4": ("ssl_error", 2), "s5": ("partial", 1), "s9": ("skipped", 0)}


def test_full_text_status_takes_all_results_of_a_source(spark, tables):
    # results of every third doc_id have no text (3), those of every 97th name a document (97); ids of a source have unlike remainders by 20
    rows = [(1, "t", "a"), (2, "t", "a"), (4, "t", "b"), (5, "", "b"), (3, "t", "c"), (97, "t", "c"), (11, "t", "src1"), (41, "", "src11"), (7, "t", None)]
    path = tables(documents=("doc_id long, text string, lang string, source string", [(i, t, "en", s) for i, t, s in rows]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = {"a": "returned", "b": "not_returned", "c": "document_available", "src1": "returned", "src11": "not_returned", None: "returned"}
    for found in (catalog.QUERIES["full_text_status"](spark, path).collect(), con.sql(catalog.ORACLES["full_text_status"]).select("source", "full_text_status").fetchall()):
        assert len(found) == len(want) and dict(map(tuple, found)) == want


@pytest.mark.parametrize("name", ["upsert_two_keys", "upsert_conflicts"])
def test_upsert_takes_all_records(spark, data, name):
    base, fresh = catalog._two_key_tables(spark, data)
    positions = {r[0] for r in base.select("created_at").union(fresh.select("position")).collect()}
    assert positions == {r[0] for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()}
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    sql = catalog.ORACLES[name]
    for cut, whole in (("position % 2 = 0)", "position % 3 <> 0)"), ("position % 3 = 0)", "position % 3 <> 1)")):
        sql = sql.replace(cut, whole)
    assert "position % 3 <> 1" in sql and "position % 3 <> 0" in sql
    rows = catalog.QUERIES[name](spark, data)
    assert rows.count() > 0
    assert sorted(map(tuple, rows.collect())) == sorted(con.sql(sql).select(*rows.columns).fetchall())


def test_request_cache_shows_what_the_join_lets_through(spark, data, monkeypatch):
    monkeypatch.setattr(catalog.discovery, "request_cache_misses", lambda requests, cache: requests.withColumn("cache_key", F.lit("k")))
    assert any(r["page_id"] % 3 == 0 for r in catalog.QUERIES["request_cache"](spark, data).collect())
