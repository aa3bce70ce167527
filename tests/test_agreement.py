"""Queries and their SQL state the same rule where ties and odd markup leave room; tables are made here."""

import duckdb
import pytest

from recordlake import catalog, catalog_pages  # noqa: F401


@pytest.fixture
def both(spark, tmp_path):
    """Writes a table and gives a query's rows by Spark and by DuckDB."""

    def run(name, table, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        return sorted(map(tuple, df.collect()), key=repr), sorted(con.sql(catalog.ORACLES[name]).select(*df.columns).fetchall(), key=repr)

    return run


@pytest.mark.parametrize("turn", [1, -1])
def test_last_wins_breaks_ties(both, turn):
    rows = [(1, 3, 2), (1, 5, 2), (1, 4, 2), (1, 6, 1), (2, 8, 1), (2, 2, 1)][::turn]
    mine, theirs = both("dedup_last_wins", "lineitem", "l_orderkey long, l_suppkey long, l_linenumber int", rows)
    assert mine == theirs == [("r1", 12, 11, "run-5"), ("r2", 21, 21, "run-2")]


PAGE = '<html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">{link}</a></li></ul></nav><!-- ad --><div class="ad">Un.</div><article><h1>{title}</h1><p><b>{bold}<br><p>{last}</p></article><footer>&copy; x &middot; y</footer></body></html>'
PAGES = [
    PAGE.format(title="x &amp;&amp;&amp; y&amp", link="z", bold="w", last="The"), PAGE.format(title="a b&quot", link="THE", bold="the", last="the"), PAGE.format(title="The", link="z", bold="the ", last="the"),
    PAGE.format(title=" ", link="z", bold="w", last="the w"), PAGE.format(title="the", link="z", bold="the w", last="v"),
]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("html_title", [(0, "x &&& y&"), (1, 'a b"'), (2, "The"), (3, None), (4, "the")]),
        ("html_visible_text", [(0, "x &&& y& z Un. x &&& y& w The © x · y"), (1, 'a b" THE Un. a b" the the © x · y'), (2, "The z Un. The the the © x · y"), (3, "z Un. w the w © x · y"), (4, "the z Un. the the w v © x · y")]),
        ("find_by_text", [(0, "p", None), (1, "a", "/x"), (2, "b", None), (4, "h1", None)]),
    ],
)
def test_pages_with_cut_references_and_short_texts(both, name, want):
    mine, theirs = both(name, "pages", "page_id long, url string, html string", [(i, "http://x", p) for i, p in enumerate(PAGES)])
    assert mine == theirs == want
