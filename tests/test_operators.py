import pytest
from pyspark.sql import functions as F

from recordlake.operators import canonical, dedup, discovery, federate, quality, store
from recordlake.plans.search_query import InvalidQueryError, SearchQuery
from recordlake.sinks import export
from recordlake.sources import envelopes, html, readers, registry
from recordlake.streaming import collect


@pytest.mark.parametrize(("total", "start", "returned", "known", "flag"), [
    (10, 1, 10, True, True), (0, 0, 0, True, True), (10, 1, 0, True, False), (20, 11, 10, True, True), (20, 1, 10, True, False), (20, 1, 10, False, None), (None, 1, 10, True, None),
])
def test_completeness(spark, total, start, returned, known, flag):
    row = spark.createDataFrame([(total, start, returned, known)], "t int, s int, r int, k boolean")
    assert row.select(federate.page_completeness(F.col("t"), F.col("s"), F.col("r"), F.col("k"))["is_complete"]).first()[0] is flag


def test_two_sources_second_page(spark):
    schema = "id string, source string, number string, type string, summary string, arrival long"
    rows = [("1", "a", "1", None, "x", 0), ("2", "a", "2", None, "x", 1), ("2b", "b", "2", None, "x", 2), ("3", "b", "3", None, "x", 3)]
    results = spark.createDataFrame(rows, schema)
    unique = federate.rank_dedup(results, "nada", [F.asc("arrival")])
    assert [r["number"] for r in federate.ranked_page(unique, 2, 2).collect()] == ["3"]
    env = federate.envelope(results, unique, 2, 2).first()
    assert (env["unique_total"], env["returned"], env["has_more"]) == (3, 1, False)


def test_upsert_by_two_keys(spark):
    schema = "kind string, id string, canonical_key string, created_at long, v long"
    base = spark.createDataFrame([("d", "1", "k1", 1, 0), ("d", "2", "k2", 2, 0)], schema)
    fresh = spark.createDataFrame([("d", "9", "k1", 7, 1, 0), ("d", "2", "k1x", 7, 1, 1), ("d", "3", "k3", 7, 1, 2)], schema + ", position long")
    kept, conflicts = store.upsert_records(base, fresh)
    assert {(r["id"], r["canonical_key"], r["created_at"]) for r in kept.collect()} == {("9", "k1", 1), ("2", "k1x", 2), ("3", "k3", 7)}
    assert conflicts.count() == 0
    clash = spark.createDataFrame([("d", "1", "k2", 7, 1, 0)], schema + ", position long")
    kept, conflicts = store.upsert_records(base, clash)
    assert kept.count() == 2 and conflicts.count() == 1


def test_snapshots_and_migration(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a long")
    store.save_snapshot(spark, {"records": df}, f"file://{tmp_path}/db", "v1")
    store.save_snapshot(spark, {"records": df.union(df)}, f"file://{tmp_path}/db", "v2")
    assert store.load_snapshot(spark, f"file://{tmp_path}/db", "records").count() == 2
    assert store.migrate(df, {"a": "long", "b": "string"}).columns == ["a", "b"]
    with pytest.raises(store.InvalidFilterError):
        store.predicate(colour="red")


def test_sync_counters(spark):
    rows = spark.createDataFrame([("1",), ("1",), (" ",)], "id string")
    assert tuple(dedup.sync_counters(rows, "id").first()) == (3, 1, 1, 1)


def test_page_iterator_cap(spark):
    rows = spark.createDataFrame([("s", str(i), 1 + i // 3, i) for i in range(9)] + [("s", "0", 4, 9)], "source string, id string, page int, position int")
    assert [r["page"] for r in readers.iter_pages(rows, 5).orderBy("position").collect()] == [1, 1, 1, 2, 2]


def test_query_rules():
    with pytest.raises(InvalidQueryError):
        SearchQuery.of(colour="red")
    with pytest.raises(InvalidQueryError):
        SearchQuery(page=0)
    with pytest.raises(InvalidQueryError):
        SearchQuery(published_from="2024-02-01", published_to="01/01/2024")
    q = SearchQuery(text="caso 0003938-14.2017.8.26.0323", exact_phrase="a b", any_words="x y", without_words="z", cda=" ")
    assert q.identifiers() == ["number"]
    assert q.expression() == 'caso 0003938-14.2017.8.26.0323 "a b" x ou y não z'


def test_canonical_status(spark):
    schema = "id string, source string, court string, type string, number string, rapporteur string, summary string, full_text string, judgment_date string, publication_date string, access_status string, extraction_status string, question string, thesis string, updated_at string"
    rows = spark.createDataFrame([("1", "s", "C", "Acórdão", "5", None, " ", None, "01/02/2020", None, None, "complete", None, None, None), ("2", "s", "C", "acordao_resumo", "0", None, "x", None, None, None, "public", "complete", None, None, "2020-01-01")], schema)
    d = canonical.to_decisions(rows).collect()
    assert [(r["id"], r["access_status"], r["extraction_status"], r["judgment_date"], r["transformations"]) for r in d] == [("1", "partial", "partial", "2020-02-01", ["judgment_date_normalized", "access_downgraded", "extraction_downgraded"])]
    assert canonical.to_precedents(rows).first()["canonical_key"] == "precedent|s|c|acordao_resumo|2"
    cases = spark.range(1).select(canonical.case_structs(F.lit('[{"numero":"1","classe":"A"},{"link":"x"}]')).alias("c")).first()["c"]
    assert [tuple(c) for c in cases] == [("1", "A", None)]


def test_html(spark):
    page = "<html><head><title>T &amp; x</title><script>var a='<p>';</script></head><body><p>one<p>two <b>bold</b><br>end<form action='/s' method=POST><input name=q value=1><select name=o></select></form><a href='/a'>A</a><table><tr><th>Classe:</th><td>X</td></tr></table><dl><dt>Relator:<dd>Y</dl></body>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    row = df.select(html.visible_text("h").alias("v"), html.title("h").alias("t"), html.links("h").alias("l"), html.form_fields("h").alias("f"), html.label_pairs("h").alias("m")).collect()
    assert row[0]["v"] == "T & x one two bold end A Classe: X Relator: Y"
    assert row[0]["t"] == "T & x"
    assert [tuple(x) for x in row[0]["l"]] == [("/a", "A")]
    assert [(x["form"], x["method"], x["name"], x["kind"]) for x in row[0]["f"]] == [("/s", "post", "q", "input"), ("/s", "post", "o", "select")]
    assert row[0]["m"] == {"classe": "X", "relator": "Y"}
    assert row[1]["v"] is None and row[2]["v"] is None
    card = "<div class='item x'><a href='/d'>Ver</a> Relator: Ana Classe: Ap</div>"
    got = spark.createDataFrame([(card,)], "h string").select(html.cards("div", "item", ["Classe", "Relator"])("h").alias("c")).first()["c"]
    assert got == [{"text": "Ver Relator: Ana Classe: Ap", "url": "/d", "relator": "Ana", "classe": "Ap"}]


def test_readers(spark, tmp_path):
    bodies = spark.createDataFrame([('[{"a":1},2]',), ('{"data":[{"a":1}],"x":2}',), ('{"a":3}',)], "b string")
    assert [len(r[0]) for r in bodies.select(readers.json_records(F.col("b"))).collect()] == [1, 1, 1]
    (tmp_path / "a.csv").write_bytes("nome; valor\nação; \"x;\ny\"\n".encode("latin-1"))
    got = readers.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert got.columns == ["nome", "valor"] and got.first()["nome"] == "ação" and got.first()["valor"] == "x;\ny"
    text = "intro\nANO | BASE | ARQUIVO\n2020 | a | f.csv\n2021 | b | \n"
    found = spark.range(1).select(readers.read_manifest(F.lit(text)).alias("m")).first()["m"]
    assert found == [{"ANO": "2020", "BASE": "a", "ARQUIVO": "f.csv"}]
    body = '{"result":{"results":[{"id":"d","title":"t","resources":[{"id":"r","format":"csv"},{"id":"s","format":"json"},{"id":"u","format":"CSV"}]}]}}'
    d = readers.describe_datasets(spark.createDataFrame([(body,)], "body string")).first()
    assert (d["formats"], d["resource_count"]) == (["CSV", "JSON"], 3)


def test_xlsx(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Classe</t></si><si><t>RE</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Data</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>45000</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("u", bytearray(buffer.getvalue()))], "url string, content binary")
    assert [tuple(r) for r in readers.sheet_table(df, ["Classe", "Data"]).collect()] == [("u", 1, 0, "RE", "45000")]
    assert readers.sheet_table(df, ["Outro"]).count() == 0
    with zipfile.ZipFile(buffer, "a") as z:
        for n, head in ((2, "Outra"), (10, "Classe")):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>{head}</t></is></c><c r="B1" t="inlineStr"><is><t>Data</t></is></c></row><row><c r="B2"><v>{n}</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("u", bytearray(buffer.getvalue())), ("v", None)], "url string, content binary")
    assert sorted(tuple(r) for r in readers.sheet_table(df, ["Classe", "Data"]).collect()) == [("u", 1, 0, "RE", "45000"), ("u", 10, 0, None, "10")]
    assert sorted(tuple(r) for r in readers.sheet_contracts(df, ["Classe", "Data"]).collect()) == [("u", 1, False), ("u", 2, True), ("u", 10, False)]


def test_envelopes(spark):
    body = '{"response":{"numFound":7,"docs":[{"cod_ementa":"1","numero_processo":"n","ementa_completa":"<b>E</b> x","data_julgamento":"2020-01-02T00:00:00Z"},{"cod_ementa":" "}]}}'
    rows = envelopes.parse_results(spark.createDataFrame([("u", body)], "url string, body string"), "tjrs_solr").collect()
    assert [(r["id"], r["summary"], r["judgment_date"], r["total"]) for r in rows] == [("1", "E x", "2020-01-02", 7)]
    for source in envelopes.ENVELOPES:
        assert envelopes.parse_results(spark.createDataFrame([("u", "{}"), ("v", None)], "url string, body string"), source).count() == 0
    assert registry.capabilities(spark).count() == 45


def test_quality(spark):
    nodes = [(p, p) for p in ("captcha <table>", "captcha", "ok")]
    df = spark.createDataFrame(nodes, "a string, b string")
    assert [r[0] for r in df.select(quality.blocked(F.col("a"), "captcha", "<table")).collect()] == [False, True, False]
    urls = [("https://a.example.com/x", True), ("http://user@example.com/", False), ("http://127.0.0.1/", False), ("ftp://example.com", False), ("http://notexample.com", False), (None, False)]
    got = spark.createDataFrame(urls, "u string, e boolean").select(quality.allowed_url(F.col("u"), ["example.com"]), "e").collect()
    assert all(a == b for a, b in got)
    flags = spark.range(1).select(quality.secrecy_flags(F.lit("Segredo de Justiça"), F.lit("public"), F.lit("complete")).alias("s")).first()["s"]
    assert tuple(flags) == ("partial", "complete")


def test_stop_reasons(spark):
    rows = [("a", 1, 10, 10, False, None), ("a", 2, 10, 0, False, None), ("b", 1, 10, 10, True, None), ("c", 1, 0, 0, None, "x"), ("d", 1, 9, 9, False, None), ("d", 2, 9, 9, False, None)]
    got = collect.stop_reasons(spark.createDataFrame(rows, "source string, page int, returned int, fresh int, is_complete boolean, error string"), 15, 9)
    assert {(r["source"], r["page"], r["reason"], r["stored"]) for r in got.collect()} == {("a", 2, "repeated_page", 10), ("b", 1, "provider_complete", 10), ("c", 1, "provider_error", 0), ("d", 2, "max_records", 15)}
    with pytest.raises(ValueError):
        collect.check_resume({"source": "a", "query": {"text": "x", "page": 3}}, "a", {"text": "y"})
    collect.check_resume({"source": "a", "query": {"text": "x", "page": 3}}, "a", {"text": "x"})


def test_stream_resumes(spark, tmp_path):
    root = f"file://{tmp_path}"
    page = lambda ids: spark.createDataFrame([("s", i) for i in ids], "source string, id long").coalesce(1)
    page([1, 2]).write.mode("append").parquet(f"{root}/pages")
    args = (spark, f"{root}/pages", "source string, id long", ["source", "id"], f"{root}/out", f"{root}/cp")
    collect.collect_new(*args)
    page([2, 3]).write.mode("append").parquet(f"{root}/pages")
    collect.collect_new(*args)
    assert sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3]


def test_exports(spark):
    df = spark.createDataFrame([("1", 'a "b", c', None)], "id string, summary string, court string")
    assert export.ordered(df, ["id", "summary", "court", "x"]).select(export.csv_line(["id", "summary", "court", "x"])).first()[0] == '1,"a ""b"", c",,'
    assert df.select(export.json_line(df, df.columns)).first()[0] == '{"court":null,"id":"1","summary":"a \\"b\\", c"}'
    assert df.select(export.markdown_record(F.col("id"), Court=F.col("court"), Summary=F.col("summary"))).first()[0] == '## 1\n**Summary:** a "b", c'


def test_frontier_visits_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    got = discovery.crawl_frontier(edges, spark.createDataFrame([("a",)], "node string"), 5)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1)}
