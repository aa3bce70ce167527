import json

import pytest
from pyspark.sql import functions as F

from recordlake.api import Engine, UnknownSourceError
from recordlake.plans.search_query import SearchQuery


@pytest.fixture
def engine(spark, tmp_path):
    docs = [{"cod_ementa": str(i), "numero_processo": f"{i % 3}", "tipo_documento": "Acórdão", "nome_tribunal": "TJRS", "ementa_completa": "dano moral" if i % 2 else "outro", "data_publicacao": f"2020-01-0{i + 1}"} for i in range(6)]
    body = json.dumps({"response": {"numFound": 6, "docs": docs}})
    captures = spark.createDataFrame([("tjrs_solr", "u", 200, None, body)], "source string, url string, code int, header string, body string")
    return Engine(spark, captures, root=f"file://{tmp_path}/store")


def test_search(engine):
    page = engine.search("tjrs_solr", SearchQuery(text="DANO", page_size=2)).collect()
    assert [r["id"] for r in page] == ["5", "3"]
    ranked, envelope = engine.search_many(SearchQuery(text="dano"), ["tjrs_solr"])
    assert sorted(r["id"] for r in ranked.collect()) == ["1", "3", "5"]
    assert envelope.first()["unique_total"] == 3
    with pytest.raises(UnknownSourceError):
        engine.source_results("nowhere")
    assert engine.list_sources().count() == 45
    assert engine.route(SearchQuery(text="dano")).filter("searched").count() > 30


def test_runs(engine):
    first = engine.search_and_store_run("tjrs_solr", SearchQuery(text="dano"), "2024-01-01")
    again = engine.search_and_store_run("tjrs_solr", SearchQuery(), "2024-01-02")
    assert engine.records().count() == 3  # three case numbers
    assert engine.get_research_run_records(first).count() == 3
    assert [r["id"] for r in engine.list_research_runs().collect()] == [again, first]
    assert {r["created_at"] for r in engine.records().collect()} == {"2024-01-01"}


def test_sync(spark, engine):
    schema = "id string, numeroProcesso string, descricaoClasse string, ministroRelator string, nomeOrgaoJulgador string, ementa string, dataDecisao string, dataPublicacao string, position int"
    rows = spark.createDataFrame([("1", "a", None, None, None, "old", "20240101", None, 0), ("1", "a", None, None, None, "new", "20240101", None, 1), (None, "b", None, None, None, None, None, None, 2)], schema)
    decisions, counters = engine.sync_source_resource(rows, "d")
    assert [r["summary"] for r in decisions.collect()] == ["new"] and tuple(counters.first()) == (3, 1, 1, 1)
    assert decisions.filter(F.col("judgment_date") == "2024-01-01").count() == 1


def test_filters_apply_or_warn_and_pages_bound_what_is_fetched(spark):
    schema = "source string, id string, url string, court string, type string, number string, summary string, rapporteur string, publication_date string, updated_at string, judgment_date string, oab string"
    rows = [("s", f"i{i:02d}", f"u{i:02d}", "C", "Acórdão", f"{i}", "dano moral", "R", f"2020-01-{1 + i:02d}", None, f"2019-01-{28 - i:02d}", "A" if i % 2 else "B") for i in range(25)]
    engine = Engine(spark, results=spark.createDataFrame(rows, schema))
    _, envelope = engine.search_many(SearchQuery(text="dano", page=2), ["s"])
    assert envelope.first()["collected"] == 20
    assert [r["id"] for r in engine.search("s", SearchQuery(oab="A", page_size=2)).collect()] == ["i23", "i21"]
    assert [r["id"] for r in engine.search("s", SearchQuery(order_by="date", page_size=2)).collect()] == ["i00", "i01"]
    with pytest.warns(UserWarning, match="cda"):
        engine.search("s", SearchQuery(cda="1"))
