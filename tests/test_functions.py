import pytest
from pyspark.sql import functions as F

from recordlake.functions import dates, identity, text
from recordlake.scratch import bound_batches


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "iso"), [
    ("31/12/2025", "2025-12-31"), ("10 de março de 2024", "2024-03-10"), ("1º de janeiro de 2020", "2020-01-01"), ("sem data", None), ("2024-03-10T23:59:59-03:00", "2024-03-10"), ("20240310", "2024-03-10"),
    ("31/02/2024", None), ("5.6.2023", "2023-06-05"), ("2023/6/5", "2023-06-05"), ("em 05/06/23 às", "2023-06-05"), ("", None), (None, None), ("7-8-2021", "2021-08-07"),
])
def test_dates(spark, raw, iso):
    assert spark.createDataFrame([(raw,)], "d string").select(dates.normalize_date(F.col("d"))).first()[0] == iso


def test_numbers_and_types(spark):
    assert one(spark, text.normalize_cnj_number(F.lit("00000001234520201234"))) == "0000000-12.3452.0.20.1234"
    assert one(spark, text.normalize_cnj_number(F.lit(" REsp  12 "))) == "REsp 12"
    assert one(spark, text.normalize_decision_type(F.lit("Acordo"))) == "acordao"
    assert one(spark, text.normalize_decision_type(F.lit("Decisão Monocrática"))) == "decisao_monocratica"
    assert one(spark, text.normalize_decision_type(F.lit(" "))) is None
    assert one(spark, text.normalize_court_code(F.lit(" tj-sp "))) == "TJSP"
    assert one(spark, text.slug(F.lit("--"))) == "registro"


def test_text(spark):
    rows = spark.createDataFrame([("ﬁm  de\n linha",), ("  ",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.normalize_text("t")).collect()] == ["fim de linha", None, None]
    assert [r[0] for r in rows.select(text.normalize_lines("t")).collect()] == ["fim de\nlinha", None, None]
    assert one(spark, text.accent_contains(F.lit("Straße do AÇÃO"), "strasse do acao")) is True
    assert one(spark, text.collapse_doubled(F.lit("a b a b"))) == "a b"
    assert one(spark, text.collapse_doubled(F.lit("a b a"))) == "a b a"
    assert one(spark, text.public_value(F.lit(" Não informada "))) is None
    assert one(spark, text.strip_session(F.lit("http://x/a?token=1&b=2"))) == "http://x/a?b=2"
    assert one(spark, text.labelled_value(F.lit("Relator: João Órgão: X"), "Relator", ["Relator", "Órgão"])) == "João"
    assert one(spark, text.unwrap_partial(F.lit("<u><![CDATA[a]]><![CDATA[resultados b]]></u>"))) == "resultados b"
    urls = spark.createDataFrame([("../x#f", "http://h/a/b"), ("", "http://h"), (None, None)], "u string, b string")
    assert [r[0] for r in urls.select(text.join_url("u", "b")).collect()] == ["http://h/x", None, None]
    assert spark.createDataFrame([("Órgão (A)",)], "k string").select(text.ascii_key("k")).first()[0] == "orgao_(a)"


def test_keys(spark):
    key = identity.canonical_key(*(F.lit(v) for v in ("decision", "tjsp_cjsg", "TJSP", " 0003938-14.2017.8.26.0323", "", "Acordao")))
    assert one(spark, key) == "decision|tjsp_cjsg|tjsp|0003938-14.2017.8.26.0323|acordao"
    null = F.lit(None).cast("string")
    assert one(spark, identity.record_identity(F.lit("12-A"), null, null, F.lit("C"), F.lit("s"), F.lit("1"))) == "case:12a"
    assert one(spark, identity.record_identity(null, F.lit(""), F.lit("Tema"), F.lit("C"), F.lit("s"), F.lit("1"))) == "precedent:C:Tema:1"
    assert one(spark, identity.record_identity(F.lit("--"), null, null, F.lit("C"), F.lit("s"), F.lit("1"))) == "case:"
    assert one(spark, identity.record_identity(null, null, null, F.lit("C"), F.lit("s"), F.lit("1"))) == "source:s:1"
    assert one(spark, identity.relevance("Dano dano o moral", F.lit("danodano Moral"))) == 5
    assert one(spark, dates.excel_serial_date(F.lit("45000"))) == "2023-03-15"


def test_long_texts_come_to_python_in_small_batches(spark):
    @F.arrow_udf("int")
    def rows(v):
        import pyarrow as pa

        return pa.array([len(v)] * len(v), pa.int32())

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "67108864b")
        bound_batches(spark)
        texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x "), 100_000).alias("t"))
        assert texts.select(F.max(rows("t"))).first()[0] < 100
        assert texts.select(F.sum(F.length(text.normalize_text("t")))).first()[0] == 300 * 199_999
    finally:
        spark.conf.set(name, before)
