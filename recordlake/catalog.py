"""Queries over the driver's tables, one per operator, each beside independent SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions import dates, fields, identity, text
from recordlake.operators import canonical, coverage, dedup, discovery, federate, probe, quality, store
from recordlake.plans.search_query import SearchQuery
from recordlake.plans.views import view, with_views
from recordlake.scratch import bound_batches
from recordlake.shipping import ship
from recordlake.sinks import export
from recordlake.sources import html, readers, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEARCH_TEXT = "the and of responsabilidade"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def flags(**tests) -> list:
    return [t.alias(n) for n, t in tests.items()]


# --- federated search

_TOKENS = identity.query_tokens(SEARCH_TEXT)
_SCORED = with_views("results") + f""", scored AS (
  SELECT *, lower(concat_ws(' ', question, thesis, summary, number)) AS h, 'case:' || regexp_replace(lower(number), '[^0-9a-z]', '', 'g') AS identity FROM results
), ranked AS (
  SELECT *, {" + ".join(f"CAST((length(h) - length(replace(h, '{t}', ''))) // {len(t)} AS BIGINT)" for t in _TOKENS)} AS score FROM scored
), uniq AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY score DESC, source, arrival) AS rn FROM ranked) WHERE rn = 1
)"""


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.rank_dedup(view(spark, sf_dir, "results"), SEARCH_TEXT, [F.asc("source"), F.asc("arrival")])


@query("federated_rank_dedup_page", _SCORED + " SELECT id, source, court, number, identity, score FROM uniq ORDER BY score DESC, source, id LIMIT 10 OFFSET 10")
def federated_rank_dedup_page(spark, sf_dir):
    return federate.ranked_page(_unique(spark, sf_dir), 2, 10).select("id", "source", "court", "number", "identity", "score")


@query("federated_rank_dedup_all", _SCORED + " SELECT id, source, identity, score FROM uniq")
def federated_rank_dedup_all(spark, sf_dir):
    return _unique(spark, sf_dir).select("id", "source", "identity", "score")


@query("federated_envelope_counts", _SCORED + """ SELECT (SELECT count(*) FROM results) AS collected, count(*) AS unique_total,
  greatest(0, least(10, count(*) - 10)) AS returned, count(*) > 20 AS has_more, CASE WHEN count(*) > 20 THEN CAST(20 AS BIGINT) END AS next_offset FROM uniq""")
def federated_envelope_counts(spark, sf_dir):
    return federate.envelope(view(spark, sf_dir, "results"), _unique(spark, sf_dir), 2, 10)


@query("federated_concatenate", with_views("results") + """, parts AS (SELECT *, CAST(substr(source, 4) AS INT) AS n FROM results WHERE source IN ('src3', 'src1', 'src2')),
  windowed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY arrival) AS rn FROM parts)
  SELECT id, source, CAST(CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END AS INT) AS source_order FROM windowed WHERE rn <= 20""")
def federated_concatenate(spark, sf_dir):
    results = view(spark, sf_dir, "results")
    parts = federate.concatenate({s: results.filter(F.col("source") == s) for s in ("src3", "src1", "src2")})
    return federate.fetch_window(parts, 2, 10).select("id", "source", "source_order")


@query("word_filter_and_or_not_phrase", with_views("results") + """ SELECT id, court FROM results WHERE contains(lower(coalesce(summary, '')), 'the') AND contains(lower(coalesce(summary, '')), 'and')
  AND (contains(lower(coalesce(summary, '')), 'thble') OR contains(lower(coalesce(summary, '')), 'ouer') OR contains(lower(coalesce(summary, '')), 'inan')) AND NOT contains(lower(coalesce(summary, '')), 'trash') AND contains(lower(coalesce(summary, '')), 'of the')""")
def word_filter_and_or_not_phrase(spark, sf_dir):
    q = SearchQuery.of(all_words="the and", any_words="thble ouer inan", without_words="trash", exact_phrase="of the")
    return view(spark, sf_dir, "results").filter(q.word_predicate(F.col("summary"))).select("id", "court")


@query("boosted_search_score", with_views("results") + """ SELECT id, round(CAST((CASE WHEN contains(lower(coalesce(thesis, '')), 'the') THEN 3.0 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(thesis, '')), 'and') THEN 3.0 ELSE 0 END)
  + (CASE WHEN contains(lower(coalesce(summary, '')), 'the') THEN 1.5 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(summary, '')), 'and') THEN 1.5 ELSE 0 END) AS DOUBLE), 3) AS score FROM results""")
def boosted_search_score(spark, sf_dir):
    q = SearchQuery.of(text="the and")
    score = q.boosted_score(thesis=(F.col("thesis"), 3.0), summary=(F.col("summary"), 1.5))
    return view(spark, sf_dir, "results").select("id", F.round(score, 3).alias("score"))


@query("accent_fold_search", "SELECT doc_id FROM documents WHERE contains(replace(lower(strip_accents(text)), 'ß', 'ss'), 'cion')")
def accent_fold_search(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter(text.accent_contains(F.col("text"), "Ción")).select("doc_id")


@query("facet_counts_topk", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, lang LIMIT 3")
def facet_counts_topk(spark, sf_dir):
    return quality.facet_topk(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", 3)


# --- canonical model

@query("classify_decision", with_views("results") + """ SELECT id, regexp_matches(lower(trim(type)), 'decisao|decisão|despacho|sentenca|sentença') OR lower(trim(type)) IN ('acordao', 'acórdão', 'monocratica', 'monocrática') AS is_decision,
  CASE trim(type) WHEN 'Acórdão' THEN 'acordao' WHEN 'Decisão Monocrática' THEN 'decisao_monocratica' WHEN 'Súmula' THEN 'sumula' WHEN 'Despacho' THEN 'despacho' ELSE 'sentenca' END AS decision_type FROM results""")
def classify_decision(spark, sf_dir):
    return view(spark, sf_dir, "results").select("id", canonical.is_decision(F.col("type")).alias("is_decision"), text.normalize_decision_type(F.col("type")).alias("decision_type"))


_DAY = "strftime(strptime(judgment_date, '%-d/%-m/%Y'), '%Y-%m-%d')"


@query("canonical_decisions", with_views("results") + f""" SELECT id, source, court, number AS case_number, trim(rapporteur) AS rapporteur, {_DAY} AS judgment_date, judgment_date AS judgment_date_raw, publication_date,
  coalesce(nullif(trim(access_status), ''), 'partial') AS access_status, CASE WHEN extraction_status = 'complete' AND summary = '' AND full_text IS NULL THEN 'partial' ELSE extraction_status END AS extraction_status,
  'decision|' || source || '|' || lower(court) || '|' || number AS canonical_key,
  concat_ws(',', 'judgment_date_normalized', CASE WHEN nullif(trim(access_status), '') IS NULL THEN 'access_downgraded' END, CASE WHEN extraction_status = 'complete' AND summary = '' AND full_text IS NULL THEN 'extraction_downgraded' END) AS transformations
  FROM results WHERE type <> 'Súmula'""")
def canonical_decisions(spark, sf_dir):
    made = canonical.to_decisions(view(spark, sf_dir, "results"))
    return made.select("id", "source", "court", "case_number", "rapporteur", "judgment_date", "judgment_date_raw", "publication_date", "access_status", "extraction_status", "canonical_key", F.array_join("transformations", ",").alias("transformations"))


@query("canonical_precedents", with_views("results") + """ SELECT id, source, court, number, type AS precedent_type, nullif(trim(thesis), '') AS thesis, substr(updated_at, 1, 10) AS updated_at, updated_at AS updated_at_raw,
  'precedent|' || source || '|' || lower(court) || '|súmula|' || number AS canonical_key FROM results WHERE type = 'Súmula'""")
def canonical_precedents(spark, sf_dir):
    return canonical.to_precedents(view(spark, sf_dir, "results")).select("id", "source", "court", "number", "precedent_type", "thesis", "updated_at", "updated_at_raw", "canonical_key")


@query("canonical_key", with_views("records") + """ SELECT id, concat_ws('|', kind, lower(source), lower(court), case_number, lower(subject)) AS canonical_key FROM records""")
def canonical_key(spark, sf_dir):
    return view(spark, sf_dir, "records").select("id", identity.canonical_key(F.col("kind"), F.col("source"), F.col("court"), F.col("case_number"), F.col("subject")).alias("canonical_key"))


@query("record_identity", with_views("records") + """ SELECT id, CASE WHEN position % 3 = 0 THEN 'case:' || case_number WHEN position % 3 = 1 THEN concat_ws(':', 'precedent', court, subject, id) ELSE concat_ws(':', 'source', source, id) END AS identity,
  CASE WHEN position % 2 = 0 THEN concat_ws(':', source, id) ELSE concat_ws(':', source, case_number, kind) END AS collection_identity FROM records""")
def record_identity(spark, sf_dir):
    rows = view(spark, sf_dir, "records").withColumns({"cn": F.when(F.col("position") % 3 == 0, F.col("case_number")), "pt": F.when(F.col("position") % 3 == 1, F.col("subject")), "cid": F.when(F.col("position") % 2 == 0, F.col("id"))})
    null = F.lit(None).cast("string")
    return rows.select("id", identity.record_identity(F.col("cn"), null, F.col("pt"), F.col("court"), F.col("source"), F.col("id")).alias("identity"), identity.collection_identity(F.col("source"), F.col("cid"), F.col("case_number"), F.col("kind")).alias("collection_identity"))


@query("normalize_dates", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS iso FROM orders""")
def normalize_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month(d))
    forms = [F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "d-M-yyyy"), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy/MM/dd"), F.concat_ws(" de ", F.dayofmonth(d), month, F.year(d)), F.date_format(d, "yyyyMMdd"), F.lit("31/02/2020")]
    chosen = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", dates.normalize_date(chosen).alias("iso"))


@query("normalize_cnj", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN substr(n, 1, 7) || '-' || substr(n, 8, 2) || '.' || substr(n, 10, 4) || '.' || substr(n, 14, 1) || '.' || substr(n, 15, 2) || '.' || substr(n, 17) ELSE 'REsp ' || o_orderkey END AS cnj FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS n FROM orders)")
def normalize_cnj(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.lpad(F.col("o_orderkey").cast("string"), 20, "0")).otherwise(F.concat(F.lit(" REsp   "), "o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.normalize_cnj_number(raw).alias("cnj"))


@query("normalize_court_code", "SELECT n_nationkey, replace(replace(upper(n_name), '-', ''), ' ', '') AS code, lower(trim(regexp_replace(n_name, '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS slug FROM nation")
def normalize_court_code(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", text.normalize_court_code(F.col("n_name")).alias("code"), text.slug(F.col("n_name")).alias("slug"))


@query("normalize_text", "SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS clean, sha256(text) AS fingerprint FROM documents")
def normalize_text(spark, sf_dir):
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.normalize_text(F.col("text")).alias("clean"), identity.fingerprint(F.col("text")).alias("fingerprint"))


@query("url_normalize", "SELECT page_id, split_part(url, '#', 1) AS url, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def url_normalize(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.drop_fragment(F.col("url")).alias("url"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("excel_serial_date", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(DATE '1899-12-30' + CAST(40000 + p_partkey % 5000 AS INT) AS VARCHAR) WHEN 1 THEN '2020-02-29' ELSE p_name END AS iso FROM part")
def excel_serial_date(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, (40000 + F.col("p_partkey") % 5000).cast("string")).when(F.col("p_partkey") % 3 == 1, "2020-02-29").otherwise(F.col("p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", dates.excel_serial_date(raw).alias("iso"))


@query("array_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS iso FROM orders")
def array_date(spark, sf_dir):
    d = F.col("o_orderdate")
    parts = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.year(d), F.lit(13), F.lit(1))).otherwise(F.array(F.year(d), F.month(d), F.dayofmonth(d)))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", dates.array_date(parts).alias("iso"))


@query("public_values", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS value, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS first_value FROM documents")
def public_values(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(" Não informado ")).otherwise(F.col("source"))
    return docs.select("doc_id", text.public_value(raw).alias("value"), text.first_nonempty(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit("  ")), F.col("lang")).alias("first_value"))


@query("labelled_values", "SELECT o_orderkey, trim(o_orderpriority) AS classe, c_name AS relator FROM orders JOIN customer ON o_custkey = c_custkey")
def labelled_values(spark, sf_dir):
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    line = F.concat(F.lit("Classe: "), "o_orderpriority", F.lit(" Relator : "), "c_name", F.lit(" Data: x"))
    labels = ["Classe", "Relator", "Data"]
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", text.labelled_value(line, "Classe", labels).alias("classe"), text.labelled_value(line, "Relator", labels).alias("relator"))


@query("synthetic_ids", """SELECT o_orderkey, 'rec-' || substr(sha256(concat(o_orderkey, '|', coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END, ''), '|', o_orderpriority)), 1, 16) AS id,
  sha256('{"key": "' || o_orderkey || '", "status": "' || o_orderstatus || '"}') AS json_key FROM orders""")
def synthetic_ids(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus"))
    return orders.select("o_orderkey", text.synthetic_id("rec-", 16, F.col("o_orderkey"), status, F.col("o_orderpriority")).alias("id"), identity.json_fingerprint({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey")}).alias("json_key"))


@query("localized_totals", "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000 AS total FROM orders")
def localized_totals(spark, sf_dir):
    line = F.concat(F.lit("Foram encontrados "), "o_orderkey", F.lit(".000 registros"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.localized_total(line, r"encontrados ([\d.]+) registros").alias("total"))


@query("text_cleanup", "SELECT n_nationkey, n_name || ' ' || n_name || ', ok' AS punctuated, n_name AS halved, 'https://x.test/a?q=1' AS url FROM nation")
def text_cleanup(spark, sf_dir):
    n = F.col("n_name")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", text.close_punctuation(F.concat_ws(" ", n, n, F.lit(", ok"))).alias("punctuated"), text.collapse_doubled(F.concat_ws(" ", n, n)).alias("halved"), text.strip_session(F.lit("https://x.test/a;jsessionid=1?q=1&token=9")).alias("url"),
    )


# --- store

@query("store_query_filters", with_views("records") + " SELECT id, kind, publication_date FROM records WHERE kind = 'decision' AND court = 'BUILDING' AND publication_date >= '1995-01-01' AND publication_date <= '1997-06-30'")
def store_query_filters(spark, sf_dir):
    return view(spark, sf_dir, "records").filter(store.predicate(kind="decision", court="BUILDING", subject="", date_from="1995-01-01", date_to="1997-06-30")).select("id", "kind", "publication_date")


@query("store_query_page", with_views("records") + " SELECT id, publication_date, updated_at FROM records WHERE kind = 'precedent' ORDER BY publication_date DESC NULLS LAST, updated_at DESC, id LIMIT 15 OFFSET 30")
def store_query_page(spark, sf_dir):
    return store.query_records(view(spark, sf_dir, "records"), 15, 30, kind="precedent").select("id", "publication_date", "updated_at")


@query("store_list", with_views("records") + " SELECT id, updated_at FROM records ORDER BY updated_at DESC, id LIMIT 20")
def store_list(spark, sf_dir):
    return store.list_records(view(spark, sf_dir, "records")).select("id", "updated_at")


@query("store_count", with_views("records") + " SELECT count(*) AS total FROM records WHERE kind = 'decision' AND subject = '1-URGENT'")
def store_count(spark, sf_dir):
    return store.count_records(view(spark, sf_dir, "records"), kind="decision", subject="1-URGENT")


@query("store_stats_grouping_sets", with_views("records") + """ SELECT 'all' AS "grouping", NULL AS name, count(*) AS total FROM records UNION ALL SELECT 'kind', kind, count(*) FROM records WHERE kind IS NOT NULL GROUP BY kind
  UNION ALL SELECT 'source', source, count(*) FROM records WHERE source IS NOT NULL GROUP BY source""")
def store_stats_grouping_sets(spark, sf_dir):
    return store.stats(view(spark, sf_dir, "records"))


@query("run_records_join", with_views("records", "links") + """ SELECT DISTINCT r.id, publication_date, updated_at FROM links JOIN records r ON canonical_key = r.id WHERE run_id = 'run-3' ORDER BY publication_date DESC NULLS LAST, updated_at DESC, id LIMIT 25""")
def run_records_join(spark, sf_dir):
    records = view(spark, sf_dir, "records").withColumn("canonical_key", F.col("id"))
    return store.run_records(view(spark, sf_dir, "links"), records, F.lit("run-3"), 25).select("id", "publication_date", "updated_at")


@query("run_records_count", with_views("links") + " SELECT run_id, count(DISTINCT canonical_key) AS total FROM links WHERE run_id IN ('run-3', 'run-5') GROUP BY run_id")
def run_records_count(spark, sf_dir):
    links = view(spark, sf_dir, "links")
    return store.count_run_records(links, F.lit("run-3")).select(F.lit("run-3").alias("run_id"), "total").unionByName(store.count_run_records(links, F.lit("run-5")).select(F.lit("run-5").alias("run_id"), "total"))


@query("runs_list", with_views("links") + " SELECT run_id AS id, max(position) AS created_at FROM links GROUP BY run_id ORDER BY created_at DESC, id")
def runs_list(spark, sf_dir):
    return store.list_runs(view(spark, sf_dir, "links").groupBy(F.col("run_id").alias("id")).agg(F.max("position").alias("created_at")))


@query("upsert_last_wins", with_views("links") + """, both_ AS (SELECT run_id, canonical_key, position, linenumber, CASE WHEN linenumber > 3 THEN 1 ELSE 0 END AS is_new FROM links)
  SELECT run_id, canonical_key, arg_max(linenumber, is_new * 1000000000000 + position) AS linenumber, min(position) AS created_at FROM both_ GROUP BY run_id, canonical_key""")
def upsert_last_wins(spark, sf_dir):
    links = view(spark, sf_dir, "links").withColumn("created_at", F.col("position"))
    return store.upsert(links.filter("linenumber <= 3"), links.filter("linenumber > 3"), ["run_id", "canonical_key"], "position").select("run_id", "canonical_key", "linenumber", "created_at")


def _two_key_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = view(spark, sf_dir, "records").withColumn("created_at", F.col("position"))
    base = records.filter("position % 3 <> 0").select("kind", "id", F.concat_ws("|", F.lit("k"), "position").alias("canonical_key"), "created_at", "price")
    fresh = records.filter("position % 3 <> 1").select(
        "kind", F.when(F.col("position") % 4 == 0, F.col("id")).otherwise(F.concat(F.lit("n"), "position")).alias("id"),
        F.concat_ws("|", F.lit("k"), F.when(F.col("position") % 5 == 0, F.col("position") + 2).otherwise(F.col("position"))).alias("canonical_key"), F.lit(10**12).cast("long").alias("created_at"), (F.col("price") + 1).alias("price"), "position",
    )
    return base, fresh


_TWO_KEYS = with_views("records") + """, base AS (SELECT kind, id, 'k|' || position AS canonical_key, position AS created_at, price FROM records WHERE position % 3 <> 0),
  fresh0 AS (SELECT kind, CASE WHEN position % 4 = 0 THEN id ELSE 'n' || position END AS id, 'k|' || CASE WHEN position % 5 = 0 THEN position + 2 ELSE position END AS canonical_key, price + 1 AS price, position FROM records WHERE position % 3 <> 1),
  fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY position DESC) AS rn FROM fresh0) WHERE rn = 1),
  m AS (SELECT f.*, a.canonical_key AS key_of_id, a.created_at AS born_id, b.id AS id_of_key, b.created_at AS born_key FROM fresh f LEFT JOIN base a ON f.kind = a.kind AND f.id = a.id LEFT JOIN base b ON f.canonical_key = b.canonical_key),
  clash AS (SELECT * FROM m WHERE key_of_id IS NOT NULL AND id_of_key IS NOT NULL AND key_of_id <> canonical_key), clean AS (SELECT * FROM m EXCEPT SELECT * FROM clash)"""


@query("upsert_two_keys", _TWO_KEYS + """ SELECT kind, id, canonical_key, coalesce(born_key, born_id, 1000000000000) AS created_at, price FROM clean
  UNION ALL SELECT kind, id, canonical_key, created_at, price FROM base WHERE canonical_key NOT IN (SELECT canonical_key FROM clean) AND (kind, id) NOT IN (SELECT (kind, id) FROM clean)""")
def upsert_two_keys(spark, sf_dir):
    return store.upsert_records(*_two_key_tables(spark, sf_dir))[0]


@query("upsert_conflicts", _TWO_KEYS + " SELECT kind, id, canonical_key FROM clash")
def upsert_conflicts(spark, sf_dir):
    return store.upsert_records(*_two_key_tables(spark, sf_dir))[1].select("kind", "id", "canonical_key")


@query("selector_sticky_approve", with_views("links") + """, s AS (SELECT run_id, canonical_key, linenumber = 2 AS approved, position, CAST(linenumber * 0.1 AS DOUBLE) AS confidence FROM links)
  SELECT run_id, canonical_key, bool_or(approved) AS approved, round(arg_max(confidence, position), 3) AS confidence FROM s GROUP BY run_id, canonical_key""")
def selector_sticky_approve(spark, sf_dir):
    links = view(spark, sf_dir, "links").select("run_id", "canonical_key", (F.col("linenumber") == 2).alias("approved"), "position", F.round(F.col("linenumber") * 0.1, 3).alias("confidence"), F.lit(1).alias("matches"), "linenumber")
    parts = [links.filter(c).drop("linenumber") for c in ("linenumber <= 3", "linenumber > 3")]
    return store.selector_upsert(*parts, ["run_id", "canonical_key"]).drop("matches")


# --- de-duplication and budgets

@query("dedup_first_wins", with_views("links") + " SELECT run_id, canonical_key, min(position) AS position FROM links GROUP BY run_id, canonical_key")
def dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(view(spark, sf_dir, "links"), ["run_id", "canonical_key"], [F.asc("position")]).select("run_id", "canonical_key", "position")


@query("dedup_last_wins", with_views("links") + " SELECT canonical_key, max(position) AS position, min(position) AS first_position, max({'position': position, 'run_id': run_id}).run_id AS run_id FROM links GROUP BY canonical_key")
def dedup_last_wins(spark, sf_dir):
    return dedup.last_wins(view(spark, sf_dir, "links"), ["canonical_key"], "position").select("canonical_key", "position", "first_position", "run_id")


@query("repeated_page", with_views("evidence") + """, p AS (SELECT seq // 50 AS page, source || ':' || (seq % 37) AS ident, seq FROM evidence), n AS (SELECT *, row_number() OVER (PARTITION BY page, ident ORDER BY seq) AS rn, min(page) OVER (PARTITION BY ident) AS first_page FROM p)
  SELECT page, count(*) AS "rows", CAST(count_if(rn > 1) AS BIGINT) AS page_duplicates, CAST(count_if(rn = 1 AND first_page < page) AS BIGINT) AS seen_before FROM n GROUP BY page""")
def repeated_page(spark, sf_dir):
    pages = view(spark, sf_dir, "evidence").select(F.floor(F.col("seq") / 50).alias("page"), F.concat_ws(":", "source", F.col("seq") % 37).alias("ident"), "seq")
    return dedup.duplicate_counts(pages, "page", "ident", [F.asc("seq")])


@query("collect_cap_running", with_views("evidence") + " SELECT run, seq, CAST(running AS INT) AS running FROM (SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY seq) AS running FROM evidence) WHERE running <= 25")
def collect_cap_running(spark, sf_dir):
    return dedup.record_cap(view(spark, sf_dir, "evidence"), ["run"], [F.asc("seq")], 25).select("run", "seq", "running")


@query("crawl_byte_budget", with_views("evidence") + """ SELECT run, seq, CAST(before AS BIGINT) AS bytes_before FROM (SELECT run, seq, coalesce(sum(bytes) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM evidence) WHERE before < 500""")
def crawl_byte_budget(spark, sf_dir):
    return dedup.byte_budget(view(spark, sf_dir, "evidence"), ["run"], [F.asc("seq")], "bytes", 500).select("run", "seq", "bytes_before")


@query("sync_counters", "SELECT count(*) AS seen, count(DISTINCT CASE WHEN l_orderkey % 10 > 0 THEN l_orderkey END) AS saved, CAST(count(*) - count_if(l_orderkey % 10 = 0) - count(DISTINCT CASE WHEN l_orderkey % 10 > 0 THEN l_orderkey END) AS BIGINT) AS duplicates, CAST(count_if(l_orderkey % 10 = 0) AS BIGINT) AS invalid FROM lineitem")
def sync_counters(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.when(F.col("l_orderkey") % 10 > 0, F.col("l_orderkey").cast("string")).otherwise(F.lit(" ")).alias("id"))
    return dedup.sync_counters(lines, "id")


_MANIFEST = with_views("manifest") + ", old AS (SELECT source, resource_id, CASE WHEN resource_id % 4 = 0 THEN 'stale' ELSE fingerprint END AS fingerprint FROM manifest WHERE status = 'complete')"


def _old_manifest(now: DataFrame) -> DataFrame:
    return now.select("source", "resource_id", F.when(F.col("resource_id") % 4 == 0, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"), "status")


@query("sync_skip_antijoin", _MANIFEST + " SELECT source, resource_id, fingerprint FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source = m.source AND o.resource_id = m.resource_id AND o.fingerprint = m.fingerprint)")
def sync_skip_antijoin(spark, sf_dir):
    now = view(spark, sf_dir, "manifest")
    return dedup.unsynced(now, _old_manifest(now), ["source", "resource_id"]).select("source", "resource_id", "fingerprint")


@query("sync_skip_semijoin", _MANIFEST + " SELECT m.source, m.resource_id FROM manifest m JOIN old o ON o.source = m.source AND o.resource_id = m.resource_id AND o.fingerprint = m.fingerprint")
def sync_skip_semijoin(spark, sf_dir):
    now = view(spark, sf_dir, "manifest")
    return dedup.synced(now, _old_manifest(now), ["source", "resource_id"]).select("source", "resource_id")


@query("iter_pages", with_views("results") + """, u AS (SELECT source, number AS id, min(arrival) AS arrival FROM results GROUP BY source, number), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY arrival // 10, arrival) AS running FROM u)
  SELECT source, id, arrival AS position, CAST(running AS INT) AS running FROM n WHERE running <= 8""")
def iter_pages(spark, sf_dir):
    rows = view(spark, sf_dir, "results").select("source", F.col("number").alias("id"), F.floor(F.col("arrival") / 10).alias("page"), F.col("arrival").alias("position"))
    return readers.iter_pages(rows, 8).select("source", "id", "position", "running")


# --- routing

_CAPS = with_views("capabilities") + """, routed AS (SELECT source, category, unified, filters, CASE WHEN NOT unified THEN 'unified_search_not_supported' WHEN category = 'case_lookup' THEN 'outside_jurisprudence_scope' WHEN filters <> '' AND NOT contains(filters, 'number') THEN 'identifier_filter_not_supported'
  WHEN category = 'judicial_communications' THEN 'not_jurisprudence_source' WHEN category <> 'court_jurisprudence' THEN 'category_not_applicable' END AS skip_reason FROM capabilities)"""


def _capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "capabilities").withColumn("supported_filters", F.filter(F.split("filters", ","), lambda f: f != ""))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.route_sources(_capabilities(spark, sf_dir), ["number"], ["types", "courts", "text"], ["court_jurisprudence"])


@query("route_sources", _CAPS + """ SELECT source, skip_reason, skip_reason IS NULL AS searched, CASE WHEN skip_reason IS NOT NULL THEN '' WHEN filters = '' THEN 'courts,types' WHEN filters = 'number,text' THEN 'courts,types' ELSE '' END AS warnings FROM routed""")
def route_sources(spark, sf_dir):
    return _routes(spark, sf_dir)


@query("routing_summary", _CAPS + """, err AS (SELECT source, 'ReadTimeout' AS error FROM capabilities WHERE key % 7 = 1), r AS (SELECT *, CASE WHEN skip_reason IS NOT NULL THEN '' WHEN filters IN ('', 'number,text') THEN 'courts,types' ELSE '' END AS warnings FROM routed)
  SELECT source, 1 AS part_order, 'searched' AS part, '' AS detail FROM r WHERE skip_reason IS NULL AND source NOT IN (SELECT source FROM err) UNION ALL SELECT source, 2, 'warning', warnings FROM r WHERE warnings <> ''
  UNION ALL SELECT source, 3, 'skipped', skip_reason FROM r WHERE skip_reason IS NOT NULL UNION ALL SELECT source, 4, 'failed', error FROM err WHERE source IN (SELECT source FROM r WHERE skip_reason IS NULL)""")
def routing_summary(spark, sf_dir):
    errors = view(spark, sf_dir, "capabilities").filter("key % 7 = 1").select("source", F.lit("ReadTimeout").alias("error"))
    return federate.routing_summary(_routes(spark, sf_dir), errors)


@query("default_sources", with_views("capabilities") + " SELECT source FROM capabilities WHERE unified AND category IN ('court_jurisprudence', 'court_catalog') ORDER BY source")
def default_sources(spark, sf_dir):
    return federate.default_sources(_capabilities(spark, sf_dir), ["court_jurisprudence", "court_catalog"])


@query("source_registry", "SELECT source FROM (VALUES " + ", ".join(f"('{r['source']}', '{r['category']}', {r['unified']})" for r in registry.rows()) + """) AS r(source, category, unified)
  WHERE unified AND category IN ('administrative_jurisprudence', 'court_jurisprudence', 'court_precedents', 'curated_jurisprudence', 'electoral_jurisprudence', 'jurisprudence', 'qualified_precedents')""")
def source_registry(spark, sf_dir):
    return federate.default_sources(registry.capabilities(spark), registry.DEFAULT_CATEGORIES)


_STATUS = with_views("capabilities", "evidence") + """, completeness AS (SELECT source, CASE WHEN sum(bytes) % 5 = 0 THEN 0 ELSE count(*) END AS returned, CASE WHEN sum(bytes) % 5 = 0 THEN 0 ELSE 9 END AS reported_total, CASE count(*) % 3 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS is_complete FROM evidence GROUP BY source),
  errors AS (SELECT source, arg_max(kind || ': ' || chain, seq) AS error FROM evidence WHERE kind IS NOT NULL AND status = 'error' GROUP BY source), counts AS (SELECT source, count(*) AS n FROM evidence GROUP BY source),
  routing AS (SELECT source, CASE key % 9 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'searched' END AS action FROM capabilities WHERE key % 10 <> 3)"""


@query("source_status_view", _STATUS + """ SELECT coalesce(r.source, n.source) AS source, CASE WHEN r.source IS NULL THEN 'ok' WHEN error IS NOT NULL AND regexp_matches(lower(error), 'ssl|certificate|tls') THEN 'ssl_error' WHEN error IS NOT NULL OR action = 'failed' THEN 'failed' WHEN action = 'skipped' THEN 'skipped'
  WHEN c.source IS NULL THEN 'ok' WHEN c.is_complete IS NULL THEN 'unknown' WHEN NOT c.is_complete THEN 'partial' WHEN returned = 0 AND reported_total = 0 THEN 'empty' ELSE 'ok' END AS status,
  CAST(CASE WHEN c.source IS NOT NULL AND r.source IS NOT NULL THEN returned ELSE coalesce(n, 0) END AS BIGINT) AS count
  FROM routing r LEFT JOIN completeness c ON r.source = c.source LEFT JOIN errors e ON r.source = e.source FULL JOIN counts n ON r.source = n.source""")
def source_status_view(spark, sf_dir):
    events, n = view(spark, sf_dir, "evidence"), F.count(F.lit(1))
    nothing = F.sum("bytes") % 5 == 0
    completeness = events.groupBy("source").agg(F.when(nothing, 0).otherwise(n).alias("returned"), F.when(nothing, 0).otherwise(9).alias("reported_total"), F.when(n % 3 > 0, n % 3 == 2).alias("is_complete"))
    errors = events.filter("kind is not null and status = 'error'").groupBy("source").agg(F.max_by(F.concat("kind", F.lit(": "), "chain"), "seq").alias("error"))
    routing = view(spark, sf_dir, "capabilities").filter("key % 10 <> 3").select("source", F.when(F.col("key") % 9 == 0, "skipped").when(F.col("key") % 9 == 1, "failed").otherwise("searched").alias("action"))
    return federate.source_status(routing, completeness, errors, events.groupBy("source").agg(n.alias("n"))).select("source", "status", "count")


@query("fit_remote_page", """WITH a AS (SELECT p_partkey, CAST(1 + p_partkey % 7 AS INT) AS page, CAST(1 + p_partkey % 100 AS INT) AS size FROM part), b AS (SELECT *, CASE WHEN size <= 10 THEN 10 WHEN size <= 25 THEN 25 WHEN size <= 50 THEN 50 ELSE 100 END AS fitted FROM a)
  SELECT p_partkey, fitted AS size, CAST((page - 1) * size // fitted + 1 AS INT) AS page, CAST((page - 1) * size % fitted AS INT) AS "offset" FROM b""")
def fit_remote_page(spark, sf_dir):
    fitted = federate.fit_remote_page((1 + F.col("p_partkey") % 7).cast("int"), (1 + F.col("p_partkey") % 100).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fitted.alias("f")).select("p_partkey", "f.size", "f.page", "f.offset")


@query("page_completeness", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 0 ELSE 20 + doc_id % 50 END AS total, doc_id % 40 AS start, doc_id % 11 AS returned, doc_id % 5 > 0 AS known FROM documents)
  SELECT doc_id, CASE WHEN NOT known OR total IS NULL THEN NULL WHEN total = 0 THEN TRUE WHEN returned = 0 THEN FALSE ELSE greatest(start, 1) + returned - 1 >= total END AS is_complete,
  CASE WHEN NOT known OR total IS NULL THEN 'total_unknown' WHEN total = 0 THEN 'no_results' WHEN returned = 0 THEN 'empty_page' WHEN greatest(start, 1) + returned - 1 >= total THEN 'total_reached' ELSE 'more_available' END AS reason FROM p""")
def page_completeness(spark, sf_dir):
    i = F.col("doc_id")
    total = F.when(i % 6 == 0, F.lit(None)).when(i % 6 == 1, 0).otherwise(20 + i % 50)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", federate.page_completeness(total, i % 40, i % 11, i % 5 > 0).alias("c")).select("doc_id", "c.is_complete", "c.reason")


@query("completeness_rollup", with_views("capabilities") + """, s AS (SELECT source, NOT unified AS skipped, key % 9 = 0 AS failed, CASE key % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS c FROM capabilities)
  SELECT coalesce(string_agg(source, ',' ORDER BY source) FILTER (c), '') AS complete_sources, coalesce(string_agg(source, ',' ORDER BY source) FILTER (NOT c), '') AS partial_sources, coalesce(string_agg(source, ',' ORDER BY source) FILTER (c IS NULL AND NOT failed AND NOT skipped), '') AS unknown_sources,
  count_if(skipped OR failed) = 0 AND count_if(coalesce(NOT c, TRUE)) = 0 AS collection_complete FROM s""")
def completeness_rollup(spark, sf_dir):
    key = F.col("key")
    flag = F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    return federate.completeness_rollup(view(spark, sf_dir, "capabilities").select("source", (~F.col("unified")).alias("skipped"), F.lit(False).alias("warned"), (key % 9 == 0).alias("failed"), flag.alias("is_complete")))


# --- quality, contracts, discovery

@query("http_access_status", with_views("evidence") + """, d AS (SELECT *, CASE WHEN code IN (401, 403, 407, 451) THEN 'access_controlled' WHEN code = 429 THEN 'rate_limited' WHEN code = 404 THEN 'empty' WHEN code IN (500, 503) THEN 'source_unavailable' WHEN code = 200 AND bytes > 0 THEN 'valid' WHEN code = 200 THEN 'empty' ELSE 'unknown' END AS discovery FROM evidence)
  SELECT seq, CASE code WHEN 404 THEN 'not_found' WHEN 401 THEN 'login_required' WHEN 403 THEN 'access_control_required' WHEN 429 THEN 'source_unavailable' WHEN 503 THEN 'source_unavailable' WHEN 500 THEN 'source_unavailable' WHEN 200 THEN 'public' ELSE 'partial' END AS access, discovery,
  CASE discovery WHEN 'access_controlled' THEN 'access_control_required' WHEN 'source_unavailable' THEN 'source_unavailable' WHEN 'empty' THEN 'not_found' WHEN 'valid' THEN 'public' ELSE 'partial' END AS discovery_access,
  CASE WHEN discovery = 'empty' OR NOT bytes > 0 THEN 'empty' WHEN discovery IN ('access_controlled', 'rate_limited') THEN 'partial' WHEN discovery = 'source_unavailable' THEN 'failed' ELSE 'complete' END AS extraction FROM d""")
def http_access_status(spark, sf_dir):
    body = F.col("bytes") > 0
    found = view(spark, sf_dir, "evidence").withColumn("discovery", probe.discovery_of_code(F.col("code"), body))
    return found.select("seq", quality.access_of_status(F.col("code")).alias("access"), "discovery", probe.access_of_discovery(F.col("discovery")).alias("discovery_access"), probe.extraction_of_discovery(F.col("discovery"), body).alias("extraction"))


@query("discovery_status_maps", with_views("evidence") + """ SELECT seq, CASE transport WHEN 'timeout' THEN 'timeout' WHEN 'tls_error' THEN 'tls_error' WHEN 'source_unavailable' THEN 'source_unavailable' WHEN 'redirect_limit' THEN 'source_unavailable' WHEN 'redirect_outside_allowlist' THEN 'redirect_outside_allowlist' ELSE 'unknown' END AS of_transport,
  CASE route WHEN 'live_valid' THEN 'valid' WHEN 'candidate' THEN 'candidate' WHEN 'partial_response' THEN 'candidate' WHEN 'access_control_or_login' THEN 'access_controlled' WHEN 'not_found' THEN 'empty' WHEN 'source_unavailable' THEN 'source_unavailable' WHEN 'invalid_response' THEN 'unknown'
    ELSE CASE WHEN code = 404 THEN 'empty' WHEN code = 429 THEN 'rate_limited' WHEN code IN (401, 403, 407, 451) THEN 'access_controlled' WHEN code >= 500 THEN 'source_unavailable' WHEN code = 200 THEN CASE WHEN bytes > 0 THEN 'valid' ELSE 'empty' END ELSE 'unknown' END END AS of_route
  FROM (SELECT *, ['timeout', 'tls_error', 'source_unavailable', 'redirect_limit', 'redirect_outside_allowlist', 'other'][CAST(seq % 6 + 1 AS INT)] AS transport,
    ['live_valid', 'candidate', 'partial_response', 'access_control_or_login', 'not_found', 'source_unavailable', 'invalid_response', 'odd'][CAST(seq % 8 + 1 AS INT)] AS route FROM evidence)""")
def discovery_status_maps(spark, sf_dir):
    one_of = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("seq") % len(names) + 1).cast("int"))
    transport = one_of(["timeout", "tls_error", "source_unavailable", "redirect_limit", "redirect_outside_allowlist", "other"])
    route = one_of(["live_valid", "candidate", "partial_response", "access_control_or_login", "not_found", "source_unavailable", "invalid_response", "odd"])
    return view(spark, sf_dir, "evidence").select("seq", probe.discovery_of_transport(transport).alias("of_transport"), probe.discovery_of_route(route, F.col("code"), F.col("bytes") > 0).alias("of_route"))


_KIND = """CASE WHEN seq % 12 IN (0, 7) THEN 'NetworkConfigurationError' WHEN seq % 12 = 2 THEN 'SslVerificationError' ELSE kind END"""


@query("error_classification", with_views("evidence") + f""" SELECT seq, {_KIND} AS error_class, CASE seq % 12 WHEN 0 THEN 'network_configuration' WHEN 7 THEN 'network_configuration' WHEN 2 THEN 'tls_verification_failed' WHEN 3 THEN 'timeout' WHEN 4 THEN 'blocked' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'source_changed' WHEN 8 THEN 'query_rejected' ELSE 'error' END AS validation FROM evidence WHERE kind IS NOT NULL""")
def error_classification(spark, sf_dir):
    kind, chain = F.col("kind"), F.col("chain")
    return view(spark, sf_dir, "evidence").filter(kind.isNotNull()).select("seq", quality.classify_error(kind, chain).alias("error_class"), quality.validation_of_error(kind, chain).alias("validation"))


@query("health_counts", with_views("evidence") + """, h AS (SELECT CASE seq % 12 WHEN 3 THEN 'timeout' WHEN 4 THEN 'blocked' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'source_changed' WHEN 7 THEN 'source_unavailable' WHEN 10 THEN CASE WHEN bytes > 0 THEN 'healthy' ELSE 'empty' END WHEN 11 THEN CASE WHEN bytes > 0 THEN 'healthy' ELSE 'empty' END ELSE 'error' END AS status FROM evidence)
  SELECT status, count(*) AS n FROM h GROUP BY status ORDER BY status""")
def health_counts(spark, sf_dir):
    return quality.status_counts(view(spark, sf_dir, "evidence").select(quality.health(F.col("bytes"), F.col("kind")).alias("status")), "status")


@query("status_mixed", with_views("evidence") + " SELECT run, CASE WHEN count(s) = 0 THEN NULL WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'mixed' END AS status FROM (SELECT run, CASE WHEN run % 3 = 0 THEN NULL WHEN run % 3 = 1 THEN 'view' ELSE status END AS s FROM evidence) GROUP BY run")
def status_mixed(spark, sf_dir):
    run = F.col("run")
    return quality.mixed_status(view(spark, sf_dir, "evidence").select("run", F.when(run % 3 == 0, F.lit(None)).when(run % 3 == 1, "view").otherwise(F.col("status")).alias("status")), "run", "status")


@query("full_text_status", with_views("results") + """ SELECT source, CASE WHEN count_if(coalesce(full_text, '') = '') = 0 THEN 'returned' WHEN count_if(arrival % 97 = 0) > 0 THEN 'document_available' ELSE 'not_returned' END AS full_text_status FROM results GROUP BY source""")
def full_text_status(spark, sf_dir):
    return quality.full_text_status(view(spark, sf_dir, "results").withColumn("url", F.when(F.col("arrival") % 97 == 0, "x")), "source", "full_text", "url")


_ASKED = with_views("results") + """, r AS (SELECT 's' || arrival % 60 AS source, CASE WHEN arrival % 60 = 4 AND arrival % 7 = 0 THEN ' ' ELSE id END AS id, CASE WHEN arrival % 60 = 5 THEN 'other' ELSE 's' || arrival % 60 END AS result_source, CASE WHEN arrival % 60 = 6 THEN ' ' ELSE summary END AS summary, thesis, question, full_text,
    CASE WHEN arrival % 60 <> 7 THEN 'search' END AS endpoint FROM results WHERE arrival % 60 <> 8)"""


@query("validation_report", _ASKED + """, p AS (SELECT i, 's' || i AS source, i <> 9 AS page_source, i <> 10 AS page_trace, i <> 11 AS page_number, i <> 12 AS page_size, i <> 13 AS reported_total_nonnegative, i = 14 AS unreadable FROM range(60) AS g(i)),
  c AS (SELECT source, bool_and(trim(id) <> '') AS result_ids, bool_and(result_source = source) AS result_sources, bool_and(trim(coalesce(summary, '')) <> '' OR trim(coalesce(thesis, '')) <> '' OR trim(coalesce(question, '')) <> '' OR trim(coalesce(full_text, '')) <> '') AS result_content, bool_and(endpoint IS NOT NULL) AS result_traces, count(*) AS returned FROM r GROUP BY source),
  f AS (SELECT p.source, i, coalesce(returned, 0) AS returned, CASE WHEN unreadable THEN 'normalized_response' ELSE concat_ws(',', CASE WHEN NOT page_source THEN 'page_source' END, CASE WHEN NOT page_trace THEN 'page_trace' END, CASE WHEN NOT page_number THEN 'page_number' END, CASE WHEN NOT page_size THEN 'page_size' END, CASE WHEN NOT reported_total_nonnegative THEN 'reported_total_nonnegative' END,
    CASE WHEN NOT result_ids THEN 'result_ids' END, CASE WHEN NOT result_sources THEN 'result_sources' END, CASE WHEN NOT result_content THEN 'result_content' END, CASE WHEN NOT result_traces THEN 'result_traces' END) END AS failed_checks FROM p LEFT JOIN c ON p.source = c.source)
  SELECT source, returned, failed_checks, CASE WHEN failed_checks <> '' THEN 'contract_invalid' WHEN returned = 0 THEN 'empty' ELSE 'valid' END AS status FROM f WHERE i IN (SELECT arrival % 60 FROM results)""")
def validation_report(spark, sf_dir):
    i, name = F.col("i"), F.concat(F.lit("s"), F.col("i"))
    rows = view(spark, sf_dir, "results").withColumn("i", F.col("arrival") % 60)
    pages = rows.select("i").distinct().select(
        name.alias("source"), F.when(i == 9, "other").otherwise(name).alias("page_source"), F.when(i != 10, "search").alias("endpoint"), F.when(i == 11, 2).otherwise(1).alias("page"),
        F.when(i == 12, 5).otherwise(10).alias("page_size"), F.when(i == 13, -1).when(i != 14, 99).alias("total"),
    )
    results = rows.filter(i != 8).select(
        name.alias("source"), F.when((i == 4) & (F.col("arrival") % 7 == 0), " ").otherwise(F.col("id")).alias("id"), F.when(i == 5, "other").otherwise(name).alias("result_source"), F.when(i == 6, " ").otherwise(F.col("summary")).alias("summary"),
        "thesis", "question", "full_text", F.when(i != 7, "search").alias("endpoint"),
    )
    return quality.validation_report(pages, results, 10)


_CONTRACT = with_views("capabilities") + """, l AS (SELECT *, CASE WHEN key % 2 = 0 OR key % 3 = 0 OR (unified AND balance > 2000) THEN 4 WHEN filters <> '' AND key % 7 > 0 THEN 3 WHEN balance > 0 THEN 2 ELSE 1 END AS level FROM capabilities),
  c AS (SELECT *, CASE WHEN key % 5 IN (0, 1) THEN 'alto' WHEN level >= 3 THEN 'medio' ELSE 'alto' END AS risk FROM l)"""


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = view(spark, sf_dir, "capabilities")
    key, balance = F.col("key"), F.col("balance")
    level = quality.contract_level(F.lit(True), balance > 0, F.col("filters") != "", key % 7 > 0, key % 2 == 0, key % 3 == 0, F.col("unified"), balance > 2000, F.col("category"))
    words = F.when(key % 5 == 0, "exige CAPTCHA").when(key % 5 == 1, "há controle de acesso").when(key % 5 == 2, "pede login")
    caps = caps.withColumn("level", level).withColumn("risk", quality.contract_risk(words, F.col("level")))
    return caps.withColumn("maturity", quality.maturity(F.col("level")))


@query("contract_level_risk", _CONTRACT + " SELECT source, level, risk, CASE WHEN level >= 5 THEN 'maduro' WHEN level >= 3 THEN 'intermediario' ELSE 'inicial' END AS maturity FROM c")
def contract_level_risk(spark, sf_dir):
    return _contracts(spark, sf_dir).select("source", "level", "risk", "maturity")


@query("contract_summary", _CONTRACT + " SELECT level, risk, count(*) AS n FROM c GROUP BY level, risk")
def contract_summary(spark, sf_dir):
    return _contracts(spark, sf_dir).groupBy("level", "risk").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_score", """WITH s AS (SELECT p_partkey, p_brand, least(p_size, 20) + least(p_partkey % 40, 25) + least(p_partkey % 25, 20) + least(p_partkey % 30, 20) + least(p_size % 20, 15) AS score FROM part)
  SELECT p_partkey, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM s""")
def coverage_score(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    score = quality.coverage_score((s, 20), (k % 40, 25), (k % 25, 20), (k % 30, 20), (s % 20, 15))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", score.alias("score"), quality.coverage_grade(score).alias("grade"))


@query("unified_filter_support", with_views("capabilities") + " SELECT f AS filter, count(*) AS n, round(count(*) / (SELECT count(*) FROM capabilities), 3) AS ratio FROM (SELECT unnest(string_split(filters, ',')) AS f FROM capabilities) WHERE f <> '' GROUP BY f")
def unified_filter_support(spark, sf_dir):
    caps = _capabilities(spark, sf_dir)
    total = caps.agg(F.count(F.lit(1)).alias("total"))
    counted = caps.select(F.explode("supported_filters").alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(total), how="inner").select("filter", "n", F.round(F.col("n") / F.col("total"), 3).alias("ratio"))


@query("filter_algebra", with_views("capabilities") + """ SELECT source, concat_ws(',', CASE WHEN contains(filters, 'courts') THEN NULL ELSE 'courts' END, CASE WHEN contains(filters, 'text') THEN NULL ELSE 'text' END) AS missing, concat_ws(',', CASE WHEN contains(filters, 'number') THEN 'number' END, CASE WHEN contains(filters, 'types') THEN 'types' END) AS undeclared FROM capabilities""")
def filter_algebra(spark, sf_dir):
    caps = _capabilities(spark, sf_dir).withColumns({"declared": F.array(F.lit("text"), F.lit("courts")), "none": F.array().cast("array<string>")})
    found = caps.select("source", *discovery.filter_algebra("declared", "supported_filters", "none"))
    return found.select("source", F.array_join("missing", ",").alias("missing"), F.array_join("undeclared", ",").alias("undeclared"))


def _occurs(column: str, pattern: str) -> str:
    """A pattern between Unicode word borders, for an engine whose borders are ASCII."""
    inner = pattern.removeprefix("\\b").removesuffix("\\b")
    return f"regexp_matches({column}, '(?i)(^|[^\\pL\\pN_])(?:{inner})($|[^\\pL\\pN_])')"


@query("legal_signals", with_views("notices") + " SELECT doc_id, " + ", ".join(f"{_occurs('lower(text)', p)} AS {n}" for n, p in probe.LEGAL_SIGNALS.items()) + " FROM notices")
def legal_signals(spark, sf_dir):
    found = view(spark, sf_dir, "notices").select("doc_id", probe.legal_signals(F.col("text")).alias("s"))
    return found.select("doc_id", *(F.col("s")[n].alias(n) for n in probe.LEGAL_SIGNALS))


_SHOWN = "CASE WHEN doc_id % 3 = 0 THEN 'Confirme: não sou um robô, verificação' WHEN doc_id % 3 = 1 THEN text ELSE 'just a moment' END"
_ACCESS = with_views("notices") + f""", n AS (SELECT doc_id, lower(text) AS r, lower({_SHOWN}) AS v FROM notices), a AS (SELECT doc_id, r, v, {", ".join(f"{_occurs('v', p)} AS v_{n}, {_occurs('r', p)} AS r_{n}" for n, p in probe.ACCESS_SIGNALS.items())}, contains(v, 'just a moment') AS challenged FROM n)"""


@query("access_signals", _ACCESS + """ SELECT doc_id, v_captcha OR contains(v, 'digite os números') AS captcha, v_recaptcha OR (r_recaptcha AND (contains(v, 'não sou um robô') OR v_captcha)) AS recaptcha, v_turnstile OR (r_turnstile AND challenged) AS turnstile, v_cloudflare OR (r_cloudflare AND challenged) AS cloudflare,
  v_login AS login, v_anti_robot OR contains(r, 'antirrob') AS anti_robot, r_empty_session AS empty_session, r_access_denied AS access_denied, r_request_blocked AS request_blocked FROM a""")
def access_signals(spark, sf_dir):
    rows = view(spark, sf_dir, "notices").withColumn("visible", F.expr(_SHOWN))
    found = rows.select("doc_id", probe.access_signals(F.col("text"), F.col("visible")).alias("s"))
    return found.select("doc_id", *(F.col("s")[n].alias(n) for n in probe.ACCESS_SIGNALS))


_PROBE = with_views("notices") + f""", t AS (SELECT *, lower(text) AS low, regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS bare FROM notices),
  f AS (SELECT doc_id, code, elapsed_ms, response_complete AND NOT content_truncated AS whole, transport_status = 'complete' AS carried, CASE WHEN expected IS NOT NULL THEN contains(text, expected) END AS expected,
    {" OR ".join(_occurs("low", p) for p in probe.LEGAL_SIGNALS.values())} AS legal, {_occurs("low", probe.LEGAL_SIGNALS["full_text"])} OR content_type = 'application/pdf' AS document,
    content_type IN ('application/json', 'text/xml') OR (starts_with(bare, '{{') AND ends_with(bare, '}}')) OR (starts_with(bare, '[') AND ends_with(bare, ']')) AS structured, {" OR ".join(_occurs("low", p) for p in probe.PAGINATION)} AS paged,
    {" OR ".join(_occurs("low", p) for p in probe.ACCESS_SIGNALS.values())} OR contains(low, 'digite os números') OR contains(low, 'antirrob') AS access FROM t),
  s AS (SELECT *, greatest(0, (code = 200)::INT + 3 * structured::INT + 3 * legal::INT + 2 * paged::INT + 2 * document::INT + 2 * coalesce(expected, FALSE)::INT + CASE WHEN access THEN -4 ELSE 1 END + (elapsed_ms <= 2500)::INT
    - CASE code WHEN 404 THEN 4 WHEN 503 THEN 3 ELSE 0 END - 2 * (NOT legal AND NOT structured)::INT - 3 * (NOT whole OR NOT carried)::INT) AS score,
    CASE WHEN code = 404 THEN 'not_found' WHEN access THEN 'access_control_or_login' WHEN code = 503 THEN 'source_unavailable' WHEN NOT whole THEN 'partial_response' WHEN NOT coalesce(expected, TRUE) THEN 'candidate' WHEN legal OR structured THEN 'live_valid' ELSE 'candidate' END AS status FROM f)"""


@query("route_score_grade", _PROBE + """ SELECT doc_id, score, CASE WHEN score >= 8 THEN 'A' WHEN score >= 5 THEN 'B' WHEN score >= 2 THEN 'C' ELSE 'D' END AS grade, status,
  CASE status WHEN 'live_valid' THEN CASE WHEN score >= 8 THEN 'Promover' ELSE 'Manter' END WHEN 'candidate' THEN 'Investigar' WHEN 'partial_response' THEN 'Resposta' WHEN 'access_control_or_login' THEN 'Documentar' WHEN 'not_found' THEN 'Descartar' ELSE 'Registrar' END AS advice FROM s""")
def route_score_grade(spark, sf_dir):
    rows = view(spark, sf_dir, "notices").withColumns({"visible": F.col("text"), "expected_texts": F.array_compact(F.array("expected"))})
    read = probe.analyze(rows)
    return read.select("doc_id", "score", F.col("quality_grade").alias("grade"), F.col("route_status").alias("status"), F.split_part("recommendation", F.lit(" "), F.lit(1)).alias("advice"))


@query("content_type_detect", with_views("captures") + " SELECT page_id, CASE WHEN header = 'text/html; charset=utf-8' THEN 'text/html' WHEN regexp_matches(lower(substr(body, 1, 4096)), '<html|<!doctype html') THEN 'text/html' ELSE 'text/plain' END AS content_type, CAST(strlen(body) AS INT) AS byte_size, sha256(body) AS content_sha256 FROM captures")
def content_type_detect(spark, sf_dir):
    rows = readers.captured(view(spark, sf_dir, "captures").withColumn("content", F.col("body").cast("binary")))
    return rows.select("page_id", text.content_type(F.col("header"), F.col("content")).alias("content_type"), "byte_size", "content_sha256")


@query("allowed_urls", "SELECT page_id, regexp_matches(url, '^https?://([^/?#]+\\.)?example\\.(com|org)([/?#]|$)') AS allowed FROM pages")
def allowed_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", quality.allowed_url(F.col("url"), ["example.com", "example.org"]).alias("allowed"))


#: White space as Unicode has it; references as browsers resolve them, which may lack their semicolon ('&amp' at a cut).
_SPACES = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\pZ]+"
_REFERENCES = {"&lt": "<", "&gt": ">", "&quot": '"', "&copy": "©", "&middot": "·", "&nbsp": " ", "&amp": "&"}


def shown_sql(markup: str) -> str:
    """Visible text of a stretch of markup: tags dropped, references resolved, white space collapsed; null for none."""
    text = f"regexp_replace({markup}, '<[^>]+>', ' ', 'g')"
    for name, character in _REFERENCES.items():
        text = f"regexp_replace({text}, '{name};?', '{character}', 'g')"
    return f"nullif(trim(regexp_replace({text}, '{_SPACES}', ' ', 'g')), '')"


@query("html_title", f"SELECT page_id, {shown_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title FROM pages")
def html_title(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.title(F.col("html")).alias("title"))


@query("html_visible_text", f"""SELECT page_id, {shown_sql("regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g')")} AS text FROM pages""")
def html_visible_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("form_fields")
def form_fields(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode_outer(html.form_fields(F.col("html"))).alias("f")).select("page_id", "f.*")


@query("node_similarity")
def node_similarity(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc"), F.posexplode(html.signatures(F.col("html"))).alias("position", "signature")).withColumn("depth", F.col("signature.depth"))
    target = nodes.filter("signature.tag = 'p'").groupBy("doc").agg(F.min_by("signature", "position").alias("target"))
    return discovery.top_similar(nodes.join(target, "doc"), "target").select("doc", "position", "similarity", "rank")


@query("crawl_frontier_bfs", """WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 's' || s_suppkey, 'r' || (s_suppkey % 5) FROM supplier),
  walk(node, depth) AS (SELECT 'r0', 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON node = src WHERE depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def crawl_frontier_bfs(spark, sf_dir):
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "supplier", "customer")}
    name = lambda prefix, c: F.concat(F.lit(prefix), c)
    edges = t["nation"].select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    edges = edges.union(t["supplier"].select(name("n", "s_nationkey"), name("s", "s_suppkey"))).union(t["customer"].select(name("n", "c_nationkey"), name("c", "c_custkey"))).union(t["supplier"].select(name("s", "s_suppkey"), name("r", F.col("s_suppkey") % 5)))
    return discovery.crawl_frontier(edges.distinct(), spark.range(1).select(F.lit("r0").alias("node")), 3)


@query("discovery_run_metrics", with_views("evidence") + """, g AS (SELECT run, status, count(*) AS n, sum(bytes) AS b FROM evidence GROUP BY run, status) SELECT run, CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(b) AS BIGINT) AS bytes, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM g GROUP BY run""")
def discovery_run_metrics(spark, sf_dir):
    return discovery.run_metrics(view(spark, sf_dir, "evidence"))


@query("request_cache", with_views("captures") + " SELECT page_id, sha256('GET' || chr(10) || url || chr(10) || chr(10)) AS cache_key FROM captures WHERE page_id % 3 > 0")
def request_cache(spark, sf_dir):
    requests = view(spark, sf_dir, "captures").select("page_id", F.lit("GET").alias("method"), "url", F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("body"))
    key = F.sha2(F.concat_ws("\n", "method", "url", F.lit(""), F.lit("")), 256)
    cache = requests.filter("page_id % 3 = 0").select(key.alias("cache_key"))
    return discovery.request_cache_misses(requests.withColumn("url", F.col("url")), cache).select("page_id", "cache_key")


@query("json_records_reader", "SELECT event_id, props AS record, json_extract_string(props, '$.k') AS k FROM events")
def json_records_reader(spark, sf_dir):
    p = F.col("props")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), p, F.lit(",5]"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"n":1,"items":['), p, F.lit("]}"))).otherwise(p)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.explode(readers.json_records(body)).alias("record"))
    return rows.select("event_id", F.regexp_replace("record", r'":(?=\S)', '": ').alias("record"), F.get_json_object("record", "$.k").alias("k"))


_LONG = "repeat('x', CAST(500 + event_id % 30 AS INT))"


@query("redact_map", f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN '<redacted>' WHEN 1 THEN '<redacted>' WHEN 2 THEN '<redacted>' WHEN 3 THEN '<redacted>' WHEN 4 THEN '<redacted>' ELSE v END AS value, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 30 > 12 THEN '<redacted-text>' ELSE {_LONG} END WHEN event_id % 3 = 1 THEN '{{"a": [{{"Session-Id": "<redacted>", "k": ' || event_id || '}}]}}' END AS payload,
  CASE WHEN event_id % 2 = 0 THEN '<redacted-bytes>' END AS body FROM (SELECT event_id, CASE event_id % 8 WHEN 5 THEN repeat('ã', 4096) || '…<truncated>' ELSE json_extract_string(props, '$.k') END AS v FROM events)""")
def redact_map(spark, sf_dir):
    key = F.element_at(F.array(*map(F.lit, ["X-Api-Key", "Set-Cookie", "passwd", "ACCESS_TOKEN", "my.session", "long", "senha", "pass"])), (F.col("event_id") % 8 + 1).cast("int"))
    value = F.when(F.col("event_id") % 8 == 5, F.repeat(F.lit("ã"), 4097)).otherwise(F.get_json_object("props", "$.k"))
    payload = F.when(F.col("event_id") % 3 == 0, F.expr(_LONG)).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a":[{"Session-Id":{"x":1},"k":'), "event_id", F.lit("}]}")))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"key": key, "payload": quality.redact_payload(payload), "body": quality.redact_bytes(F.when(F.col("event_id") % 2 == 0, F.lit(b"x")))})
    return events.select("event_id", quality.redact_map(F.create_map("key", value))[F.col("key")].alias("value"), "payload", "body")


# --- exports

_LINE = "CASE WHEN regexp_matches({0}, '[,\"\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query("export_csv_columns", with_views("records") + " SELECT id, id || ',' || coalesce(source, '') || ',' || court || ',' || case_number || ',' || " + _LINE.format("(subject || ', \"x\"')") + " || ',' AS line FROM records")
def export_csv_columns(spark, sf_dir):
    columns = ["id", "source", "court", "case_number", "subject", "missing"]
    rows = view(spark, sf_dir, "records").withColumn("subject", F.concat("subject", F.lit(', "x"')))
    return export.ordered(rows, columns).select("id", export.csv_line(columns).alias("line"))


@query("export_jsonl_sorted", with_views("records") + """ SELECT id, '{"case_number":"' || case_number || '","court":"' || court || '","id":"' || id || '","source":' || coalesce('"' || source || '"', 'null') || '}' AS line FROM records""")
def export_jsonl_sorted(spark, sf_dir):
    rows = view(spark, sf_dir, "records")
    return rows.select("id", export.json_line(rows, ["source", "id", "court", "case_number"]).alias("line"))


@query("export_markdown", with_views("records") + """, lines AS (SELECT court, id, '## ' || id || coalesce(chr(10) || '**Source:** ' || source, '') || chr(10) || '**Case:** ' || case_number AS line FROM records),
  paged AS (SELECT *, (row_number() OVER (PARTITION BY court ORDER BY id, line) - 1) // 1000 + 1 AS page FROM lines)
  SELECT court, page, string_agg(line, chr(10) || chr(10) ORDER BY id, line) AS markdown FROM paged GROUP BY court, page""")
def export_markdown(spark, sf_dir):
    rows = view(spark, sf_dir, "records")
    return export.markdown_pages(rows, "court", "id", export.markdown_record(F.col("id"), Source=F.col("source"), Case=F.col("case_number")))


@query("stream_collect_dedup", "SELECT event_type AS source, user_id AS id, count(*) > 0 AS seen FROM events GROUP BY event_type, user_id")
def stream_collect_dedup(spark, sf_dir):
    from recordlake.streaming.run import collected_events

    return collected_events(spark, sf_dir)




# --- rules on single columns and small tables

@query("find_case_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN substr(n, 1, 7) || '-' || substr(n, 8, 2) || '.' || substr(n, 10, 4) || '.' || substr(n, 14, 1) || '.' || substr(n, 15, 2) || '.' || substr(n, 17) END AS number FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 20, '7') AS n FROM orders)")
def find_case_number(spark, sf_dir):
    n = F.lpad(F.col("o_orderkey").cast("string"), 20, "7")
    number = text.normalize_cnj_number(n)
    line = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Autos "), number, F.lit(", folha 12-3"))).otherwise(F.concat(F.lit("Autos "), n, F.lit("-00")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.find_case_number(line).alias("number"))


@query("unwrap_partial", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '<p>resultados ' || n_name || '</p>' WHEN 1 THEN '<x><![CDATA[' || n_name || ']]></x>' ELSE 'resultados a' || chr(10) || n_name || ' resultados' END AS markup FROM nation")
def unwrap_partial(spark, sf_dir):
    k, n = F.col("n_nationkey") % 3, F.col("n_name")
    block = lambda c: F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))
    sent = F.when(k == 0, F.concat(F.lit("<a>"), block(n), block(F.concat(F.lit("<p>resultados "), n, F.lit("</p>"))), F.lit("</a>"))).when(k == 1, F.concat(F.lit("<x>"), block(n), F.lit("</x>")))
    sent = sent.otherwise(F.concat(block(F.lit("resultados a")), block(F.lit("outro")), block(F.concat(n, F.lit(" resultados")))))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", text.unwrap_partial(sent).alias("markup"))


@query("lenient_decision_type", with_views("results") + " SELECT id, CASE trim(type) WHEN 'Acórdão' THEN 'acordao' WHEN 'sentença' THEN 'sentenca' WHEN 'Decisão Monocrática' THEN 'decisao' END AS decision_type FROM results")
def lenient_decision_type(spark, sf_dir):
    return view(spark, sf_dir, "results").select("id", text.lenient_decision_type(F.col("type")).alias("decision_type"))


@query("field_keys", """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (N ' || p_size || ') ' || p_brand), '[^a-z0-9()]+', '_', 'g'), '_') AS key FROM (SELECT p_partkey, p_name, p_size, p_brand FROM part)""")
def field_keys(spark, sf_dir):
    label = F.concat("p_name", F.lit(" (N "), "p_size", F.lit(")  "), "p_brand", F.lit(" -"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.ascii_key(label).alias("key"))


@query("infer_kind", with_views("results") + " SELECT id, CASE WHEN arrival % 4 = 0 THEN 'document' WHEN arrival % 4 = 1 OR arrival % 11 = 0 THEN 'precedent' ELSE 'decision' END AS kind FROM results")
def infer_kind(spark, sf_dir):
    four = F.col("arrival") % 4
    made = canonical.infer_kind(F.when(four == 0, "pdf"), F.when(four == 1, F.col("number")), F.col("question"), F.col("thesis"))
    return view(spark, sf_dir, "results").select("id", made.alias("kind"))


@query("store_rows", with_views("records") + " SELECT id, coalesce(publication_date, substr(updated_at, 1, 10)) AS publication_date FROM records")
def store_rows(spark, sf_dir):
    return canonical.store_rows(view(spark, sf_dir, "records")).select("id", "publication_date")


@query("dataset_decisions", """SELECT 'dataset-' || substr(sha256('acordaos:' || o_orderkey), 1, 24) AS id, o_orderstatus AS case_number, nullif(trim(o_orderpriority), '') AS summary, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS judgment_date FROM orders WHERE o_orderkey % 10 > 0""")
def dataset_decisions(spark, sf_dir):
    o, null = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.lit(None).cast("string")
    rows = o.select(
        F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey").cast("string")).otherwise(" ").alias("id"), F.col("o_orderstatus").alias("numeroProcesso"), null.alias("descricaoClasse"), null.alias("ministroRelator"),
        null.alias("nomeOrgaoJulgador"), F.col("o_orderpriority").alias("ementa"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("dataDecisao"), null.alias("dataPublicacao"),
    )
    return canonical.dataset_decisions(rows, F.lit("acordaos")).select("id", "case_number", "summary", "judgment_date")


@query("distinct_routes", with_views("evidence") + " SELECT DISTINCT source || '/' || code AS route FROM evidence WHERE code <> 404")
def distinct_routes(spark, sf_dir):
    return discovery.distinct_routes(view(spark, sf_dir, "evidence").select(F.when(F.col("code") != 404, F.concat_ws("/", "source", "code")).alias("route")))


@query("secrecy_flags", with_views("results") + """ SELECT id, CASE WHEN arrival % 4 < 3 THEN 'partial' ELSE 'public' END AS access_status, CASE WHEN arrival % 4 IN (1, 2) THEN 'partial' ELSE extraction_status END AS extraction_status FROM results""")
def secrecy_flags(spark, sf_dir):
    four = F.col("arrival") % 4
    note = F.when(four == 0, "Processo em SEGREDO DE JUSTIÇA").when(four == 1, "aguardando publicação").when(four == 2, "Conteúdo pendente")
    return view(spark, sf_dir, "results").select("id", quality.secrecy_flags(note, F.lit("public"), F.col("extraction_status")).alias("f")).select("id", "f.*")


@query("page_echo", with_views("evidence") + " SELECT seq, CASE WHEN seq % 5 = 1 THEN 'source_changed' ELSE status END AS extraction FROM evidence")
def page_echo(spark, sf_dir):
    five = F.col("seq") % 5
    reported = F.when(five == 0, F.lit(None).cast("long")).when(five == 1, F.col("seq") + 1).otherwise(F.col("seq"))
    return view(spark, sf_dir, "evidence").select("seq", quality.page_echo(F.col("seq"), reported, F.col("status")).alias("extraction"))


@query("blocked_pages", "SELECT page_id, contains(lower(html), 'login') AND NOT contains(lower(html), '<table') AS blocked, contains(lower(html), 'login') AS challenged FROM pages")
def blocked_pages(spark, sf_dir):
    html_ = F.col("html")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", quality.blocked(html_, "login", "<table").alias("blocked"), quality.blocked(html_, "login", None).alias("challenged"))


@query("legal_content", with_views("results") + " SELECT id, trim(coalesce(thesis, '')) <> '' OR trim(coalesce(full_text, '')) <> '' AS legal FROM results")
def legal_content(spark, sf_dir):
    return view(spark, sf_dir, "results").select("id", canonical.has_legal_content(F.col("thesis"), F.col("full_text")).alias("legal"))


@query("selector_memory_page", """WITH m AS (SELECT n_nationkey AS id, n_nationkey % 4 = 0 OR n_nationkey = 3 AS approved, n_regionkey * 10 AS confidence, n_nationkey % 7 AS matches FROM nation)
  SELECT id, approved, confidence, matches FROM m WHERE approved ORDER BY approved DESC, confidence DESC, matches, id LIMIT 6""")
def selector_memory_page(spark, sf_dir):
    k = F.col("n_nationkey")
    memory = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("id"), (k % 4 == 0).alias("approved"), (F.col("n_regionkey") * 10).alias("confidence"), (k % 7).alias("matches"))
    return store.selector_candidates(store.approve_selector(memory, 3), 6, approved_only=True)


@query("manifest_list", with_views("manifest") + " SELECT source, resource_id, size AS synced_at, CAST(NULL AS VARCHAR) AS note FROM manifest")
def manifest_list(spark, sf_dir):
    rows = view(spark, sf_dir, "manifest").select("source", F.lit("d").alias("dataset_id"), "resource_id", F.col("size").alias("synced_at"))
    return store.migrate(store.list_manifests(rows), {"note": "string"}).drop("dataset_id")


@query("plan_downloads", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'JSON' ELSE 'pdf' END AS format FROM part WHERE p_partkey % 3 < 2 AND (p_partkey % 7 = 0 OR p_size <= 30) ORDER BY p_partkey LIMIT 500")
def plan_downloads(spark, sf_dir):
    three = F.col("p_partkey") % 3
    resources = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.when(three == 0, "csv").when(three == 1, "JSON").otherwise("pdf").alias("format"), F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"))
    return readers.plan_downloads(resources, ["CSV", "json"], 30, 500).select("id", "format")


@query("read_manifest", "SELECT n_nationkey, 'BNMP' AS base, n_name AS arquivo FROM nation UNION ALL SELECT n_nationkey, 'X', n_name || '.zip' FROM nation")
def read_manifest(spark, sf_dir):
    lines = F.concat(F.lit("gerado em 1/1\r\nBase | Arquivo\nBNMP| "), "n_name", F.lit(" \n|\nY|\nX |"), "n_name", F.lit(".zip|extra"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.explode(readers.read_manifest(lines)).alias("m"))
    return rows.select("n_nationkey", F.col("m")["BASE"].alias("base"), F.col("m")["ARQUIVO"].alias("arquivo"))


@query("local_window", "SELECT s_suppkey, s_name, 16 AS window_start FROM supplier ORDER BY s_name, s_suppkey LIMIT 15 OFFSET 15")
def local_window(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    return federate.local_window(suppliers, [F.asc("s_name"), F.asc("s_suppkey")], 2, 15).drop("window_size")


# --- fields of single sources

def _titles(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat(F.when(k % 3 == 0, "IRDR - tema 00").when(k % 3 == 1, "Tema 0").otherwise("Temas "), k.cast("string"), F.lit(" "), "p_name", F.when(k % 4 == 0, F.concat(F.lit(" ( "), "p_type", F.lit(" ) "))).otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", title.alias("title"))


_TITLES = """WITH t AS (SELECT p_partkey, p_name, p_type, CASE p_partkey % 3 WHEN 0 THEN 'IRDR - tema 00' WHEN 1 THEN 'Tema 0' ELSE 'Temas ' END || p_partkey || ' ' || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' ( ' || p_type || ' ) ' ELSE '' END AS title FROM part)"""


@query("theme_titles", _TITLES + " SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey AS BIGINT) END AS theme, CASE WHEN p_partkey % 4 = 0 THEN trim(p_type) END AS status FROM t")
def theme_titles(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", fields.theme_number(F.col("title")).alias("theme"), fields.title_status(F.col("title")).alias("status"))


@query("title_or_detail_filter", _TITLES + " SELECT p_partkey FROM t WHERE contains(title, '7') AND contains(lower(title) || ' ' || lower(p_type), 'brass')")
def title_or_detail_filter(spark, sf_dir):
    fits = coverage.title_or_detail(F.lower("title"), F.lower("p_type"), "7", "brass")
    return _titles(spark, sf_dir).filter(fits).select("p_partkey")


@query("class_subject_split", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderstatus END AS case_class,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority || '/' || o_orderstatus END AS subject FROM orders""")
def class_subject_split(spark, sf_dir):
    three = F.col("o_orderkey") % 3
    value = F.when(three == 0, "").when(three == 1, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.concat("o_orderstatus", F.lit(" / "), "o_orderpriority", F.lit("/"), "o_orderstatus", F.lit(" ")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fields.split_class_subject(value).alias("s")).select("o_orderkey", "s.*")


@query("sheet_results", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'ADI' END AS c, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'SP' ELSE '' END AS u, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS d FROM orders),
  s AS (SELECT *, CASE WHEN c = '' AND n = '' THEN '' ELSE c || CASE WHEN c <> '' AND n <> '' THEN ' ' ELSE '' END || n || CASE WHEN u = '' THEN '' ELSE '/' || u END END AS number FROM r)
  SELECT o_orderkey, 'stf-informativo-77-' || CASE WHEN number = '' THEN CAST(o_orderkey AS VARCHAR) ELSE lower(replace(replace(number, ' ', '-'), '/', '-')) END AS id, number, CAST(CAST(DATE '1899-12-30' + CAST(d AS INT) AS DATE) AS VARCHAR) AS day FROM s""")
def sheet_results(spark, sf_dir):
    k = F.col("o_orderkey")
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    row = fields.sheet_result(F.lit("77"), F.lit(""), k, F.when(k % 5 != 0, "ADI").otherwise(""), F.when(k % 3 != 0, k.cast("string")).otherwise(""), F.when(k % 2 == 0, "SP"), serial)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", row.alias("r")).select("o_orderkey", "r.*")


@query("embedded_files", """SELECT page_id, CASE WHEN page_id % 4 > 0 THEN sha256(html) END AS sha256, CASE WHEN page_id % 4 > 0 THEN CAST(octet_length(encode(html)) AS BIGINT) END AS bytes FROM pages WHERE html IS NOT NULL""")
def embedded_files(spark, sf_dir):
    value = F.when(F.col("page_id") % 4 > 0, F.base64(F.encode("html", "UTF-8"))).when(F.col("page_id") % 8 == 0, "").otherwise("no base64!")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("html IS NOT NULL")
    return pages.select("page_id", fields.embedded_file(value).alias("f")).select("page_id", "f.sha256", "f.bytes")


_CUSTOMER_JSON = """CASE c_custkey % 4 WHEN 0 THEN '{"id":' || c_custkey || ',"nome":" ' || c_name || ' ","descricao":""}' WHEN 1 THEN '[{"sigla":"' || c_mktsegment || '"},"x ",{"other":1},' || c_custkey || ']' WHEN 2 THEN ' ' || c_name || ' ' END"""


@query("json_value_text", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment || '; x; ' || c_custkey WHEN 2 THEN c_name ELSE '' END AS value FROM customer""")
def json_value_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fields.json_text(F.expr(_CUSTOMER_JSON)).alias("value"))


_ANSWER_JSON = """'{"a":"/API/' || page_id || '","b: c":["' || url || '",{"d":"q \\\\"query\\\\": ok"}],"n":' || page_id || '}'"""


@query("json_strings", "WITH j AS (SELECT page_id, CAST(" + _ANSWER_JSON.replace("\\\\", "\\") + """ AS JSON) AS body FROM pages WHERE url IS NOT NULL)
  SELECT page_id, value, regexp_matches(value, '^(/|https?://)') AND regexp_matches(lower(value), '/api|search|juris|document|query') AS endpoint FROM (SELECT page_id, v.atom ->> '$' AS value FROM j, json_tree(j.body) v WHERE v.type = 'VARCHAR')""")
def json_strings(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("url IS NOT NULL").select("page_id", F.explode(fields.json_strings(F.expr(_ANSWER_JSON))).alias("value"))
    return found.withColumn("endpoint", fields.endpoint_like(F.col("value")))


@query("labelled_fields", """SELECT o_orderkey, o_orderpriority AS body, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def labelled_fields(spark, sf_dir):
    line = F.concat(F.lit("ÓRGÃO julgador:  "), "o_orderpriority", F.lit(" / Tipo de Documento: "), F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit(" / Data de Julgamento: "), F.col("o_orderdate").cast("date").cast("string"), F.lit("/ Nr. Processo: 1"))).otherwise(""))
    patterns = {"body": r"(?u)(?:órgão|orgao) julgador:\s*(.*?)\s*/\s*tipo de documento:", "kind": r"tipo de documento:\s*(.*?)\s*/\s*data de julgamento:", "day": r"data de julgamento:\s*(.*?)\s*/\s*nr\. processo:"}
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fields.labelled_fields(line, patterns).alias("f")).select("o_orderkey", "f.*")


@query("first_uuid", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS uuid FROM customer")
def first_uuid(spark, sf_dir):
    uuid = F.concat(F.lit(" 00000000-0000-4000-8000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    three = F.col("c_custkey") % 3
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fields.first_uuid(F.col("c_name"), F.when(three == 1, uuid), F.when(three == 2, uuid)).alias("uuid"))


@query("summary_chars", with_views("results") + " SELECT court, CAST(sum(length(coalesce(summary, ''))) AS BIGINT) AS chars FROM results GROUP BY court")
def summary_chars(spark, sf_dir):
    return view(spark, sf_dir, "results").groupBy("court").agg(F.sum(fields.summary_chars(F.col("summary"))).alias("chars"))


# --- coverage of sources

_PROFILE = """CASE n_nationkey % 9 WHEN 0 THEN 'court_precedents' WHEN 1 THEN 'curated_jurisprudence' ELSE 'court_jurisprudence' END"""
_RECORDS = {0: ["CanonicalDecision", "CanonicalPrecedent"], 1: ["CanonicalPrecedent", "ProviderCatalog"], 2: ["CanonicalDocument", "CanonicalDecision"], 3: ["CanonicalDocument", "ProviderCatalog"], 4: ["CanonicalDocument"], 5: []}


@query("semantic_profile", f"""SELECT n_nationkey, CASE {_PROFILE} WHEN 'court_precedents' THEN 'precedent' WHEN 'curated_jurisprudence' THEN 'curated' ELSE
  (CASE n_nationkey % 6 WHEN 0 THEN 'hybrid_decision_precedent' WHEN 1 THEN 'precedent' WHEN 2 THEN 'decision' WHEN 3 THEN 'catalog' WHEN 4 THEN 'document' ELSE 'unclassified' END) END AS profile FROM nation""")
def semantic_profile(spark, sf_dir):
    records = F.array().cast("array<string>")
    for n, names in _RECORDS.items():
        records = F.when(F.col("n_nationkey") % 6 == n, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(records)
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", coverage.semantic_profile(F.expr(_PROFILE), records).alias("profile"))


@query("source_contracts", with_views("capabilities") + """ SELECT source, CASE WHEN key % 3 = 0 AND key % 5 > 0 THEN key % 5 ELSE key % 4 END AS level,
  CASE WHEN key % 6 = 0 THEN 'esaj' WHEN key % 4 = 0 THEN 'pje' ELSE category END AS family FROM capabilities""")
def source_contracts(spark, sf_dir):
    known = view(spark, sf_dir, "capabilities").withColumn("inferred_level", F.col("key") % 4)
    overrides = known.filter("key % 3 = 0").select("source", (F.col("key") % 5).alias("level"), F.when(F.col("key") % 6 == 0, "esaj").otherwise("").alias("family"))
    return coverage.source_contracts(known, overrides, known.filter("key % 4 = 0").select("source", F.lit("pje").alias("family")))


@query("source_audit", with_views("capabilities", "evidence") + """, e AS (SELECT source, count(*) AS swept, max(code) AS worst FROM evidence GROUP BY source)
  SELECT c.source, CASE WHEN key % 2 = 0 THEN 'ok' END AS smoke, swept, worst FROM capabilities c LEFT JOIN e ON c.source = e.source""")
def source_audit(spark, sf_dir):
    known = view(spark, sf_dir, "capabilities")
    sweep = view(spark, sf_dir, "evidence").groupBy("source").agg(F.count(F.lit(1)).alias("swept"), F.max("code").alias("worst"))
    return coverage.audit(known.select("source"), known.filter("key % 2 = 0").select("source", F.lit("ok").alias("smoke")), sweep)


_SCORES = with_views("capabilities") + ", s AS (SELECT source, category, CAST(balance % 101 AS BIGINT) AS score FROM capabilities)"


def _scores(spark, sf_dir):
    return view(spark, sf_dir, "capabilities").select("source", "category", (F.col("balance") % 101).alias("score"))


@query("coverage_totals", _SCORES + " SELECT count(*) AS sources, count(*) FILTER (score >= 85) AS strong, count(*) FILTER (score < 50) AS weak, round(avg(score), 1) AS mean_score FROM s")
def coverage_totals(spark, sf_dir):
    return coverage.coverage_totals(_scores(spark, sf_dir))


@query("coverage_ends", _SCORES + """ SELECT source, category, score, 'best' AS part FROM (FROM s ORDER BY score DESC, source LIMIT 5)
  UNION ALL SELECT source, category, score, 'worst' FROM (FROM s ORDER BY score, source LIMIT 10)""")
def coverage_ends(spark, sf_dir):
    return coverage.coverage_ends(_scores(spark, sf_dir))


@query("tier_counts", with_views("capabilities") + " SELECT category AS status, count(*) AS n FROM capabilities GROUP BY category")
def tier_counts(spark, sf_dir):
    return quality.status_counts(view(spark, sf_dir, "capabilities"), "category").withColumnRenamed("category", "status")


@query("document_status_counts", with_views("results") + " SELECT extraction_status AS status, count(*) AS n FROM results GROUP BY extraction_status")
def document_status_counts(spark, sf_dir):
    return quality.status_counts(view(spark, sf_dir, "results"), "extraction_status").withColumnRenamed("extraction_status", "status")


@query("list_courts", "SELECT s_suppkey, upper(substr(n_name, 1, 2)) AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0 AND n_name ILIKE 'IR%' AND s_suppkey % 5 <> 0")
def list_courts(spark, sf_dir):
    courts = view(spark, sf_dir, "capabilities").select(
        F.col("key").alias("s_suppkey"), F.upper(F.substring("nation", 1, 2)).alias("state"), F.when(F.col("key") % 2 == 0, "state").otherwise("federal").alias("branch"),
        F.lit("esaj").alias("source_system"), F.when(F.col("unified"), "implemented").otherwise("planned").alias("provider_status"),
    )
    return coverage.list_courts(courts, branch="state", state=" ir ", system="esaj", implemented=True).select("s_suppkey", "state")


@query("search_deadline", with_views("capabilities") + """ SELECT source, CAST(CASE WHEN key % 4 = 0 OR key * 10 > 600 THEN 0 ELSE key % 7 END AS BIGINT) AS returned,
  CASE WHEN key % 4 = 0 OR key * 10 > 600 THEN 'TimeoutError' WHEN key % 7 = 0 THEN 'HTTPError' END AS error, NOT (key % 4 = 0 OR key * 10 > 600) AND key % 7 > 0 AS answered FROM capabilities""")
def search_deadline(spark, sf_dir):
    known, key = view(spark, sf_dir, "capabilities"), F.col("key")
    answers = known.filter("key % 4 <> 0").select("source", (key * 10).alias("elapsed_ms"), (key % 7).alias("returned"), F.when(key % 7 == 0, "HTTPError").alias("error"))
    return coverage.with_deadline(known.select("source"), answers, 600)


@query("text_match_order", "SELECT page_id FROM pages ORDER BY length(url), page_id % 7 DESC, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END, page_id LIMIT 20")
def text_match_order(spark, sf_dir):
    k = F.col("page_id")
    order = coverage.match_order(F.col("url"), k % 7, F.when(k % 2 == 0, k.cast("string")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy(*order, "page_id").limit(20).select("page_id")


@query("sub_catalogues", "SELECT 'sumula' AS catalogue, n_name AS title, CAST(NULL AS INT) AS theme FROM nation UNION ALL SELECT 'boletim', r_name, CAST(r_regionkey AS INT) FROM region")
def sub_catalogues(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("sumula").alias("catalogue"), F.col("n_name").alias("title"))
    second = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lit("boletim").alias("catalogue"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("int").alias("theme"))
    return federate.concatenate({"sumula": first, "boletim": second}).drop("source_order")


@query("compact_records", with_views("results") + " SELECT id, source, court, number, summary FROM results")
def compact_records(spark, sf_dir):
    return coverage.compact(view(spark, sf_dir, "results").select("id", "source", "court", "number", "summary", "full_text"))


@query("export_run", with_views("records") + " SELECT " + ", ".join(
    {"record_kind": "CASE kind WHEN 'document' THEN 'document' WHEN 'precedent' THEN 'precedent' ELSE 'decision' END AS record_kind", "id": "id", "source": "coalesce(source, '') AS source", "court": "coalesce(court, '') AS court",
     "document_type": "CASE kind WHEN 'document' THEN 'pdf' ELSE '' END AS document_type", "precedent_type": "CASE kind WHEN 'precedent' THEN 'sumula' WHEN 'document' THEN 'x' ELSE '' END AS precedent_type"}.get(c, f"'' AS {c}")
    for c in export.RUN_CSV) + " FROM records")
def export_run(spark, sf_dir):
    kind = F.col("kind")
    rows = view(spark, sf_dir, "records").select("id", "source", "court", F.when(kind == "document", "pdf").alias("document_type"), F.when(kind == "precedent", "sumula").when(kind == "document", "x").alias("precedent_type"))
    return export.run_rows(rows)


from recordlake import catalog_pages  # noqa: E402, F401 (its queries join these)
