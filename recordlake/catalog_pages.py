"""Queries over pages: elements, selectors, rules of sites and robots; part of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.api import RECORD_SCHEMA, Engine
from recordlake.catalog import _capabilities, _contracts, query, shown_sql
from recordlake.operators import documents, federate, quality, replay, robots, routes, store
from recordlake.plans.search_query import SearchQuery
from recordlake.plans.views import view, view_sql, with_views
from recordlake.scratch import fresh_path, written
from recordlake.shipping import ship
from recordlake.sources import dom, registry, sites, split_csv
from recordlake.streaming import partial


def _pages(spark, sf_dir):
    ship(spark)
    return dom.dom(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


_PLAIN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_ANCHORS = "regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')"


@query("html_links", f"""SELECT page_id, position, {_PLAIN.format("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS url, trim(regexp_replace({_PLAIN.format("regexp_extract(a, '>([^<]*)<', 1)")}, '\\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest({_ANCHORS}) AS a, generate_subscripts({_ANCHORS}, 1) - 1 AS position FROM pages)""")
def html_links(spark, sf_dir):
    found = dom.links(_pages(spark, sf_dir)).select(F.col("page").alias("page_id"), F.posexplode("links").alias("position", "l"))
    return found.select("page_id", F.col("position").cast("long").alias("position"), "l.url", "l.text")


@query("selector_candidates")
def selector_candidates(spark, sf_dir):
    own = F.filter("nodes", lambda n: n["own"].isNotNull())
    found = _pages(spark, sf_dir).select(F.col("page").alias("page_id"), F.posexplode(own).alias("position", "n"))
    return found.select("page_id", "position", "n.selector", "n.tag", F.col("n.own").alias("text"), "n.depth")


_NAV, _ARTICLE = "regexp_extract(html, '(?s)<nav>.*?</nav>')", "regexp_extract(html, '(?s)<article>.*?</article>')"
#: Selectors with what they count in pages of the tables' shape.
SELECTORS = {
    "nav li > a": f"len(regexp_extract_all({_NAV}, '<a href='))",
    "nav li:nth-of-type(2n+1) a[href^='/t']": f"len(list_filter(regexp_extract_all({_NAV}, '<a href=\"[^\"]*'), lambda a, i: i % 2 = 1 AND starts_with(a, '<a href=\"/t')))",
    "article > p": f"len(regexp_extract_all({_ARTICLE}, '<p>'))",
    "article > p:not(:first-of-type)": f"greatest(0, len(regexp_extract_all({_ARTICLE}, '<p>')) - 1)",
    "h1 + p": f"len(regexp_extract_all({_ARTICLE}, '</h1><p>'))",
    "h1 ~ p, h1": f"1 + len(regexp_extract_all({_ARTICLE}, '<p>'))",
    "nav ~ div.ad": "len(regexp_extract_all(html, '<div class=\"ad\">'))",
    "html[lang|='fr'] nav > ul > li:last-child": "CAST(contains(html, '<html lang=\"fr\">') AS INT)",
    "table td": "0",
}


@query("css_select", " UNION ALL ".join(f"SELECT '{s.replace(chr(39), chr(39) * 2)}' AS selector, page_id, CAST({n} AS BIGINT) AS n FROM pages WHERE {n} > 0" for s, n in SELECTORS.items()))
def css_select(spark, sf_dir):
    nodes = written(dom.elements(_pages(spark, sf_dir)), "elements")  # pages are parsed once for all selectors
    parts = [dom.select(nodes, s).groupBy(F.col("page").alias("page_id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("selector"), "page_id", "n") for s in SELECTORS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("xpath_select", f"SELECT page_id, regexp_extract(regexp_extract_all({_NAV}, '<a href=\"[^\"]*')[2], '\"(.*)', 1) AS url FROM pages WHERE len(regexp_extract_all({_NAV}, '<a href=')) > 1")
def xpath_select(spark, sf_dir):
    found = dom.xpath(dom.elements(_pages(spark, sf_dir)), "/html/body//nav/ul/li[2]/a[@href]")
    return found.select(F.col("page").alias("page_id"), F.element_at("attrs", "href").alias("url"))


#: Elements with text of their own in pages of the tables' shape, with their depths; each text follows its start tag.
_OWNERS = {"a": 6, "b": 5, "p": 4, "h1": 4, "title": 3, "div": 3, "footer": 3}
_OWNED = f"regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<(?:{'|'.join(_OWNERS)})(?: [^>]*)?>[^<]*')"


@query("find_by_text", f"""WITH own AS (SELECT page_id, unnest({_OWNED}) AS s, generate_subscripts({_OWNED}, 1) AS i FROM pages), f AS (SELECT page_id, i, regexp_extract(s, '^<([a-z0-9]+)', 1) AS tag, regexp_extract(s, '^<a href="([^"]*)"', 1) AS url FROM own WHERE lower({shown_sql("s")}) = 'the'),
  n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE tag {" ".join(f"WHEN '{t}' THEN {d}" for t, d in _OWNERS.items())} END DESC, i) AS place FROM f) SELECT page_id, tag, CASE WHEN tag = 'a' THEN url END AS url FROM n WHERE place = 1""")
def find_by_text(spark, sf_dir):
    found = dom.find_by_text(_pages(spark, sf_dir), " THE ", exact=True, limit=1)
    return found.select(F.col("page").alias("page_id"), "tag", F.element_at("attrs", "href").alias("url"))


@query("find_by_regex", f"SELECT page_id, CAST(len(list_filter({_ANCHORS}, lambda a: regexp_matches({_PLAIN.format('a')}, '>[A-Z][a-z]+<'))) AS BIGINT) AS n FROM pages WHERE len(list_filter({_ANCHORS}, lambda a: regexp_matches({_PLAIN.format('a')}, '>[A-Z][a-z]+<'))) > 0")
def find_by_regex(spark, sf_dir):
    found = dom.find_by_regex(_pages(spark, sf_dir), "^[A-Z][a-z]+$").filter("tag = 'a'")
    return found.groupBy(F.col("page").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


# --- result lists of sites: pages of five records each, made of the results in the shape of five sites

_CNJ = "concat(substr(n20, 1, 7), '-', substr(n20, 8, 2), '.', substr(n20, 10, 4), '.', substr(n20, 14, 1), '.', substr(n20, 15, 2), '.', substr(n20, 17, 4))"
_RECORDS = f"""SELECT arrival, arrival div 5 AS page, (arrival div 5) % 5 AS site, (arrival div 25) % 8 AS variation, {_CNJ} AS cnj, trim(rapporteur) AS rapporteur, day, replace(replace(replace(coalesce(summary, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS summary
  FROM (SELECT *, lpad(CAST(arrival AS STRING), 20, '0') AS n20, concat(lpad(CAST(1 + arrival % 28 AS STRING), 2, '0'), '/', lpad(CAST(1 + arrival % 12 AS STRING), 2, '0'), '/', 2000 + arrival % 25) AS day FROM results)"""
_SOURCES = ["tjsp_cjsg", "trf2_eproc_jurisprudencia", "tjpr_jurisprudencia", "trf5_jurisprudencia", "stj_scon"]
_ITEMS = [
    """concat("<table><tr class='ementaClass'><td><a class='downloadEmenta' cdAcordao='", arrival, "' cdForo='0'>", cnj, "</a></td></tr><tr class='ementaClass2'><td><strong>Relator(a):</strong> ", rapporteur, "</td></tr><tr class='ementaClass2'><td><strong>Data do julgamento:</strong> ", day, "</td></tr><tr><td><div id='textAreaDados_", arrival, "'>", summary, "</div></td></tr></table>")""",
    """concat("<div class='resultadoItem' id='resultado", arrival, "'><a class='numero-processo'>", cnj, "</a><div><span class='resLabel'>Relator</span><span class='resValue'>", rapporteur, "</span></div><div><span class='resLabel'>Data do Julgamento:</span><span class='resValue'>", day, "</span></div><div><span class='resLabel'>Ementa</span><span class='resValue'>", summary, "</span></div></div>")""",
    """concat("<tr><td><input name='idsSelecionados' value='", arrival, "'><a href='/jurisprudencia/j/", arrival, "'>ver</a> (Acórdão) ", cnj, " Relator: ", rapporteur, " Data Julgamento: ", day, "</td><td class='juris-tabela-ementa'>", summary, "</td></tr>")""",
    """concat("<tr><td class='grid'><a href='javascript:detalhesDocumento(&quot;", arrival, "&quot;)'>v</a> Órgão Julgador: T / Tipo de Documento: Acórdão / Data de Julgamento: ", day, " / Nr. Processo: ", cnj, if(trim(summary) = '', '', concat(" EMENTA: ", summary)), "</td></tr>")""",
    """concat("<div class='documento'><a class='doclink' href='/d?num_registro=", arrival, "'>", cnj, "</a><p class='relator'>", rapporteur, "</p><p class='data-julgamento'>", day, "</p><div class='ementa'>", summary, "</div></div>")""",
]
_FRAMES = [("<div id='divDadosResultado-A'>Resultados 1 a 5 de 95 ", "</div>"), ("<form>", "</form>"), ("95 registro(s) encontrado(s)<table class='resultTable jurisprudencia'>", "</table>"), ("<table>", "</table>"), ("<div id='resultados'>Resultados 1 a 5 de 95 ", "</div>")]
_RENAMED = [("downloadEmenta", "baixar"), ("resultadoItem", "cartao"), ("resultTable", "tabela"), ("'grid'", "'grade'"), ("resultados'", "lista'")]
_NOTHING = ["Resultado consulta", "<form id='frmJurisprudenciaPesquisa'></form>", "Nenhum resultado", "Nenhum documento", "resultado: nenhum"]
_CLOSED = ["<i>captchaControleAcesso</i>", "<i>login e senha</i>", "<i>acesso negado</i>", "<i>captcha</i>", "<i>g-recaptcha</i>"]


def _site_pages(spark, sf_dir):
    view(spark, sf_dir, "results").createOrReplaceTempView("results")
    by_site = lambda parts: F.element_at(F.array(*parts), F.col("site").cast("int") + 1)
    texts = lambda parts: by_site([F.lit(p) for p in parts])
    items = spark.sql(_RECORDS).withColumn("item", by_site([F.expr(i) for i in _ITEMS]))
    pages = items.groupBy("page", "site", "variation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arrival", "item"))), lambda x: x["item"]), "").alias("body"))
    whole = F.concat(texts([a for a, _ in _FRAMES]), F.col("body"), texts([b for _, b in _FRAMES]))
    renamed = F.replace(whole, texts([a for a, _ in _RENAMED]), texts([b for _, b in _RENAMED]))
    markup = F.when(F.col("variation") == 5, renamed).when(F.col("variation") == 6, texts(_NOTHING)).when(F.col("variation") == 7, texts(_CLOSED)).otherwise(whole)
    return pages.select(texts(_SOURCES).alias("source"), "page", markup.alias("markup"))


_SITE_SQL = "WITH results AS (" + view_sql("results") + """), r AS (SELECT arrival, arrival // 5 AS page, (arrival // 5) % 5 AS site, (arrival // 25) % 8 AS variation, lpad(CAST(arrival AS VARCHAR), 20, '0') AS n, trim(rapporteur) AS rapporteur,
    lpad(CAST(1 + arrival % 28 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + arrival % 12 AS VARCHAR), 2, '0') || '/' || (2000 + arrival % 25) AS day, nullif(trim(regexp_replace(coalesce(summary, ''), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\pZ]+', ' ', 'g')), '') AS summary FROM results)"""


@query("site_records", _SITE_SQL + """ SELECT ['tjsp-cjsg-', 'trf2-eproc-jurisprudencia-', 'tjpr-', 'trf5-jurisprudencia-', 'stj-scon-'][CAST(site + 1 AS INT)] || arrival || CASE WHEN site = 0 THEN '-0' ELSE '' END AS id, page,
  substr(n, 1, 7) || '-' || substr(n, 8, 2) || '.' || substr(n, 10, 4) || '.' || substr(n, 14, 1) || '.' || substr(n, 15, 2) || '.' || substr(n, 17) AS number, CASE WHEN site <> 3 THEN rapporteur END AS rapporteur, day AS judgment_date, summary FROM r WHERE variation < 5""")
def site_records(spark, sf_dir):
    records, _ = sites.read_pages(_site_pages(spark, sf_dir), sites.site_rules(spark), sites.field_rules(spark))
    return records.select("id", "page", *(F.element_at("fields", F.lit(n)).alias(n) for n in ("number", "rapporteur", "judgment_date", "summary")))


@query("site_outcomes", _SITE_SQL + """ SELECT ['tjsp_cjsg', 'trf2_eproc_jurisprudencia', 'tjpr_jurisprudencia', 'trf5_jurisprudencia', 'stj_scon'][CAST(site + 1 AS INT)] AS source, page, CASE variation WHEN 5 THEN 'contract_changed' WHEN 6 THEN 'empty' WHEN 7 THEN 'access_control' ELSE 'records' END AS outcome,
  CAST(CASE WHEN variation < 5 THEN count(*) ELSE 0 END AS BIGINT) AS n_records FROM r GROUP BY site, page, variation""")
def site_outcomes(spark, sf_dir):
    _, outcomes = sites.read_pages(_site_pages(spark, sf_dir), sites.site_rules(spark), sites.field_rules(spark))
    return outcomes.select("source", "page", "outcome", "n_records")


# --- robots: an answer for most origins of the pages, of five kinds by the length of the host

_BODIES = [
    "User-agent: *\nDisallow: /en/\nAllow: /en/*7\nAllow: /en/9\n",
    "# all\nuser-agent: lakebot\nuser-agent: other\nDisallow: /*?\nAllow: /fr/ # french\nDisallow:\n\nUser-agent: *\nDisallow: /\n",
    "Disallow: /\nUser-agent: *\nDisallow: /*.html$\nDisallow: /es\nAllow: /es\n",
]
_FITS = {"/en/": "^/en/", "/en/*7": "^/en/.*7", "/en/9": "^/en/9", "/*?": "^/.*[?]", "/fr/": "^/fr/", "/*.html$": "^/.*[.]html$", "/es": "^/es"}
_GROUPS = [(0, "/en/", False), (0, "/en/*7", True), (0, "/en/9", True), (1, "/*?", False), (1, "/fr/", True), (2, "/*.html$", False), (2, "/es", False), (2, "/es", True)]


@query("robots_rules", "WITH u AS (SELECT page_id, split_part(url, '#', 1) AS url, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS origin FROM pages), p AS (SELECT *, length(origin) % 6 AS kind, CASE WHEN starts_with(substr(url, length(origin) + 1), '/') THEN '' ELSE '/' END || substr(url, length(origin) + 1) AS target FROM u), r(kind, pattern, regex, allow) AS (VALUES "
    + ", ".join(f"({k}, '{p}', '{_FITS[p]}', {a})" for k, p, a in _GROUPS)
    + """), m AS (SELECT page_id, arg_max(pattern, length(pattern) * 2 + allow::INT) AS rule, arg_max(allow, length(pattern) * 2 + allow::INT) AS allow FROM p JOIN r ON p.kind = r.kind AND regexp_matches(target, regex) GROUP BY page_id)
  SELECT p.page_id, CASE WHEN kind < 3 THEN coalesce(allow, TRUE) WHEN kind = 3 THEN TRUE WHEN kind = 4 THEN FALSE END AS allowed, CASE WHEN kind < 3 THEN rule END AS rule FROM p LEFT JOIN m ON p.page_id = m.page_id""")  # fmt: skip
def robots_rules(spark, sf_dir):
    ship(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.length("origin") % 6
    origins = pages.select(robots.origin_of(F.col("url")).alias("origin")).distinct().filter(kind < 5)
    body = F.element_at(F.array(*map(F.lit, _BODIES)), F.least(kind + 1, F.lit(3)))
    answers = origins.select("origin", F.when(kind < 3, 200).when(kind == 3, 404).when(F.length("origin") % 4 > 0, 503).alias("status"), F.when(kind < 3, body).alias("body"))
    return robots.may_fetch(pages.select("page_id", "url"), answers, "LakeBot/1.0").select("page_id", "allowed", "rule")


# --- collection in runs whose limit falls inside a page

def _run_pages(spark, sf_dir):
    """Pages of 40 rows a source, of which some repeat."""
    rows = view(spark, sf_dir, "evidence")
    place = F.row_number().over(Window.partitionBy("source").orderBy("seq")) - 1
    rows = rows.withColumns({"page": (F.floor(place / 40) + 1).cast("int"), "id": F.concat("run", F.lit("-"), F.col("seq") % 700)})
    grouped = rows.groupBy("source", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: F.struct(x["id"].alias("id"), x["seq"].cast("string").alias("payload"))).alias("rows"))
    return grouped.select("source", F.lit(1).cast("long").alias("run"), "page", "rows", F.lit(None).cast("long").alias("total"), F.lit(False).alias("is_complete"), F.lit(None).cast("string").alias("error"))


@query("collect_partial_pages", with_views("evidence") + """, r AS (SELECT source, run || '-' || seq % 700 AS id, seq, (row_number() OVER (PARTITION BY source ORDER BY seq) - 1) // 40 + 1 AS page FROM evidence),
  f AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY seq) AS n FROM r), u AS (SELECT source, page, count_if(n = 1) AS fresh FROM f GROUP BY source, page), last AS (SELECT source, coalesce(min(page) FILTER (fresh = 0), max(page)) AS page FROM u GROUP BY source)
  SELECT f.source, id, CAST(f.page AS INT) AS page, CAST(seq AS VARCHAR) AS payload FROM f JOIN last USING (source) WHERE n = 1 AND f.page <= last.page""")
def collect_partial_pages(spark, sf_dir):
    ship(spark)
    folder = fresh_path(spark, "collection")
    pages = written(_run_pages(spark, sf_dir), "collection-pages")
    paths = (f"{folder}/pages", f"{folder}/out", f"{folder}/checkpoint")
    pages.write.mode("append").parquet(paths[0])
    partial.collect_pages(spark, *paths, max_records=65)  # ends within the second page of each source
    rest = partial.due(pages, partial.progress(spark, paths[1])).withColumn("run", F.lit(2).cast("long"))
    rest.write.mode("append").parquet(paths[0])
    partial.collect_pages(spark, *paths, max_pages=1_000_000, max_records=10**12)
    return partial.stored(spark, paths[1]).select("source", "id", "page", "payload")


# --- routing of a query over the registry, and saved runs

_ROUTED = SearchQuery.of(text="dano", number="1", types=("Acórdão",), published_from="2020-01-01")


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


@query("engine_route", with_views("results") + ", r(i, source, category, unified, filters) AS (VALUES " + ", ".join(f"({i}, '{r['source']}', '{r['category']}', {r['unified']}, {_list_sql(r['supported_filters'])})" for i, r in enumerate(registry.rows()))
    + """), s AS (SELECT *, CASE WHEN NOT unified THEN 'unified_search_not_supported' WHEN category = 'case_lookup' THEN 'outside_jurisprudence_scope' WHEN len(filters) > 0 AND NOT list_contains(filters, 'number') THEN 'identifier_filter_not_supported' WHEN category = 'judicial_communications' THEN 'not_jurisprudence_source'
      WHEN category NOT IN ('administrative_jurisprudence', 'court_jurisprudence', 'court_precedents', 'curated_jurisprudence', 'electoral_jurisprudence', 'jurisprudence', 'qualified_precedents') THEN 'category_not_applicable' WHEN i NOT IN (SELECT arrival % 60 FROM results) THEN 'no_results_at_hand' END AS reason FROM r)
  SELECT source, reason AS skip_reason, reason IS NULL AS searched, CASE WHEN reason IS NULL OR reason = 'no_results_at_hand' THEN array_to_string(list_sort(list_filter(['published_from', 'text', 'types'], lambda f: NOT list_contains(filters, f) AND NOT (f = 'text' AND len(filters) = 0))), ',') ELSE '' END AS warnings FROM s""")  # fmt: skip
def engine_route(spark, sf_dir):
    names = [r["source"] for r in registry.rows()]
    at = (F.col("arrival") % 60).cast("int") + 1
    results = view(spark, sf_dir, "results").filter(at <= len(names)).withColumn("source", F.element_at(F.array(*map(F.lit, names)), at))
    return Engine(spark, results=results).search_report(_ROUTED)


@query("concurrent_run_saves", with_views("records") + """ SELECT CASE WHEN position % 2 = 0 THEN 'even' ELSE 'third' END AS run, count(*) AS linked, count(*) AS stored FROM records WHERE position % 2 = 0 GROUP BY ALL UNION ALL SELECT 'third', count(*), count(*) FROM records WHERE position % 3 = 0""")
def concurrent_run_saves(spark, sf_dir):
    """Two runs saved at once: the second's first attempt is overtaken by the first."""
    root = fresh_path(spark, "store")
    rows = view(spark, sf_dir, "records").withColumns({"canonical_key": F.col("id"), "created_at": F.lit("2024-01-01")})
    kinds = dict(f.split() for f in RECORD_SCHEMA.split(", "))

    def save(name, part, before=None):
        made = store.migrate(part, kinds).select(*kinds, "position")
        about = spark.createDataFrame([(name,)], "id string")
        build = store.run_save(name, made, about, RECORD_SCHEMA)
        overtaken = [before] if before else []

        def late(base):
            tables = build(base)
            while overtaken:
                overtaken.pop()()  # the other run commits between reading and committing
            return tables

        store.commit(spark, root, late)

    save("third", rows.filter("position % 3 = 0"), lambda: save("even", rows.filter("position % 2 = 0")))
    now = store.latest(spark, root)
    linked = now.table("links").join(now.table("records").select("canonical_key", F.lit(1).alias("there")), "canonical_key", "left")
    return linked.groupBy(F.col("run_id").alias("run")).agg(F.count(F.lit(1)).alias("linked"), F.count("there").alias("stored"))


_RULES = {"title": r"<title>", "login": r"\blogin\b", "ementa": r"\bementa\b", "number": r"\b\d{3}\b"}
_CHANGED = _RULES | {"ementa": r"\bpara\b"}


@query("evidence_replay", "WITH b AS (SELECT DISTINCT sha256(html) AS content_sha256, regexp_matches(lower(html), '(^|[^\\pL\\pN_])para($|[^\\pL\\pN_])') AS found FROM pages) SELECT content_sha256, 'ementa' AS rule, found FROM b")
def evidence_replay(spark, sf_dir):
    """What a replay computes again after one of four rules has changed."""
    path = fresh_path(spark, "bodies")
    replay.save_bodies(view(spark, sf_dir, "captures"), path)
    replay.save_bodies(view(spark, sf_dir, "captures"), path)  # nothing new
    rules = lambda r: spark.createDataFrame(list(r.items()), "rule string, pattern string")
    first, _ = replay.replay(path, spark.createDataFrame([], replay.RESULT_SCHEMA), rules(_RULES))
    _, again = replay.replay(path, first, rules(_CHANGED))
    return again.select("content_sha256", "rule", "found")


@query("quoted_records", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, '')) AS n_chars FROM documents WHERE contains(lower(coalesce(text, '')), 'the') OR contains(CAST(doc_id AS VARCHAR), 'the')")
def quoted_records(spark, sf_dir):
    """Documents as records of a pipe file whose texts hold quotes and line breaks, found by a word."""
    ship(spark)
    path = fresh_path(spark, "pipe")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.col("doc_id").cast("string"), F.lit("|"), quoted)
    header = F.lit("KEY|TEXT\n")
    first = F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) == 1
    parts = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(8))).withColumn("value", F.when(first, F.concat(header, line)).otherwise(line))
    parts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    found = split_csv.scan(split_csv.read_quoted(spark, path), "the", 1 << 60)
    text = F.element_at("values", F.lit("TEXT"))
    return found.select(F.element_at("values", F.lit("KEY")).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars"))


_BASE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@query("route_candidates", f"""WITH p AS (SELECT page_id, {_BASE} AS base, {_ANCHORS} AS a FROM pages), v AS (
    SELECT page_id, base, {_PLAIN.format("regexp_extract(unnest(a), 'href=\"([^\"]*)\"', 1)")} AS value, 'GET' AS method, 'link' AS source, 1 AS k FROM p
    UNION ALL SELECT page_id, base, '/main.css', 'GET', 'asset', 2 FROM p WHERE page_id % 2 = 0 UNION ALL SELECT page_id, base, '/app.js', 'GET', 'script', 3 FROM p WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, base, '/find', 'POST', 'form', 4 FROM p WHERE page_id % 5 = 0 UNION ALL SELECT page_id, base, '/api/x?y=1', 'GET', 'script', 5 FROM p WHERE page_id % 7 = 0 UNION ALL SELECT page_id, base, '/api/last', 'GET', 'text', 7 FROM p WHERE page_id % 11 = 0)
  SELECT page_id, method, base || trim(value) AS url, arg_min(source, k) AS source FROM v GROUP BY ALL""")
def route_candidates(spark, sf_dir):
    ship(spark)
    part = lambda n, markup: F.when(F.col("page_id") % n == 0, F.lit(markup)).otherwise(F.lit(""))
    extra = F.concat(part(2, "<link href='/main.css'>"), part(3, "<script src='/app.js'></script>"), part(5, "<form action='/find' method=post></form>"), part(7, "<script>x(); fetch( '/api/x?y=1' )</script>"), part(11, "<p>see /api/last</p>"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("html", F.concat("html", extra)).withColumn("kind", F.lit("text/html"))
    return routes.route_candidates(pages, "page_id", "url", "html", "kind").select("page_id", "method", "url", "source")


@query("json_filter_keys", """SELECT doc_id, name, field_type FROM (SELECT doc_id, unnest(['pageSize', 'searchText', 'Tipo', 'datas']) AS name, unnest(['int', 'str', 'NoneType', 'json_array']) AS field_type FROM documents WHERE doc_id % 3 > 0)""")
def json_filter_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = F.to_json(F.struct(F.col("doc_id").alias("pageSize"), F.coalesce("text", F.lit("")).alias("searchText"), F.lit(None).cast("string").alias("Tipo"), F.array("lang").alias("datas"), F.lit(1).alias("other")), {"ignoreNullFields": "false"})
    body = F.when(F.col("doc_id") % 3 > 0, made).otherwise(F.concat(F.lit("["), made, F.lit("]")))
    return routes.filter_keys(docs.select("doc_id", body.alias("body")), "doc_id", "body").select("doc_id", "name", "field_type")


# --- documents by type, depth of fetching, sources by name, bounds of pages, lists of contracts

_KINDS = ["text/html", "application/json", "text/plain", "application/pdf", "application/vnd.api+json", "", "application/xhtml+xml"]


@query("text_extraction", """WITH d AS (SELECT doc_id, CAST(doc_id % 7 AS INT) AS k, CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(text, '') END AS t FROM documents), n AS (SELECT *, nullif(trim(regexp_replace(t, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\pZ]+', ' ', 'g')), '') AS visible, nullif(regexp_replace(t, '^[\\s\\x0B\\x1C-\\x1F\\x{85}\\pZ]+|[\\s\\x0B\\x1C-\\x1F\\x{85}\\pZ]+$', '', 'g'), '') AS bare FROM d)
  SELECT doc_id, sha256(CASE WHEN k IN (0, 6) THEN visible WHEN k IN (1, 2, 4) THEN bare END) AS text_sha256, CASE WHEN t = '' AND k NOT IN (0, 6) THEN 'empty' WHEN k IN (3, 5) THEN 'unsupported_format' WHEN coalesce(CASE WHEN k IN (0, 6) THEN visible ELSE bare END, '') = '' THEN 'empty' ELSE 'complete' END AS status FROM n""")
def text_extraction(spark, sf_dir):
    ship(spark)
    text = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    marked = F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p><script>x</script>"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", kind.alias("kind"), F.when((F.col("doc_id") % 7).isin(0, 6), marked).otherwise(text).cast("binary").alias("content"))
    return docs.select("doc_id", documents.extract_text(F.col("content"), F.col("kind")).alias("d")).select("doc_id", F.sha2("d.text", 256).alias("text_sha256"), "d.status")


@query("fetch_depth", with_views("evidence") + """, p AS (SELECT source, CAST(run AS INT) + 1 AS page, CASE WHEN run = 7 AND source = 's3' THEN 0 ELSE count(*) % 5 + 1 END AS n, source = 's2' AND run = 2 AS is_complete, CASE WHEN source = 's4' THEN 6 END AS total FROM evidence GROUP BY source, run),
  r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY page) AS BIGINT) AS records FROM p), e AS (SELECT source, min(page) AS last FROM r WHERE n = 0 OR is_complete OR records >= coalesce(total, 1000000) OR records >= 20 GROUP BY source)
  SELECT r.source, page, records FROM r LEFT JOIN e ON r.source = e.source WHERE page <= coalesce(last, page)""")
def fetch_depth(spark, sf_dir):
    n = F.when((F.col("run") == 7) & (F.col("source") == "s3"), 0).otherwise(F.count(F.lit(1)) % 5 + 1)
    pages = view(spark, sf_dir, "evidence").groupBy("source", "run").agg(n.alias("n"))
    pages = pages.select("source", (F.col("run").cast("int") + 1).alias("page"), "n", ((F.col("source") == "s2") & (F.col("run") == 2)).alias("is_complete"), F.when(F.col("source") == "s4", 6).alias("total"))
    return federate.fetch_depth(pages, 2, 10).select("source", "page", "records")


@query("route_requested", with_views("capabilities") + """, q AS (SELECT DISTINCT 's' || l_suppkey * 2 AS source FROM lineitem) SELECT q.source, CASE WHEN c.source IS NULL THEN NULL WHEN NOT unified THEN 'unified_search_not_supported' WHEN category = 'case_lookup' THEN 'outside_jurisprudence_scope' WHEN category = 'judicial_communications' THEN 'not_jurisprudence_source' WHEN category <> 'court_jurisprudence' THEN 'category_not_applicable' END AS skip_reason,
  c.source IS NULL OR (unified AND category = 'court_jurisprudence') AS searched, c.source IS NOT NULL AS known FROM q LEFT JOIN capabilities c ON q.source = c.source""")
def route_requested(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("s"), F.col("l_suppkey") * 2).alias("source"))
    return federate.route_requested(asked, _capabilities(spark, sf_dir), [], ["text"], ["court_jurisprudence"]).select("source", "skip_reason", "searched", "known")


@query("window_bounds", with_views("records") + """, t AS (SELECT court, count(*) AS total FROM records GROUP BY court) SELECT court, CAST(CASE WHEN total > 3000 THEN 3001 ELSE 0 END AS BIGINT) AS start, CAST(CASE WHEN total > 3000 THEN least(total, 3100) ELSE 0 END AS BIGINT) AS "end", total FROM t""")
def window_bounds(spark, sf_dir):
    totals = view(spark, sf_dir, "records").groupBy("court").agg(F.count(F.lit(1)).alias("n"))
    return totals.select("court", federate.window_bounds(F.col("n"), 31, 100).alias("w")).select("court", "w.*")


@query("contract_lists", with_views("capabilities") + """, l AS (SELECT source, CASE WHEN key % 2 = 0 OR key % 3 = 0 OR (unified AND balance > 2000) THEN 4 WHEN filters <> '' AND key % 7 > 0 THEN 3 WHEN balance > 0 THEN 2 ELSE 1 END AS level, key % 5 IN (0, 1) AS words FROM capabilities)
  SELECT count(*) AS total_sources, string_agg(source, ',' ORDER BY source) FILTER (level < 4 OR words) AS needs_deepening, '' AS ready_for_agents FROM l""")
def contract_lists(spark, sf_dir):
    found = quality.contract_lists(_contracts(spark, sf_dir))
    return found.select("total_sources", F.array_join("needs_deepening", ",").alias("needs_deepening"), F.array_join("ready_for_agents", ",").alias("ready_for_agents"))


@query("record_lookup", with_views("records") + """, w AS (SELECT kind, max(position) AS position FROM records WHERE kind <> 'document' GROUP BY kind) SELECT r.kind, id, court, price, TRUE AS few_files FROM records r JOIN w USING (kind, position)""")
def record_lookup(spark, sf_dir):
    """One record of each of two kinds out of a stored table, and whether at most a few of its files were opened."""
    root = fresh_path(spark, "store")
    records = view(spark, sf_dir, "records")
    now = store.save_snapshot(spark, {"records": records}, root, "v1")
    wanted = records.filter("kind != 'document'").groupBy("kind").agg(F.max_by("id", "position").alias("id")).orderBy("kind").collect()
    parts = []
    for r in wanted:
        rows, files = store.lookup(now, "records", kind=r["kind"], id=r["id"])
        parts.append(rows.select("kind", "id", "court", "price", F.lit(len(files) <= 2).alias("few_files")))
    return parts[0].unionByName(parts[1])
