"""Result lists of court sites, read by rules in tables; a changed site is told apart from an empty answer.

A site rule names the container of the results, an item in it (or, for some sites, anywhere) and, if the item is only a mark, the enclosing
element that holds the item's fields. A field rule names elements of an item by selector, what to take of them
(text or an attribute), a pattern whose first group is the value, and, for labels, the element beside that has
the value. Rules of one field are tried by rank, then by place. A page's outcome is one of

- ``records``: items with all required fields were found,
- ``empty``: the site says that there is nothing, by an empty container, a text or an element, and counts none,
- ``access_control``: the page asks for a login or a captcha,
- ``contract_changed``: what should be there is missing, whatever else the page holds.

Rules are small tables that the driver reads; pages are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.functions.text import collapse_space
from recordlake.scratch import written
from recordlake.sources import dom

SITE_SCHEMA = "family string, sources array<string>, prefix string, id_fields array<string>, container string, anywhere boolean, item string, scope string, total string, empty_text string, empty_element string, blocked string, not_blocked string"
FIELD_SCHEMA = "family string, field string, rank int, selector string, take string, pattern string, beside string, required boolean"
CNJ = r"(\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})"
DAY = r"(\d{2}/\d{2}/\d{4})"

# How the sites mark their result lists (selectors, labels, words).
SITES = [
    ("cjsg", ["tjsp_cjsg", "tjac_cjsg", "tjal_cjsg", "tjam_cjsg", "tjce_cjsg", "tjms_cjsg"], None, ["cd_acordao", "cd_foro"], "#divDadosResultado-A, #tdResultados", True, "a.downloadEmenta", "table", r"(?i)Resultados\s+\d+\s+a\s+\d+\s+de\s+(\d+)|Ac[oó]rd[aã]os\((\d+)\)", "Resultado consulta|Resultados", None, "(?i)captchacontroleacesso|g-recaptcha|emptysession.jsp|empty session", "(?i)divdadosresultado|tdresultados|downloadementa"),
    ("eproc", ["tjsp_eproc_jurisprudencia", "tjrj_eproc_jurisprudencia", "tjsc_eproc_jurisprudencia", "tnu_eproc_jurisprudencia", "trf2_eproc_jurisprudencia", "trf4_eproc_jurisprudencia", "trf6_eproc_jurisprudencia"], None, ["document_id"], None, True, ".resultadoItem", None, None, None, "#frmJurisprudenciaPesquisa", "(?i)g-recaptcha|cf-turnstile|cloudflare|captcha|login e senha|entrar no sistema", "(?i)resultadoitem"),
    ("tjpr", ["tjpr_jurisprudencia"], "tjpr", ["source_id"], "table.resultTable.jurisprudencia", False, "tr input[name='idsSelecionados']", "tr", r"(?i)([\d.]+)\s+registro\(s\) encontrado", "(?i)registro\\(s\\) encontrado|nenhum resultado", None, "(?i)captcha|acesso negado|access denied", "(?i)resultTable"),
    ("trf5", ["trf5_jurisprudencia"], "trf5-jurisprudencia", ["document_id"], None, True, "td.grid", None, None, "(?i)nenhum|no resultado", None, "(?i)captcha|acesso negado|access denied", "(?i)class=.?grid"),
    ("scon", ["stj_scon"], "stj-scon", ["registry"], "#resultados, .resultados", False, ".documento, .resultado", None, r"(?i)Resultados\s+\d+\s+a\s+\d+\s+de\s+(\d+)", "(?i)resultado.*nenhum|nenhum.*resultado", None, "(?i)challenge-error-text|cf-error|verifica[cç][aã]o automatica|enable javascript and cookies to continue|g-recaptcha|recaptcha_response_token", "(?i)id=.?resultados|class=.?documento"),
]
FIELDS = [
    ("cjsg", "cd_acordao", 1, "a.downloadEmenta", "cdacordao", None, None, True), ("cjsg", "cd_foro", 1, "a.downloadEmenta", "cdforo", None, None, False), ("cjsg", "number", 1, "a.downloadEmenta", None, r"(.+)", None, True),
    ("cjsg", "rapporteur", 1, "tr.ementaClass2", None, r"(?iu)^relator\s*\(a\)\s*:?\s*(.+)$", None, False), ("cjsg", "rapporteur", 2, "tr.ementaClass2", None, r"(?iu)^relator\s*:?\s*(.+)$", None, False), ("cjsg", "judging_body", 1, "tr.ementaClass2", None, r"(?iu)^[oó]rg[aã]o julgador\s*:?\s*(.+)$", None, False),
    ("cjsg", "class_subject", 1, "tr.ementaClass2", None, r"(?iu)^classe/assunto\s*:?\s*(.+)$", None, False), ("cjsg", "updated_at", 1, "tr.ementaClass2", None, rf"(?iu)^data de registro\s*:?\s*{DAY}", None, False), ("cjsg", "publication_date", 1, "tr.ementaClass2", None, rf"(?iu)^data de publica[cç][aã]o\s*:?\s*{DAY}", None, False),
    ("cjsg", "judgment_date", 1, "tr.ementaClass2", None, rf"(?iu)^data d[eo] julgamento\s*:?\s*{DAY}", None, False), ("cjsg", "summary", 1, "[id^='textAreaDados_']", None, r"(.+)", None, False),
    ("eproc", "document_id", 1, "input.chkDocumento", "value", r"(.+)", None, False), ("eproc", "document_id", 2, ".resultadoItem", "id", r"^(?:resultado)?(.+)$", None, True), ("eproc", "number", 1, "a.numero-processo, a[data-link*='processo_']", None, CNJ, None, False), ("eproc", "number", 2, ".resultadoItem", None, CNJ, None, False),
    ("eproc", "type", 1, ".resValueTipoJurisprudencia", None, r"(.+)", None, False), ("eproc", "rapporteur", 1, ".resLabel", None, r"(?iu)^magistrado\s*:?$", ".resValue", False), ("eproc", "rapporteur", 2, ".resLabel", None, r"(?iu)^relator\s*:?$", ".resValue", False), ("eproc", "judging_body", 1, ".resLabel", None, r"(?iu)^[oó]rg[aã]o julgador\s*:?$", ".resValue", False),
    ("eproc", "judgment_date", 1, ".resLabel", None, r"(?iu)^data do julgamento\s*:?$", ".resValue", False), ("eproc", "publication_date", 1, ".resLabel", None, r"(?iu)^data da publica[cç][aã]o\s*:?$", ".resValue", False), ("eproc", "summary", 1, ".resLabel", None, r"(?iu)^decis[aã]o\s*:?$", ".resValue", False), ("eproc", "summary", 2, ".resLabel", None, r"(?iu)^ementa\s*:?$", ".resValue", False),
    ("tjpr", "source_id", 1, "input[name='idsSelecionados']", "value", r"(.+)", None, True), ("tjpr", "url", 1, "a[href*='/jurisprudencia/j/']", "href", r"^([^;?]+)", None, True), ("tjpr", "number", 1, "tr", None, CNJ, None, False), ("tjpr", "type", 1, "tr", None, r"\((\p{L}[^)]*)\)", None, False),
    ("tjpr", "rapporteur", 1, "tr", None, r"Relator:\s*(.*?)\s*(?:Processo:|Órgão Julgador:|Data Julgamento:|Segredo de Justiça|$)", None, False), ("tjpr", "judging_body", 1, "tr", None, r"Órgão Julgador:\s*(.*?)\s*(?:Processo:|Data Julgamento:|Segredo de Justiça|$)", None, False), ("tjpr", "judgment_date", 1, "tr", None, rf"Data Julgamento:\s*{DAY}", None, False), ("tjpr", "summary", 1, "td.juris-tabela-ementa", None, r"(.+)", None, False),
    ("trf5", "document_id", 1, "[href*='detalhesDocumento']", "href", r"detalhesDocumento\(['\"](\d+)['\"]\)", None, True), ("trf5", "document_id", 2, "[onclick*='detalhesDocumento']", "onclick", r"detalhesDocumento\(['\"](\d+)['\"]\)", None, False), ("trf5", "number", 1, "td.grid", None, CNJ, None, True),
    ("trf5", "judging_body", 1, "td.grid", None, r"(?iu)[oó]rg[aã]o julgador:\s*(.*?)\s*/\s*Tipo de Documento:", None, False), ("trf5", "type", 1, "td.grid", None, r"(?i)Tipo de Documento:\s*(.*?)\s*/\s*Data de Julgamento:", None, False), ("trf5", "judgment_date", 1, "td.grid", None, r"(?i)Data de Julgamento:\s*(.*?)\s*/\s*Nr\. Processo:", None, False), ("trf5", "summary", 1, "td.grid", None, r"(?i)EMENTA:\s*(.+)$", None, False),
    ("scon", "registry", 1, ".registro", None, r"(.+)", None, False), ("scon", "registry", 2, "a.doclink, a[href]", "href", r"num_registro=(\d+)", None, True), ("scon", "number", 1, ".processo", None, r"(.+)", None, False), ("scon", "number", 2, "a.doclink, a[href]", None, r"(.+)", None, False), ("scon", "url", 1, "a.doclink, a[href]", "href", r"(.+)", None, False),
    ("scon", "rapporteur", 1, ".relator", None, r"(.+)", None, False), ("scon", "judgment_date", 1, ".data-julgamento", None, r"(.+)", None, False), ("scon", "publication_date", 1, ".data-publicacao", None, r"(.+)", None, False), ("scon", "summary", 1, ".ementa", None, r"(.+)", None, False), ("scon", "judging_body", 1, ".orgao-julgador", None, r"(.+)", None, False),
]


def site_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, SITE_SCHEMA)


def field_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, FIELD_SCHEMA)


#: What selectors ask of an element.
_ASKED = ("pre", "last", "parent", "depth", "tag", "id", "classes", "attrs", "nth", "of_kind", "child", "of_parent", "start", "stop")


def _overlap(name: str, numbers: list[int]) -> Column:
    return F.arrays_overlap(name, F.array(*map(F.lit, numbers))) if numbers else F.lit(False)


def _by_family(family: Column, cases: list[Column]) -> Column:
    return F.coalesce(*(F.when(family == i, case) for i, case in enumerate(cases)))


def _parsed(pages: DataFrame, sites: list) -> DataFrame:
    """The pages of all families, parsed once; ``page`` holds the family's number, the source, the page's key and whether the door is closed."""
    families = F.array_compact(F.array(*(F.when(F.col("source").isin(site["sources"]), i) for i, site in enumerate(sites))))
    markup = F.coalesce("markup", F.lit(""))
    closed = _by_family(F.col("family"), [markup.rlike(site["blocked"]) & ~markup.rlike(site["not_blocked"]) for site in sites])
    keyed = pages.withColumn("family", F.explode(families)).select(F.struct("family", "source", "page", closed.alias("closed")).alias("page"), "markup")
    asked = F.transform("nodes", lambda n: F.struct(*(n[name].alias(name) for name in _ASKED)))
    return written(dom.dom(keyed, "page", "markup").withColumn("nodes", asked), "pages")


def _hits(parsed: DataFrame, sites: list, rules: list[list]) -> tuple[DataFrame, dict[tuple[int, str], int]]:
    """The elements that match a selector of their family, with what the field rules take of them, in one pass.

    ``ks`` numbers the selectors matched, ``found`` has a row a rule that finds something or labels, ``shown`` is the text of
    elements that may be beside a label. The second result numbers (family, selector).
    """
    family, k, chains, tests = F.col("page.family"), {}, {}, []
    for i, (site, own) in enumerate(zip(sites, rules, strict=True)):
        asked = [_inside(site), site["scope"], site["container"], site["empty_element"], *(r[c] for r in own for c in ("selector", "beside"))]
        for selector in dict.fromkeys(x for x in asked if x):
            k[i, selector] = len(k)
            chains[i, selector] = []
            for steps in dom.chains(selector):
                chains[i, selector].append([(c, len(tests) + j) for j, (c, _) in enumerate(steps)])
                tests += [(family == i) & test for _, test in steps]
    # what an element may end is told by its last step; the steps before are met below
    fits = lambda i, selector: _overlap("fits", [steps[-1][1] for steps in chains[i, selector]])
    shown = dom.text_of(F.col("text"), {c: F.col(c) for c in ("start", "stop")})

    def one(i: int, rule) -> Column:
        value = F.element_at("attrs", F.lit(rule["take"])) if rule["take"] else shown
        labelled = F.coalesce(value.rlike(rule["pattern"]), F.lit(False)) if rule["beside"] else F.lit(False)
        if rule["beside"]:
            value = F.lit(None).cast("string")
        elif rule["pattern"]:
            value = F.regexp_extract(value, rule["pattern"], 1)
        beside = F.lit(k[i, rule["beside"]] if rule["beside"] else None).cast("int")
        return F.when(fits(i, rule["selector"]), F.struct(F.lit(k[i, rule["selector"]]).alias("k"), F.lit(rule["field"]).alias("field"), F.lit(rule["rank"]).alias("rank"), collapse_space(value).alias("value"), beside.alias("beside"), labelled.alias("labelled")))

    every = [(i, r) for i, own in enumerate(rules) for r in own]
    besides = {(i, r["beside"]) for i, r in every if r["beside"]}
    # one column of the tests that fit: a column each would have Spark infer constraints of their combinations
    nodes = parsed.select("page", "text", F.inline("nodes")).withColumn("fits", F.array_compact(F.array(*(F.when(t, n) for n, t in enumerate(tests))))).filter("size(fits) > 0")
    alone = {x: [s for s in own if len(s) == 1] for x, own in chains.items()}
    ks = F.array_compact(F.array(*(F.when(_overlap("fits", [s[0][1] for s in own]), k[x]) for x, own in alone.items())))
    hits = nodes.select(
        "page", "pre", "last", "parent", "child", "fits", ks.alias("ks"), F.array_compact(F.array(*(one(i, r) for i, r in every))).alias("found"),
        F.when(reduce(lambda a, b: a | b, [fits(*b) for b in sorted(besides)], F.lit(False)), shown).alias("shown"),
    )
    hits = written(hits, "hits")
    joint = {x: [s for s in own if len(s) > 1] for x, own in chains.items() if len(alone[x]) < len(own)}
    if joint:
        few = hits.select("page", "pre", "last", "parent", "child", "fits")
        ended = [dom.matched(few.filter(_overlap("fits", [n for s in own for _, n in s])), [[(c, F.array_contains("fits", n)) for c, n in s] for s in own]).select("page", "pre", F.lit(k[x]).alias("k")) for x, own in joint.items()]
        ended = reduce(DataFrame.unionByName, ended).groupBy(F.col("page").alias("e_page"), F.col("pre").alias("e_pre")).agg(F.collect_set("k").alias("joint"))
        hits = hits.join(ended, (F.col("page") == F.col("e_page")) & (F.col("pre") == F.col("e_pre")), "left")
        hits = hits.withColumn("ks", F.array_union("ks", F.coalesce("joint", F.array().cast("array<int>"))))
    kept = F.filter("found", lambda r: F.array_contains("ks", r["k"]) & (r["labelled"] | F.coalesce(r["value"] != "", F.lit(False))))
    hits = hits.filter("size(ks) > 0").select("page", "pre", "last", "parent", "ks", kept.alias("found"), "shown")
    return written(hits, "hits") if joint else hits, k


def _inside(site) -> str:
    return site["item"] if site["anywhere"] or not site["container"] else dom.nested(site["container"], site["item"])


def _items(hits: DataFrame, sites: list, k: dict) -> DataFrame:
    """(at_page, item, from, to): the items and the elements that hold their fields."""
    marks = _matching(hits, {k[i, _inside(site)] for i, site in enumerate(sites)}).select(F.col("page").alias("at_page"), F.col("pre").alias("item"), F.col("pre").alias("from"), F.col("last").alias("to"))
    scopes = {i: k[i, site["scope"]] for i, site in enumerate(sites) if site["scope"]}
    if not scopes:
        return marks
    scoped = F.col("at_page.family").isin(list(scopes))
    around = _matching(hits, set(scopes.values())).select(F.col("page").alias("s_page"), F.col("pre").alias("s_pre"), F.col("last").alias("s_last"))
    held = marks.filter(scoped).join(around, (F.col("at_page") == F.col("s_page")) & (F.col("s_pre") <= F.col("item")) & (F.col("s_last") >= F.col("item")))
    held = held.groupBy("at_page", "item").agg(F.max(F.struct("s_pre", "s_last")).alias("s")).select("at_page", "item", F.col("s.s_pre").alias("from"), F.col("s.s_last").alias("to"))
    return marks.filter(~scoped).unionByName(held)


def _matching(hits: DataFrame, ks: set[int]) -> DataFrame:
    return hits.filter(_overlap("ks", sorted(ks)))


def _values(hits: DataFrame, items: DataFrame, rules: list[list], k: dict) -> DataFrame:
    """(page, item, field, rank, at, value): what each rule finds in each item."""
    inside = hits.filter("size(found) > 0").join(items, (F.col("page") == F.col("at_page")) & (F.col("pre") >= F.col("from")) & (F.col("pre") <= F.col("to")))
    taken = inside.select("page", "item", "parent", F.col("pre").alias("at"), F.inline("found"))
    direct = taken.filter("not labelled").select("page", "item", "field", "rank", "at", "value")
    besides = sorted({k[i, r["beside"]] for i, own in enumerate(rules) for r in own if r["beside"]})
    if not besides:
        return direct
    near = hits.filter("shown is not null").select("page", "parent", "pre", "shown", F.explode(F.array_intersect("ks", F.array(*map(F.lit, besides)))).alias("v_k"))
    near = near.groupBy(F.col("page").alias("v_page"), F.col("parent").alias("v_parent"), "v_k").agg(F.min_by("shown", "pre").alias("v"))
    labels = taken.filter("labelled").join(near, (F.col("page") == F.col("v_page")) & (F.col("parent") == F.col("v_parent")) & (F.col("beside") == F.col("v_k")))
    return direct.unionByName(labels.filter("v != ''").select("page", "item", "field", "rank", "at", F.col("v").alias("value")))


def _records(values: DataFrame, sites: list, rules: list[list]) -> DataFrame:
    """(page, item, fields, key): whole items, the first of each key."""
    family = F.col("page.family")
    best = values.groupBy("page", "item", "field").agg(F.min_by("value", F.struct("rank", "at")).alias("value"))
    found = best.groupBy("page", "item").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    there = lambda own: [F.element_at("fields", F.lit(n)).isNotNull() for n in sorted(_required(own))]
    whole = _by_family(family, [reduce(lambda a, b: a & b, there(own), F.lit(True)) for own in rules])
    key = _by_family(family, [F.concat_ws("-", *(F.element_at("fields", F.lit(n)) for n in site["id_fields"])) for site in sites])
    once = Window.partitionBy("page", "key").orderBy("item")
    return found.filter(whole).withColumn("key", key).withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n")


def _required(own: list) -> set[str]:
    return {r["field"] for r in own if r["required"]}


def _outcomes(parsed: DataFrame, hits: DataFrame, items: DataFrame, kept: DataFrame, sites: list, k: dict) -> DataFrame:
    family, shown = F.col("page.family"), F.coalesce(F.decode("text", "UTF-8"), F.lit(""))

    def total(site) -> Column:
        totals = [F.nullif(F.regexp_extract(shown, site["total"], g), F.lit("")) for g in range(1, 1 + (site["total"] or "").count("(?i)") + (site["total"] or "").count(")|"))]
        return F.coalesce(*(F.replace(t, F.lit("."), F.lit("")).cast("long") for t in totals), F.lit(0).cast("long"))

    state = parsed.select("page", _by_family(family, [total(s) for s in sites]).alias("total"), _by_family(family, [shown.rlike(s["empty_text"]) if s["empty_text"] else F.lit(False) for s in sites]).alias("says_empty"))
    counts = items.groupBy(F.col("at_page").alias("i_page")).agg(F.count(F.lit(1)).alias("n_items"))
    records = kept.groupBy(F.col("page").alias("r_page")).agg(F.count(F.lit(1)).alias("n_records"))
    bare = {k[i, s[c]] for i, s in enumerate(sites) for c in ("container", "empty_element") if s[c]}
    bare = _matching(hits, bare).select(F.col("page").alias("c_page")).distinct()
    for frame, name in ((counts, "i_page"), (records, "r_page"), (bare, "c_page")):
        state = state.join(frame, F.col("page") == F.col(name), "left")
    n_items, n_records = F.coalesce("n_items", F.lit(0)), F.coalesce("n_records", F.lit(0))
    outcome = (
        F.when(F.col("page.closed"), "access_control").when(n_records > 0, "records").when((n_items > 0) | (F.col("total") > 0), "contract_changed")
        .when(F.col("c_page").isNotNull() | F.col("says_empty"), "empty").otherwise("contract_changed")
    )
    return state.select("page.source", "page.page", outcome.alias("outcome"), "total", n_items.cast("long").alias("n_items"), F.when(outcome == "records", n_records).otherwise(0).cast("long").alias("n_records"))


def read_pages(pages: DataFrame, sites: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (source, page, item, id, fields by name) and outcomes (source, page, outcome, total, n_items, n_records).

    ``pages`` has source, page (a key of its own for each page) and markup. Pages of sources without a rule come out
    as ``no_rule``. All families are read together: pages are built and parsed once, and what follows joins only the
    elements that a selector matches, with what was taken of their texts.
    """
    found = sites.collect()
    by_family: dict[str, list] = {}
    for r in fields.collect():
        by_family.setdefault(r["family"], []).append(r)
    rules = [by_family[site["family"]] for site in found]
    parsed = _parsed(pages, found)
    hits, k = _hits(parsed, found, rules)
    items = _items(hits, found, k)
    values = _values(hits, items, rules, k)
    prefix = _by_family(F.col("page.family"), [F.lit(site["prefix"]) if site["prefix"] else F.replace("page.source", F.lit("_"), F.lit("-")) for site in found])
    # a page with a whole item is read unless its door is closed
    records = _records(values, found, rules).filter(~F.col("page.closed")).select("page.source", "page.page", "item", F.concat(prefix, F.lit("-"), "key").alias("id"), "fields")
    counted = set().union(*(_required(own) | set(site["id_fields"]) for site, own in zip(found, rules, strict=True)))  # no other field decides what counts
    outcomes = _outcomes(parsed, hits, items, _records(values.filter(F.col("field").isin(sorted(counted))), found, rules), found, k)
    known = [s for site in found for s in site["sources"]]
    other = pages.filter(~F.coalesce(F.col("source").isin(known), F.lit(False))).select("source", "page", F.lit("no_rule").alias("outcome"), *(F.lit(0).cast("long").alias(n) for n in ("total", "n_items", "n_records")))
    return records, outcomes.unionByName(other)
