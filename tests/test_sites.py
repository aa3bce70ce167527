"""Sites read by rules alone: records, empty answers, closed doors and changed pages."""

from recordlake.sources import sites

CNJ = "0001234-56.2020.8.26.0100"
CJSG_ITEM = "<table><tr class='ementaClass'><td><a class='downloadEmenta' cdAcordao='{0}' cdForo='7'>" + CNJ + "</a></td></tr><tr class='ementaClass2'><td><strong>Relator(a):</strong> Ana Dias</td></tr><tr class='ementaClass2'><td><strong>Órgão julgador:</strong> 3ª Turma</td></tr><tr class='ementaClass2'><td><strong>Data de Registro:</strong> 05/02/2021</td></tr><tr><td><div id='textAreaDados_{0}'>EMENTA &amp; voto</div></td></tr></table>"
EPROC = "<div class='resultadoItem' id='resultado44'><a class='numero-processo'>{0}</a><span class='resValueTipoJurisprudencia'>Acórdão</span><div><span class='resLabel'>Magistrado:</span> <span class='resValue'>Rui</span></div><div><span class='resLabel'>Data da Publicação</span><span class='resValue'>01/02/2022</span></div><div><span class='resLabel'>EMENTA</span><span class='resValue'>texto</span></div></div>"
TJPR = "<table class='resultTable jurisprudencia'><tr><th>x</th></tr><tr><td><input name='idsSelecionados' value='9'><a href='/jurisprudencia/j/9;jsessionid=1'>ver</a> (Acórdão) Processo: {0} Relator: Eva Data Julgamento: 03/04/2019 00:00</td><td class='juris-tabela-ementa'>E</td></tr></table>"
TRF5 = "<table><tr><td class='grid'><a href=\"javascript:detalhesDocumento('77')\">v</a> Órgão Julgador: 1ª Turma / Tipo de Documento: Acórdão / Data de Julgamento: 01/01/2020 / Nr. Processo: {0} EMENTA: longa ementa</td></tr></table>"
SCON = "<div id='resultados'>Resultados 1 a 1 de 5<div class='documento'><a class='doclink' href='/d?num_registro=55'>REsp 1</a><p class='relator'>Min. X</p><p class='ementa'>E</p></div></div>"

PAGES = [
    ("tjsp_cjsg", "a", "<div id='divDadosResultado-A'>Resultados 1 a 2 de 40" + CJSG_ITEM.format(1) + CJSG_ITEM.format(2) + CJSG_ITEM.format(1) + "</div>"), ("tjac_cjsg", "b", "<div id='tdResultados'>" + CJSG_ITEM.format(5) + "</div>"),
    ("tjsp_cjsg", "c", "<div id='divDadosResultado-A'>Resultados 1 a 2 de 40<p>novo leiaute</p></div>"), ("tjsp_cjsg", "d", "<p>Resultado consulta: nada</p>"), ("tjsp_cjsg", "e", "<div id='outroNome'>" + CJSG_ITEM.format(3) + "</div>"), ("tjsp_cjsg", "f", "<form action='captchaControleAcesso.do'></form>"),
    ("tjsp_cjsg", "g", "<div id='divDadosResultado-A'>nada</div>"), ("tjsp_cjsg", "h", "<div id='divDadosResultado-A'><table><tr><td><a class='downloadEmenta'>sem código</a></table></div>"),
    ("trf2_eproc_jurisprudencia", "i", EPROC.format(CNJ)), ("trf2_eproc_jurisprudencia", "j", "<form id='frmJurisprudenciaPesquisa'></form>"), ("trf2_eproc_jurisprudencia", "k", "<div class='cartao'>x</div>"), ("trf2_eproc_jurisprudencia", "l", "Entrar no sistema"),
    ("tjpr_jurisprudencia", "m", TJPR.format(CNJ)), ("tjpr_jurisprudencia", "n", "Nenhum resultado"), ("tjpr_jurisprudencia", "o", "<table class='jurisprudencia'></table>"), ("tjpr_jurisprudencia", "p", "1.234 registro(s) encontrado(s)<table class='resultTable jurisprudencia'><tr><td>x</table>"),
    ("trf5_jurisprudencia", "q", TRF5.format(CNJ)), ("trf5_jurisprudencia", "r", "Nenhum documento"), ("trf5_jurisprudencia", "s", "<p>olá</p>"), ("trf5_jurisprudencia", "t", "<table><tr><td class='grid'>sem número</table>"),
    ("stj_scon", "u", SCON), ("stj_scon", "v", "resultado: nenhum"), ("stj_scon", "w", "<div class='outro'></div>"), ("stj_scon", "x", "g-recaptcha"), ("unknown", "y", "<p>"), ("stj_scon", "z", None),
]


def test_outcomes_and_records(spark):
    pages = spark.createDataFrame(PAGES, "source string, page string, markup string").repartition(4)
    records, outcomes = sites.read_pages(pages, sites.site_rules(spark), sites.field_rules(spark))
    got = {r["page"]: (r["outcome"], r["total"], r["n_records"]) for r in outcomes.collect()}
    changed, empty, closed = ("contract_changed", 0, 0), ("empty", 0, 0), ("access_control", 0, 0)
    assert got == {
        "a": ("records", 40, 2), "b": ("records", 0, 1), "c": ("contract_changed", 40, 0), "d": empty, "e": ("records", 0, 1), "f": closed, "g": empty, "h": changed, "i": ("records", 0, 1), "j": empty, "k": changed, "l": closed,
        "m": ("records", 0, 1), "n": empty, "o": changed, "p": ("contract_changed", 1234, 0), "q": ("records", 0, 1), "r": empty, "s": changed, "t": changed, "u": ("records", 5, 1), "v": empty, "w": changed, "x": closed, "y": ("no_rule", 0, 0), "z": changed,
    }
    rows = {r["id"]: r["fields"] for r in records.collect()}
    cjsg = {"cd_foro": "7", "number": CNJ, "rapporteur": "Ana Dias", "judging_body": "3ª Turma", "updated_at": "05/02/2021", "summary": "EMENTA & voto"}
    assert rows == {
        "tjsp-cjsg-1-7": cjsg | {"cd_acordao": "1"}, "tjsp-cjsg-2-7": cjsg | {"cd_acordao": "2"}, "tjsp-cjsg-3-7": cjsg | {"cd_acordao": "3"}, "tjac-cjsg-5-7": cjsg | {"cd_acordao": "5"},
        "trf2-eproc-jurisprudencia-44": {"document_id": "44", "number": CNJ, "type": "Acórdão", "rapporteur": "Rui", "publication_date": "01/02/2022", "summary": "texto"},
        "tjpr-9": {"source_id": "9", "url": "/jurisprudencia/j/9", "number": CNJ, "type": "Acórdão", "rapporteur": "Eva", "judgment_date": "03/04/2019", "summary": "E"},
        "trf5-jurisprudencia-77": {"document_id": "77", "number": CNJ, "judging_body": "1ª Turma", "type": "Acórdão", "judgment_date": "01/01/2020", "summary": "longa ementa"},
        "stj-scon-55": {"registry": "55", "number": "REsp 1", "url": "/d?num_registro=55", "rapporteur": "Min. X", "summary": "E"},
    }


def test_a_new_site_needs_rules_only(spark):
    site = [("x", ["novo"], "n", ["k"], "ul", False, "li", None, None, None, "form", "(?!)", "(?!)")]
    field = [("x", "k", 1, "li", "data-k", None, None, True), ("x", "name", 1, "li > b:first-child", None, None, None, False)]
    pages = spark.createDataFrame([("novo", 1, "<ul><li data-k=1><b>u</b><b>v</b><li data-k=2>w</ul>"), ("novo", 2, "<form>"), ("novo", 3, "")], "source string, page long, markup string")
    records, outcomes = sites.read_pages(pages, spark.createDataFrame(site, sites.SITE_SCHEMA), spark.createDataFrame(field, sites.FIELD_SCHEMA))
    assert {r["id"]: r["fields"] for r in records.collect()} == {"n-1": {"k": "1", "name": "u"}, "n-2": {"k": "2"}}
    assert {r["page"]: r["outcome"] for r in outcomes.collect()} == {1: "records", 2: "empty", 3: "contract_changed"}


def test_pages_are_built_once_for_all_families(spark):
    """Pages are dear to build: once for all rules together, and once more to name those without a rule."""
    built = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame(PAGES, "source string, page string, markup string").mapInArrow(counted, "source string, page string, markup string")
    records, outcomes = sites.read_pages(pages, sites.site_rules(spark), sites.field_rules(spark))
    assert (records.count(), outcomes.count()) == (8, len(PAGES))
    assert built.value <= 2 * len(PAGES)
