"""JSON search answers of sources as result rows: where the list, the total and the fields are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.dates import normalize_date
from recordlake.functions.text import first_nonempty, public_value, strip_tags

FIELDS = ("id", "type", "number", "court", "judging_body", "rapporteur", "question", "thesis", "summary", "full_text", "judgment_date", "publication_date", "updated_at", "status")


@dataclass(frozen=True)
class Envelope:
    """``lists``: JSON paths of record lists; ``fields``: paths in a record, tried in order."""

    lists: tuple[str, ...]
    total: str | None
    fields: dict[str, tuple[str, ...]]
    constants: dict[str, str] = field(default_factory=dict)


#: Paths of the JSON sources (fixed values).
ENVELOPES = {
    "bnp_pangea": Envelope(("$.resultados",), "$.total", {
        "id": ("id",), "type": ("tipo",), "number": ("nr",), "court": ("orgao",), "question": ("questao",), "thesis": ("tese",), "status": ("situacao",), "updated_at": ("ultimaAtualizacao",)}),
    "stf_juris": Envelope(("$.result.hits.hits",), "$.result.hits.total.value", {
        "id": ("_source.id", "_id"), "type": ("_source.base",), "number": ("_source.processo_numero",), "rapporteur": ("_source.relator_processo_nome",), "summary": ("_source.ementa_texto",),
        "judgment_date": ("_source.julgamento_data",), "publication_date": ("_source.publicacao_data",)}, {"court": "STF"}),
    "tst_jurisprudencia": Envelope(("$.registros",), "$.totalRegistros", {
        "id": ("registro.id",), "type": ("registro.tipo.nome",), "number": ("registro.numFormatado", "registro.numero"), "judging_body": ("registro.orgaoJudicante.descricao",), "rapporteur": ("registro.nomRelator",),
        "summary": ("registro.ementa", "registro.txtEmentaHighlight"), "full_text": ("registro.inteiroTeorHtml",), "judgment_date": ("registro.dtaJulgamento",), "publication_date": ("registro.dtaPublicacao",),
        "updated_at": ("registro.dtaAtualizacao",)}, {"court": "TST"}),
    "tjmt_jurisprudencia_api": Envelope(("$.AcordaoCollection", "$.DecisaoMonocraticaCollection"), "$.CountTotal", {
        "id": ("Id",), "type": ("Tipo",), "number": ("Processo.NumeroUnicoFormatado",), "judging_body": ("Processo.DescricaoCamara",), "rapporteur": ("Processo.NomeRelator",), "summary": ("Conteudo",), "full_text": ("Documento",),
        "judgment_date": ("Processo.DataJulgamento",), "publication_date": ("Processo.DataPublicacao",)}, {"court": "TJMT"}),
    "tjpe_jurisprudencia": Envelope(("$",), None, {
        "id": ("chave",), "type": ("descrClasseCNJ",), "number": ("npu", "codigoProcesso"), "judging_body": ("nomeOrgaoJulgador",), "rapporteur": ("relator",), "summary": ("textoEmenta",), "full_text": ("textoAcordao",),
        "judgment_date": ("dataJulgamento",), "publication_date": ("dataPublicacao",)}, {"court": "TJPE"}),
    "tjce_sjuris": Envelope(("$.pagina.content",), "$.pagina.totalElements", {
        "id": ("id", "idDocumento"), "type": ("nomeDocumento",), "number": ("numeroProcesso",), "judging_body": ("orgaoJulgador",), "rapporteur": ("magistrado",), "summary": ("ementa",), "full_text": ("conteudo",),
        "publication_date": ("dataPublicacao",)}, {"court": "TJCE"}),
    "tjro_liame": Envelope(("$.data.results",), "$.data.total", {
        "id": ("registro.numero",), "type": ("especie",), "number": ("registro.numero",), "question": ("registro.questao",), "thesis": ("registro.tese",), "rapporteur": ("registro.relator",), "status": ("registro.situacao",),
        "judgment_date": ("registro.dataJulgamento",), "publication_date": ("registro.dataPublicacao",), "updated_at": ("registro.dataAtualizacao",)}, {"court": "TJRO"}),
    "tjba_graphql": Envelope(("$.data.filter.decisoes",), "$.data.filter.itemCount", {
        "id": ("hash", "id"), "type": ("tipoDecisao",), "number": ("numeroProcesso",), "judging_body": ("orgaoJulgador.nome",), "rapporteur": ("relator.nome",), "summary": ("ementa",), "full_text": ("conteudo",),
        "judgment_date": ("dataJulgamento",), "publication_date": ("dataPublicacao",), "updated_at": ("dataAtualizacao",)}, {"court": "TJBA"}),
    "tjrs_solr": Envelope(("$.response.docs",), "$.response.numFound", {
        "id": ("cod_ementa",), "type": ("tipo_documento",), "number": ("numero_processo",), "court": ("nome_tribunal",), "rapporteur": ("nome_relator",), "judging_body": ("orgao_julgador",), "summary": ("ementa_completa",),
        "judgment_date": ("data_julgamento",), "publication_date": ("data_publicacao",)}),
    "tjpa_jurisprudencia_bff": Envelope(("$.content", "$.itens"), "$.totalElements", {
        "id": ("id",), "type": ("tipo",), "number": ("numeroProcesso",), "judging_body": ("orgaoJulgador",), "rapporteur": ("relator",), "summary": ("ementa",), "judgment_date": ("dataJulgamento",), "publication_date": ("dataPublicacao",)},
        {"court": "TJPA"}),
    "tjpb_pje_jurisprudencia": Envelope(("$.data", "$.resultado"), "$.total", {
        "id": ("id", "uuid"), "type": ("tipo",), "number": ("numeroProcesso",), "judging_body": ("orgaoJulgador",), "rapporteur": ("relator",), "summary": ("ementa",), "judgment_date": ("dataJulgamento",), "publication_date": ("dataPublicacao",)},
        {"court": "TJPB"}),
}


def _listed(body: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(body, path) if path != "$" else body, "array<string>"), F.array().cast("array<string>"))


def parse_results(captures: DataFrame, source: str) -> DataFrame:
    """One row per record of a JSON answer (column ``body``), with its place, the total and the raw record."""
    spec = ENVELOPES[source]
    records = F.concat(*(_listed(F.col("body"), p) for p in spec.lists))
    total = F.get_json_object("body", spec.total).try_cast("long") if spec.total else F.lit(None).cast("long")
    rows = captures.select("url", total.alias("total"), F.posexplode(records).alias("position", "raw"))
    value = lambda name: F.coalesce(*(public_value(strip_tags(F.get_json_object("raw", f"$.{p}"))) for p in spec.fields.get(name, ())), F.lit(spec.constants.get(name)).cast("string"))
    made = rows.select(F.lit(source).alias("source"), "url", "position", "total", *(value(n).alias(n) for n in FIELDS), "raw")
    return made.withColumns({n: normalize_date(F.col(n)) for n in ("judgment_date", "publication_date", "updated_at")}).filter(first_nonempty(F.col("id"), F.col("number")).isNotNull())


def facets(captures: DataFrame, path: str, key: str, count: str) -> DataFrame:
    """Facet buckets that a source returns along with its answer."""
    bucket = F.explode(_listed(F.col("body"), path))
    return captures.select("url", bucket.alias("b")).select("url", F.get_json_object("b", f"$.{key}").alias("value"), F.get_json_object("b", f"$.{count}").try_cast("long").alias("n"))
