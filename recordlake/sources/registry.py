"""The public sources and what they declare, as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: source | category | pagination | formats | full text | takes part in federated search (fixed values).
SOURCES = """
bnp_pangea|qualified_precedents|page|json|N|Y
cjf_jurisprudencia|court_jurisprudence|local_window|html|N|Y
cnj_jurisprudencia|curated_jurisprudence|page|html/pdf|N|Y
justica_eleitoral_sjur|electoral_jurisprudence|none|json|N|N
stf_informativo|court_jurisprudence|local_window|xlsx|N|Y
stf_juris|court_jurisprudence|offset|json|N|Y
stj_dados_abertos_jurisprudencia|court_jurisprudence_dataset|catalog_offset|json/csv/zip|N|N
stj_informativo|court_jurisprudence|local_window|html|N|Y
stj_scon|court_jurisprudence|page|html/pdf|Y|Y
stm_jurisprudencia|court_jurisprudence|offset|html|Y|Y
tce_sp_jurisprudencia|administrative_jurisprudence|local_window|html|N|Y
tcu_jurisprudencia|administrative_jurisprudence|local_window|csv/text/html|N|Y
tjac_cjsg|court_jurisprudence|page|html|Y|Y
tjal_cjsg|court_jurisprudence|page|html|Y|Y
tjam_cjsg|court_jurisprudence|page|html|Y|Y
tjba_graphql|court_jurisprudence|page|json/html/text|Y|Y
tjce_cjsg|court_jurisprudence|page|html|Y|Y
tjce_informativos|curated_jurisprudence|local_window|html/pdf|N|Y
tjce_sjuris|court_jurisprudence|page|json/text/pdf|Y|Y
tjdf_juris|court_jurisprudence|page|html|Y|Y
tjgo_projudi_jurisprudencia|court_jurisprudence|page|html|N|Y
tjma_jurisconsult|court_catalog|none|json|N|N
tjms_cjsg|court_jurisprudence|page|html|Y|Y
tjmt_jurisprudencia_api|court_jurisprudence|page|json/html/text|Y|Y
tjpa_jurisprudencia_bff|court_jurisprudence|page|json|Y|Y
tjpb_pje_jurisprudencia|court_jurisprudence|page|json/html|Y|Y
tjpe_jurisprudencia|court_jurisprudence|offset|json/html|Y|Y
tjpi_juspi|court_jurisprudence|page|html|Y|Y
tjpr_jurisprudencia|court_jurisprudence|page|html|N|Y
tjrj_eproc_jurisprudencia|court_jurisprudence|page|html|Y|Y
tjro_liame|court_precedents|page|json|N|N
tjrr_juris|court_jurisprudence|page|html/text|Y|Y
tjrs_solr|court_jurisprudence|offset|json|N|Y
tjsc_eproc_jurisprudencia|court_jurisprudence|page|html|Y|Y
tjsp_cjsg|court_jurisprudence|page|html|Y|Y
tjsp_eproc_jurisprudencia|court_jurisprudence|page|html|Y|Y
tjsp_nugepnac|court_precedents|local_window|html|N|Y
tjto_jurisprudencia|court_jurisprudence|offset|html|Y|Y
tnu_eproc_jurisprudencia|court_jurisprudence|page|html|Y|Y
tre_sp_temas|electoral_jurisprudence|local_window|html/pdf|N|Y
trf2_eproc_jurisprudencia|court_jurisprudence|page|html|Y|Y
trf4_eproc_jurisprudencia|court_jurisprudence|local_window|html|Y|Y
trf5_jurisprudencia|court_jurisprudence|none|html|Y|Y
trf6_eproc_jurisprudencia|court_jurisprudence|page|html|Y|Y
tst_jurisprudencia|court_jurisprudence|offset|json/html|Y|Y
"""

#: Categories that federated search includes by default (fixed values).
DEFAULT_CATEGORIES = [
    "court_jurisprudence", "court_precedents", "qualified_precedents", "curated_jurisprudence",
    "electoral_jurisprudence", "administrative_jurisprudence", "jurisprudence",
]


#: source: search filters that it declares (fixed values); others declare none.
FILTERS = """
bnp_pangea: text number courts types all_words any_words without_words exact_phrase updated_from updated_to
cjf_jurisprudencia: text number types
cnj_jurisprudencia: text number published_from published_to page
stf_informativo: text number
stf_juris: text number published_from published_to updated_from updated_to
stj_dados_abertos_jurisprudencia: catalog_query rows dataset_id resource_id format max_bytes force
stj_informativo: text number
stj_scon: text number
stm_jurisprudencia: text number
tce_sp_jurisprudencia: text types
tcu_jurisprudencia: text number
tjac_cjsg tjal_cjsg tjam_cjsg tjce_cjsg tjms_cjsg: text number exact_phrase updated_from updated_to types order_by
tjba_graphql: text exact_phrase number updated_from updated_to published_from published_to order_by
tjce_informativos: text number types published_from published_to page
tjce_sjuris: text all_words any_words without_words exact_phrase types source_origins
tjdf_juris: text exact_phrase all_words any_words without_words rapporteur published_from published_to updated_from updated_to
tjgo_projudi_jurisprudencia: text number
tjma_jurisconsult: types catalog
tjmt_jurisprudencia_api: text published_from published_to types order_by
tjpa_jurisprudencia_bff: text types source_origins published_from published_to case_class subject rapporteur
tjpb_pje_jurisprudencia: text number case_class judging_body rapporteur published_from published_to source_origin
tjpe_jurisprudencia: text number published_from published_to types order_by
tjpi_juspi: text number types rapporteur source_origin updated_from updated_to
tjpr_jurisprudencia: text number published_from published_to updated_from updated_to
tjro_liame: text number published_from published_to types page
tjrr_juris: text number exact_phrase updated_from updated_to published_from published_to
tjrs_solr: text exact_phrase number page published_from published_to
tjsp_cjsg: text number
tjsp_eproc_jurisprudencia tjrj_eproc_jurisprudencia tjsc_eproc_jurisprudencia tnu_eproc_jurisprudencia trf2_eproc_jurisprudencia trf6_eproc_jurisprudencia: text number published_from published_to updated_from updated_to
tjsp_nugepnac: text number types
tjto_jurisprudencia: text exact_phrase number rapporteur source_origin types order_by page fetch_details
tre_sp_temas: text exact_phrase
trf4_eproc_jurisprudencia: text number
trf5_jurisprudencia: text number published_from published_to types
tst_jurisprudencia: text all_words any_words without_words exact_phrase number published_from published_to updated_from updated_to types
"""


def declared_filters() -> dict[str, list[str]]:
    lines = [line.split(":") for line in FILTERS.strip().splitlines()]
    return {source: filters.split() for sources, filters in lines for source in sources.split()}


def rows() -> list[dict]:
    names = ("source", "category", "pagination", "formats", "full_text", "unified")
    table = [dict(zip(names, line.split("|"), strict=True)) for line in SOURCES.split()]
    declared = declared_filters()
    return [r | {"formats": r["formats"].split("/"), "full_text": r["full_text"] == "Y", "unified": r["unified"] == "Y", "supported_filters": declared.get(r["source"], [])} for r in table]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "source string, category string, pagination string, formats array<string>, full_text boolean, unified boolean, supported_filters array<string>")
