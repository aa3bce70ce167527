"""Normalised results to canonical decisions and precedents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.dates import normalize_date
from recordlake.functions.identity import canonical_key
from recordlake.functions.text import first_nonempty, nonblank, normalize_decision_type

#: Words that make a type a decision, contained or equal (fixed values).
DECISION_PARTS = ["decisao", "decisão", "despacho", "sentenca", "sentença"]
DECISION_NAMES = ["acordao", "acórdão", "monocratica", "monocrática"]


def is_decision(kind: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(low.rlike("|".join(DECISION_PARTS)) | low.isin(DECISION_NAMES), True).otherwise(False)


def effective_access(status: Column) -> Column:
    """An unknown access status is partial, never public."""
    return F.coalesce(nonblank(status), F.lit("partial"))


def has_legal_content(*columns: Column) -> Column:
    return first_nonempty(*columns).isNotNull()


def effective_extraction(status: Column, *content: Column) -> Column:
    """Complete without any content is partial."""
    return F.when((status == "complete") & ~has_legal_content(*content), "partial").otherwise(status)


def lineage(**changes: Column) -> Column:
    """Names of the changes whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in changes.items())))


def raw_value(raw: Column, *keys: str) -> Column:
    """First non-blank value of a JSON object under any of the keys."""
    return F.coalesce(*(nonblank(F.get_json_object(raw, f"$.{k}")) for k in keys))


def case_structs(json: Column) -> Column:
    """JSON list of cases as structs; entries without a number are left out."""
    kind = "array<struct<numero:string,number:string,classe:string,case_class:string,link:string,url:string>>"
    cases = F.transform(
        F.from_json(json, kind),
        lambda c: F.struct(first_nonempty(c["numero"], c["number"]).alias("number"), first_nonempty(c["classe"], c["case_class"]).alias("case_class"), first_nonempty(c["link"], c["url"]).alias("url")),
    )
    return F.filter(cases, lambda c: c["number"].isNotNull())


def to_decisions(results: DataFrame) -> DataFrame:
    """Canonical decisions of those results that are decisions."""
    content = [F.col(c) for c in ("summary", "full_text")]
    judged = normalize_date(F.col("judgment_date"))
    published = normalize_date(F.col("publication_date"))
    number = nonblank(F.col("number"))
    return results.filter(is_decision(F.col("type"))).select(
        "id", "source", "court", F.lit("decision").alias("kind"), normalize_decision_type(F.col("type")).alias("decision_type"),
        number.alias("case_number"), nonblank(F.col("rapporteur")).alias("rapporteur"), nonblank(F.col("summary")).alias("summary"), "full_text",
        judged.alias("judgment_date"), F.col("judgment_date").alias("judgment_date_raw"),
        published.alias("publication_date"), F.col("publication_date").alias("publication_date_raw"),
        effective_access(F.col("access_status")).alias("access_status"), effective_extraction(F.col("extraction_status"), *content).alias("extraction_status"),
        canonical_key(F.lit("decision"), F.col("source"), F.col("court"), number).alias("canonical_key"),
        lineage(
            judgment_date_normalized=~judged.eqNullSafe(F.col("judgment_date")), publication_date_normalized=~published.eqNullSafe(F.col("publication_date")),
            access_downgraded=nonblank(F.col("access_status")).isNull(), extraction_downgraded=(F.col("extraction_status") == "complete") & ~has_legal_content(*content),
        ).alias("transformations"),
    )


def to_precedents(results: DataFrame) -> DataFrame:
    """Canonical precedents: all results that are no decisions."""
    content = [F.col(c) for c in ("summary", "thesis", "question", "full_text")]
    return results.filter(~is_decision(F.col("type"))).select(
        "id", "source", "court", F.lit("precedent").alias("kind"), nonblank(F.col("type")).alias("precedent_type"), F.col("number"),
        nonblank(F.col("question")).alias("question"), nonblank(F.col("thesis")).alias("thesis"), normalize_date(F.col("updated_at")).alias("updated_at"), F.col("updated_at").alias("updated_at_raw"),
        effective_access(F.col("access_status")).alias("access_status"), effective_extraction(F.col("extraction_status"), *content).alias("extraction_status"),
        canonical_key(F.lit("precedent"), F.col("source"), F.col("court"), F.col("type"), F.coalesce(F.nullif(F.col("number"), F.lit("0")), F.col("id"))).alias("canonical_key"),
    )


def store_rows(records: DataFrame) -> DataFrame:
    """Rows of the record store; precedents are dated by their update."""
    return records.withColumn("publication_date", normalize_date(F.coalesce(F.col("publication_date"), F.col("updated_at"))))


def infer_kind(document_type: Column, number: Column, question: Column, thesis: Column) -> Column:
    return F.when(document_type.isNotNull(), "document").when(question.isNotNull() | thesis.isNotNull() | number.isNotNull(), "precedent").otherwise("decision")


def dataset_decisions(rows: DataFrame, dataset: Column) -> DataFrame:
    """Rows of an open dataset as decisions with stable ids; rows without an id are left out."""
    from recordlake.functions.identity import dataset_row_id

    return rows.filter(nonblank(F.col("id")).isNotNull()).select(
        dataset_row_id(dataset, F.col("id")).alias("id"), F.col("numeroProcesso").alias("case_number"), F.col("descricaoClasse").alias("case_class"),
        F.col("ministroRelator").alias("rapporteur"), F.col("nomeOrgaoJulgador").alias("judging_body"), nonblank(F.col("ementa")).alias("summary"),
        normalize_date(F.col("dataDecisao")).alias("judgment_date"), normalize_date(F.col("dataPublicacao")).alias("publication_date"),
    )
