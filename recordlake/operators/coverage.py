"""Coverage of sources: contracts with overrides, audits, summaries, the court catalogue and late answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories whose sources hold precedents whatever they declare (fixed values).
PRECEDENT_CATEGORIES = ["qualified_precedents", "court_precedents", "electoral_jurisprudence"]


def semantic_profile(category: Column, records: Column) -> Column:
    """What a source is about: by category, else by the record types that it declares."""
    has = lambda name: F.coalesce(F.array_contains(records, name), F.lit(False))
    return (
        F.when(category.isin(PRECEDENT_CATEGORIES), "precedent").when(category == "curated_jurisprudence", "curated")
        .when(has("CanonicalDecision") & has("CanonicalPrecedent"), "hybrid_decision_precedent").when(has("CanonicalPrecedent"), "precedent")
        .when(has("CanonicalDecision"), "decision").when(has("ProviderCatalog"), "catalog").when(has("CanonicalDocument"), "document").otherwise("unclassified")
    )


def source_contracts(capabilities: DataFrame, overrides: DataFrame, families: DataFrame) -> DataFrame:
    """Level and family of each source: an override (level, family) first, then the family default, then what was inferred."""
    known = capabilities.join(overrides.select("source", F.col("level").alias("own_level"), F.col("family").alias("own_family")), "source", "left")
    known = known.join(families.select("source", F.col("family").alias("default_family")), "source", "left")
    level = F.coalesce(F.when(F.col("own_level") > 0, F.col("own_level")), "inferred_level")
    family = F.coalesce(F.nullif("own_family", F.lit("")), F.nullif("default_family", F.lit("")), "category")
    return known.select("source", level.alias("level"), family.alias("family"))


def audit(capabilities: DataFrame, smoke: DataFrame, sweep: DataFrame) -> DataFrame:
    """Every declared source with what its smoke test and the sweep (each once a source) found."""
    return capabilities.join(smoke, "source", "left").join(sweep, "source", "left")


def coverage_totals(scores: DataFrame) -> DataFrame:
    """One row: sources, those with score 85 and more, those under 50, mean score."""
    score = F.col("score")
    return scores.agg(F.count(F.lit(1)).alias("sources"), F.count_if(score >= 85).alias("strong"), F.count_if(score < 50).alias("weak"), F.round(F.avg("score"), 1).alias("mean_score"))


def coverage_ends(scores: DataFrame, best: int = 5, worst: int = 10) -> DataFrame:
    """The best and the worst sources by score, ties by name."""
    top = scores.orderBy(F.desc("score"), "source").limit(best).withColumn("part", F.lit("best"))
    return top.unionByName(scores.orderBy("score", "source").limit(worst).withColumn("part", F.lit("worst")))


def list_courts(courts: DataFrame, branch: str | None = None, state: str | None = None, system: str | None = None, implemented: bool | None = None) -> DataFrame:
    """Courts that meet every condition given; states compare in capitals."""
    if branch:
        courts = courts.filter(F.col("branch") == branch)
    if state and state.strip():
        courts = courts.filter(F.col("state") == state.strip().upper())
    if system:
        courts = courts.filter(F.col("source_system") == system)
    if implemented is not None:
        courts = courts.filter(F.col("provider_status") == ("implemented" if implemented else "planned"))
    return courts


def with_deadline(routed: DataFrame, answers: DataFrame, deadline_ms: int) -> DataFrame:
    """One status a routed source: answers (source, elapsed_ms, returned, error) within the deadline count, all others are timeouts."""
    intime = answers.filter(F.col("elapsed_ms") <= deadline_ms)
    joined = routed.join(intime, "source", "left")
    error = F.when(F.col("elapsed_ms").isNull(), "TimeoutError").otherwise(F.col("error"))
    return joined.select("source", F.coalesce("returned", F.lit(0)).cast("long").alias("returned"), error.alias("error"), error.isNull().alias("answered"))


def match_order(text: Column, depth: Column, node_id: Column) -> list[Column]:
    """Text matches: shortest text first, then deepest, then those with an id."""
    return [F.length(text).asc(), depth.desc(), F.coalesce(node_id == "", F.lit(True)).asc()]


def title_or_detail(title: Column, detail: Column, number: str | None, text: str | None) -> Column:
    """The number, if given, stands in the title, and the text in title or detail (both already folded for search)."""
    fits = F.lit(True) if not number else F.coalesce(title.contains(number), F.lit(False))
    return fits if not text else fits & F.concat_ws(" ", title, detail).contains(text)


def compact(records: DataFrame, heavy: tuple[str, ...] = ("raw", "full_text", "highlights", "source_trace")) -> DataFrame:
    """Records without the columns that only detail views show."""
    return records.drop(*heavy)
