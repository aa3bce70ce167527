"""Federated search: routing, concatenation, ranking, de-duplication, one global page and its envelope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.functions.identity import record_identity, relevance
from recordlake.operators.canonical import is_decision


def concatenate(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of sources in routing order, with their ordinal."""
    numbered = [df.withColumn("source_order", F.lit(i)) for i, df in enumerate(parts.values())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def fetch_window(results: DataFrame, pages: int, page_size: int, arrival: list[Column] | None = None) -> DataFrame:
    """At most ``pages * page_size`` results of each source, in order of arrival."""
    window = Window.partitionBy("source").orderBy(*(arrival or [F.asc("arrival")]))
    return results.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= pages * page_size).drop("__n")


def rank_dedup(results: DataFrame, text: str, arrival: list[Column]) -> DataFrame:
    """Per identity the best-scored result, the first to arrive among equals."""
    null = F.lit(None).cast("string")
    scored = results.withColumns({
        "score": relevance(text, *(F.col(c) for c in ("question", "thesis", "summary", "case_number", "number") if c in results.columns)),
        "identity": record_identity(F.col("case_number") if "case_number" in results.columns else null, F.col("number"), F.when(~is_decision(F.col("type")), F.col("type")), F.col("court") if "court" in results.columns else null, F.col("source"), F.col("id")),
    })
    window = Window.partitionBy("identity").orderBy(F.desc("score"), *arrival)
    return scored.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def ranked_page(unique: DataFrame, page: int, size: int) -> DataFrame:
    return unique.orderBy(F.desc("score"), F.asc("source"), F.asc("id")).offset((page - 1) * size).limit(size)


def envelope(collected: DataFrame, unique: DataFrame, page: int, size: int) -> DataFrame:
    """collected, unique, returned, has_more, next_offset of a global page."""
    counted = collected.agg(F.count(F.lit(1)).alias("collected")).crossJoin(unique.agg(F.count(F.lit(1)).alias("unique_total")))
    returned = F.greatest(F.lit(0), F.least(F.lit(size), F.col("unique_total") - (page - 1) * size))
    more = F.col("unique_total") > page * size
    return counted.select("collected", "unique_total", returned.cast("long").alias("returned"), more.alias("has_more"), F.when(more, F.lit(page * size).cast("long")).alias("next_offset"))


def completeness_rollup(status: DataFrame) -> DataFrame:
    """Complete, partial and unknown sources by three-valued flags, and whether the whole collection is complete."""
    named = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("source")))), ",")
    ok = (F.count_if(F.col("skipped") | F.col("warned") | F.col("failed")) == 0) & (F.count_if(F.coalesce(~F.col("is_complete"), F.lit(True))) == 0)
    return status.agg(
        named(F.col("is_complete")).alias("complete_sources"), named(~F.col("is_complete")).alias("partial_sources"),
        named(F.col("is_complete").isNull() & ~F.col("failed") & ~F.col("skipped")).alias("unknown_sources"), ok.alias("collection_complete"),
    )


def page_completeness(total: Column, start: Column, returned: Column, authoritative: Column) -> Column:
    """Struct of the three-valued flag and its reason."""
    known = F.coalesce(authoritative, F.lit(False)) & total.isNotNull() & (total >= 0)
    done = F.greatest(start, F.lit(1)) + returned - 1 >= total
    flag = F.when(known, F.when(total == 0, True).when(returned == 0, False).otherwise(done))
    reason = F.when(~known, "total_unknown").when(total == 0, "no_results").when(returned == 0, "empty_page").when(done, "total_reached").otherwise("more_available")
    return F.struct(flag.alias("is_complete"), reason.alias("reason"))


def route_sources(capabilities: DataFrame, identifiers: list[str], refinements: list[str], categories: list[str]) -> DataFrame:
    """Every source with its decision: skip reason (first rule that holds) or searched, and warnings."""
    supported = F.col("supported_filters")
    asked = F.array(*map(F.lit, identifiers)).cast("array<string>")
    missing = F.array_except(asked, supported)
    reason = (
        F.when(~F.col("unified"), "unified_search_not_supported").when(F.col("category") == "case_lookup", "outside_jurisprudence_scope")
        .when((F.size(supported) > 0) & (F.size(missing) > 0), "identifier_filter_not_supported").when(F.col("category") == "judicial_communications", "not_jurisprudence_source")
        .when(~F.col("category").isin(categories), "category_not_applicable")
    )
    wanted = F.array(*map(F.lit, refinements)).cast("array<string>")
    extra = F.array_except(wanted, supported)
    extra = F.when(F.size(supported) == 0, F.array_except(extra, F.array(F.lit("text")))).otherwise(extra)
    return capabilities.select("source", reason.alias("skip_reason"), reason.isNull().alias("searched"), F.when(reason.isNull(), F.array_join(F.array_sort(extra), ",")).otherwise("").alias("warnings"))


def routing_summary(routes: DataFrame, errors: DataFrame) -> DataFrame:
    """(source, part, detail): searched and not failed, warned, skipped, failed, in that order."""
    part = lambda df, n, name, detail: df.select("source", F.lit(n).alias("part_order"), F.lit(name).alias("part"), detail.alias("detail"))
    searched = part(routes.filter("searched").join(errors, "source", "left_anti"), 1, "searched", F.lit(""))
    warned = part(routes.filter("searched and warnings != ''"), 2, "warning", F.col("warnings"))
    skipped = part(routes.filter("not searched"), 3, "skipped", F.col("skip_reason"))
    failed = part(errors.join(routes.filter("searched"), "source", "left_semi"), 4, "failed", F.col("error"))
    return searched.unionByName(warned).unionByName(skipped).unionByName(failed)


def default_sources(capabilities: DataFrame, categories: list[str]) -> DataFrame:
    return capabilities.filter(F.col("unified") & F.col("category").isin(categories)).select("source").orderBy("source")


def source_status(routing: DataFrame, completeness: DataFrame, errors: DataFrame, counts: DataFrame) -> DataFrame:
    """Status of each routed source, and of those that have results without being routed.

    ``routing`` (source, action), ``completeness`` (source, returned, reported_total, is_complete), ``errors`` (source,
    error) and ``counts`` (source, n: results) have a row a source. An error comes first, then a skip, then what is
    known to be incomplete, of unknown completeness, or completely empty.
    """
    known = completeness.select("source", F.col("returned").alias("__returned"), "reported_total", "is_complete", F.lit(True).alias("__known"))
    joined = routing.join(known, "source", "left").join(errors, "source", "left").join(counts, "source", "full")
    returned = F.when(F.col("__known"), F.coalesce("__returned", F.lit(0))).otherwise(F.coalesce("n", F.lit(0)))
    error, known = F.lower(F.col("error")), F.coalesce("__known", F.lit(False))
    status = (
        F.when(F.col("action").isNull(), "ok").when(error.isNotNull(), F.when(error.rlike("ssl|certificate|tls"), "ssl_error").otherwise("failed")).when(F.col("action") == "failed", "failed")
        .when(F.col("action") == "skipped", "skipped").when(~F.col("is_complete"), "partial").when(F.col("is_complete").isNull() & known, "unknown")
        .when(known & (returned == 0) & (F.col("reported_total") == 0), "empty").when(F.col("action") == "searched", "ok").otherwise("unknown")
    )
    return joined.select("source", status.alias("status"), returned.cast("long").alias("count"), "reported_total", "is_complete")


def fit_remote_page(page: Column, size: Column) -> Column:
    """Smallest remote page size of 10, 25, 50, 100 that holds the request, the remote page, and the offset in it."""
    fitted = F.when(size <= 10, 10).when(size <= 25, 25).when(size <= 50, 50).otherwise(100)
    first = (page - 1) * size
    return F.struct(fitted.alias("size"), (F.floor(first / fitted) + 1).cast("int").alias("page"), (first % fitted).cast("int").alias("offset"))


def route_requested(requested: DataFrame, capabilities: DataFrame, identifiers: list[str], refinements: list[str], categories: list[str]) -> DataFrame:
    """Routing of the sources asked for by name; one that declares nothing is searched all the same."""
    known = route_sources(capabilities, identifiers, refinements, categories).withColumn("known", F.lit(True))
    joined = requested.select("source").distinct().join(known, "source", "left")
    return joined.select("source", "skip_reason", F.coalesce("searched", F.lit(True)).alias("searched"), F.coalesce("warnings", F.lit("")).alias("warnings"), F.coalesce("known", F.lit(False)).alias("known"))


def fetch_depth(pages: DataFrame, page: int, page_size: int) -> DataFrame:
    """Pages (source, page, n, is_complete, total) that a federated page takes of each source, with ``records`` so far.

    A source is read until there are enough records for the global page, a page is empty, the source calls a page
    its last, or its total is reached.
    """
    target = page * page_size
    upto = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    running = pages.withColumn("records", F.sum("n").over(upto))
    ends = (F.col("n") == 0) | F.coalesce(F.col("is_complete"), F.lit(False)) | F.coalesce((F.col("total") >= 0) & (F.col("records") >= F.col("total")), F.lit(False)) | (F.col("records") >= target)
    return running.withColumn("__ended", F.coalesce(F.max(ends).over(earlier), F.lit(False))).filter("not __ended").drop("__ended")


def window_bounds(total: Column, page: int, size: int) -> Column:
    """One-based start and end of a page of a local table, 0 where it is empty."""
    first = max(page - 1, 0) * size
    shown = F.greatest(F.lit(0), F.least(F.lit(size), total - first))
    return F.struct(F.when(shown > 0, first + 1).otherwise(0).cast("long").alias("start"), F.when(shown > 0, first + shown).otherwise(0).cast("long").alias("end"), total.cast("long").alias("total"))


def local_window(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of a local table with its one-based start and end."""
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumns({"window_start": F.lit((page - 1) * size + 1), "window_size": F.lit(size)})
