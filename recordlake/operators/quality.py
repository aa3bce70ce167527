"""Validation, health, contract and coverage rules, and response scoring."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What the names of hidden keys hold, and the marks of hidden and cut values.
SECRET_WORDS = ("authorization", "cookie", "password", "passwd", "secret", "token", "session", "api_key", "apikey")
HIDDEN, HIDDEN_BYTES, HIDDEN_TEXT, CUT = "<redacted>", "<redacted-bytes>", "<redacted-text>", "…<truncated>"
#: Status by the class of the error that ended a request.
HEALTH_OF_ERROR = {
    "AccessControlRequiredError": "blocked", "RateLimitDetectedError": "rate_limited", "ParserContractChangedError": "source_changed",
    "NetworkConfigurationError": "source_unavailable", "SourceUnavailableError": "source_unavailable", "TimeoutError": "timeout",
}
VALIDATION_OF_ERROR = HEALTH_OF_ERROR | {"QueryRejectedError": "query_rejected", "UnsupportedQueryError": "unsupported_query"}


def access_of_status(code: Column) -> Column:
    return (
        F.when(code == 404, "not_found").when(code == 401, "login_required").when(code == 403, "access_control_required")
        .when(code.isin(408, 425, 429) | (code >= 500), "source_unavailable").when((code >= 300) & (code < 400), "partial").when((code >= 200) & (code < 300), "public").otherwise("partial")
    )


def _proxy_failed(chain: Column) -> Column:
    low = F.lower(F.coalesce(chain, F.lit("")))
    return low.contains("proxyerror") | low.contains("unable to connect to proxy")


def _certificate_failed(chain: Column) -> Column:
    low = F.lower(F.coalesce(chain, F.lit("")))
    return low.contains("ssl") & (low.contains("certificate") | low.contains("certificado"))


def classify_error(kind: Column, chain: Column) -> Column:
    """Type of an error by the messages of its chain, else its class; null without an error."""
    named = F.when(_proxy_failed(chain), "NetworkConfigurationError").when(_certificate_failed(chain), "SslVerificationError").otherwise(kind)
    return F.when(kind.isNotNull(), named)


def blocked(text: Column, challenge: str, result: str | None) -> Column:
    """Challenge words count only where no result markup contradicts them."""
    found = F.lower(text).rlike(challenge)
    return found if result is None else found & ~F.lower(text).rlike(result)


def mixed_status(df: DataFrame, group: str, status: str) -> DataFrame:
    """Per group the one status there is, ``mixed`` for several, null for none."""
    return df.groupBy(group).agg(F.when(F.count(status) == 0, F.lit(None)).when(F.min(status) == F.max(status), F.min(status)).otherwise("mixed").alias("status"))


def full_text_status(df: DataFrame, group: str, text: str, url: str) -> DataFrame:
    """Per group: all texts are there, some result names a document, or neither."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return df.groupBy(group).agg(F.when(F.bool_and(filled(text)), "returned").when(F.bool_or(filled(url)), "document_available").otherwise("not_returned").alias("full_text_status"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n")).orderBy(status)


#: Checks of a page and of its results, in the order in which failures are listed.
PAGE_CHECKS = ("page_source", "page_trace", "page_number", "page_size", "reported_total_nonnegative")
RESULT_CHECKS = ("result_ids", "result_sources", "result_content", "result_traces")


def validation_report(pages: DataFrame, results: DataFrame, requested_size: int, errors: DataFrame | None = None) -> DataFrame:
    """Per source asked: failed checks of its first page and results, and valid, empty, contract_invalid or what failed.

    ``pages`` (source, page_source, page, page_size, total, endpoint) has a row a source; ``results`` (source, id,
    result_source, summary, thesis, question, full_text, endpoint) are checked where there are any. A missing page
    size or total can't be read as an answer at all. ``errors`` (source, kind, chain) are those of sources without a page.
    """
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    page_tests = [F.col("page_source") == F.col("source"), F.col("endpoint").isNotNull(), F.col("page") == 1, F.col("page_size") >= requested_size, F.col("total") >= 0]
    result_tests = [filled("id"), F.col("result_source") == F.col("source"), reduce(lambda a, b: a | b, map(filled, ("summary", "thesis", "question", "full_text"))), F.col("endpoint").isNotNull()]
    checked = pages.select("source", *(F.coalesce(t, F.lit(False)).alias(n) for n, t in zip(PAGE_CHECKS, page_tests, strict=True)), (F.col("page_size").isNull() | F.col("total").isNull()).alias("unreadable"))
    found = results.groupBy("source").agg(*(F.bool_and(F.coalesce(t, F.lit(False))).alias(n) for n, t in zip(RESULT_CHECKS, result_tests, strict=True)), F.count(F.lit(1)).alias("returned"))
    joined = checked.join(found, "source", "left")
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(n), F.lit(True)), F.lit(n)) for n in (*PAGE_CHECKS, *RESULT_CHECKS))))
    listed = F.when(F.col("unreadable"), "normalized_response").otherwise(F.array_join(failed, ","))
    report = joined.select("source", F.coalesce("returned", F.lit(0)).alias("returned"), listed.alias("failed_checks"))
    report = report.withColumn("status", F.when(F.col("failed_checks") != "", "contract_invalid").when(F.col("returned") == 0, "empty").otherwise("valid"))
    if errors is None:
        return report
    broken = errors.select("source", F.lit(0).cast("long").alias("returned"), F.lit("").alias("failed_checks"), validation_of_error(F.col("kind"), F.col("chain")).alias("status"))
    return report.unionByName(broken.join(pages, "source", "left_anti"))


def validation_of_error(kind: Column, chain: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in VALIDATION_OF_ERROR.items() for x in pair))
    return F.when(_proxy_failed(chain), "network_configuration").when(_certificate_failed(chain), "tls_verification_failed").otherwise(F.coalesce(known[kind], F.lit("error")))


def health(returned: Column, kind: Column) -> Column:
    """healthy or empty by what a source returned, or what the class of its error says."""
    known = F.create_map(*(F.lit(x) for pair in HEALTH_OF_ERROR.items() for x in pair))
    return F.when(kind.isNotNull(), F.coalesce(known[kind], F.lit("error"))).when(returned > 0, "healthy").otherwise("empty")


def contract_level(records: Column, fields: Column, endpoints: Column, limitations: Column, full_text: Column, catalog: Column, live_tests: Column, responsible_use: Column, category: Column) -> Column:
    """Level 1 to 4 by the highest rule that holds, whatever the lower ones say; level 5 is only ever granted by hand."""
    return F.when(full_text | catalog | (live_tests & responsible_use), 4).when(endpoints & limitations, 3).when(records & fields, 2).otherwise(1)


def contract_risk(limitations: Column, level: Column) -> Column:
    low = F.lower(F.coalesce(limitations, F.lit("")))
    return F.when(low.contains("captcha") | low.contains("controle de acesso"), "alto").when(level >= 5, "baixo").when(level >= 3, "medio").otherwise("alto")


def contract_lists(contracts: DataFrame) -> DataFrame:
    """One row over (source, level, risk): total, sources that need work and sources that agents may use, in order of name."""
    named = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("source"))))
    shallow = (F.col("level") < 4) | F.col("risk").isin("alto", "critico")
    ready = (F.col("level") >= 5) & F.col("risk").isin("baixo", "medio")
    return contracts.agg(F.count(F.lit(1)).alias("total_sources"), named(shallow).alias("needs_deepening"), named(ready).alias("ready_for_agents"))


def maturity(level: Column) -> Column:
    return F.when(level >= 5, "maduro").when(level >= 3, "intermediario").otherwise("inicial")


def coverage_score(*dimensions: tuple[Column, int]) -> Column:
    """Sum of dimensions, each between 0 and its cap."""
    return reduce(lambda a, b: a + b, (F.greatest(F.lit(0), F.least(c, F.lit(cap))) for c, cap in dimensions))


def coverage_grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D")


def facet_topk(df: DataFrame, facet: str, k: int) -> DataFrame:
    return df.groupBy(facet).agg(F.count(F.lit(1)).alias("n")).filter(F.col(facet).isNotNull()).orderBy(F.desc("n"), facet).limit(k)


def secrecy_flags(text: Column, access: Column, extraction: Column) -> Column:
    """Secret or pending content makes access partial, pending content extraction too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pending = low.rlike("aguardando (publica|libera)|conte[uú]do pendente")
    secret = low.rlike("segredo de justi[cç]a|sigilo")
    return F.struct(F.when(secret | pending, "partial").otherwise(access).alias("access_status"), F.when(pending, "partial").otherwise(extraction).alias("extraction_status"))


def page_echo(requested: Column, reported: Column, extraction: Column) -> Column:
    """A source that reports another page than asked for has changed."""
    return F.when(reported.isNotNull() & (reported != requested), "source_changed").otherwise(extraction)


def secret_key(key: Column) -> Column:
    plain = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    return reduce(lambda a, b: a | b, (plain.contains(w) for w in SECRET_WORDS))


def redact_map(c: Column) -> Column:
    """Values of secret-named keys hidden, long values cut."""
    return F.transform_values(c, lambda k, v: F.when(secret_key(k), HIDDEN).when(F.length(v) > 4096, F.concat(F.substring(v, 1, 4096), F.lit(CUT))).otherwise(v))


def redact_headers(c: Column) -> Column:
    """Values of secret-named headers hidden; others stay whole."""
    return F.transform_values(c, lambda k, v: F.when(secret_key(k), HIDDEN).otherwise(v))


def _redacted(value, hide: bool = False):
    """A parsed JSON value with secrets hidden at every depth."""
    if hide:
        return HIDDEN
    if isinstance(value, dict):
        return {k: _redacted(v, any(w in k.lower().replace("-", "_") for w in SECRET_WORDS)) for k, v in value.items()}
    if isinstance(value, list):
        return [_redacted(v) for v in value]
    return value[:4096] + CUT if isinstance(value, str) and len(value) > 4096 else value


@F.pandas_udf(StringType())
def redact_payload(payloads: pd.Series) -> pd.Series:
    """A request's body: JSON with secrets hidden at every depth; other text hidden if it has over 512 characters."""

    def one(text):
        try:
            return None if text is None else json.dumps(_redacted(json.loads(text)), ensure_ascii=False)
        except ValueError:
            return HIDDEN_TEXT if len(text) > 512 else text

    return payloads.map(one, na_action="ignore")


def redact_bytes(c: Column) -> Column:
    return F.when(c.isNotNull(), HIDDEN_BYTES)


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """http(s), no user information, a public host name that is or lies under an allowed one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    inside = reduce(lambda a, b: a | b, ((host == h) | host.endswith("." + h) for h in hosts), F.lit(False))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|0\.|\[)|\.local$")
    return F.coalesce(url.rlike("^(?i)https?://") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~private & inside, F.lit(False))
