"""Analysis of captured answers: legal and access signals, features, score, status and advice; discovery statuses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signal names and patterns, matched in lower-cased text with Unicode word borders.
LEGAL_SIGNALS = {
    "case_number": r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b",
    "acordao": r"\bac[oó]rd[aã]o\b",
    "ementa": r"\bementa\b",
    "jurisprudencia": r"\bjurisprud[eê]ncia\b",
    "relator": r"\brelator(?:a)?\b",
    "judging_body": r"\b(?:[oó]rg[aã]o julgador|turma|c[aâ]mara|se[cç][aã]o)\b",
    "decision": r"\b(?:decis[aã]o|senten[cç]a|voto)\b",
    "precedent": r"\b(?:tese|tema|s[uú]mula|repercuss[aã]o geral|repetitivo|irdr|iac)\b",
    "full_text": r"\b(?:inteiro teor|documento|pdf|visualizar ac[oó]rd[aã]o)\b",
}
ACCESS_SIGNALS = {
    "captcha": r"\bcaptcha\b",
    "recaptcha": r"\b(?:recaptcha|g-recaptcha)\b",
    "turnstile": r"\bturnstile\b",
    "cloudflare": r"\bcloudflare\b",
    "login": r"\b(?:fa[cç]a login|login obrigat[oó]rio|entrar no sistema|autentica[cç][aã]o requerida|sajcas|cas server)\b",
    "anti_robot": r"\b(?:antirrob[oô]|anti-rob[oô]|verifica[cç][aã]o automatica)\b",
    "empty_session": r"\b(?:emptysession|sess[aã]o expirada|sess[aã]o inexistente)\b",
    "access_denied": r"\b(?:access denied|acesso negado|forbidden|n[aã]o autorizado)\b",
    "request_blocked": r"\b(?:request blocked|request could not be satisfied)\b",
}
PAGINATION = (r"\bresultados?\s+\d+\s+a\s+\d+\s+de\s+\d+\b", r"\bp[aá]gina\s+\d+\b", r"\bpr[oó]xima\b", r"\btrocaDePagina\b", r"\bpage(?:Number)?\b")
CHALLENGE = r"\b(?:enable\s+javascript\s+and\s+cookies|just\s+a\s+moment|attention\s+required|cloudflare\s+ray|checking\s+your\s+browser|verifica[cç][aã]o\s+humana|managed\s+challenge)\b"
CAPTCHA_PROMPT = r"\b(?:digite\s+os\s+n[uú]meros|informe\s+o\s+c[oó]digo)\b"
RECAPTCHA_PROMPT = r"\b(?:captcha|n[aã]o\s+sou\s+um\s+rob[oô]|verifica[cç][aã]o\s+humana)\b"
ROBOT_PROMPT = r"\b(?:rob[oô]|automatizada|verifica[cç][aã]o)\b"
#: What to do with a route, by status.
STRONG_ROUTE = "Promover para ficha de contrato e fixture offline antes do provider."
ADVICE = {
    "live_valid": "Manter como candidato forte; aprofundar campos, paginacao e documento.",
    "candidate": "Investigar contrato com HAR/DevTools e confirmar conteudo juridico objetivo.",
    "partial_response": "Resposta parcial; preservar sinais encontrados e investigar paginacao, streaming ou timeout de leitura.",
    "access_control_or_login": "Documentar bloqueio; nao implementar bypass de captcha, login ou sessao.",
    "not_found": "Descartar rota ou revisar URL/metodo antes de novo probe.",
    "source_unavailable": "Registrar indisponibilidade e repetir teste em outra janela.",
}
#: Discovery statuses by what the transport reported, and by route status.
TRANSPORT_STATUS = {"timeout": "timeout", "tls_error": "tls_error", "source_unavailable": "source_unavailable", "redirect_limit": "source_unavailable", "redirect_outside_allowlist": "redirect_outside_allowlist"}
ROUTE_DISCOVERY = {"live_valid": "valid", "candidate": "candidate", "partial_response": "candidate", "access_control_or_login": "access_controlled", "not_found": "empty", "source_unavailable": "source_unavailable", "invalid_response": "unknown"}


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case; word borders know accents."""
    return F.coalesce(text, F.lit("")).rlike("(?iuU)" + pattern)


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of several patterns occurs, all of them between word borders: one pass over the text."""
    inner = [p.removeprefix(r"\b").removesuffix(r"\b") for p in patterns]
    return matches(text, rf"\b(?:{'|'.join(inner)})\b")


def legal_signals(text: Column) -> Column:
    low = F.lower(text)
    return F.create_map(*(x for name, p in LEGAL_SIGNALS.items() for x in (F.lit(name), matches(low, p))))


def access_signals(raw: Column, visible: Column) -> Column:
    """Map of signals: most count in the visible text; some in the raw one, alone or with a challenge in view."""
    raw, visible = F.lower(F.coalesce(raw, F.lit(""))), F.lower(F.coalesce(visible, F.lit("")))
    shown = {name: matches(visible, p) for name, p in ACCESS_SIGNALS.items()}
    hidden = {name: matches(raw, p) for name, p in ACCESS_SIGNALS.items()}
    found = shown | {name: hidden[name] for name in ("empty_session", "access_denied", "request_blocked")}
    for name in ("turnstile", "cloudflare"):
        found[name] = shown[name] | (hidden[name] & matches(visible, CHALLENGE))
    found["captcha"] = shown["captcha"] | matches(visible, CAPTCHA_PROMPT) | (raw.contains("tokendesafio") & raw.contains('"imagem"'))
    found["recaptcha"] = shown["recaptcha"] | (hidden["recaptcha"] & matches(visible, RECAPTCHA_PROMPT))
    found["anti_robot"] = shown["anti_robot"] | (hidden["anti_robot"] & matches(visible, ROBOT_PROMPT)) | raw.contains("antirrob")
    return F.create_map(*(x for name in ACCESS_SIGNALS for x in (F.lit(name), found[name])))


def any_signal(signals: Column) -> Column:
    return F.exists(F.map_values(signals), lambda x: x)


def any_legal_signal(text: Column) -> Column:
    """``any_signal`` of ``legal_signals``, in one pass."""
    return matches_any(F.lower(text), LEGAL_SIGNALS.values())


#: Signals that count in the raw text, and those that count there only with a challenge or a prompt in view.
RAW_SIGNALS = ("empty_session", "access_denied", "request_blocked")
HINTED_SIGNALS = ("turnstile", "cloudflare", "recaptcha", "anti_robot")


def any_access_signal(raw: Column, visible: Column) -> Column:
    """``any_signal`` of ``access_signals``: a pass over each text, and single signals only where the raw text hints at them."""
    low, shown = F.lower(F.coalesce(raw, F.lit(""))), F.lower(F.coalesce(visible, F.lit("")))
    in_view = matches_any(shown, [*(p for name, p in ACCESS_SIGNALS.items() if name not in RAW_SIGNALS), CAPTCHA_PROMPT])
    in_raw = matches_any(low, [ACCESS_SIGNALS[name] for name in RAW_SIGNALS]) | low.contains("antirrob") | (low.contains("tokendesafio") & low.contains('"imagem"'))
    hinted = matches_any(low, [ACCESS_SIGNALS[name] for name in HINTED_SIGNALS])
    return in_view | in_raw | (hinted & any_signal(access_signals(raw, visible)))


def features(content_type: Column, text: Column, visible: Column, legal: Column, full_text: Column) -> Column:
    """Struct of what an answer offers; ``legal``: any legal signal; ``full_text``: that of a full text."""
    kind, text = F.lower(F.coalesce(content_type, F.lit(""))), F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    json = kind.contains("json") | (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    xml = kind.contains("xml") | bare.startswith("<?xml")
    both = F.concat(text, F.lit("\n"), F.coalesce(visible, F.lit("")))
    return F.struct(
        (json | xml).alias("structured_response"), (kind.contains("html") | F.lower(text).contains("<html")).alias("html_response"), (kind.contains("application/pdf") | text.startswith("%PDF")).alias("pdf_response"),
        matches_any(both, PAGINATION).alias("pagination"), full_text.alias("full_text_link"), legal.alias("legal_content"),
    )


def score(code: Column, found: Column, access: Column, expected_all: Column, elapsed_ms: Column, whole: Column) -> Column:
    """Points of a route, not below 0. ``access``: any access signal; ``expected_all``: null without expected texts."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    total = (
        points((code >= 200) & (code < 300), 1) + points(found["structured_response"], 3) + points(found["legal_content"], 3) + points(found["pagination"], 2)
        + points(found["full_text_link"] | found["pdf_response"], 2) + points(expected_all, 2) + points(elapsed_ms <= 2500, 1) + F.when(access, -4).otherwise(1)
        - F.when(code == 404, 4).when(code >= 400, 3).otherwise(0) - points(~found["legal_content"] & ~found["structured_response"], 2) - points(~whole, 3)
    )
    return F.greatest(total, F.lit(0))


def grade(points: Column) -> Column:
    return F.when(points >= 8, "A").when(points >= 5, "B").when(points >= 2, "C").otherwise("D")


def status(code: Column, found: Column, access: Column, expected_all: Column, whole: Column) -> Column:
    return (
        F.when(code == 404, "not_found").when(access, "access_control_or_login").when(code >= 400, "source_unavailable").when(~whole, "partial_response")
        .when(~expected_all, "candidate").when(found["legal_content"] | found["structured_response"], "live_valid").otherwise("candidate")
    )


def advice(route_status: Column, points: Column) -> Column:
    texts = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return F.when((route_status == "live_valid") & (points >= 8), STRONG_ROUTE).otherwise(F.coalesce(texts[route_status], F.lit(ADVICE["source_unavailable"])))


def analyze(answers: DataFrame) -> DataFrame:
    """Adds signals, features, score, status, grade and advice to captured answers.

    Columns taken: code, content_type, text, visible, expected_texts (array), elapsed_ms, response_complete,
    content_truncated, transport_status. The legal signals are those of the visible text, or of the raw text where
    nothing is visible. Nulls count as empty texts, no expectations and unknown time.
    """
    text, visible = F.coalesce("text", F.lit("")), F.coalesce("visible", F.lit(""))
    has = F.transform(F.coalesce("expected_texts", F.array().cast("array<string>")), lambda x: text.contains(x) | visible.contains(x))
    judged = F.when(visible != "", visible).otherwise(text)
    read = answers.withColumns({
        "legal_signals": legal_signals(judged), "access_signals": access_signals(text, visible), "legal": any_legal_signal(judged), "access": any_access_signal(text, visible),
        "expected_all": F.when(F.size(has) > 0, F.forall(has, lambda x: x)),
        "whole": F.coalesce("response_complete", F.lit(True)) & ~F.coalesce("content_truncated", F.lit(False)),
    })
    full_text = F.col("legal") & matches(F.lower(judged), LEGAL_SIGNALS["full_text"])
    read = read.withColumn("route_features", features(F.col("content_type"), text, visible, F.col("legal"), full_text))
    found, access, expected, whole = F.col("route_features"), F.col("access"), F.col("expected_all"), F.col("whole")
    carried = whole & (F.coalesce("transport_status", F.lit("complete")) == "complete")
    read = read.withColumns({"score": score(F.col("code"), found, access, expected, F.col("elapsed_ms"), carried), "route_status": status(F.col("code"), found, access, expected, whole)})
    read = read.withColumns({"quality_grade": grade(F.col("score")), "recommendation": advice(F.col("route_status"), F.col("score")), "ok": F.col("route_status") == "live_valid"})
    return read.drop("expected_all", "whole", "access", "legal")


# --- discovery

def discovery_of_transport(transport: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in TRANSPORT_STATUS.items() for x in pair))
    return F.coalesce(known[transport], F.lit("unknown"))


def discovery_of_code(code: Column, has_body: Column) -> Column:
    return (
        F.when(code.isin(401, 403, 407, 451), "access_controlled").when(code == 429, "rate_limited").when(code == 404, "empty").when(code >= 500, "source_unavailable")
        .when((code >= 200) & (code < 300), F.when(has_body, "valid").otherwise("empty")).otherwise("unknown")
    )


def discovery_of_route(route_status: Column, code: Column, has_body: Column) -> Column:
    """Status by what the content says, or by the code where the route has no status."""
    known = F.create_map(*(F.lit(x) for pair in ROUTE_DISCOVERY.items() for x in pair))
    return F.coalesce(known[route_status], discovery_of_code(code, has_body))


def access_of_discovery(found: Column) -> Column:
    return (
        F.when(found.isin("access_controlled", "redirect_outside_allowlist"), "access_control_required").when(found.isin("source_unavailable", "timeout", "tls_error"), "source_unavailable")
        .when(found == "empty", "not_found").when(found.isin("valid", "candidate"), "public").otherwise("partial")
    )


def extraction_of_discovery(found: Column, has_body: Column) -> Column:
    return (
        F.when((found == "empty") | ~has_body, "empty").when(found.isin("access_controlled", "rate_limited"), "partial")
        .when(found.isin("source_unavailable", "timeout", "tls_error"), "failed").otherwise("complete")
    )
