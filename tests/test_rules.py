"""Rules of routing, contracts, health, validation, probes and redaction: outcomes stated one by one."""

import json

import pytest
from pyspark.sql import functions as F

from recordlake.operators import documents, federate, probe, quality
from recordlake.plans.search_query import SearchQuery


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def true_signals(spark, rows, column):
    return [{k for k, v in m.items() if v} for m in values(spark, rows, "raw string, visible string", column)]


def test_legal_signals_end_at_word_borders(spark):
    rows = [("Acórdão e EMENTA da 3ª Turma",), ("ementas, relatório, preementa",), ("açãoementa ementaé",), ("nº 0001234-56.2020.8.26.0100.",), ("10001234-56.2020.8.26.0100",), ("Súmula 7; inteiro  teor; Inteiro teor",), ("sentença do relator; voto",), (None,)]
    got = true_signals(spark, [(r[0], None) for r in rows], probe.legal_signals(F.col("raw")))
    assert got == [{"acordao", "ementa", "judging_body"}, set(), set(), {"case_number"}, set(), {"precedent", "full_text"}, {"decision", "relator"}, set()]


def test_access_signals_in_raw_and_visible_text(spark):
    rows = [
        ("<div class='g-recaptcha'>", "Busca"), ("<div class='g-recaptcha'>", "Não sou um robô"), ("", "reCAPTCHA"), ("cf turnstile cloudflare", "Página comum"), ("cf turnstile cloudflare", "Just a  moment"),
        ("acesso negado", ""), ("", "acesso negado"), ("faça login", "x"), ("x", "Faça login"), ('{"tokenDesafio": 1, "imagem": ""}', ""), ("", "Informe o código"), ("antirrobotica", ""), ("", "recapitulação"),
    ]
    got = true_signals(spark, rows, probe.access_signals(F.col("raw"), F.col("visible")))
    assert got == [set(), {"recaptcha"}, {"recaptcha"}, set(), {"turnstile", "cloudflare"}, {"access_denied"}, set(), set(), {"login"}, {"captcha"}, {"captcha"}, {"anti_robot"}, set()]


def test_probe_status_score_and_advice(spark):
    schema = "code int, content_type string, text string, visible string, expected_texts array<string>, elapsed_ms int, response_complete boolean, content_truncated boolean, transport_status string"
    rows = [
        (200, "application/json", '{"ementa": "x", "page": 1}', "", ["ementa"], 100, True, False, "complete"), (200, "text/html", "<html>ementa", "ementa", None, 9000, True, False, "complete"),
        (200, "text/html", "<html>ementa", "ementa", ["tese"], 100, True, False, "complete"), (200, "text/html", "<html>oi", "oi", [], 100, True, False, None), (404, "", "", "", None, None, True, False, "complete"),
        (403, "", "acesso negado", "", None, None, True, False, "complete"), (451, "", "x", "x", None, None, True, False, "complete"), (200, "", "ementa", "ementa", None, 1, True, True, "complete"), (200, "", "ementa", "ementa", None, 1, False, False, "timeout_after_headers"),
    ]
    got = probe.analyze(spark.createDataFrame(rows, schema)).collect()
    assert [r["route_status"] for r in got] == ["live_valid", "live_valid", "candidate", "candidate", "not_found", "access_control_or_login", "source_unavailable", "partial_response", "partial_response"]
    # 1 (code) + 3 (structure) + 3 (legal) + 2 (pages) + 2 (expected) + 1 (open) + 1 (fast); 1 + 3 + 1; 1 + 3 + 1 + 1; 1 + 1 + 1 - 2; below 0; ...; 1 + 3 + 1 + 1 - 3
    assert [r["score"] for r in got] == [13, 5, 6, 1, 0, 0, 0, 3, 3]
    assert [r["quality_grade"] for r in got] == list("ABBDDDDCC")
    assert [r["recommendation"].split()[0] for r in got] == ["Promover", "Manter", "Investigar", "Investigar", "Descartar", "Documentar", "Registrar", "Resposta", "Resposta"]
    assert [r["ok"] for r in got] == [True, True] + [False] * 7


def test_discovery_statuses(spark):
    codes = [(200, True), (204, False), (302, True), (401, True), (403, True), (407, True), (451, True), (404, True), (429, True), (418, True), (500, True), (None, True)]
    got = values(spark, codes, "code int, body boolean", probe.discovery_of_code(F.col("code"), F.col("body")))
    assert got == ["valid", "empty", "unknown", *["access_controlled"] * 4, "empty", "rate_limited", "unknown", "source_unavailable", "unknown"]
    names = [("timeout",), ("tls_error",), ("redirect_limit",), ("redirect_outside_allowlist",), ("else",), (None,)]
    assert values(spark, names, "t string", probe.discovery_of_transport(F.col("t"))) == ["timeout", "tls_error", "source_unavailable", "redirect_outside_allowlist", "unknown", "unknown"]
    found = [("access_controlled", True), ("empty", True), ("valid", False), ("candidate", True), ("tls_error", True), ("rate_limited", True), ("unknown", True)]
    rows = spark.createDataFrame(found, "f string, b boolean").select(probe.access_of_discovery(F.col("f")), probe.extraction_of_discovery(F.col("f"), F.col("b"))).collect()
    assert list(map(tuple, rows)) == [("access_control_required", "partial"), ("not_found", "empty"), ("public", "empty"), ("public", "complete"), ("source_unavailable", "failed"), ("partial", "partial"), ("partial", "complete")]


def test_errors(spark):
    rows = [("ConnectionError", "x | ProxyError(y)"), ("E", "Unable to connect to proxy"), ("E", "some proxy"), ("SSLError", "handshake"), ("E", "ssl: bad certificate"), ("E", "SSL certificado"), ("E", "certificate"), ("RateLimitDetectedError", None), ("QueryRejectedError", "q"), ("TimeoutError", ""), (None, None)]
    kind, chain = F.col("kind"), F.col("chain")
    got = spark.createDataFrame(rows, "kind string, chain string").select(quality.classify_error(kind, chain), quality.validation_of_error(kind, chain), quality.health(F.lit(0), kind)).collect()
    assert [r[0] for r in got] == ["NetworkConfigurationError", "NetworkConfigurationError", "E", "SSLError", "SslVerificationError", "SslVerificationError", "E", "RateLimitDetectedError", "QueryRejectedError", "TimeoutError", None]
    assert [r[1] for r in got][:10] == ["network_configuration", "network_configuration", "error", "error", "tls_verification_failed", "tls_verification_failed", "error", "rate_limited", "query_rejected", "timeout"]
    assert [r[2] for r in got][7:] == ["rate_limited", "error", "timeout", "empty"]
    assert values(spark, [(3,)], "n int", quality.health(F.col("n"), F.lit(None).cast("string"))) == ["healthy"]


def test_route_reasons(spark):
    rows = [("a", "court_jurisprudence", False, []), ("b", "case_lookup", True, ["text"]), ("c", "court_jurisprudence", True, ["text"]), ("d", "judicial_communications", True, []), ("e", "court_catalog", True, []), ("f", "court_jurisprudence", True, ["number"]), ("g", "jurisprudence", True, [])]
    caps = spark.createDataFrame(rows, "source string, category string, unified boolean, supported_filters array<string>")
    got = {r["source"]: (r["skip_reason"], r["warnings"]) for r in federate.route_sources(caps, ["number"], ["text", "courts"], ["court_jurisprudence", "jurisprudence"]).collect()}
    assert got == {"a": ("unified_search_not_supported", ""), "b": ("outside_jurisprudence_scope", ""), "c": ("identifier_filter_not_supported", ""), "d": ("not_jurisprudence_source", ""), "e": ("category_not_applicable", ""), "f": (None, "courts,text"), "g": (None, "courts")}


@pytest.mark.parametrize(("flags", "level", "words", "risk"), [
    ((True, True, False, False, False, False, False, False), 2, None, "alto"), ((False, False, True, True, False, False, False, False), 3, "login", "medio"), ((False, False, False, False, True, False, False, False), 4, "Controle de Acesso", "alto"),
    ((False, False, False, False, False, False, True, True), 4, "limite", "medio"), ((True,) * 8, 4, "CAPTCHA", "alto"), ((True, False, True, False, False, False, True, False), 1, "", "alto"),
])
def test_contract_levels_and_risks(spark, flags, level, words, risk):
    found = quality.contract_level(*map(F.lit, flags), F.lit("case_lookup"))
    row = spark.range(1).select(found.alias("level"), quality.contract_risk(F.lit(words).cast("string"), found).alias("risk")).first()
    assert tuple(row) == (level, risk)


def test_validation_reports(spark):
    pages = [(s, s, 1, 10, 5, "e") for s in "abcdefgh"] + [("i", "x", 2, 1, -1, None), ("j", "j", 1, None, 5, "e")]
    results = [("a", "1", "a", "s", None, None, None, "e"), ("b", " ", "b", "s", None, None, None, "e"), ("c", "1", "z", "s", None, None, None, "e"), ("d", "1", "d", " ", None, "", None, "e"), ("e", "1", "e", "", "t", None, None, "e"), ("f", "1", "f", None, None, "q", None, None), ("g", "1", "g", None, None, None, "full", "e")]
    report = quality.validation_report(
        spark.createDataFrame(pages, "source string, page_source string, page int, page_size int, total int, endpoint string"),
        spark.createDataFrame(results, "source string, id string, result_source string, summary string, thesis string, question string, full_text string, endpoint string"), 10,
        spark.createDataFrame([("k", "AccessControlRequiredError", "login"), ("a", "E", "x")], "source string, kind string, chain string"),
    )
    got = {r["source"]: (r["failed_checks"], r["status"]) for r in report.collect()}
    assert got == {
        "a": ("", "valid"), "b": ("result_ids", "contract_invalid"), "c": ("result_sources", "contract_invalid"), "d": ("result_content", "contract_invalid"), "e": ("", "valid"), "f": ("result_traces", "contract_invalid"), "g": ("", "valid"), "h": ("", "empty"),
        "i": ("page_source,page_trace,page_number,page_size,reported_total_nonnegative", "contract_invalid"), "j": ("normalized_response", "contract_invalid"), "k": ("", "blocked"),
    }


def test_source_status_precedence(spark):
    routing = [(s, "searched") for s in "abcdefg"] + [("h", "skipped"), ("i", "failed"), ("j", "skipped"), ("k", "odd")]
    complete = [("b", 0, 0, None), ("c", 0, 0, False), ("d", 0, 0, True), ("e", 0, 7, True), ("f", 3, 3, True), ("j", 0, 0, True)]
    errors = [("a", "SSLError: x"), ("j", "boom"), ("f", "bad TLS")]
    got = federate.source_status(
        spark.createDataFrame(routing, "source string, action string"), spark.createDataFrame(complete, "source string, returned int, reported_total int, is_complete boolean"),
        spark.createDataFrame(errors, "source string, error string"), spark.createDataFrame([("g", 4), ("z", 2)], "source string, n long"),
    )
    assert {r["source"]: (r["status"], r["count"]) for r in got.collect()} == {
        "a": ("ssl_error", 0), "b": ("unknown", 0), "c": ("partial", 0), "d": ("empty", 0), "e": ("ok", 0), "f": ("ssl_error", 3), "g": ("ok", 4), "h": ("skipped", 0), "i": ("failed", 0), "j": ("failed", 0), "k": ("unknown", 0), "z": ("ok", 2),
    }


def test_full_text_status(spark):
    rows = [("a", "t", None), ("a", "u", None), ("b", "t", None), ("b", "", "url"), ("c", "t", None), ("c", None, ""), ("d", None, None)]
    got = quality.full_text_status(spark.createDataFrame(rows, "g string, t string, u string"), "g", "t", "u")
    assert dict(map(tuple, got.collect())) == {"a": "returned", "b": "document_available", "c": "not_returned", "d": "not_returned"}


def test_redaction(spark):
    row = spark.range(1).select(
        quality.redact_map(F.create_map(*(F.lit(x) for x in ("Api-Key", "a", "pass", "b", "senha", "c", "SESSION_id", "d", "long", "é" * 5000, "nil")), F.lit(None).cast("string"))).alias("m"),
        quality.redact_headers(F.create_map(F.lit("Cookie"), F.lit("a"), F.lit("x"), F.lit("y" * 5000))).alias("h"), quality.redact_bytes(F.lit(b"ab")).alias("b"),
    ).first()
    assert row["m"] == {"Api-Key": "<redacted>", "pass": "b", "senha": "c", "SESSION_id": "<redacted>", "long": "é" * 4096 + "…<truncated>", "nil": None}
    assert row["h"] == {"Cookie": "<redacted>", "x": "y" * 5000} and row["b"] == "<redacted-bytes>"
    payloads = [('{"a":[{"Token":{"b":1},"c":"x"}],"l":"' + "z" * 4097 + '"}',), ("plain",), ("p" * 513,), ("p" * 512,), (None,), ('"token"',)]
    got = values(spark, payloads, "p string", quality.redact_payload("p"))
    assert json.loads(got[0]) == {"a": [{"Token": "<redacted>", "c": "x"}], "l": "z" * 4096 + "…<truncated>"}
    assert got[1:] == ["plain", "<redacted-text>", "p" * 512, None, '"token"']


def test_text_by_type(spark):
    rows = [("<p>a <b>b</b><script>x</script></p>", "text/html"), ("<p></p>", "application/xhtml+xml"), (' {"a": 1}\n', "application/json"), (" x ", "text/csv"), ("  ", "text/plain"), ("%PDF", "application/pdf"), ("[]", "application/ld+json"), ("", "application/pdf"), (None, "text/html"), ("x", None)]
    df = spark.createDataFrame(rows, "c string, k string").select(documents.extract_text(F.col("c").cast("binary"), F.col("k")).alias("d"))
    got = [(r["d"]["text"], r["d"]["status"], r["d"]["transformation"]) for r in df.collect()]
    assert got == [
        ("a b", "complete", "html_text_extracted"), (None, "empty", "html_text_extracted"), ('{"a": 1}', "complete", "json_text_preserved"), ("x", "complete", "text_decoded_utf8"), (None, "empty", "text_decoded_utf8"), (None, "unsupported_format", None),
        ("[]", "complete", "json_text_preserved"), (None, "empty", None), (None, "empty", None), (None, "unsupported_format", None),
    ]


def test_depth_of_fetching(spark):
    rows = [("a", 1, 10, None, None), ("a", 2, 10, None, None), ("a", 3, 10, None, None), ("b", 1, 3, True, None), ("b", 2, 3, None, None), ("c", 1, 0, None, 9), ("c", 2, 5, None, 9), ("d", 1, 4, None, 7), ("d", 2, 3, None, 7), ("d", 3, 1, None, 7), ("e", 1, 5, None, -1), ("e", 2, 5, None, -1)]
    got = federate.fetch_depth(spark.createDataFrame(rows, "source string, page int, n int, is_complete boolean, total int"), 2, 10)
    assert sorted((r["source"], r["page"], r["records"]) for r in got.collect()) == [("a", 1, 10), ("a", 2, 20), ("b", 1, 3), ("c", 1, 0), ("d", 1, 4), ("d", 2, 7), ("e", 1, 5), ("e", 2, 10)]


def test_sources_asked_for_by_name(spark):
    caps = spark.createDataFrame([("a", "case_lookup", True, []), ("b", "jurisprudence", True, ["text"])], "source string, category string, unified boolean, supported_filters array<string>")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("new",)], "source string")
    got = {r["source"]: tuple(r)[1:] for r in federate.route_requested(asked, caps, [], ["text", "types"], ["jurisprudence"]).collect()}
    assert got == {"a": ("outside_jurisprudence_scope", False, "", True), "b": (None, True, "types", True), "new": (None, True, "", False)}


def test_bounds_lists_and_payload(spark):
    got = spark.createDataFrame([(0,), (5,), (10,), (25,)], "n long").select(federate.window_bounds(F.col("n"), 2, 10).alias("w")).collect()
    assert [tuple(r["w"]) for r in got] == [(0, 0, 0), (0, 0, 5), (0, 0, 10), (11, 20, 25)]
    rows = spark.createDataFrame([("b", 5, "baixo"), ("a", 5, "medio"), ("c", 4, "medio"), ("e", 3, "baixo"), ("d", 5, "alto")], "source string, level int, risk string")
    assert tuple(quality.contract_lists(rows).first()) == (5, ["d", "e"], ["a", "b"])
    assert quality.contract_lists(rows.limit(0)).first()["total_sources"] == 0
    payload = SearchQuery.of(text="x", types=("A",), page=2, updated_from="2020-01-01").precedent_filter()
    assert payload["buscaGeral"] == "x" and payload["tipos"] == ["A"] and payload["pagina"] == 2 and payload["atualizacaoDesde"] == "2020-01-01" and payload["cancelados"] is False and len(payload) == 14


def test_signals_are_sought_in_few_passes(spark):
    parts = ["", "x", "captcha", "g-recaptcha", "turnstile", "cloudflare", "Faça login", "antirrobô", "verificação automatica", "sessão expirada", "acesso negado", "Request blocked", "digite os números", "just a moment", "não sou um robô", "robô", "antirrobot", 'tokendesafio "imagem"', "ementa", "açãoementa", "inteiro teor", "0001234-56.2020.8.26.0100"]
    df = spark.createDataFrame([(a, b) for a in parts for b in parts], "raw string, seen string")
    raw, seen = F.col("raw"), F.col("seen")
    wrong = df.filter((probe.any_access_signal(raw, seen) != probe.any_signal(probe.access_signals(raw, seen))) | (probe.any_legal_signal(seen) != probe.any_signal(probe.legal_signals(seen))))
    assert wrong.count() == 0
    passes = df.filter(probe.any_legal_signal(seen))._jdf.queryExecution().optimizedPlan().toString().upper().count("RLIKE")
    assert passes == 1
