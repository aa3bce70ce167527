"""The engine's tables as projections of the driver's, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlake.shipping import ship

#: view: (table or join, {column: expression}).
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "results": ("documents", {
        "id": "concat('doc-', doc_id)", "source": "source", "court": "upper(lang)", "arrival": "doc_id",
        "type": "CASE doc_id % 5 WHEN 0 THEN 'Acórdão' WHEN 1 THEN 'Decisão Monocrática' WHEN 2 THEN 'Súmula' WHEN 3 THEN ' Despacho ' ELSE 'sentença' END",
        "number": "lpad(CAST(doc_id % 50 AS VARCHAR(20)), 20, '0')", "summary": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END", "full_text": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END",
        "question": "CAST(NULL AS VARCHAR(20))", "thesis": "CASE WHEN doc_id % 11 = 0 THEN text END", "rapporteur": "concat(' R', doc_id % 9, ' ')",
        "judgment_date": "concat(1 + doc_id % 28, '/', 1 + doc_id % 12, '/', 2000 + doc_id % 25)", "publication_date": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat(2001 + doc_id % 24, '-0', 1 + doc_id % 9, '-', 10 + doc_id % 18) END",
        "updated_at": "concat(2001 + doc_id % 24, '-0', 1 + doc_id % 9, '-', 10 + doc_id % 18, 'T10:00:00Z')", "access_status": "CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN ' ' END", "extraction_status": "CASE WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'partial' END",
    }),
    "records": ("orders JOIN customer ON o_custkey = c_custkey", {
        "kind": "CASE o_orderstatus WHEN 'O' THEN 'decision' WHEN 'F' THEN 'precedent' ELSE 'document' END", "id": "concat('r', o_orderkey)", "source": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('src', c_nationkey) END", "court": "c_mktsegment",
        "case_number": "lpad(CAST(o_orderkey % 1000 AS VARCHAR(20)), 20, '0')", "subject": "o_orderpriority", "rapporteur": "c_name", "publication_date": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END",
        "updated_at": "concat(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T0', o_orderkey % 10, ':00:00')", "position": "o_orderkey", "price": "CAST(round(o_totalprice * 100) AS BIGINT)",
    }),
    "links": ("lineitem", {"run_id": "concat('run-', l_suppkey % 7)", "canonical_key": "concat('r', l_orderkey)", "position": "l_orderkey * 10 + l_linenumber", "linenumber": "l_linenumber"}),
    "capabilities": ("supplier JOIN nation ON s_nationkey = n_nationkey", {
        "source": "concat('s', s_suppkey)", "category": "CASE s_nationkey % 6 WHEN 0 THEN 'case_lookup' WHEN 1 THEN 'judicial_communications' WHEN 2 THEN 'court_catalog' ELSE 'court_jurisprudence' END", "unified": "s_suppkey % 5 <> 0",
        "filters": "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'number,text' WHEN 2 THEN 'text,courts' ELSE 'number,text,courts,types' END", "nation": "n_name", "key": "s_suppkey", "balance": "CAST(floor(s_acctbal) AS BIGINT)",
    }),
    "evidence": ("events", {
        "seq": "event_id", "run": "user_id % 20", "status": "event_type", "bytes": "CAST(floor(abs(value)) AS BIGINT)", "source": "concat('s', 1 + user_id % 10)", "props": "props",
        "code": "CASE event_id % 13 WHEN 0 THEN 404 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 302 WHEN 6 THEN 418 WHEN 7 THEN 407 WHEN 8 THEN 451 WHEN 9 THEN 500 ELSE 200 END",
        "kind": "CASE event_id % 12 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'SSLError' WHEN 2 THEN 'ConnectionError' WHEN 3 THEN 'TimeoutError' WHEN 4 THEN 'AccessControlRequiredError' WHEN 5 THEN 'RateLimitDetectedError' WHEN 6 THEN 'ParserContractChangedError' WHEN 7 THEN 'SourceUnavailableError' WHEN 8 THEN 'QueryRejectedError' WHEN 9 THEN 'ConnectionError' END",
        "chain": "CASE event_id % 12 WHEN 0 THEN 'Max retries exceeded | ProxyError(refused)' WHEN 1 THEN 'SSL handshake: bad record' WHEN 2 THEN '[SSL: CERTIFICATE_VERIFY_FAILED] certificate verify failed' WHEN 3 THEN 'read timed out' WHEN 4 THEN 'captcha' WHEN 5 THEN '429' WHEN 6 THEN 'no container' WHEN 7 THEN 'Unable to connect to proxy' WHEN 8 THEN 'bad word' WHEN 9 THEN 'certificado ausente' END",
    }),
    "captures": ("pages", {"url": "url", "body": "html", "page_id": "page_id", "code": "CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 301 ELSE 200 END", "header": "CASE page_id % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN '' END"}),
    "notices": ("documents", {
        "doc_id": "doc_id", "code": "CASE doc_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 302 ELSE 200 END", "content_type": "CASE doc_id % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'application/pdf' ELSE 'text/plain' END",
        "text": "concat(coalesce(text, ''), ' ', CASE doc_id % 27 WHEN 0 THEN 'nº 0001234-56.2020.8.26.0100.' WHEN 1 THEN 'ACÓRDÃO' WHEN 2 THEN 'Ementas' WHEN 3 THEN 'ementa:' WHEN 4 THEN 'Jurisprudência' WHEN 5 THEN 'relatora' WHEN 6 THEN 'relatório' WHEN 7 THEN 'Órgão julgador' WHEN 8 THEN 'sentença' WHEN 9 THEN 'açãoementa' WHEN 10 THEN 'súmula' WHEN 11 THEN 'inteiro teor' WHEN 12 THEN 'captcha' WHEN 13 THEN 'g-recaptcha' WHEN 14 THEN 'Cloudflare' WHEN 15 THEN 'Faça login' WHEN 16 THEN 'antirrobô' WHEN 17 THEN 'sessão expirada' WHEN 18 THEN 'acesso negado' WHEN 19 THEN 'Request blocked' WHEN 20 THEN 'digite os números' WHEN 21 THEN 'Resultados 1 a 10 de 95' WHEN 22 THEN 'próxima' WHEN 23 THEN 'página 3' WHEN 24 THEN 'trocaDePagina' WHEN 25 THEN 'recapitulação' ELSE 'turnstile, just a moment' END)",
        "elapsed_ms": "doc_id * 37 % 4000", "response_complete": "doc_id % 11 <> 0", "content_truncated": "doc_id % 17 = 0", "transport_status": "CASE WHEN doc_id % 19 = 0 THEN 'partial_read_error' ELSE 'complete' END", "expected": "CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'absent from every page' END",
    }),
    "manifest": ("part", {
        "source": "p_brand", "resource_id": "p_partkey", "fingerprint": "concat(p_size, '-', CAST(floor(p_retailprice) AS BIGINT))", "status": "CASE WHEN p_partkey % 3 = 0 THEN 'failed' ELSE 'complete' END", "name": "p_name", "size": "p_size",
    }),
}


def view_sql(name: str, dialect: str = "duckdb") -> str:
    table, columns = VIEWS[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table}"


def with_views(*names: str) -> str:
    """A WITH clause for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    source, columns = VIEWS[name]
    tables = [w for w in source.replace("JOIN", " ").split(" ON ")[0].split() if w]
    df = spark.read.parquet(f"{sf_dir}/{tables[0]}.parquet")
    if len(tables) == 2:
        left, right = source.split(" ON ")[1].split(" = ")
        other = spark.read.parquet(f"{sf_dir}/{tables[1]}.parquet")
        df = df.join(other, df[left] == other[right])
    return df.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
