"""The operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm.bpe_transducer import decode_ids, encode_texts
from recordlake.llm.debruijn import remove_repeats
from recordlake.llm.decontaminate import find_matches, hit_words
from recordlake.llm.hamerly import encode as encode_vectors
from recordlake.llm.jaccard_groups import jaccard_components
from recordlake.llm.mixing import mix
from recordlake.llm.periodic_runs import find_runs
from recordlake.llm.scratch import bound_batches, fresh_path
from recordlake.llm.secret_scan import corpus_words, scan
from recordlake.llm.shuffle_shards import write_shuffled
from recordlake.llm.stable_knn import search
from recordlake.llm.toxicity import fit, score
from recordlake.llm.url_filter import filter_urls
from recordlake.llm.wavelet import document_digests, write_token_shards
from recordlake.shipping import ship

#: A document of at least this score is toxic.
TOXIC_SCORE = 0.7
#: Most frequent words of the corpus that guess costs know.
DICTIONARY = 10_000
#: (verdict, host/path) of the URL rules.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest",
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan(documents, ["doc_id"], dictionary=corpus_words(documents, DICTIONARY))


def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links", "class_id")


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    return document_digests(write_token_shards(table(spark, sf_dir, "documents"), path, tokenizer_path()))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_shuffled(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"), 40)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return written.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def op9_stable_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = score(documents, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op11_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    listed = "" if books is None else ",".join(map(str, books.entries.ravel().tolist()))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.sha2(F.lit(listed), 256).alias("codebooks_sha256"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    counted = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "ids")
    decoded = decode_ids(counted, ranks, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def tails_repeated(documents: DataFrame) -> DataFrame:
    """doc_id and text; in documents whose crc32(doc_id) ends in 0 the words from a place on repeat a first part of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = documents.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    rebuilt = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p AS INT)])), ' ')")
    return cut.select("doc_id", F.when(F.col("n") > 0, rebuilt).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(tails_repeated(table(spark, sf_dir, "documents")), ["doc_id"])
    # of exact fractions length / period the greater one, then the earlier, then the shorter period
    order = "x.length * y.period > y.length * x.period or (x.length * y.period = y.length * x.period and struct(x.start, x.period) < struct(y.start, y.period))"
    best = F.expr(f"aggregate(runs, runs[0], (y, x) -> if({order}, x, y))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return digests.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_source_mix": op2_source_mix,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_groups": op4_jaccard_groups,
    "op5_debruijn_dedup": op5_debruijn_dedup,
    "op6_token_shards": op6_token_shards,
    "op7_url_filter": op7_url_filter,
    "op8_shuffle_shards": op8_shuffle_shards,
    "op9_stable_knn": op9_stable_knn,
    "op10_toxicity": op10_toxicity,
    "op11_hamerly_codes": op11_hamerly_codes,
    "op12_bpe_transducer": op12_bpe_transducer,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS, _ALNUM_WORDS = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lloyd_sql(rounds: int = 6, entries: int = 16, parts: int = 8, scale: int = 4096) -> str:
    """Plain Lloyd rounds with full scans: a chain of tables a round."""
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT p, e - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM parts) WHERE e <= {entries})"]
    nearest = f"""SELECT vec_id, label, a.p, a.x, min(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + e) AS m FROM parts a JOIN b{{0}} b ON a.p = b.p GROUP BY vec_id, label, a.p, a.x"""
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        steps.append(f"""s{i} AS MATERIALIZED (SELECT p, e, list(q ORDER BY j) AS x FROM (SELECT p, e, j, CAST((s - ((s % c) + c) % c) // c AS BIGINT) AS q FROM
  (SELECT p, m % {entries} AS e, j, sum(x[j]) AS s, count(*) AS c FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY p, e, j)) GROUP BY p, e)""")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.x, b.x) AS x FROM b{i} b LEFT JOIN s{i} s ON b.p = s.p AND b.e = s.e)")
    steps.append(f"final AS MATERIALIZED ({nearest.format(rounds)})")
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM final GROUP BY vec_id, label)")
    steps.append("listed AS (SELECT sha256(coalesce(string_agg(array_to_string(x, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM b" + str(rounds) + ")")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, listed"


ORACLES: dict[str, str] = {
    "op11_hamerly_codes": _lloyd_sql(),
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS w FROM benchmark),
starts AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT item, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM starts),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows)),
parts AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM places),
hits AS (SELECT p.doc_id, p.i, p.k, o.item, o.i AS j FROM parts p JOIN windows o ON p.s = o.s AND p.k = o.k),
runs AS (SELECT doc_id, k, i - row_number() OVER (PARTITION BY doc_id, item, k, j - i ORDER BY i) AS island, item, j - i AS diagonal FROM hits),
longest AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) + k - 1 AS n FROM runs GROUP BY doc_id, item, k, diagonal, island) GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
""",
    "op13_periodic_runs": f"""
WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
crc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE_WORDS}) AS w, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS h FROM documents, steps),
places AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM crc),
shift AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
d AS MATERIALIZED (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w FROM shift),
windows AS MATERIALIZED (SELECT doc_id, n, i - 1 AS i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(1, n - 6)) AS i FROM d)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
long AS (SELECT doc_id, q, min(i) AS s, count(*) + 7 + q AS l FROM islands GROUP BY doc_id, q, island HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM long GROUP BY doc_id, s, l),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) AS r FROM runs) WHERE r = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q + 1, s + l + 1)) AS p FROM runs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op4_jaccard_groups": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACE_WORDS}) AS w FROM documents),
starts AS (SELECT doc_id, w, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y, c = p.n AND c = q.n AS equal FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
walk(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT a, y FROM walk JOIN links ON b = x),
components AS (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a),
degrees AS (SELECT x AS doc_id, count(*) AS n_links, min(CASE WHEN equal THEN y END) AS twin FROM links GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id
FROM d JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN degrees USING (doc_id)
""",
    "op5_debruijn_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE_WORDS}) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op7_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts LEFT JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
""",
}
