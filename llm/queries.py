"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, bpe, chunk_bpe, counts, decontaminate, divergence, quality, sharding, simhash, suffix_array, suffix_tree, token_files, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after the edits that delete repeated lines, from trees that are built once."""
    out = counts.recount(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, counts.repeated_lines)
    return out.select("doc_id", "n_edits", "n_before", "n_tokens", "n_reencoded", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_after"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(_table(spark, sf_dir, "pages"))
    out = warc.resolve(warc.build_index(spark, folder))
    return out.select(F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_key").cast("long").alias("refers_to"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_shards(_table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)
    index = token_files.build_index(manifest)
    found = token_files.lookup(manifest.select("id", "occurrence"), index)
    read = token_files.read_ids(found, token_files.shard_table(manifest), token_files.id_width(TOKENIZER))
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _removed(span: str = "spans") -> str:
    return f"aggregate({span}, 0L, (s, x) -> s + x.stop - x.start)"


def op6_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.repeated_words(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.expr(_removed()).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    out = bpe.decode(ids, RANKS)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array.repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", F.expr(_removed()).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = sharding.assign(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1), keep=("size", "text_crc32", "law"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        F.expr(decontaminate.contaminated_sql()).alias("contaminated"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balls.cluster(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_bpe.encode(_table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    import corpus_pipeline

    own = (op1_quality_rules, op2_token_counts, op3_warc, op4_token_files, op5_simhash, op6_suffix_trees, op7_byte_bpe, op8_suffix_arrays, op9_sharding, op10_decontaminate)
    own += (op11_centroids, op12_divergence, op13_chunk_bpe)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op1_sql() -> str:
    scores = {n: e.replace("try_divide(", "div0(") for n, e, _ in quality.RULES}
    rules, n_rules, n_cuts = [], len(quality.RULES), max(len(c) for _, _, c in quality.RULES)
    for name, _, cuts in quality.RULES:
        num, den = scores[name][len("div0(") : -1].split(", ")
        for c in cuts:
            rules.append(f"SELECT doc_id, lang, '{name}' AS rule, {c!r}::DOUBLE AS cutoff, coalesce({num}::DOUBLE / nullif({den}, 0), 0) > {c!r}::DOUBLE AS rejected FROM m")
    p = quality.RISK / n_rules
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
m0 AS (SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
m AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
r AS ({' UNION ALL '.join(rules)}),
lab AS (SELECT doc_id, min(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
t AS (SELECT lang, rule, cutoff, count(*) FILTER (rejected AND y = 1) AS good_hit, count(*) FILTER (y = 1) AS n_good, count(*) FILTER (rejected AND y <> 1) AS bad_hit, count(*) FILTER (y <> 1) AS n_bad
  FROM r JOIN lab USING (doc_id) JOIN m USING (doc_id, lang) WHERE NOT base_failed GROUP BY ALL),
p AS (SELECT *, CASE WHEN good_hit >= n_good * {p!r} THEN 1 ELSE list_sum(list_transform(range(0, good_hit + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({p!r}) + (n_good - j) * ln(1 - {p!r})))) END AS pv,
  coalesce(bad_hit / nullif(n_bad, 0)::DOUBLE, 0) - coalesce(good_hit / nullif(n_good, 0)::DOUBLE, 0) AS gap, {quality.DELTA!r} / ((SELECT count(DISTINCT lang) FROM t) * {n_rules} * {n_cuts}) AS level FROM t),
best AS (SELECT lang, rule, cutoff FROM p WHERE pv <= level AND gap > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gap DESC, cutoff DESC) = 1),
rej AS (SELECT DISTINCT doc_id FROM r JOIN best USING (lang, rule, cutoff) WHERE rejected)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rej) AS kept FROM m"""


_OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest AND payload_bytes >= 1000"""

_OP6_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i + d) AS g FROM hit, (SELECT unnest(range(0, 13)) AS d) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
pos AS (SELECT doc_id, unnest(g) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN pos USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_OP8_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
e AS (SELECT doc_id, i, i + 50 AS j, lag(i + 50) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit),
run AS (SELECT doc_id, i, j, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM e),
span AS (SELECT doc_id, r, min(i) AS a, max(j) AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS a2, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM span),
agg AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, min(a) AS first,
  string_agg(substr(x, 2 * b + 1, 2 * (coalesce(a2, length(x) // 2) - b)), '' ORDER BY a) AS rest FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN first IS NULL THEN x ELSE substr(x, 1, 2 * first) || rest END)) AS kept_sha256 FROM d LEFT JOIN agg USING (doc_id)"""


_OP10_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_OP10_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_OP10_WORDS} AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS h FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
win AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS h FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, win.n, i FROM win JOIN g ON win.h = g.h AND win.n = g.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    away = "CAST(list_sum(list_transform(range(1, 65), lambda j: (a.v[j] - b.v[j]) * (a.v[j] - b.v[j]))) AS BIGINT)"
    nearest = lambda i: f"SELECT * FROM (SELECT a.r, a.vec_id, a.v, b.c, {away} AS d FROM k a, c{i} b) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1"
    steps = []
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({nearest(i)})",
            f"s{i} AS (SELECT c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j)",
            f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))",
        ]
    good = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {good}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
f AS MATERIALIZED ({nearest(rounds)})
SELECT vec_id, CAST(f.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM f JOIN c{rounds} z ON f.c = z.c"""


_OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT tot.lang, tot.source, kept.term, coalesce(n.n, 0) AS n, 1 + 1000000000 * (coalesce(n.n, 0) + 2) // (total + 2 * v) AS p
  FROM tot JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN n ON n.lang = tot.lang AND n.source = tot.source AND n.term = kept.term),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n)::BIGINT + 2) // (any_value(lt) + 2 * any_value(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total)::BIGINT AS lt FROM tot GROUP BY lang) USING (lang) GROUP BY lang, term),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.lang = a.lang AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
tr AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pr
UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM tr QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB can express the query; the rest is tested against brute force."""
    import corpus_pipeline

    out = {"op1_quality_rules": _op1_sql(), "op3_warc": _OP3_SQL, "op6_suffix_trees": _OP6_SQL, "op8_suffix_arrays": _OP8_SQL, "op10_decontaminate": _OP10_SQL}
    out |= {"op11_centroids": _op11_sql(), "op12_divergence": _OP12_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
