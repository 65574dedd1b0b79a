"""Queries and SQL of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbalest.llm import byte_bpe, decontamination, language_id, lexical, licenses, lm_score, mixing, negatives, sharding, simhash, substring_dedup, topk, url_filter
from arbalest.llm.common import documents, id_remainder


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.search(vectors, F.col("id") % 100 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", id_remainder(3) == 1)
    languages = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), languages).drop("text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 16)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), with_text=False).drop("kept_text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.leaks(documents(spark, sf_dir), items).drop("th")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_exact_topk, op2_language_id, op3_mix_sources, op4_license_scan, op5_shard, op6_url_filter, op7_substring_dedup, op8_decontaminate, op9_lm_score, op10_simhash, op11_ranked_search, op12_byte_bpe, op13_hard_negatives)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op3_mix_sources": OP3_SQL, "op4_license_scan": op4_sql(), "op5_shard": OP5_SQL, "op6_url_filter": op6_sql(), "op7_substring_dedup": OP7_SQL, "op11_ranked_search": OP11_SQL, "op13_hard_negatives": OP13_SQL}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CASE rank % 2 WHEN 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank) AS k FROM w),
p AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_size,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight,
             sum(source_size) OVER ()::DOUBLE AS total FROM o),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * full_size) / open_weight AS rate FROM p),
f AS (SELECT rate FROM l WHERE NOT rate * weight > 2.0::DOUBLE * source_size ORDER BY k LIMIT 1),
t AS (SELECT w.*, least(coalesce((SELECT rate FROM f), 0) * weight, 2.0::DOUBLE * source_size) AS target FROM w),
c AS (SELECT d.*, t.source_size, t.target, t.tilt,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, floor(target)::BIGINT AS whole, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM c),
k AS (SELECT *, (passes * size + greatest(0, least(whole - passes * source_size - ahead, size)))::BIGINT AS taken FROM n)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN abs(round((sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (ahead / target)) - (1 - tilt)) / (2 * tilt), 9)) END AS first_position
FROM k
"""

#: crc32 byte by byte with a table from its rule; the jump hash as a recursion on 128-bit integers.
OP5_SQL = r"""
WITH RECURSIVE table_bits AS (
  SELECT n, n AS c, 0 AS step FROM (SELECT unnest(range(256)) AS n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM table_bits WHERE step < 8),
crc_table AS (SELECT list(c::BIGINT ORDER BY n) AS t FROM table_bits WHERE step = 8),
d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
texts AS (SELECT DISTINCT text, h FROM d),
crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM texts, crc_table),
keys AS (SELECT DISTINCT coalesce(doc_id, 0) AS k FROM documents),
jump AS (
  SELECT n, k, k::HUGEINT AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM keys, (SELECT unnest([16, 17]) AS n)
  UNION ALL
  SELECT n, k, s, j, floor((j + 1) * (2147483648.0::DOUBLE / ((s >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT n, k, j, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM jump WHERE j < n)),
last AS (SELECT n, k, max(b) AS shard FROM jump WHERE j >= n GROUP BY n, k),
a AS (
  SELECT d.doc_id, octet_length(encode(d.text))::BIGINT + 1 AS size, text_crc32, x.shard::INT AS shard, y.shard::INT AS grown_shard,
         substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || text_crc32::VARCHAR), 1, 3) AS bucket
  FROM d JOIN crcs USING (text) JOIN last x ON x.n = 16 AND x.k = coalesce(doc_id, 0) JOIN last y ON y.n = 17 AND y.k = coalesce(doc_id, 0))
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM a
"""


OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i + 1:i + 35], ' ')) AS h FROM (SELECT r, ws, unnest(range(0, len(ws) - 34)) AS i FROM w)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM win JOIN dup USING (h), (SELECT unnest(range(35)) AS k)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT r, doc_id, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
i AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM i GROUP BY item_id, term),
w AS (SELECT r, unnest(ws) AS term FROM d),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM w SEMI JOIN q USING (term) GROUP BY r, term),
v AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, g GROUP BY term, nn),
s AS (
  SELECT item_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN v USING (term) JOIN f USING (term) JOIN n USING (r), g GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS a, v.vec_id AS b, q.label = v.label AS same, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
"""


def op6_sql() -> str:
    listed = ", ".join(f"'{x}'" for x in url_filter.LISTED)
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN EXISTS (SELECT 1 FROM (SELECT unnest([{listed}]) AS x) WHERE host = x OR suffix(host, '.' || x)) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op4_sql() -> str:
    rows = ", ".join(f"({i}, '{label}', '{key}', '{text}')" for i, (label, key, text) in enumerate(licenses.TEMPLATES))
    base = ", ".join(f"('{text}', '{label}')" for text, label in licenses.BASE)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT string_split(phrase, ' ') AS ps, label FROM (VALUES {base}) v(phrase, label)),
t AS (SELECT id, label, string_split(phrase, ' ') AS ks, string_split(text, ' ') AS ts FROM (VALUES {rows}) v(id, label, phrase, text)),
post AS (SELECT id, unnest(ts) AS word, unnest(range(len(ts))) AS q, len(ts) AS size FROM t),
keys AS (SELECT id, k, k + unnest(range(len(ks))) AS q, len(ks) AS length FROM (SELECT id, ks, ts, unnest(range(len(ts) - len(ks) + 1)) AS k FROM t) WHERE ts[k + 1:k + len(ks)] = ks),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM d),
lw AS (SELECT w.* FROM w SEMI JOIN (SELECT word FROM post UNION SELECT unnest(ps) FROM b) v USING (word)),
idf AS (SELECT v.word, count(DISTINCT r) AS n, ln((SELECT count(*) + 1 FROM d)::DOUBLE / (count(DISTINCT r) + 1)) AS idf
        FROM (SELECT word FROM post UNION SELECT unnest(ps) FROM b) v LEFT JOIN lw USING (word) GROUP BY v.word),
rare AS (SELECT r, word FROM (SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY n, word) AS k FROM (SELECT DISTINCT r, word FROM lw) JOIN idf USING (word)) WHERE k <= {licenses.RARE}),
al AS (SELECT r, id, place - q AS o FROM lw JOIN rare USING (r, word) JOIN post USING (word) GROUP BY r, id, place - q HAVING count(DISTINCT word) >= {licenses.VOTES}),
hit AS (SELECT al.*, post.q, idf, size FROM al JOIN post USING (id) JOIN idf USING (word) JOIN lw ON lw.r = al.r AND lw.word = post.word AND lw.place = al.o + post.q),
total AS (SELECT id, sum(idf) AS total FROM post JOIN idf USING (word) GROUP BY id),
share AS (SELECT r, id, o, CASE WHEN count(*) = any_value(size) THEN 1.0::DOUBLE ELSE round(coalesce(sum(idf) / nullif(any_value(total), 0), 0), 6) END AS share FROM hit JOIN total USING (id) GROUP BY r, id, o),
whole AS (SELECT DISTINCT r, id, o FROM (SELECT r, id, o, k FROM hit JOIN keys USING (id, q) GROUP BY r, id, o, k HAVING count(*) = any_value(length))),
tl AS (SELECT r, label FROM share JOIN whole USING (r, id, o) JOIN t USING (id) WHERE share >= {licenses.SHARE}),
bp AS (SELECT r, label, i FROM (SELECT r, ws, ps, label, unnest(range(len(ws) - len(ps) + 1)) AS i FROM d, b WHERE list_contains(ws, ps[1])) WHERE ws[i + 1:i + len(ps)] = ps),
bg AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM bp GROUP BY r),
lg AS (SELECT r, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT r, label FROM tl UNION SELECT r, label FROM bp) GROUP BY r),
sg AS (SELECT r, max(share) AS score FROM share GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM d LEFT JOIN bg USING (r) LEFT JOIN lg USING (r) LEFT JOIN sg USING (r)
"""
