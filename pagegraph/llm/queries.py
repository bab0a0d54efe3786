"""One query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few, table
from . import bpe_automaton, centroids, decontaminate, exact_dedup, html_density, katz, language_id, merkle, merkle_sql, paragraph_dedup, quality_rules, simhash, token_counts, training_order

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few(paragraph_dedup.removals(docs), docs)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few(decontaminate.report(docs, table(spark, sf_dir, "benchmark")), docs)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_line(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.order_of(table(spark, sf_dir, "documents"), training_order.bpe_ids(spark, BYTE_RANKS, public_tokenizers.PATTERN))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few(simhash.near_duplicates(docs), docs)


def without_line_ends() -> Column:
    """The leaf of a row whose text lost its line ends, for every other row; null for the rest."""
    text = F.replace("text", F.lit("\n"), F.lit(""))
    other = merkle.leaf([text if c == "text" else F.col(c) for c in merkle.FIELDS])
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, other)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.attest(docs, without_line_ends())


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return few(centroids.clusters(vectors), vectors)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few(exact_dedup.groups(docs), docs)


OP6_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM item WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, win.n, item_id FROM spot JOIN win ON spot.t = win.t AND spot.n = win.n
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: The stored pages have one form, an article of a heading and paragraphs: for them SQL can state the text.
OP3_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '<br>', ' ', 'g'), '</?(h1|p)>', chr(1), 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b),
d AS (SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

#: Rounds are one CTE each: distances to all centroids as sums over lists, the least of them with its number, means.
OP12_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v AS c
  FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT 16)
), {rounds}
SELECT vec_id, CAST(n3.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY n3.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM n3 JOIN c3 ON n3.cluster = c3.cluster
"""
_NEAREST = """n{0} AS (
  SELECT vec_id, v, best.d AS distance, best.k AS cluster FROM (
    SELECT vec_id, v, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 'k': cluster}}) AS best
    FROM kept, c{0} GROUP BY vec_id, v)
)"""
_MOVED = """c{1} AS (
  SELECT c{0}.cluster, coalesce(m, c{0}.c) AS c FROM c{0} LEFT JOIN (
    SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m
    FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM n{0}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i) GROUP BY cluster
  ) AS means ON means.cluster = c{0}.cluster
)"""
OP12_SQL = OP12_SQL.format(rounds=", ".join([x for r in range(3) for x in (_NEAREST.format(r), _MOVED.format(r, r + 1))] + [_NEAREST.format(3)]))

OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_scoring, op3_html_extraction, op4_language_id, op5_substring_dedup, op6_benchmark_decontamination, op7_token_counts, op8_training_order, op9_bpe_encoding, op10_simhash, op11_merkle_manifest, op12_centroid_clusters, op13_exact_dedup)}
ORACLE_SQL = {"op3_html_extraction": OP3_SQL, "op6_benchmark_decontamination": OP6_SQL, "op11_merkle_manifest": merkle_sql.sql(), "op12_centroid_clusters": OP12_SQL, "op13_exact_dedup": OP13_SQL}
