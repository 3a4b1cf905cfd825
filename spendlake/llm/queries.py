"""Contract queries of the operators, with production parameters over whole tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import (bpe, centroids, decontaminate, fingerprints, html_blocks, line_dedup, minmax_dedup, ngram_join, pii, pitman_yor, quality,
                           token_counts, zone_search)
from spendlake.llm.common import apply_steps, held_out, small_batches, table, text_or_empty

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE, EOD = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 50256  # 50256 is free in this vocabulary
QUALITY_FOLDS, QUALITY_THRESHOLD = 5, 0.3


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op8_bpe_encoding_decoding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_FILE)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts.document_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), RANK_FILE, EOD)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Trees:
    """Fitted on labelled rows outside the held-out fold."""
    small_batches(spark)
    return quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels"), ~held_out(QUALITY_FOLDS)))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, docs, sf_dir)
    return (quality.score(docs, model, drop=("text",))
            .select("doc_id", held_out(QUALITY_FOLDS).alias("held_out"), "score",
                    F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted")))


LINE_MIN_DOCS, LINE_MIN_CHARS = 10, 1


@query("op5_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN l END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent(table(spark, sf_dir, "documents").select("doc_id", "text"), LINE_MIN_DOCS, LINE_MIN_CHARS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return (html_blocks.extract(pages, html_blocks.fit(pages), drop=("html",))
            .withColumn("n_chars", F.length("text").cast("long")))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    found = pii.detect(docs, pii.train(docs))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rank = fingerprints.rarity_rank(fingerprints.rarity(docs))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = (fingerprints.with_next(docs, "doc_id", "text", "following", parts)
             .withColumn("edited", fingerprints.edited(F.col("text"), F.col("following")))
             .withColumn("n_chars", F.length("text").cast("long"))
             .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)))
    steps = [fingerprints.digest_step({"text": "fingerprint", "edited": "edited_fingerprint", "following": "_next"}, rank),
             fingerprints.likeness_step({"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "_next")})]
    return apply_steps(pairs, steps, drop=("text", "edited", "following", "_next"))


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


LM_FOLDS = 10


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores, model = pitman_yor.score_texts(docs, docs.filter(~held_out(LM_FOLDS)))
    return scores.select("doc_id", held_out(LM_FOLDS).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.join_all(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return zone_search.mine(table(spark, sf_dir, "embeddings"), label)


CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIMS, CLUSTER_SCALE = 16, 3, 64, 64


def clustering_sql(k: int = CLUSTERS, rounds: int = CLUSTER_ROUNDS, dims: int = CLUSTER_DIMS, scale: int = CLUSTER_SCALE) -> str:
    """Lloyd's rounds in SQL, one pair of tables a round."""
    sql = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k})"""]
    for t in range(rounds + 1):
        sql.append(f"""d{t} AS MATERIALIZED (
  SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM kept CROSS JOIN c{t}),
a{t} AS MATERIALIZED (
  SELECT vec_id, v, min_by(cluster, distance * {k} + cluster) AS cluster, min(distance) AS distance FROM d{t} GROUP BY vec_id, v)""")
        if t < rounds:
            sql.append(f"""s{t} AS MATERIALIZED (
  SELECT cluster, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS m FROM (
    SELECT cluster, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS i FROM a{t}) GROUP BY cluster, i)
  GROUP BY cluster),
c{t + 1} AS MATERIALIZED (SELECT c{t}.cluster, coalesce(m, c) AS c FROM c{t} LEFT JOIN s{t} ON s{t}.cluster = c{t}.cluster)""")
    return ",\n".join(sql) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


@query("op13_centroid_clustering", clustering_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIMS, CLUSTER_SCALE)


@query("op12_minhash_near_dedup", r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM sets LEFT JOIN least ON a = doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minmax_dedup.dedup(table(spark, sf_dir, "documents"))
