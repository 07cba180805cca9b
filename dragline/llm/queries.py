"""Registered queries of the corpus operators, one per operator, and the DuckDB text where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dragline.llm import (
    bpe_codec, collocations, decontaminate, exact_dedup, hard_negatives, line_dedup, lm_score, mixing, sharding, simhash, token_count, toxicity, warc)
from dragline.llm.shared import documents


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_table(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


#: Domains of op4: good and plain prose, poor prose, and either kind with abuse; and their shares of the mixture.
DOMAIN_SHARES = (0.85, 0.13, 0.015, 0.005)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", (2 * F.col("toxic") + 1 - F.col("quality")).alias("domain"))
    return mixing.rate_table(documents(spark, sf_dir), labels, DOMAIN_SHARES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_table(documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leak_table(documents(spark, sf_dir), benchmark)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_table(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(documents(spark, sf_dir), least=0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_codec.encode(documents(spark, sf_dir), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return bpe_codec.decode(coded, vocabulary, text="decoded").select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_lm_score, op2_warc, op3_token_count, op4_mixing, op5_toxicity, op6_simhash, op7_decontaminate, op8_exact_dedup,
    op9_sharding, op10_line_dedup, op11_hard_negatives, op12_bpe_codec,
    op13_collocations)}

ORACLE = {
    "op2_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex
          FROM pages),
        g AS (
          SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper,
                 array_to_string(list_transform(range(1, 41), lambda k: right(bin(
                   16 + strpos('0123456789abcdef', substr(hex, k, 1)) - 1), 4)), '') AS bits
          FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
                 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
                 + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
                 + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS intact
        FROM g""",
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS at, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
          SELECT a.at AS a, a.id AS anchor_id, b.at AS b, b.id AS id, a.label = b.label AS same,
                 CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.at <> b.at WHERE a.id % 100 = 0),
        p AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) AS place FROM s WHERE same)
          WHERE place <= 5),
        n AS (
          SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id, s.b) AS rank
          FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 10""",
    "op13_collocations": r"""
        WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
          FROM documents),
        g AS (
          SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: w[i + 1:i + k])) AS g
          FROM p, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
        c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
        cut AS (
          SELECT c.*, i, c.g[1:i] AS x, c.g[i + 1:c.k] AS y FROM c, (VALUES (1), (2), (3)) AS t(i) WHERE i < c.k),
        s AS (
          SELECT cut.lang, cut.k, cut.g, cut.a, i, fx.a AS l, fy.a AS r,
                 CAST(CAST(2000000 AS HUGEINT) * cut.a // (fx.a + fy.a) AS BIGINT) AS score
          FROM cut JOIN f fx ON fx.lang = cut.lang AND fx.g = cut.x JOIN f fy ON fy.lang = cut.lang AND fy.g = cut.y),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
        o AS (
          SELECT lang, c.g[j + 1:j + m] AS g, max(a) AS longest
          FROM c, (VALUES (0), (1), (2)) AS t(j), (VALUES (2), (3)) AS u(m) WHERE m < c.k AND j + m <= c.k GROUP BY ALL),
        d AS (
          SELECT b.*, array_to_string(b.g, ' ') AS phrase
          FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.longest IS NULL OR 100 * o.longest < 80 * b.a),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
        SELECT z.lang, rank, phrase, a, l, r, n, score
        FROM z JOIN (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang) t ON t.lang = z.lang WHERE rank <= 2000""",
}
