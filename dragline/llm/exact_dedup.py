"""Exact duplicates with the frequent texts taken out before the shuffle.

Digests of whole normalised texts are summarised by Misra-Gries counters (``freqItems``, mergeable, at most
``1 / support`` of them), which cannot miss a digest held by more than ``support`` of the rows.  The candidates are
counted exactly; those that hold are the winners, at most ``1 / support`` rows, and are broadcast: their documents are
decided where they lie.  The remaining digests, each of them a small share of the rows, are shuffled by digest.

Defined cases: a null text counts as empty; null ids come last, so a null id stays only where its whole group has none;
of rows that repeat id and text, one stays; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline.llm.shared import stored, unused
from dragline.scale import settle

WHITE_SPACE = r"[\x20\x09-\x0D]+"
SUPPORT = 1 / 512


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " "), 256)


def winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests held by more than ``support`` of the rows, with their first row and exact count; at most 1/support."""
    found = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    rows = digests.count()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    counted = digests.join(F.broadcast(found), "digest").groupBy("digest").agg(
        first.alias("first"), F.count("*").alias("group_size"))
    return settle(counted.filter(F.col("group_size") > support * rows))


def decide(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Add keep_id, group_size and kept to rows of (id, digest, at); ``at`` tells repeated rows apart."""
    frequent = winners(digests, support)
    split = digests.join(
        F.broadcast(frequent.select("digest", F.col("first.id").alias("keep_id"), F.col("first.at").alias("keep_at"),
                                    "group_size")), "digest")
    decided = ["id", "at", "digest", "keep_id", "group_size", "kept"]
    heavy = split.withColumn("kept", F.col("at") == F.col("keep_at")).select(*decided)
    group = Window.partitionBy("digest")
    in_order = group.orderBy(F.col("id").asc_nulls_last(), "at")
    rest = (
        digests.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.first("id").over(in_order))
        .withColumn("kept", F.row_number().over(in_order) == 1)
        .withColumn("group_size", F.count("*").over(group))
        .select(*decided)
    )
    return heavy.unionByName(rest)


def duplicate_table(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: the key, keep_id, group_size, kept, text_sha256."""
    digests = settle(docs.select(
        F.col(key).alias("id"), text_digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("at")))
    return decide(digests, support).select(
        F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    at = unused(docs, "at")
    rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "exact-dedup")
    digests = settle(rows.select(F.col(key).alias("id"), text_digest(F.col(text)).alias("digest"), F.col(at).alias("at")))
    kept = decide(digests, support).filter("kept").select(F.col("at").alias(at))
    return rows.join(kept, at, "left_semi").drop(at)
