"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The matrix says how many rows of each input partition go to each shard.  Its rows are drawn one after the other from
the multivariate hypergeometric law of what the shards still lack, so every assignment of rows to shards of the given
sizes is equally likely and the sizes come out exactly.  Each partition permutes its rows and deals them out by its
matrix row; after the exchange the rows of each shard are permuted again by a distributed sort on random keys, and a
row's slot is its place in that order.  All draws depend on the seed, the partition and the position alone, so a task
that runs again deals the same cards.

The matrix has one row per input partition and one column per shard.  A shard is never gathered into one task.

Law ``rows``: shard sizes differ by one row at most.  Rows are not grouped (equal texts may part).  Defined cases: null
text has size 8; null or repeated ids and repeated rows are rows like any other; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dragline.llm.shared import POSITION_BITS, part_of, stored, unused
from dragline.scale import settle

N_SHARDS = 24
SEED = 20240607
_EXACT_BELOW = 10**9  # the library's hypergeometric sampler takes no larger urns


def shard_sizes(rows: int, n_shards: int) -> np.ndarray:
    return np.array([rows // n_shards + (s < rows % n_shards) for s in range(n_shards)], dtype=np.int64)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if good + bad < _EXACT_BELOW:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    total = good + bad  # urns beyond that: normal law with the same mean and variance, kept within the possible range
    mean = draws * good / total
    var = mean * (bad / total) * ((total - draws) / (total - 1))
    return int(np.clip(round(rng.normal(mean, max(var, 0) ** 0.5)), max(0, draws - bad), min(good, draws)))


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row p: how many of partition p's rows go to each shard.  Rows add up to ``counts``, columns to ``sizes``."""
    rng, lacks = np.random.default_rng(seed), [int(s) for s in sizes]
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest = sum(lacks)
        for s, lack in enumerate(lacks):
            rest -= lack
            take = _hypergeometric(rng, lack, rest, n) if rest else n
            matrix[p, s] = take
            lacks[s] -= take
            n -= take
    return matrix


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-spread 64-bit value for each number (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).view(np.int64)


def assign_shards(numbered: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """(at, shard, slot) for rows numbered by ``monotonically_increasing_id`` in a column ``at``."""
    counted = sorted((r[0], r[1]) for r in numbered.groupBy(part_of("at").alias("p")).count().collect())
    counts = [n for _, n in counted]
    matrix = communication_matrix(counts, shard_sizes(sum(counts), n_shards), seed)
    # only what one partition needs reaches its rows: bounded by the number of input partitions times the shards
    bounds = numbered.sparkSession.sparkContext.broadcast({p: np.cumsum(matrix[i]) for i, (p, _) in enumerate(counted)})

    def deal(batches):
        orders: dict[int, np.ndarray] = {}
        for pdf in batches:
            at = pdf["at"].to_numpy(np.int64)
            part, place = at >> POSITION_BITS, at & ((1 << POSITION_BITS) - 1)
            shard = np.empty(len(at), np.int32)
            for p in np.unique(part):
                ends = bounds.value[int(p)]
                if p not in orders:
                    orders[p] = np.random.default_rng([seed, int(p)]).permutation(int(ends[-1])).astype(np.int64)
                here = part == p
                shard[here] = np.searchsorted(ends, orders[p][place[here]], side="right")
            yield pdf.assign(shard=shard, key=_mixed(at, seed))

    dealt = numbered.select("at").mapInPandas(deal, "at long, shard int, key long")
    placed = settle(dealt.orderBy("shard", "key", "at").select("at", "shard", F.monotonically_increasing_id().alias("to")))
    heads = placed.groupBy(part_of("to").alias("q"), "shard").agg(F.count("*").alias("n"), F.min("to").alias("head"))
    before = Window.partitionBy("shard").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.select("q", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("head")).alias("shift"))
    # one row per sort partition and shard in it
    return placed.withColumn("q", part_of("to")).join(F.broadcast(starts), ["q", "shard"]).select(
        "at", "shard", (F.col("to") + F.col("shift")).alias("slot"))


def sharded(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with all columns, a shard and a slot (new names where the columns exist already)."""
    at, shard, slot = (unused(docs, c) for c in ("at", "shard", "slot"))
    rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "sharding")
    placed = assign_shards(rows.select(F.col(at).alias("at")), n_shards, seed).toDF(at, shard, slot)
    # equal rows compress to a small file, which must not be taken for a small table
    return rows.join(placed.hint("merge"), at).select(*docs.columns, shard, slot)


def shard_table(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS) -> DataFrame:
    """One row per document: size, checksum of the text, shard and slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(
        F.col(key).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("at")))
    return rows.join(assign_shards(rows.select("at"), n_shards), "at").select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
