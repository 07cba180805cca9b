"""Building blocks that keep ordering work spread over the cluster.

A plain ``Window.partitionBy(k)`` puts every row of one key in one task, and a
window without partitioning puts everything in one task.  The helpers here sort
with a range shuffle instead, so that a key holding a third of the rows still
spreads, and carry only one small row per partition across the borders.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POS_BITS = 33  # monotonically_increasing_id keeps the position in the low 33 bits


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder the session names; only a local session may invent one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-sort, then note each row's partition (``_pid``) and place in it (``_pos``).

    The result is checkpointed because row positions must not change when a
    task is rerun or when the frame is read twice.
    """
    at = F.monotonically_increasing_id()
    laid_out = df.orderBy(*order).withColumn("_at", at)
    return settle(
        laid_out.select(
            *df.columns,
            F.shiftright("_at", _POS_BITS).alias("_pid"),
            F.col("_at").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_pos"),
        )
    )


def ranked(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    rank: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """Exact 1-based rank (over everything, or inside each non-null ``group``).

    ``order`` must be a full order; add a key as the last term.  ``size`` names
    a column for the number of rows in the group (grouped ranks only).
    """
    if size and not group:
        raise ValueError("size needs a group")
    placed = _placed(df, [F.col(g).asc() for g in group] + list(order))
    # one row per sort partition: safe to order in a single task and to broadcast
    counts = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    starts = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_start")
    )
    out = placed.join(F.broadcast(starts), "_pid").withColumn("_at", F.col("_start") + F.col("_pos"))
    keep = list(df.columns)
    if group:
        heads = out.groupBy(*group).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
        out = out.join(heads, list(group))
        out = out.withColumn(rank, F.col("_at") - F.col("_first") + 1)
        if size:
            out = out.withColumnRenamed("_size", size)
    else:
        out = out.withColumn(rank, F.col("_at") + 1)
    return out.select(*keep, rank, *([size] if size else []))


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    cols: Sequence[str],
    into: str = "prev",
) -> DataFrame:
    """``lag`` by one row within ``keys``, for keys of any size.

    Adds ``into``, a struct of ``cols`` taken from the preceding row, or null
    for the first row of each key.
    """
    placed = _placed(df, [F.col(k).asc_nulls_first() for k in keys] + list(order))
    row = F.struct(*[F.col(c).alias(f"k_{c}") for c in keys], F.struct(*cols).alias("body"))
    within = Window.partitionBy("_pid").orderBy("_pos")
    tails = placed.groupBy("_pid").agg(F.max_by(row, "_pos").alias("_tail"))
    carry = tails.select("_pid", F.lag("_tail").over(Window.orderBy("_pid")).alias("_carry"))
    out = (
        placed.withColumn("_before", F.lag(row).over(within))
        .join(F.broadcast(carry), "_pid", "left")
        .withColumn("_before", F.coalesce("_before", "_carry"))
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_before.k_{k}").eqNullSafe(F.col(k))
    return out.withColumn(into, F.when(same, F.col("_before.body"))).select(*df.columns, into)
