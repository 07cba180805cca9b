"""Incremental jobs: the lookup board, the event harvest, arriving snapshots and fee filings.

State lives in Spark's state store or in bucketed tables next to the
checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dragline import assumptions as A
from dragline.operators.history import change_array, fund_events
from dragline.operators.ranking import board_row
from dragline.scale import previous_row, settle


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


class Buckets:
    """A table kept by hash buckets of a key, of which a batch rewrites only those it touches.

    Merging must give the same rows when a batch comes twice; then a replayed batch has no further effect.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, n: int = 16):
        self.spark, self.path, self.key, self.n = spark, path, key, n

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def merge(self, new: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")
        new = settle(new)
        touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most n numbers
        old = None
        if _exists(self.spark, self.path):
            old = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket")
        merged = settle(combine(old, new).withColumn("bucket", bucket))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


LOOKUP = ("hidden_low_bps", "hidden_high_bps", "expense_ratio_bps", "turnover_pct", "dollar_low", "dollar_high", "ts")


def board_table(spark: SparkSession, root: str) -> Buckets:
    """Per fund: the values of its latest lookup, the number of lookups, and the last batch that changed the row."""
    return Buckets(spark, f"{root}/board", "ticker")


def stored_board(spark: SparkSession, root: str) -> DataFrame:
    return board_row(board_table(spark, root).read())


def start_board(lookups: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep the board as a table, for lookups that come in any order, however late, and more than once.

    Every event id seen is kept in an index, a folder for each batch, and counts in the batch that brought it first.  A
    fund's row knows the last batch it has taken in.  A batch that is replayed finds the same new ids and changes no row
    twice, so nothing is lost or counted again, and no watermark drops a row.
    """
    spark = lookups.sparkSession
    store, index = board_table(spark, root), f"{root}/seen"
    order = F.struct("ts", "event_id")

    def take_in(batch: int) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
        def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                return new
            before = old.select("ticker", *[F.col(c).alias(f"o_{c}") for c in ("lookup_count", "b", "at", "batch")])
            both = before.join(new, "ticker", "full_outer")
            kept = F.col("o_batch").isNotNull() & (F.col("batch").isNull() | (F.col("o_batch") >= batch))
            later = F.col("o_at").isNotNull() & (F.col("at").isNull() | (F.col("o_at") > F.col("at")))
            return both.select(
                "ticker",
                F.when(kept, F.col("o_lookup_count")).otherwise(F.coalesce("o_lookup_count", F.lit(0)) + F.col("lookup_count")).alias("lookup_count"),
                F.when(kept | later, F.col("o_b")).otherwise(F.col("b")).alias("b"),
                F.when(kept | later, F.col("o_at")).otherwise(F.col("at")).alias("at"),
                F.when(kept, F.col("o_batch")).otherwise(F.col("batch")).alias("batch"))
        return combine

    def step(rows: DataFrame, batch: int) -> None:
        ok = rows.filter(F.col("hidden_low_bps").isNotNull() & F.col("hidden_high_bps").isNotNull())
        fresh = ok.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["event_id"])
        if _exists(spark, index):
            seen = spark.read.parquet(index).filter(F.col("batch") < batch)
            fresh = fresh.join(seen.select("event_id"), "event_id", "left_anti")
        fresh = settle(fresh.select("ticker", "event_id", *LOOKUP))
        fresh.select("event_id", F.lit(batch).alias("batch")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(index)
        delta = fresh.groupBy("ticker").agg(
            F.count("*").alias("lookup_count"), F.max_by(F.struct(*LOOKUP), order).alias("b"), F.max(order).alias("at"))
        store.merge(delta.withColumn("batch", F.lit(batch).cast("long")), take_in(batch))

    return lookups.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_harvest(filings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append merger and deregistration events; files already read are not read again."""
    return (
        fund_events(filings).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def snapshot_table(spark: SparkSession, root: str) -> Buckets:
    """The first document of every fund and quarter."""
    return Buckets(spark, root, "ticker")


def start_snapshots(documents: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Store each fund once per quarter: of all documents that have come, the one filed first (``filed``).

    A document that comes late replaces the stored one if it was filed earlier, and is kept if its quarter has none.
    """
    store = snapshot_table(documents.sparkSession, root)
    rest = [c for c in documents.columns if c not in ("ticker", "quarter")]
    # ties by content, so that the order of arrival does not matter
    order = F.struct("filed", F.xxhash64(*sorted(rest)))

    def first(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new if old is None else old.unionByName(new)
        return rows.groupBy("ticker", "quarter").agg(F.min_by(F.struct(*rest), order).alias("d")).select("ticker", "quarter", "d.*")

    def step(rows: DataFrame, batch: int) -> None:
        store.merge(rows, first)

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fee_table(spark: SparkSession, root: str, key: str = "class_id") -> Buckets:
    """All snapshots seen so far, each with its changes against its predecessor in filing order."""
    return Buckets(spark, root, key)


def stored_changes(spark: SparkSession, root: str, key: str = "class_id") -> DataFrame:
    rows = fee_table(spark, root, key).read()
    return rows.select(
        key, "accession_no", "old_filing_date", F.col("filing_date").alias("new_filing_date"), F.inline("changes"))


def start_fee_changes(snapshots: DataFrame, root: str, checkpoint: str, key: str = "class_id") -> StreamingQuery:
    """Compare every fee snapshot with its predecessor, in whatever order they arrive.

    A snapshot that arrives late changes its successor's comparison too, so the classes of a batch are compared anew
    over all their snapshots.  A snapshot that comes twice counts once.
    """
    store = fee_table(snapshots.sparkSession, root, key)
    fields = ["filing_date", "accession_no", *A.TRACKED_FEES]

    def compare(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new if old is None else old.select(key, *fields).unionByName(new)
        lagged = previous_row(
            rows.dropDuplicates([key, "accession_no"]), [key], [F.col("filing_date").asc(), F.col("accession_no").asc()],
            ["filing_date", *A.TRACKED_FEES])
        return lagged.select(key, *fields, F.col("prev.filing_date").alias("old_filing_date"), change_array().alias("changes"))

    def step(batch_df: DataFrame, batch: int) -> None:
        store.merge(batch_df.select(key, *fields), compare)

    return (
        snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
