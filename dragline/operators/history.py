"""Fee histories, merger notices and the register of fund deaths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions.expr import dbl, quarter_label, rnd
from dragline.scale import previous_row

# fixed values
MERGER_FORMS = ("N-14", "N-14 8C", "N-14AE", "N-14A", "N-14MEF")
CLASS_FORMS = ("485BPOS", "485APOS", "497", "497K", "N-1A", "N-CEN")


def effective_expense_ratio(net: Column, total: Column) -> Column:
    return F.coalesce(net, total)


def synthetic_total(mgmt: Column, b1: Column, other: Column, acquired: Column, facts: bool) -> Column:
    """Total from its parts: all three needed from tables; tagged facts may omit 12b-1 and acquired fees."""
    if facts:
        zero = F.lit(0.0)
        return rnd(mgmt + F.coalesce(b1, zero) + other + F.coalesce(acquired, zero), 4)
    return rnd(mgmt + b1 + other, 2)


def is_zero_fee(mgmt: Column, total: Column, net: Column) -> Column:
    """A total of exactly zero with nothing else set: a mismatched filing, not a free fund."""
    zero = F.lit(0.0)
    return F.coalesce((total == 0.0) & (F.coalesce(mgmt, zero) == 0.0) & (F.coalesce(net, zero) == 0.0), F.lit(False))


def completed(snapshots: DataFrame, facts: bool = True) -> DataFrame:
    """Fill a missing total, drop impossible zero-fee rows and rows without data."""
    c = F.col
    total = F.coalesce(
        c("total_annual_expenses"),
        synthetic_total(c("management_fee"), c("twelve_b1_fee"), c("other_expenses"), c("acquired_fund_fees"), facts),
    )
    out = snapshots.withColumn("total_annual_expenses", total)
    return out.filter(
        (c("management_fee").isNotNull() | c("total_annual_expenses").isNotNull())
        & ~is_zero_fee(c("management_fee"), c("total_annual_expenses"), c("net_expenses"))
    )


def latest_snapshots(snapshots: DataFrame, n: int, keys: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """Newest ``n`` snapshots with data per class."""
    w = Window.partitionBy(*keys).orderBy(F.col("filing_date").desc(), F.col("accession_no").desc())
    return snapshots.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def fee_changes(snapshots: DataFrame, key: str = "class_id") -> DataFrame:
    """Field-level changes between neighbouring snapshots of a class, for classes of any length.

    The neighbour is the previous *snapshot*: a field missing there gives no change.
    """
    fields = list(A.TRACKED_FEES)
    lagged = previous_row(
        snapshots.select(key, "filing_date", "accession_no", *fields), [key],
        [F.col("filing_date").asc(), F.col("accession_no").asc()], ["filing_date", *fields],
    )
    return changes_of(lagged, key)


def change_array() -> Column:
    """Real changes of a row that carries its previous snapshot in ``prev``, one struct for each field."""
    rows = []
    for f, label in A.TRACKED_FEES.items():
        diff = F.col(f) - F.col(f"prev.{f}")
        rows.append(F.when(
            F.abs(diff) > A.FEE_TOLERANCE_PCT,
            F.struct(
                F.lit(f).alias("field_name"), F.lit(label).alias("field_label"),
                F.col(f"prev.{f}").alias("old_value"), F.col(f).alias("new_value"),
                rnd(diff * 100, 1).alias("change_bps"),
                F.when(diff > 0, "increase").otherwise("decrease").alias("direction"),
            ),
        ))
    return F.array_compact(F.array(*rows))


def changes_of(lagged: DataFrame, key: str = "class_id") -> DataFrame:
    """Unpivot rows that carry their previous snapshot in ``prev`` and keep real changes."""
    return lagged.select(
        key, "accession_no", F.col("prev.filing_date").alias("old_filing_date"),
        F.col("filing_date").alias("new_filing_date"), F.inline(change_array()),
    )


def net_change(changes: DataFrame, key: str = "class_id") -> DataFrame:
    return changes.groupBy(key).agg(
        F.count("*").alias("changes"), dbl(F.sum(F.col("change_bps").cast("decimal(18,1)"))).alias("net_change_bps"),
        (F.count("*") > 0).alias("has_changes"),
    )


def merger_list(filings: DataFrame, n: int | None = None) -> DataFrame:
    """Merger filings, or the newest ``n`` of each filer with their rank."""
    if n is None:
        return filings.filter(F.col("form").isin(*MERGER_FORMS))
    w = Window.partitionBy("cik").orderBy(F.col("date_filed").desc(), F.col("filing_path").desc())
    return (
        filings.filter(F.col("form").isin(*MERGER_FORMS)).withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
    )


def label_event(form: Column) -> Column:
    return F.when(form.startswith("N-8F"), "deregistration").when(form.startswith("N-14"), "merger/reorg")


def fund_events(filings: DataFrame) -> DataFrame:
    """Keep deregistrations and mergers and label them."""
    return filings.withColumn("event", label_event(F.col("form"))).filter(F.col("event").isNotNull())


def event_summary(events: DataFrame, bucket: Column) -> DataFrame:
    """Counts by bucket and event (zeros kept) with totals; filers are counted once per bucket too."""
    dereg, merged = F.col("event") == "deregistration", F.col("event") == "merger/reorg"
    return (
        events.groupBy(bucket.alias("bucket"), "cik")
        .agg(F.count(F.when(dereg, 1)).alias("_d"), F.count(F.when(merged, 1)).alias("_m"))
        .rollup("bucket")
        .agg(
            F.sum("_d").alias("deregistrations"), F.sum("_m").alias("mergers"),
            (F.sum("_d") + F.sum("_m")).alias("events"),
            F.count(F.when(F.col("_d") > 0, 1)).alias("filer_buckets_deregistered"),
        )
        .withColumn("bucket", F.coalesce(F.col("bucket").cast("string"), F.lit("ALL")))
    )


def calendar(start_year: int, until: Column, spark_df: DataFrame) -> DataFrame:
    """All quarters from ``start_year`` to the quarter of ``until`` (a column of the one-row frame)."""
    first = F.make_date(F.lit(start_year), F.lit(1), F.lit(1))
    return spark_df.select(
        F.explode(F.sequence(first, F.trunc(until, "quarter"), F.expr("interval 3 months"))).alias("quarter_start")
    ).withColumn("quarter", quarter_label(F.col("quarter_start")))
