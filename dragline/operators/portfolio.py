"""Portfolio-level cost of ownership for any number of portfolios at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions.expr import dbl, hidden_grade, ratio, rnd


def collapse(positions: DataFrame) -> DataFrame:
    """One row per portfolio and upper-cased ticker; blank tickers leave.

    The first given name is kept: by ``position`` if the input has line numbers, else the smallest.
    """
    key = F.upper(F.trim("ticker"))
    named = F.min("name")
    if "position" in positions.columns:
        named = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("position")))
    return (
        positions.withColumn("ticker", key).filter(F.col("ticker") != "")
        .groupBy("portfolio", "ticker")
        .agg(F.sum("weight").alias("weight"), named.alias("name"))
    )


def validation(collapsed: DataFrame) -> DataFrame:
    """Verdict per portfolio: accepted, accepted after scaling, or the reason of the rejection."""
    off = F.abs(dbl("total_weight") - 100.0)
    return (
        collapsed.groupBy("portfolio")
        .agg(F.sum("weight").alias("total_weight"), F.min("weight").alias("_least"), F.count("*").alias("positions"))
        .withColumn(
            "status",
            F.when(F.col("_least") <= 0, "rejected_non_positive")
            .when(off > A.WEIGHT_TOLERANCE_PCT, "rejected_total")
            .when(off > 0.01, "normalised").otherwise("accepted"),
        )
        .drop("_least")
    )


def priced(collapsed: DataFrame, verdict: DataFrame, cost: DataFrame) -> DataFrame:
    """Accepted positions, scaled to 100 %, with their costs and data quality.

    ``cost`` has (ticker, er_bps, brokerage_bps, underlying_bps, total_bps).
    """
    ok = verdict.filter(F.col("status").isin("accepted", "normalised")).select("portfolio", "total_weight")
    total = F.col("total_bps")
    return (
        collapsed.join(ok, "portfolio").join(cost, "ticker", "left")
        .select(
            "portfolio", "ticker", "name", "er_bps", "brokerage_bps", "underlying_bps", "total_bps",
            (dbl("weight") * 100.0 / dbl("total_weight")).alias("weight_pct"),
        )
        .withColumn(
            "quality",
            F.when(total.isNull(), "UNAVAILABLE").when(F.col("er_bps").isNotNull(), "REPORTED")
            .when(F.col("underlying_bps").isNotNull() | F.col("brokerage_bps").isNotNull(), "PARTIAL")
            .otherwise("CALCULATED"),
        )
        .withColumn("contribution_bps", F.col("weight_pct") / 100.0 * total)
    )


def summary(lines: DataFrame) -> DataFrame:
    """Weighted means over the priced part; a missing expense ratio counts as zero in its mean."""
    share = F.col("weight_pct") / 100.0
    exact = lambda c: c.cast("decimal(28,12)")
    on = F.col("total_bps").isNotNull()
    sums = lines.groupBy("portfolio").agg(
        F.count("*").alias("positions"),
        dbl(F.sum(exact(share * F.col("total_bps")))).alias("_tco"),
        dbl(F.sum(F.when(on, exact(share * F.coalesce("er_bps", F.lit(0.0)))))).alias("_er"),
        F.coalesce(dbl(F.sum(F.when(on, exact(share)))), F.lit(0.0)).alias("priced_fraction"),
    )
    mean = lambda c: F.coalesce(ratio(F.col(c), F.col("priced_fraction")), F.lit(0.0))
    return sums.select(
        "portfolio", "positions", mean("_tco").alias("true_tco_bps"), mean("_er").alias("stated_er_bps"),
        (mean("_tco") - mean("_er")).alias("hidden_gap_bps"), "priced_fraction",
        F.greatest(1.0 - F.col("priced_fraction"), F.lit(0.0)).alias("unpriced_fraction"),
    )


def projection(totals: DataFrame, balance: float = A.STARTING_BALANCE, gross: float = A.GROSS_RETURN,
               horizons: tuple[int, ...] = A.HORIZONS) -> DataFrame:
    """Wealth after each horizon at the true and at the stated cost."""
    per_year = lambda bps: 1 + gross - bps / 10_000.0
    years = F.col("horizon_years")
    wealth = lambda bps: F.lit(balance) * F.pow(per_year(F.col(bps)), years.cast("double"))
    rows = totals.select("portfolio", "true_tco_bps", "stated_er_bps",
                         F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_years"))
    out = rows.withColumn("_t", wealth("true_tco_bps")).withColumn("_s", wealth("stated_er_bps"))
    return out.select(
        "portfolio", "horizon_years", rnd("_t").alias("wealth_true"), rnd("_s").alias("wealth_stated"),
        rnd(F.col("_s") - F.col("_t")).alias("drag_dollars"),
        rnd(F.when(F.col("_s") > 0, (F.col("_s") - F.col("_t")) / F.col("_s")).otherwise(0.0), 6).alias("drag_fraction"),
    )


def compare(groups: DataFrame, cost: DataFrame, investment: float = 100_000.0, years: int = 20,
            return_pct: float = 7.0) -> DataFrame:
    """Side-by-side view: ranges, grade and dollar cost per fund, best and worst of each group.

    ``groups`` is (group, ticker); a comparison is meant for a handful of funds
    but the job takes groups of any size, since best and worst are aggregates.
    """
    or0 = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    hidden = lambda s: or0("brokerage_bps") + or0(f"spread_{s}_bps") + or0(f"impact_{s}_bps")
    lines = groups.join(cost, "ticker").select(
        "group", "ticker", "er_bps", rnd(hidden("low"), 4).alias("hidden_low_bps"),
        rnd(hidden("high"), 4).alias("hidden_high_bps"),
    )
    lines = lines.withColumn("true_low_bps", F.col("er_bps") + F.col("hidden_low_bps")).withColumn(
        "true_high_bps", F.col("er_bps") + F.col("hidden_high_bps")
    )
    gross = return_pct / 100
    free = investment * (1 + gross) ** years
    lost = free - F.lit(investment) * F.pow(1 + gross - F.col("true_high_bps") / 10_000.0, F.lit(float(years)))
    lines = lines.withColumn("grade", hidden_grade((F.col("hidden_low_bps") + F.col("hidden_high_bps")) / 2)).withColumn(
        "dollar_cost", rnd(lost)
    )
    key = lambda sign: F.struct((sign * F.col("true_high_bps")).alias("v"), F.col("ticker"))
    known = F.col("true_high_bps").isNotNull()
    ends = lines.groupBy("group").agg(
        F.min(F.when(known, key(1))).getField("ticker").alias("best_ticker"),
        F.min(F.when(known, key(-1))).getField("ticker").alias("worst_ticker"),
        rnd(F.max("dollar_cost") - F.min("dollar_cost")).alias("saving"),
    )
    return lines.join(ends, "group")


def valid_ticker(t: Column) -> Column:
    return t.rlike("^[A-Za-z]{1,6}$")
