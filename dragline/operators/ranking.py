"""Ledger order, the worst-cost board and peer comparisons."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions.expr import hidden_grade, rnd
from dragline.scale import ranked, settle

BOARD_SORTS = ("hidden_cost_mid_bps", "true_cost_mid_bps", "lookup_count", "conflict_count", "turnover_pct", "grade")


def ledger(rows: DataFrame) -> DataFrame:
    """Sequence numbers: known reported-hidden first, largest first, then the larger gap."""
    order = [
        F.col("reported_hidden_bps").isNull().asc(),
        F.coalesce("reported_hidden_bps", F.lit(0.0)).desc(),
        F.coalesce("gap_bps", F.lit(0.0)).desc(),
        F.col("ticker").asc(),
        F.col("period").asc(),
    ]
    return ranked(rows, order, rank="no")


def _stored(x: Column, n: int) -> Column:
    """Rounded, with zero stored as missing."""
    return F.when(x != 0, rnd(x, n))


def board(lookups: DataFrame) -> DataFrame:
    """One row per fund: the values of its last lookup and the number of lookups.

    Lookups without a hidden-cost range do not count.  ``max_by`` combines on
    the map side, so a fund that everybody looks up costs nothing extra.
    """
    ok = lookups.filter(F.col("hidden_low_bps").isNotNull() & F.col("hidden_high_bps").isNotNull())
    # one number in the order of (time, event), so that the aggregation can hash
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") * F.expr("10000000000000000000BD") + F.col("event_id")
    fields = ("hidden_low_bps", "hidden_high_bps", "expense_ratio_bps", "turnover_pct", "dollar_low", "dollar_high", "ts")
    last = ok.withColumn("_at", at.cast("decimal(38,0)")).groupBy("ticker").agg(
        F.count("*").alias("lookup_count"), *[F.max_by(f, "_at").alias(f"_{f}") for f in fields])
    return board_row(last.select("ticker", "lookup_count", F.struct(*[F.col(f"_{f}").alias(f) for f in fields]).alias("b")))


def board_row(last: DataFrame) -> DataFrame:
    low, high = F.col("b.hidden_low_bps"), F.col("b.hidden_high_bps")
    mid = (low + high) / 2
    return last.select(
        "ticker", "lookup_count",
        rnd(mid).alias("hidden_cost_mid_bps"), rnd(low).alias("hidden_cost_low_bps"), rnd(high).alias("hidden_cost_high_bps"),
        _stored(F.col("b.expense_ratio_bps"), 2).alias("expense_ratio_bps"),
        _stored(F.col("b.expense_ratio_bps") + mid, 2).alias("true_cost_mid_bps"),
        _stored(F.col("b.turnover_pct"), 1).alias("turnover_pct"),
        hidden_grade(mid).alias("grade"),
        F.to_date("b.ts").alias("last_updated"),
        _stored((F.col("b.dollar_low") + F.col("b.dollar_high")) / 2, 2).alias("dollar_impact"),
    )


def board_query(b: DataFrame, sort_by: str = "hidden_cost_mid_bps", limit: int = 25) -> DataFrame:
    """The first rows of the board; a sort field that the board does not know, or does not store, means ``lookup_count``."""
    if sort_by not in BOARD_SORTS or sort_by not in b.columns:
        sort_by = "lookup_count"
    key = F.col(sort_by).desc_nulls_last()  # grades: F is worst and sorts first
    return b.orderBy(key, F.col("ticker")).limit(limit)


def board_stats(b: DataFrame) -> DataFrame:
    mid = F.col("hidden_cost_mid_bps")
    worst = F.max(F.struct(mid.alias("v"), F.col("ticker")))
    some = F.when(mid != 0, mid.cast("decimal(28,4)"))
    return b.agg(
        F.count("*").alias("total_funds"), F.sum("lookup_count").alias("total_lookups"),
        worst["ticker"].alias("worst_ticker"), worst["v"].alias("worst_hidden_bps"),
        rnd(F.sum(some).cast("double") / F.count(some), 1).alias("avg_hidden_bps"),
    )


# -- peers (measures proposed in the literature on the census form) ---------------


def quantiles(rows: DataFrame, group: str, wanted: dict[str, tuple[str, float]], buckets: int = 256) -> DataFrame:
    """Exact interpolated quantiles per group, by histograms that close in on the order statistics.

    ``wanted`` maps a name to (column, q).  A round counts the values of each interval in ``buckets`` parts, combined on
    the map side, and goes on in the part that holds the rank, between the least and the largest value found there.  It
    ends when every interval has one value: no sort, and no more than ``buckets`` rows of a group and rank in a task.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in dict.fromkeys(c for c, _ in wanted.values())]))
    values = settle(rows.select(group, each.alias("x")).select(group, "x.*").filter("v IS NOT NULL"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("col"), F.lit(q).alias("q")) for name, (c, q) in wanted.items()])
    spans = values.groupBy(group, "of").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = 1 + F.col("a.q") * (F.col("n") - 1)
    targets = spans.select("*", F.explode(asked).alias("a")).filter(F.col("a.col") == F.col("of")).select(
        group, "of", "low", "high", F.col("a.name").alias("name"), (at - F.floor(at)).alias("part"),
        F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank")).withColumn("k", F.col("rank"))
    targets = settle(targets)
    while targets.filter("low < high").limit(1).count():
        width = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets
        place = F.when(F.col("low") < F.col("high"), F.least(F.floor(width), F.lit(buckets - 1))).otherwise(0)
        within = values.join(targets, [group, "of"]).filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        counts = within.groupBy(group, "of", "name", "part", "rank", "k", place.alias("place")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(group, "name", "rank").orderBy("place"))
        targets = settle(counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select(
            group, "of", "low", "high", "name", "part", "rank", (F.col("k") - F.col("upto") + F.col("n")).alias("k")))
    ends = targets.groupBy(group, "name").agg(F.min("low").alias("_a"), F.max("low").alias("_b"), F.max("part").alias("_p"))
    value = F.col("_a") + F.col("_p") * (F.col("_b") - F.col("_a"))
    return ends.groupBy(group).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in wanted])


def peer_outliers(measures: DataFrame) -> DataFrame:
    """Soft dollars above the peer median by more than one deviation; affiliated share above the 90th percentile.

    ``measures`` is (series_id, category, soft_dollar_bps, affiliated_pct), one row per fund.
    """
    measures = settle(measures)
    marks = quantiles(measures, "category", {"median_soft": ("soft_dollar_bps", 0.5), "p90_affiliated": ("affiliated_pct", 0.9)})
    sd = measures.groupBy("category").agg(F.stddev_samp("soft_dollar_bps").alias("sd_soft"))
    return (
        measures.join(marks, "category", "left").join(sd, "category", "left")
        .select(
            "series_id", "category", rnd("median_soft", 4).alias("median_soft"), rnd("sd_soft", 4).alias("sd_soft"),
            rnd("p90_affiliated", 4).alias("p90_affiliated"),
            F.coalesce(F.col("soft_dollar_bps") > F.col("median_soft") + F.col("sd_soft"), F.lit(False)).alias("soft_outlier"),
            F.coalesce(F.col("affiliated_pct") > F.col("p90_affiliated"), F.lit(False)).alias("affiliated_outlier"),
        )
    )


def percentiles(scores: DataFrame, dimensions: Iterable[str]) -> DataFrame:
    """Each dimension as its percentile, 0 to 100, among the non-null values of its category; equal values are equal."""
    names = list(dimensions)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("v")) for d in names]))
    rows = scores.select("category", "series_id", each.alias("x")).select("category", "series_id", "x.*").filter("v IS NOT NULL")
    r = ranked(rows, [F.col("v").asc(), F.col("series_id").asc()], group=["category", "dim"], size="n")
    ties = r.groupBy("category", "dim", "v").agg((F.min("rank") - 1).alias("below"))
    share = F.when(F.col("n") > 1, 100.0 * F.col("below") / (F.col("n") - 1)).otherwise(0.0)
    wide = r.join(ties, ["category", "dim", "v"]).groupBy("category", "series_id").agg(
        *[F.max(F.when(F.col("dim") == d, share)).alias(d) for d in names])
    return scores.drop(*names).join(wide, ["category", "series_id"], "left")


def scorecard(scores: DataFrame, dimensions: dict[str, float]) -> DataFrame:
    """Weighted score over the applicable dimensions, graded by position among peers.

    Dimensions are measures where lower is better; each is scaled to its
    percentile in the category first.  A null one is left out and the other
    weights are rescaled.  A: best tenth, then 25, 35, 20 and 10 %.
    """
    scores = percentiles(scores, dimensions)
    num = sum((F.coalesce(F.col(d) * w, F.lit(0.0)) for d, w in dimensions.items()), F.lit(0.0))
    den = sum((F.when(F.col(d).isNotNull(), w).otherwise(0.0) for d, w in dimensions.items()), F.lit(0.0))
    scored = scores.withColumn("score", rnd(num / F.nullif(den, F.lit(0.0)), 4)).filter(F.col("score").isNotNull())
    r = ranked(
        scored.select("category", "series_id", "score"), [F.col("score").asc(), F.col("series_id").asc()],
        group=["category"], size="n",
    )
    at = F.col("rank") / F.col("n")
    return r.withColumn(
        "grade", F.when(at <= 0.10, "A").when(at <= 0.35, "B").when(at <= 0.70, "C").when(at <= 0.90, "D").otherwise("F")
    )
