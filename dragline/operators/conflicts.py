"""Brokerage conflicts, soft dollars, credit lines and derivative use from the census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline.functions.expr import CALCULATED, NOT_DISCLOSED, UNAVAILABLE, dbl, ratio, rnd
from dragline.operators.holdings import KEYS


def soft_dollar_share(ncen: DataFrame) -> DataFrame:
    """Soft dollars in per cent of commissions; a fund-period without a census stays, as UNAVAILABLE."""
    share = F.when(F.col("commissions") > 0, F.col("soft_dollar_usd") / F.col("commissions") * 100)
    tag = F.when(~F.col("has_census"), UNAVAILABLE).when(share.isNotNull(), CALCULATED).otherwise(NOT_DISCLOSED)
    return ncen.select(*KEYS, rnd(share, 4).alias("soft_dollar_share_pct"), tag.alias("tag"))


def affiliated_concentration(broker: DataFrame) -> DataFrame:
    """Dollars and percent of commissions that went to affiliated brokers."""
    exact = F.col("gross_commission").cast("decimal(28,6)")
    sums = broker.groupBy(*KEYS).agg(
        F.count(F.when(F.col("is_affiliated"), 1)).alias("affiliated_brokers"),
        F.coalesce(dbl(F.sum(F.when(F.col("is_affiliated"), exact))), F.lit(0.0)).alias("_a"),
        dbl(F.sum(exact)).alias("_all"),
    )
    pct = F.when(F.col("affiliated_brokers") == 0, 0.0).when(F.col("_all") > 0, F.col("_a") / F.col("_all") * 100)
    return sums.select(*KEYS, "affiliated_brokers", rnd("_a").alias("affiliated_usd"), rnd(pct, 4).alias("affiliated_pct"))


def top_brokers(broker: DataFrame, n: int = 10) -> DataFrame:
    """All affiliated brokers, and the first ``n`` others in filing order."""
    w = Window.partitionBy(*KEYS).orderBy("position", "broker_name")
    cols = [*KEYS, "broker_name", "is_affiliated", rnd("gross_commission").alias("gross_commission")]
    others = (
        broker.filter(~F.col("is_affiliated")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
        .select(*cols)
    )
    return others.unionByName(broker.filter("is_affiliated").select(*cols))


def soft_dollar_subsidy(lines: DataFrame, nav: DataFrame, years: int = 3) -> DataFrame:
    """Mean of the latest years per fund line, added up per filer, in dollars and basis points.

    ``lines`` is (filer, line, year, amount); ``nav`` is (filer, net_assets).
    """
    w = Window.partitionBy("filer", "line").orderBy(F.col("year").desc())
    recent = lines.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= years)
    per_line = recent.groupBy("filer", "line").agg(
        (dbl(F.sum("amount")) / F.count("*")).alias("mean"), F.count("*").alias("n"), F.max("year").alias("latest")
    )
    total = per_line.groupBy("filer").agg(
        dbl(F.sum(F.col("mean").cast("decimal(28,8)"))).alias("_usd"),
        F.max("latest").alias("latest_year"), F.max("n").alias("years_used"),
    )
    return total.join(nav, "filer", "left").select(
        "filer", rnd("_usd").alias("subsidy_usd"),
        F.when(F.col("net_assets") > 0, rnd(F.col("_usd") / F.col("net_assets") * 10_000, 4)).alias("subsidy_bps"),
        "latest_year", "years_used",
    )


def credit_utilisation(credit: DataFrame) -> DataFrame:
    """Share of the facility drawn at its peak, and the number of other borrowers."""
    return credit.withColumn("utilisation", rnd(
        F.when(F.col("facility_size") > 0, F.col("max_outstanding") / F.col("facility_size")), 6)
    )


def derivative_use(typed: DataFrame, flagged: DataFrame, key: str = "series_id") -> DataFrame:
    """Typed records added up by type, plus flagged types that no record names."""
    sums = typed.groupBy(key, "derivative_type").agg(
        F.sum(F.abs("notional")).alias("notional"), F.count("*").alias("records")
    )
    extra = flagged.join(sums.select(key, "derivative_type"), [key, "derivative_type"], "left_anti").select(
        key, "derivative_type", F.abs("notional").cast(sums.schema["notional"].dataType).alias("notional"),
        F.lit(1).cast("bigint").alias("records"),
    )
    return sums.unionByName(extra)


def derivative_totals(use: DataFrame, key: str = "series_id") -> DataFrame:
    """Distinct types (rows are already one per type) and the notional, null when none was reported."""
    return use.groupBy(key).agg(F.count("*").alias("distinct_types"), dbl(F.sum("notional")).alias("notional"))


def census_flags(c: DataFrame) -> DataFrame:
    """The six census conflict conditions as an array of codes with its size; null and UNAVAILABLE without a census."""
    on = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    lending = F.col("is_lending")
    flags = F.array_compact(F.array(
        on(F.col("has_soft_dollar"), "soft_dollar"),
        on(F.col("affiliated_brokers") > 0, "affiliated_broker"),
        on(F.col("is_admin_affiliated"), "affiliated_administrator"),
        on(F.col("is_transfer_agent_affiliated"), "affiliated_transfer_agent"),
        on(lending & F.col("is_lending_agent_affiliated"), "affiliated_lending_agent"),
        on(lending & (F.col("lending_net_income") > 0), "securities_lending_income"),
    ))
    here = F.col("has_census")
    return c.select(*KEYS, F.when(here, F.concat_ws("|", flags)).alias("conflict_flags"), F.when(here, F.size(flags)).alias("conflict_count"),
                    F.when(here, CALCULATED).otherwise(UNAVAILABLE).alias("tag"))


def statement_flags(pm: Column, soft: Column, subsidy_bps: Column) -> Column:
    """The six conflict conditions read from statements of additional information, as codes."""
    on = lambda cond, code: F.when(F.coalesce(cond, F.lit(False)), F.lit(code))
    return F.array_compact(F.array(
        on(pm["not_linked_to_performance"], "pay_not_linked_to_performance"),
        on(pm["linked_to_assets"] & ~pm["linked_to_performance"], "pay_linked_to_assets"),
        on(pm.isNotNull() & ~pm["has_equity"], "no_equity_ownership"),
        on(soft["has_soft_dollar"], "soft_dollar"),
        on(soft["uses_commission_sharing"], "commission_sharing"),
        on(subsidy_bps > 1.0, "soft_dollar_subsidy"),
    ))


def provider_concentration(services: DataFrame) -> DataFrame:
    """Share of funds per provider within each service type, and the concentration index.

    A measure proposed in the literature on the census form; ``services`` is (kind, provider, series_id).
    """
    counts = services.groupBy("kind", "provider").agg(F.count("*").alias("funds"))
    totals = counts.groupBy("kind").agg(
        F.sum("funds").alias("_all"), F.sum((F.col("funds") * F.col("funds")).cast("decimal(38,0)")).alias("_sq")
    )
    return counts.join(totals, "kind").select(
        "kind", "provider", "funds", rnd(ratio(100.0 * dbl("funds"), dbl("_all")), 4).alias("share_pct"),
        rnd(dbl("_sq") / dbl("_all") / dbl("_all") * 10_000, 2).alias("hhi"),
    )
