"""Stage ledger, verdicts and caveats of a run, read off the joined facts instead of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragline import assumptions as A

STAGES = ("resolve", "structure", "costs", "rollup", "fees")


def notes(rows: DataFrame) -> DataFrame:
    """Data notes per fund, as rows.

    ``rows`` has has_census, has_holdings, structure, unresolved and missing_children.
    """
    n = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    all_notes = F.array_compact(F.array(
        n(~F.col("has_census"), "census filing not found"),
        n(~F.col("has_holdings"), "holdings filing not found"),
        n(F.col("structure") == "fund_of_funds", "fund of funds"),
        n(F.col("structure") == "cash_sweep", "cash sweep vehicles"),
        n(F.col("unresolved") > 0, "underlying funds not resolved"),
        n(F.col("missing_children") > 0, "underlying funds without cost data"),
    ))
    return rows.select("ticker", "period", F.explode(all_notes).alias("note"))


def caveat_counts(note_rows: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Notes per root, counted over the whole tree when ``members`` (root, member, period, paths) is given."""
    if members is None:
        return note_rows.groupBy("ticker", "period").agg(F.count("*").alias("caveats"))
    per_fund = note_rows.groupBy(F.col("ticker").alias("member"), "period").agg(F.count("*").alias("_n"))
    return (
        members.join(per_fund, ["member", "period"]).groupBy(F.col("root").alias("ticker"), "period")
        .agg(F.sum(F.col("_n") * F.col("paths")).alias("caveats"))
    )


def tree_caveat_counts(per_fund: DataFrame, edge: DataFrame, max_depth: int = A.MAX_DEPTH) -> DataFrame:
    """Notes over the whole tree of each parent in ``edge`` (parent, period, child, positions), every path counted.

    ``per_fund`` has (ticker, period, caveats).  A tree's count depends on the fund and the levels left below it only, so
    each level is a join of the edges with the counts below; members are never laid out.  Trees without a note have no row.
    """
    below = per_fund
    for _ in range(max_depth - 1):
        child = below.select(F.col("ticker").alias("child"), "period", "caveats")
        held = edge.join(child, ["child", "period"]).groupBy(F.col("parent").alias("ticker"), "period").agg(
            F.sum(F.col("positions") * F.col("caveats")).alias("caveats"))
        below = per_fund.unionByName(held).groupBy("ticker", "period").agg(F.sum("caveats").alias("caveats"))
    return below.join(edge.select(F.col("parent").alias("ticker"), "period").distinct(), ["ticker", "period"], "left_semi")


def stage_ledger(runs: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """One row per input (``keys``) and stage: ok, degraded, failed or skipped.

    ``runs`` has ticker, resolved, structured, priced, rolled (booleans), fees_found,
    children, child_fee_misses, caveats.  The first stage without a result fails
    and the rest are skipped; notes degrade the costs stage; missing fee tables
    degrade the fees stage.
    """
    checks = {"resolve": "resolved", "structure": "structured", "costs": "priced", "rollup": "rolled"}
    rows, before = [], F.lit(True)
    for stage, flag in checks.items():
        ok = F.coalesce(F.col(flag), F.lit(False))
        good = F.when(F.col("caveats") > 0, "degraded").otherwise("ok") if stage == "costs" else F.lit("ok")
        rows.append((stage, F.when(~before, "skipped").when(~ok, "failed").otherwise(good)))
        before = before & ok
    complete = before
    # notes only degrade the costs stage of a run that completed
    rows = [(s, F.when((c == "degraded") & ~complete, "ok").otherwise(c)) for s, c in rows]
    fees = F.when(~F.coalesce(F.col("fees_found"), F.lit(False)), "degraded").when(
        (F.col("children") > 0) & (F.col("child_fee_misses") > 0), "degraded").otherwise("ok")
    rows.append(("fees", F.when(complete, fees)))
    status = F.filter(
        F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), c.alias("status")) for i, (s, c) in enumerate(rows)]),
        lambda r: r["status"].isNotNull(),
    )
    return runs.select(*keys, "caveats", F.inline(status))


def verdicts(ledger: DataFrame) -> DataFrame:
    """complete, complete_with_caveats or excluded, with the stage that failed."""
    failed = F.min_by("stage", F.when(F.col("status") == "failed", F.col("position")))
    return ledger.groupBy("ticker").agg(failed.alias("failed_stage"), F.max("caveats").alias("caveats")).select(
        "ticker",
        F.when(F.col("failed_stage").isNotNull(), "excluded").when(F.col("caveats") > 0, "complete_with_caveats")
        .otherwise("complete").alias("verdict"),
        "failed_stage",
    )


def manifest(run_verdicts: DataFrame) -> DataFrame:
    """Outcome counts of a run.  The tickers themselves stay a table keyed by outcome (any number of them)."""
    return run_verdicts.groupBy("verdict").agg(F.count("*").alias("tickers"))


def source_health(ingest: DataFrame) -> DataFrame:
    """A source is degraded as soon as one read was retried or failed."""
    return ingest.groupBy("source").agg(F.sum("retries").alias("retries"), F.sum("errors").alias("errors")).withColumn(
        "status", F.when((F.col("retries") > 0) | (F.col("errors") > 0), "degraded").otherwise("ok")
    )
