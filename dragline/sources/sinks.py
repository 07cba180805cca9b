"""Outputs: resumable snapshots, long component rows, event register, board store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dragline.functions.expr import CALCULATED, ESTIMATED, NOT_DISCLOSED, UNAVAILABLE, rnd
from dragline.operators.history import fund_events
from dragline.operators.holdings import KEYS
from dragline.scale import settle

SNAPSHOT_VERSION = 1


def _range(low: str, high: str, tag: str) -> Column:
    t = F.col(tag)
    return F.when(
        t.isNotNull() & (t != UNAVAILABLE) & F.col(low).isNotNull(),
        F.struct(F.col(low).alias("low_bps"), F.col(high).alias("high_bps"),
                 rnd((F.col(low) + F.col(high)) / 2, 4).alias("mid_bps"), F.lower(t).alias("tag")),
    )


def _value(v: Column, tag: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(v.alias("value"), F.lower(tag).alias("tag")))


def document(cost: DataFrame) -> DataFrame:
    """Nested fund document: identity, components that are available, totals.

    ``cost`` carries the totals of ``costs.with_totals``.
    """
    soft_tag, soft = F.col("soft_dollar_tag"), F.col("soft_dollar_bps")
    soft_doc = F.when(soft_tag.isNotNull(), F.struct(
        ((soft_tag == NOT_DISCLOSED) | F.coalesce(soft > 0, F.lit(False))).alias("active"), soft.alias("value_bps"),
        F.lower(soft_tag).alias("tag"),
    ))
    costs = F.struct(
        _value(F.col("er_bps"), F.lit("reported")).alias("expense_ratio_bps"),
        _value(F.col("brokerage_bps"), F.col("brokerage_tag")).alias("brokerage_commissions_bps"),
        soft_doc.alias("soft_dollar_arrangements"),
        _range("spread_low_bps", "spread_high_bps", "spread_tag").alias("bid_ask_spread_cost"),
        _range("impact_low_bps", "impact_high_bps", "impact_tag").alias("market_impact_cost"),
        rnd("total_reported_bps", 4).alias("total_reported_bps"), rnd("total_low_bps", 4).alias("total_estimated_low_bps"),
        rnd("total_high_bps", 4).alias("total_estimated_high_bps"),
    )
    return cost.select(
        *KEYS, "ticker",
        F.struct(
            "ticker", F.col("fund_name").alias("name"), F.col("family").alias("fund_family"), "series_id",
            rnd("net_assets").alias("net_assets"), F.coalesce("n_holdings", F.lit(0)).alias("holdings_count"), costs.alias("costs"),
        ).alias("analysis"),
    )


def with_children(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Attach the direct children as (ticker, weight) records; the documents themselves stay one row each.

    A nested tree of documents repeats a popular child in every parent and grows
    without bound, so children are referenced and joined when read.
    """
    child = documents.select(F.col("series_id").alias("child"), "period", F.col("ticker").alias("child_ticker"))
    refs = edges.join(child, ["child", "period"]).select(
        F.col("parent").alias("series_id"), "period", "child_ticker", F.round("weight", 8).cast("double").alias("weight")
    )
    return refs


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select(*KEYS, "ticker", F.to_json("analysis").alias("json"))


UNIT = ("ticker", "quarter")
STAGE_LABELS = {"resolve": "Fund identity", "structure": "Holdings", "costs": "Cost model", "rollup": "Roll-up", "fees": "Fees"}


def snapshot_documents(units: DataFrame, ledger: DataFrame, notes: DataFrame, children: DataFrame, analyses: DataFrame, generated: Column) -> DataFrame:
    """(ticker, quarter, document): what a run says about every fund, those that it excludes included.

    ``units`` names the funds of the run; ``ledger`` is (ticker, quarter, position, stage, status), ``notes`` (.., note),
    ``children`` (.., child_ticker, weight), ``analyses`` (.., analysis).  A document refers to its direct children; who
    walks the tree reads one level after the other.  A fund whose run failed has no analysis but a reason.
    """
    unit = list(UNIT)
    stage = F.struct("position", "stage", "status")
    stages = ledger.groupBy(*unit).agg(F.array_sort(F.collect_list(stage)).alias("_stages"))
    noted = notes.groupBy(*unit).agg(F.array_sort(F.collect_list("note")).alias("quality_notes"))
    below = children.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct(F.col("child_ticker").alias("ticker"), "weight"))).alias("children"))
    rows = units.join(stages, unit, "left").join(noted, unit, "left").join(below, unit, "left").join(analyses, unit, "left")
    failed = F.get(F.filter("_stages", lambda x: x["status"] == "failed"), 0)["stage"]
    completed = F.col("_stages").isNotNull() & failed.isNull()
    note_list = F.coalesce("quality_notes", F.array().cast("array<string>"))
    label = F.coalesce(*[F.when(failed == k, F.lit(x)) for k, x in STAGE_LABELS.items()])
    reason = F.when(F.col("_stages").isNull(), "no run").otherwise(F.concat(label, F.lit(": no result")))
    verdict = F.when(~completed, F.concat(F.lit("EXCLUDED: "), reason)).when(F.size(note_list) > 0, "COMPLETE WITH CAVEATS").otherwise("COMPLETE")
    document = F.struct(
        F.lit(SNAPSHOT_VERSION).alias("snapshot_version"), generated.alias("generated"), "quarter", "ticker",
        F.struct(
            "ticker", verdict.alias("verdict"), completed.alias("completed"),
            F.transform(F.coalesce("_stages", F.array().cast("array<struct<position:int,stage:string,status:string>>")),
                        lambda x: F.struct(x["stage"].alias("stage"), x["status"].alias("status"))).alias("stages"),
            note_list.alias("quality_notes"),
        ).alias("provenance"),
        F.when(completed, F.struct("analysis.*", F.coalesce("children", F.array().cast("array<struct<ticker:string,weight:double>>")).alias("children")))
        .alias("analysis"),
        F.when(~completed, reason).alias("excluded_reason"),
    )
    return rows.select(*unit, document.alias("document"))


def _outcome() -> Column:
    verdict = F.col("document.provenance.verdict")
    return F.when(verdict.startswith("EXCLUDED"), "excluded").when(verdict == "COMPLETE", "complete").otherwise("complete_with_caveats")


def write_documents(documents: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Write one JSON document a line below ``root/documents/quarter=..``, then the manifest of the quarters written.

    Funds that stand in a quarter already are skipped unless forced.  The manifest comes last, so a quarter without one
    was not finished, and a run after a failure adds what is missing.  Returns (ticker, quarter, outcome).
    """
    spark = documents.sparkSession
    place = f"{root}/documents"
    outcome = documents.select(*UNIT, _outcome().alias("outcome"), F.to_json("document").alias("value"))
    if not force and _there(spark, place):
        present = _stored_lines(spark, place).select(F.get_json_object("value", "$.ticker").alias("ticker"), "quarter").distinct()
        outcome = outcome.join(present.withColumn("_present", F.lit(True)), list(UNIT), "left").withColumn(
            "outcome", F.when(F.col("_present"), "skipped").otherwise(F.col("outcome"))).drop("_present")
    outcome = settle(outcome)  # must not change once the write has added files
    mode = "overwrite" if force else "append"
    outcome.filter("outcome <> 'skipped'").select("quarter", "value").write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy("quarter").text(place)
    quarters = outcome.select("quarter").distinct()
    write_manifest(_stored_lines(spark, place).join(quarters, "quarter", "left_semi"), root)
    return outcome.drop("value")


def write_manifest(lines: DataFrame, root: str) -> None:
    """One JSON line for each quarter: how many of its documents are complete, with caveats, or excluded."""
    verdict = F.get_json_object("value", "$.provenance.verdict")
    kind = F.when(verdict.startswith("EXCLUDED"), "excluded").when(verdict == "COMPLETE", "complete").otherwise("caveats")
    counts = lines.groupBy("quarter").agg(
        F.count("*").alias("documents"), *[F.count(F.when(kind == k, 1)).alias(k) for k in ("complete", "caveats", "excluded")])
    body = F.to_json(F.struct(F.lit(SNAPSHOT_VERSION).alias("snapshot_version"), "quarter", "documents", "complete", "caveats", "excluded"))
    counts.select("quarter", body.alias("value")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("quarter").text(f"{root}/manifest")


def _there(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)  # noqa: SLF001 - the only way to ask a Hadoop file system from Python
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)  # noqa: SLF001


def _stored_lines(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema("value string, quarter string").text(place)


def read_snapshots(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, bad lines) of the quarters that have a manifest.

    ``schema`` describes a document.  A line that is no JSON document, or has no ticker, goes to the bad lines as it is.
    """
    done = spark.read.schema("value string, quarter string").text(f"{root}/manifest").select("quarter").distinct()
    lines = _stored_lines(spark, f"{root}/documents").join(done, "quarter", "left_semi")
    read = lines.select("quarter", "value", F.from_json(
        "value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    good = F.col("d._corrupt").isNull() & F.col("d.ticker").isNotNull()
    return read.filter(good).select("d.*").drop("_corrupt"), read.filter(~F.coalesce(good, F.lit(False))).select("quarter", "value")


def write_snapshots(docs: DataFrame, root: str, quarter: str, force: bool = False) -> DataFrame:
    """Write one record per fund under its quarter; funds already there are skipped unless forced.

    Returns (ticker, outcome).  The write is one append of the missing funds, so
    a repeated run after a failure adds only what is missing.
    """
    spark = docs.sparkSession
    stamped = docs.withColumn("snapshot_version", F.lit(SNAPSHOT_VERSION)).withColumn("quarter", F.lit(quarter))
    present = None if force else existing_tickers(spark, root, quarter)
    if present is None:
        todo, outcome = stamped, docs.select("ticker", F.lit("written").alias("outcome"))
    else:
        todo = stamped.join(present, "ticker", "left_anti")
        outcome = docs.select("ticker").join(present.withColumn("_p", F.lit(True)), "ticker", "left").select(
            "ticker", F.when(F.col("_p"), "skipped").otherwise("written").alias("outcome")
        )
    # the outcome must not change once the write has added files
    outcome = settle(outcome)
    mode = "overwrite" if force else "append"
    writer = todo.write.mode(mode).partitionBy("quarter")
    if force:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(root)
    return outcome


def existing_tickers(spark: SparkSession, root: str, quarter: str) -> DataFrame | None:
    if not _there(spark, f"{root}/quarter={quarter}"):
        return None
    return spark.read.parquet(f"{root}/quarter={quarter}").select("ticker").distinct()


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fund documents stored as JSON files; manifests and unreadable files are left out."""
    raw = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(
        path, multiLine=True, mode="PERMISSIVE"
    ).withColumn("_file", F.input_file_name())
    return raw.filter(~F.col("_file").endswith("manifest.json") & F.col("_corrupt").isNull()).drop("_corrupt", "_file")


def component_rows(cost: DataFrame, weights: DataFrame) -> DataFrame:
    """Long export: a row per available component, the hidden total and the asset mix."""
    null = F.lit(None).cast("double")

    def row(label: str, category: str, low: Column, high: Column, tag: Column, show: Column) -> Column:
        mid = (low + high) / 2
        return F.when(F.coalesce(show, F.lit(False)), F.struct(
            F.lit(label).alias("component"), F.lit(category).alias("category"), low.alias("low_bps"), high.alias("high_bps"),
            rnd(mid, 4).alias("mid_bps"), rnd(mid / 100, 6).alias("value_pct"), F.lower(tag).alias("source_tag"),
        ))

    c = F.col
    or0 = lambda x: F.coalesce(c(x), F.lit(0.0))
    total = lambda s: rnd(or0("brokerage_bps") + or0(f"spread_{s}_bps") + or0(f"impact_{s}_bps"), 4)
    shown = lambda tag: c(tag).isNotNull() & (c(tag) != UNAVAILABLE)
    rows = F.array_compact(F.array(
        row("Expense Ratio", "stated", c("er_bps"), c("er_bps"), F.lit("reported"), c("er_bps").isNotNull()),
        row("Brokerage Commissions", "hidden", c("brokerage_bps"), c("brokerage_bps"), c("brokerage_tag"), c("brokerage_bps").isNotNull()),
        row("Soft Dollar Arrangements", "hidden", null, null, c("soft_dollar_tag"), c("soft_dollar_tag") == NOT_DISCLOSED),
        row("Soft Dollar Commissions", "hidden", c("soft_dollar_bps"), c("soft_dollar_bps"), c("soft_dollar_tag"),
            c("soft_dollar_tag").isin(CALCULATED, ESTIMATED) & c("soft_dollar_bps").isNotNull()),
        row("Bid-Ask Spread Cost", "hidden", c("spread_low_bps"), c("spread_high_bps"), c("spread_tag"), shown("spread_tag")),
        row("Market Impact Cost", "hidden", c("impact_low_bps"), c("impact_high_bps"), c("impact_tag"), shown("impact_tag")),
        row("TOTAL HIDDEN COSTS", "composite", total("low"), total("high"), F.lit("composite"), F.lit(True)),
    ))
    mix = weights.join(cost.select(*KEYS, "ticker"), list(KEYS)).select(
        *KEYS, "ticker", F.concat(F.lit("Asset: "), "asset_category").alias("component"), F.lit("allocation").alias("category"),
        null.alias("low_bps"), null.alias("high_bps"), null.alias("mid_bps"), rnd(c("weight_pct") / 100, 6).alias("value_pct"),
        F.lit("nport").alias("source_tag"),
    )
    return cost.select(*KEYS, "ticker", F.inline(rows)).unionByName(mix)


def write_events(quarters: DataFrame, path: str) -> None:
    """Register of fund deaths, ordered by date, as CSV parts."""
    events = fund_events(quarters) if "event" not in quarters.columns else quarters
    events.orderBy("date_filed", "form", "cik").write.mode("overwrite").csv(path, header=True)


def load_board(raw: DataFrame) -> DataFrame:
    """Stored board rows: without ticker or midpoint they are dropped, the last row of a ticker wins.

    ``raw`` has a ``position`` column with the order of the rows.
    """
    ok = raw.filter(F.col("ticker").isNotNull() & F.col("hidden_cost_mid_bps").isNotNull())
    cols = [c for c in raw.columns if c not in ("ticker", "position")]
    return ok.groupBy("ticker").agg(F.max_by(F.struct(*cols), "position").alias("b")).select("ticker", "b.*")
