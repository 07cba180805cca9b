"""Tickers, security identifiers and names to fund identifiers, all as equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline import assumptions as A
from dragline.functions import names as N
from dragline.operators.portfolio import valid_ticker

IDS = ("cik", "series_id", "class_id")


def _id_struct(*cols: str) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def representative_class(master: DataFrame) -> DataFrame:
    """One class per series: tickers ending in X first, then alphabetical.  ``min_by`` needs no sort."""
    order = F.struct(F.when(F.col("ticker").endswith("X"), 0).otherwise(1), "ticker", "class_id")
    return master.groupBy("cik", "series_id").agg(F.min_by(_id_struct("class_id", "ticker"), order).alias("b")).select(
        "cik", "series_id", "b.class_id", "b.ticker"
    )


def by_ticker(master: DataFrame) -> DataFrame:
    """One row per ticker (the smallest identifiers, should a ticker repeat)."""
    return master.filter(F.col("ticker") != "").groupBy("ticker").agg(F.min(_id_struct(*IDS)).alias("id"))


def header_walk(headers: DataFrame, priority: Column | None = None) -> DataFrame:
    """Identifiers by ticker from filing headers: trusts in priority order, then the newest filing."""
    first = priority if priority is not None else F.lit(0)
    order = F.struct(first.alias("p"), (-F.unix_date("filing_date")).alias("d"), F.col("accession_no"), F.col("class_id"))
    return headers.filter(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.min_by(_id_struct(*IDS), order).alias("id"))


def resolve_tickers(tickers: DataFrame, master: DataFrame, census: DataFrame | None, headers: DataFrame | None) -> DataFrame:
    """Master list, then census, then filing headers.

    A loaded census is authoritative: a ticker it lacks is ABSENT and the headers
    are not asked.  ``census=None`` means it could not be loaded; then headers
    decide and a miss is UNAVAILABLE.
    """
    wanted = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    out = wanted.join(by_ticker(master).withColumnRenamed("id", "_m"), "ticker", "left")
    if census is not None:
        out = out.join(census.select("ticker", _id_struct(*IDS).alias("_c")), "ticker", "left")
        found, source = F.coalesce("_m", "_c"), F.when(F.col("_m").isNotNull(), "master").when(F.col("_c").isNotNull(), "census")
        miss = "ABSENT"
    else:
        walked = header_walk(headers).withColumnRenamed("id", "_h")
        out = out.join(walked, "ticker", "left")
        found, source = F.coalesce("_m", "_h"), F.when(F.col("_m").isNotNull(), "master").when(F.col("_h").isNotNull(), "header")
        miss = "UNAVAILABLE"
    return out.select("ticker", found.alias("id"), source.alias("source")).select(
        "ticker", *[F.col(f"id.{c}").alias(c) for c in IDS], "source",
        F.when(F.col("source").isNotNull(), "HIT").otherwise(miss).alias("verdict"),
    )


def cusip_classes(cusip_ticker: DataFrame, master: DataFrame) -> DataFrame:
    """Security identifier to share class; identifiers of anything but a registered fund fall out."""
    tick = by_ticker(master)
    return (
        cusip_ticker.filter(F.length("cusip") == 9).select(F.upper("cusip").alias("cusip"), F.upper(F.trim("ticker")).alias("ticker"))
        .join(tick, "ticker").groupBy("cusip").agg(F.min(F.struct("ticker", "id")).alias("b")).select("cusip", "b.ticker", "b.id")
    )


def resolve_names(distinct_names: DataFrame, series_names: DataFrame, master: DataFrame) -> DataFrame:
    """Names to funds: embedded ticker, then candidate names in order.

    A candidate counts only when it belongs to exactly one series; an ambiguous
    name stays unresolved.  Candidates are tried as given and with abbreviations
    expanded.  ``distinct_names`` has one column ``name``.
    """
    rep = representative_class(master)
    unique = (
        series_names.select(N.normalised(F.col("series_name")).alias("key"), "cik", "series_id").filter(F.col("key") != "")
        .groupBy("key").agg(F.min(_id_struct("cik", "series_id")).alias("lo"), F.max(_id_struct("cik", "series_id")).alias("hi"))
        .filter(F.col("lo") == F.col("hi")).select("key", "lo.*")
    )
    long = distinct_names.filter(F.length("name") >= 5)
    tries = long.select("name", F.posexplode(N.candidates(F.col("name"))).alias("at", "c")).select(
        "name", F.inline(F.array(
            F.struct((F.col("at") * 2).alias("at"), N.normalised(F.col("c")).alias("key")),
            F.struct((F.col("at") * 2 + 1).alias("at"), N.normalised(N.expanded(F.col("c"))).alias("key")),
        ))
    )
    by_name = (
        tries.join(unique, "key").groupBy("name").agg(F.min_by(_id_struct("cik", "series_id"), "at").alias("b")).select("name", "b.*")
        .join(rep, ["cik", "series_id"], "left").select("name", _id_struct("ticker", *IDS).alias("n"))
    )
    tick = by_ticker(master).select("ticker", F.struct("ticker", "id.*").alias("t"))
    embedded = long.select("name", N.embedded_ticker(F.col("name")).alias("ticker")).join(tick, "ticker").select("name", "t")
    out = distinct_names.join(embedded, "name", "left").join(by_name, "name", "left")
    pick = lambda f: F.coalesce(F.col(f"t.{f}"), F.col(f"n.{f}")).alias(f)
    return out.select("name", pick("ticker"), *[pick(c) for c in IDS])


def resolve_holdings(keys: DataFrame, cusips: DataFrame, names: DataFrame) -> DataFrame:
    """Positions to funds: by identifier, then by name, then by the identifier inside the ISIN.

    ``keys`` holds distinct (name, cusip, isin); positions join the result back on them.
    """
    c = cusips.select("cusip", F.struct("ticker", "id.*").alias("_c"))
    derived = cusips.select(F.col("cusip").alias("_isin_cusip"), F.struct("ticker", "id.*").alias("_i"))
    n = names.filter(F.col("series_id").isNotNull()).select("name", F.struct("ticker", *IDS).alias("_n"))
    out = (
        keys.withColumn("_isin_cusip", N.isin_cusip(F.col("isin"))).join(c, "cusip", "left").join(n, "name", "left")
        .join(derived, "_isin_cusip", "left")
    )
    how = F.when(F.col("_c").isNotNull(), "cusip").when(F.col("_n").isNotNull(), "name").when(F.col("_i").isNotNull(), "isin")
    pick = lambda f: F.coalesce(*[F.col(f"{s}.{f}") for s in ("_c", "_n", "_i")]).alias(f)
    return out.select("name", "cusip", "isin", how.alias("resolved_by"), pick("ticker"), *[pick(x) for x in IDS])


def latest_filing(filings: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Newest readable filing per series, by ``max_by`` rather than by sorting whole series."""
    cols = [c for c in filings.columns if c not in keys]
    return filings.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct("filing_date", "accession_no")).alias("b")
    ).select(*keys, "b.*")


def fund_profile(fund: DataFrame, ncen: DataFrame, nport: DataFrame, fees: DataFrame) -> DataFrame:
    """Fund with its latest census, holdings and fees; each side may be missing.

    A census name replaces the registrant name, and the adviser names the family.
    """
    n = ncen.select("series_id", F.col("fund_name").alias("_name"), F.col("adviser").alias("_adviser"), "commissions",
                    F.lit(True).alias("_n"))
    p = nport.select("series_id", F.col("net_assets"), F.lit(True).alias("_p"))
    return (
        fund.join(n, "series_id", "left").join(p, "series_id", "left").join(fees, "series_id", "left")
        .select(
            "series_id", "ticker", F.coalesce("_name", "fund_name").alias("fund_name"),
            F.coalesce("_adviser", "family").alias("family"), "commissions", "net_assets", "er_bps",
            F.coalesce("_n", F.lit(False)).alias("ncen_available"), F.coalesce("_p", F.lit(False)).alias("nport_available"),
        )
    )


def triage(inputs: DataFrame, universe: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Why an input cannot be analysed, as a code; null for a fund ticker.

    ``universe`` has the known fund tickers, ``suggestions`` (query, ticker) the best alias per query.
    """
    t = F.upper(F.trim("input"))
    rows = inputs.select("input", t.alias("ticker"))
    rows = rows.join(universe.select(F.col("ticker"), F.lit(True).alias("_known")).distinct(), "ticker", "left")
    if suggestions is not None:
        rows = rows.join(suggestions.select(F.col("query").alias("ticker"), F.col("ticker").alias("suggestion")), "ticker", "left")
    else:
        rows = rows.withColumn("suggestion", F.lit(None).cast("string"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    return rows.select(
        "input", valid_ticker(F.col("ticker")).alias("looks_like_ticker"),
        F.when(F.col("ticker").isin(*A.KNOWN_ETF_TICKERS), "ERR_ETF_NOT_SUPPORTED")
        .when(F.col("ticker").isin(*A.KNOWN_STOCK_TICKERS), "ERR_STOCK_NOT_FUND")
        .when(~known & F.col("suggestion").isNotNull(), "ERR_FUND_NAME_NOT_TICKER")
        .when(~known, "ERR_FUND_NOT_FOUND").alias("reject_reason"),
        F.when(~known, F.col("suggestion")).alias("suggestion"),
    )


def _grams(text: Column, n: Column | int) -> Column:
    """All runs of ``n`` letters with the place where each begins; none for a shorter text."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.struct(F.substring(text, i, n).alias("gram"), (i - 1).alias("at"))))


def alias_index(aliases: DataFrame) -> DataFrame:
    """Inverted index of pairs and triples of letters: two rows a letter, whatever the length of an alias."""
    both = F.concat(_grams(F.col("alias"), 2), F.coalesce(_grams(F.col("alias"), 3), F.array().cast("array<struct<gram:string,at:int>>")))
    return aliases.filter(F.length("alias") >= 2).select("position", "ticker", "name", "alias", F.inline(both))


def alias_search(queries: DataFrame, aliases: DataFrame, limit: int = 5) -> DataFrame:
    """Funds whose alias contains the query: early matches first, then short names.

    A query looks up the rarest of its triples (a query of two letters its pair) and checks its letters around each place
    found, so "contains" is an equi-join on the shortest posting.  ``aliases`` is (position, alias, ticker, name); of
    several matching aliases of a ticker the first in list order counts.
    """
    index = alias_index(aliases)
    wanted = queries.select(F.upper(F.trim("query")).alias("query")).filter(F.length("query") >= 2).distinct()
    asked = wanted.select("query", F.inline(_grams(F.col("query"), F.least(F.length("query"), F.lit(3)))))
    lengths = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(lengths, "gram", "left").groupBy("query").agg(
        F.min_by(F.struct("gram", F.col("at").alias("inside")), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("g")
    ).select("query", "g.gram", "g.inside")
    begin = F.col("at") - F.col("inside")
    found = rarest.join(index, "gram").filter(
        (begin >= 0) & (F.substring(F.col("alias"), begin + 1, F.length("query")) == F.col("query")))
    # of an alias the first place, of a ticker the first alias
    hits = found.groupBy("query", "ticker").agg(
        F.min(F.struct("position", begin.alias("at"), "name")).alias("b")).select("query", "ticker", "b.*")
    w = Window.partitionBy("query").orderBy("at", F.length("name"), "position")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query", "rank", "ticker", "name")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
