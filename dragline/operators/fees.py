"""Fee facts from prospectus tables, prose and tagged data, and the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline.functions import text as X
from dragline.functions.expr import if_any, let, rnd
from dragline.operators.history import synthetic_total

# fixed values ---------------------------------------------------------------
LABELS = {
    "management fee": "management_fee",
    "management fees": "management_fee",
    "distribution and/or service": "twelve_b1_fee",
    "distribution (12b": "twelve_b1_fee",
    "12b-1": "twelve_b1_fee",
    "other expense": "other_expenses",
    "acquired fund fee": "acquired_fund_fees",
    "total annual fund operating": "total_annual_expenses",
    "total annual operating": "total_annual_expenses",
    "total fund operating": "total_annual_expenses",
    "fee waiver": "fee_waiver",
    "expense reimbursement": "fee_waiver",
    "net expense": "net_expenses",
    "net annual": "net_expenses",
}
NET_LABEL = "total annual fund operating expenses after"
FEE_FIELDS = (
    "management_fee", "twelve_b1_fee", "other_expenses", "acquired_fund_fees", "total_annual_expenses", "fee_waiver",
    "net_expenses",
)
ANCHORS = ("annual fund operating expense", "annual operating expense", "fee table")
CLASS_WORDS = ("investor", "class i ", "class i\u00a0", "class a")
TURNOVER = r"(?is)(?:portfolio\s+turnover|turnover\s+rate).*?(\d+)\s*%"
LOAD = r"(?is)maximum\s+(?:initial\s+)?sales\s+(?:charge|load).*?(\d+\.?\d*)\s*%"
CONCEPTS = {
    "ManagementFeesOverAssets": "management_fee",
    "DistributionAndService12b1FeesOverAssets": "twelve_b1_fee",
    "OtherExpensesOverAssets": "other_expenses",
    "AcquiredFundFeesAndExpensesOverAssets": "acquired_fund_fees",
    "ExpensesOverAssets": "total_annual_expenses",
    "FeeWaiverOrReimbursementOverAssets": "fee_waiver",
    "NetExpensesOverAssets": "net_expenses",
}
TAXONOMIES = ("oef", "rr")
SANITY_PCT = 20.0
CLASS_TABLE_REGISTRANTS = (
    "AMERICAN FUNDS", "AMCAP FUND", "FUNDAMENTAL INVESTORS", "CAPITAL INCOME BUILDER", "CAPITAL WORLD GROWTH",
    "GROWTH FUND OF AMERICA", "INCOME FUND OF AMERICA", "INVESTMENT COMPANY OF AMERICA",
    "WASHINGTON MUTUAL INVESTORS", "BOND FUND OF AMERICA", "INTERMEDIATE BOND FUND OF AMERICA",
    "NEW PERSPECTIVE FUND", "NEW WORLD FUND", "EUROPACIFIC GROWTH", "SMALLCAP WORLD", "AMERICAN BALANCED",
    "AMERICAN HIGH-INCOME", "AMERICAN MUTUAL", "TAX-EXEMPT BOND FUND OF AMERICA", "U.S. GOVERNMENT SECURITIES FUND",
)
PROSE_REGISTRANTS = ("FIDELITY INVESTMENT TRUST", "FIDELITY SELECT PORTFOLIOS", "FIDELITY CONCORD STREET TRUST")
PROSE_SERIES = r"(?i)^Fidelity\s+Series\s+"
CLASS_ROWS = {
    "management_fee": r"Management fees(?:\s+\d)?\s",
    "twelve_b1_fee": r"Distribution and/or service \(12b-1\) fees\s",
    "other_expenses": r"Other expenses\s",
    "total_annual_expenses": r"Total annual fund operating expenses\s",
    "net_expenses": r"Total annual fund operating expenses after fee waiver\s",
    "fee_waiver": r"Fee waiver(?:\s+\d)?\s",
}
_VALUE = r"([\d.]+|[Nn]one)"
PROSE_ROWS = {
    "management_fee": rf"(?i)Management fee\s+{_VALUE}",
    "twelve_b1_fee": rf"(?i)Distribution and/or Service \(12b-1\) fees\s+{_VALUE}",
    "other_expenses": rf"(?i)Other expenses\s+{_VALUE}",
    "total_annual_expenses": rf"(?i)Total annual (?:fund )?operating expenses\s+{_VALUE}",
    "net_expenses": rf"(?i)Total annual (?:fund )?operating expenses after fee waiver(?:s)?\s+{_VALUE}",
    "fee_waiver": rf"(?i)Fee waiver(?:s)?(?: and/or expense reimbursement)?\s+{_VALUE}",
}
PROSE_TURNOVER = r"(?i)fund's portfolio turnover rate was\s+([\d.]+)\s*%"
# ----------------------------------------------------------------------------

_PCT = r"(\d+\.?\d*)\s*%"


_found = X.first_match


def percent_in(text: Column) -> Column:
    """First n%; else a bare number below 100; words and dashes for "none" give null."""

    def read(t: Column) -> Column:
        bare = let(_found(t, r"(\d+\.?\d*)").try_cast("double"), lambda b: F.when(b < 100, b))
        return F.when(
            ~F.lower(t).isin("", "none", "n/a", "—", "–", "-"), F.coalesce(_found(t, _PCT).try_cast("double"), bare)
        )

    return let(F.trim(text), read)


def scaled_percent(fraction: Column) -> tuple[Column, Column]:
    """(percent, implausible?) of a tagged decimal fraction; waivers of 20 % or more are rejected."""
    pct = rnd(fraction * 100.0, 4)
    return F.when(pct > -SANITY_PCT, pct), F.coalesce(pct >= SANITY_PCT, F.lit(False))


def fee_field(label: Column) -> Column:
    """Fee field named by a row label.  Net totals ("... after waiver") are tested before gross ones."""

    def named(low: Column) -> Column:
        out = F.when(low.contains(NET_LABEL), "net_expenses")
        for words, field in LABELS.items():
            out = out.when(low.contains(words), field)
        return out

    return let(F.lower(X.squeeze(F.replace(label, F.lit("\u00a0"), F.lit(" ")))), named)


def _last_values(pairs: Column) -> list[Column]:
    """One column per field: the last value of an ARRAY<STRUCT<field, value>>."""
    named = lambda f: (lambda p: p["field"] == f)
    return [F.try_element_at(F.filter(pairs, named(f)), F.lit(-1))["value"].alias(f) for f in FEE_FIELDS]


def _pairs(rows: Column, field, value) -> Column:
    pair = lambda r: let(field(r), lambda f: F.struct(f.alias("field"), F.when(f.isNotNull(), value(r)).alias("value")))
    return F.filter(F.transform(rows, pair), lambda p: p["field"].isNotNull() & p["value"].isNotNull())


def _class_column(rows: Column, ticker: Column) -> Column:
    """Column of the wanted share class: the last heading row above the first row of figures decides."""
    figures = F.array_position(F.transform(rows, lambda r: F.exists(r, lambda c: c.rlike(r"\d\s*%"))), F.lit(True))
    joined = lambda r: F.lower(F.concat_ws(" ", r))

    def head_of(figures: Column) -> Column:
        above = F.when(figures > 0, figures - 1).otherwise(F.size(rows)).cast("int")
        texts = F.transform(F.slice(rows, F.lit(1), above), lambda r: F.filter(r, lambda c: c != ""))
        heads = F.filter(texts, lambda r: (F.size(r) >= 2) & ~joined(r).rlike("management|distribution|expense|fee"))
        return F.try_element_at(heads, F.lit(-1))

    def place(head: Column) -> Column:
        spot = lambda test: F.array_position(F.transform(head, test), F.lit(True)) - 1
        at_least_0 = lambda at: F.when(at >= 0, at)
        by_ticker = let(spot(lambda c: F.contains(F.upper(c), F.upper(ticker))), at_least_0)
        by_word = let(spot(lambda c: F.lower(c).rlike("|".join(CLASS_WORDS))), at_least_0)
        return F.coalesce(by_ticker, by_word, F.lit(0)).cast("int")

    return let(let(figures, head_of), place)


def table_fees(docs: DataFrame, key: str, html: str, ticker: str) -> DataFrame:
    """Fees from the table that holds a fee-table heading or follows it, to its end; failing that, from two-cell rows
    anywhere.

    The last row of a field wins.  Turnover and sales load are read from the text of the whole document.
    """

    def around(page: Column, behind: Column) -> Column:
        # the last table of what stands before, if nothing closes it; what is behind runs to the end, so it occurs once
        before = F.call_function("substring_index", page, behind, F.lit(1))
        opened = F.regexp_extract(before, r"<(?i)table[^<]*+(?:<(?!/table>|table)[^<]*+)*+\z", 0)
        return F.concat(opened, F.regexp_extract(behind, r"(?i)^[^<]*+(?:<(?!/table>)[^<]*+)*+(?:</table>)?", 0))

    def region(page: Column) -> Column:
        # small letters first, in which a plain search finds out that a heading is not there
        behind = lambda low: F.coalesce(*[F.when(low.contains(a), X.from_first(page, a)) for a in ANCHORS])
        return let(let(F.lower(page), behind), lambda b: F.when(b.isNotNull(), around(page, b)))

    cells = lambda x: F.transform(X.table_rows(x), lambda r: X.row_cells(r, heads=False))

    def label(r: Column) -> Column:
        first = F.get(r, F.lit(0))
        whole = F.concat_ws(" ", F.filter(r, lambda c: ~F.trim(c).rlike(r"^\d+\.?\d*\s*%$")))
        split = ~first.rlike(r"^[\*†\(\d]")
        return F.coalesce(fee_field(first), F.when(split, fee_field(whole)))

    def value(joined: Column, place: Column) -> Column:
        found = F.regexp_extract_all(joined, F.lit(_PCT), F.lit(1))
        picked = let(found, lambda f: F.coalesce(F.get(f, place), F.get(f, F.lit(0))))
        return F.when(joined != "", picked.try_cast("double"))

    def value_or_number(r: Column, place: Column) -> Column:
        joined = F.concat_ws(" ", F.filter(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: c != ""))
        return let(joined, lambda j: F.coalesce(value(j, place), percent_in(j)))

    def near(rows: Column) -> Column:
        full = F.filter(rows, lambda r: F.size(r) > 0)
        return let(_class_column(rows, F.col(ticker)), lambda place: _pairs(full, label, lambda r: value_or_number(r, place)))

    def wide(page: Column) -> Column:
        return _pairs(
            F.filter(cells(page), lambda r: F.size(r) >= 2), lambda r: fee_field(F.get(r, F.lit(0))),
            lambda r: percent_in(F.get(r, F.lit(1))),
        )

    has = lambda p: F.exists(p, lambda x: x["field"].isin("management_fee", "total_annual_expenses"))
    first = lambda text, pattern: if_any(F.regexp_extract(text, pattern, 1)).cast("double")

    def read(page: Column, pairs: Column, layout: str) -> Column:
        # tags that follow each other go at once
        facts = lambda body: F.struct(
            F.lit(layout).alias("layout"), *_last_values(pairs), first(body, "(?=[PpTt])" + TURNOVER).alias("portfolio_turnover"),
            first(body, "(?=[Mm])" + LOAD).alias("max_sales_load"))
        return F.when(has(pairs), let(F.regexp_replace(page, r"(?:<[^>]++>)++", ""), facts))

    # each reading is made once, and the cells of the whole document only where its region gives nothing
    page = F.col(html)
    of_near = let(let(region(page), cells), lambda rows: F.when(rows.isNotNull(), let(near(rows), lambda p: read(page, p, "table"))))
    of_wide = let(wide(page), lambda p: read(page, p, "cells"))
    return docs.select(key, F.inline(F.array(F.coalesce(of_near, of_wide))))


def is_class_table_registrant(registrant: Column, class_names: Column) -> Column:
    """By registrant name, or by the pairing of an R-6 class with a 529 class."""
    up = F.upper(F.coalesce(registrant, F.lit("")))
    named = F.lit(False)
    for r in CLASS_TABLE_REGISTRANTS:
        named = named | up.contains(r)
    lower = F.transform(class_names, lambda n: F.lower(F.trim(n)))
    signature = F.array_contains(lower, "class r-6") & F.exists(class_names, lambda n: F.trim(n).startswith("Class 529-"))
    return named | F.coalesce(signature, F.lit(False))


def is_prose_series(registrant: Column, series_name: Column) -> Column:
    up = F.upper(F.coalesce(registrant, F.lit("")))
    named = F.lit(False)
    for r in PROSE_REGISTRANTS:
        named = named | up.contains(r)
    return named & F.coalesce(F.trim(series_name).rlike(PROSE_SERIES), F.lit(False))


def parser_route(registrant: Column, class_names: Column, series_name: Column) -> Column:
    """Which parser a prospectus needs: class-column tables, prose of an omnibus prospectus, or the summary table."""
    return (
        F.when(is_class_table_registrant(registrant, class_names), "class_table")
        .when(is_prose_series(registrant, series_name), "prose").otherwise("summary_table")
    )


def class_table_fees(docs: DataFrame, key: str, html: str, class_name: str) -> DataFrame:
    """Fees of one share class from blocks with one column per class.

    A block runs from "Share class:" to the next one and must show management
    fees before its first figure; the net total below the gross total belongs to it.
    """
    label = F.regexp_replace(F.trim(class_name), r"(?i)^class\s+", "")
    text = X.plain_text(F.col(html), "class_table")
    blocks = F.filter(
        F.split(text, r"(?=Share class:\s)"), lambda b: b.startswith("Share class:")
        & F.regexp_extract(b, r"^[^0-9]*+(?:[0-9]++(?!\.[0-9])[^0-9]*+)*+", 0).contains("Management fees"),
    )

    def facts(b: Column, wanted: Column) -> Column:
        """What a block says of the wanted class; each pattern is looked for once a block."""
        labels = F.filter(F.split(F.regexp_extract(b, r"Share class:\s+(.+?)\s+Management fees", 1), r"\s+"), lambda x: x != "")

        def row(pattern: str, after: bool, place: Column) -> Column:
            # a gross row is not a net row: "after fee waiver" must not follow it
            guard = "" if after else r"(?!after fee waiver)"
            rest = F.regexp_extract(b, pattern + guard + r"((?s:.*))", 1)

            def read(tokens: Column) -> Column:
                token = F.get(tokens, (place["at"] - 1).cast("int"))
                return F.when(F.size(tokens) >= place["n"], F.when(token == "none", 0.0).otherwise(token.try_cast("double")))

            return let(F.regexp_extract_all(rest, F.lit(r"(\d+\.\d+|none)"), F.lit(1)), read)

        def of(place: Column) -> Column:
            values = {f: row(p, f == "net_expenses", place) for f, p in CLASS_ROWS.items()}
            return F.when(place["at"] > 0, F.struct(wanted.alias("class_label"), place["n"].alias("n_classes"), *[x.alias(f) for f, x in values.items()]))

        return let(let(labels, lambda x: F.struct(F.array_position(x, wanted).alias("at"), F.size(x).alias("n"))), of)

    # blocks are read inside the array, so that nothing of them is evaluated again behind it
    read = lambda wanted: F.transform(blocks, lambda b, i: F.struct(i.alias("block"), facts(b, wanted).alias("f")))
    rows = docs.select(key, F.inline(F.filter(let(label, read), lambda r: r["f"]["total_annual_expenses"].isNotNull())))
    return rows.groupBy(key).agg(F.min_by("f", "block").alias("f")).select(key, "f.*")


def prose_fees(docs: DataFrame, key: str, html: str, series_name: str) -> DataFrame:
    """Fees of one fund from its summary section in an omnibus prospectus."""
    text = X.plain_text(F.col(html), "prose")
    sections = F.filter(F.split(text, r"(?i)(?=Fund Summary Fund:\s)"), lambda s: F.lower(s).startswith("fund summary fund:"))
    # headings carry trademark signs that series names do not
    head = lambda s: F.lower(F.regexp_replace(F.regexp_replace(s, r"\s*\(r\)", ""), r"(?i)^Fund Summary Fund:\s*", ""))
    wanted = F.lower(F.trim(series_name))
    mine = F.get(F.filter(sections, lambda s: F.startswith(head(s), F.concat(wanted, F.lit(" ")))), F.lit(0))
    d = docs.select(key, mine.alias("s")).filter(F.col("s").isNotNull())

    def token(pattern: str) -> Column:
        raw = F.lower(_found(F.col("s"), pattern))
        return F.when(raw == "none", 0.0).otherwise(raw.try_cast("double"))

    out = d.select(
        key, *[token(p).alias(f) for f, p in PROSE_ROWS.items()],
        _found(F.col("s"), PROSE_TURNOVER).try_cast("double").alias("portfolio_turnover"),
    )
    return out.filter(F.col("management_fee").isNotNull() & F.col("total_annual_expenses").isNotNull())


# -- tagged facts ------------------------------------------------------------------


def tagged_fees(facts: DataFrame, key: str = "accession_no") -> DataFrame:
    """Fees per (filing, series, class) from tagged facts.

    A context names its series and class inside one string in many styles, so
    both ids are cut out once and the match is a plain grouping.  Per field the
    first taxonomy with a number wins, then the first fact.
    """
    series, cls = _found(F.col("context_ref"), r"(S\d{9})"), _found(F.col("context_ref"), r"(C\d{9})")
    name = F.substring_index("concept", ":", -1)
    space = F.substring_index("concept", ":", 1)
    rank = F.when(space == TAXONOMIES[0], 0).when(space == TAXONOMIES[1], 1)
    number = F.coalesce(F.col("numeric_value"), F.col("value").try_cast("double"))
    rows = facts.select(
        key, series.alias("series_id"), cls.alias("class_id"), name.alias("_name"), rank.alias("_rank"), number.alias("_v"),
        F.col("position").alias("_at"),
    ).filter("series_id IS NOT NULL AND class_id IS NOT NULL AND _rank IS NOT NULL AND _v IS NOT NULL")
    # one long carries the order, so the aggregation can hash: taxonomy first, then place
    order = F.col("_rank").cast("long") * (1 << 40) + F.col("_at")
    pick = lambda concept: F.min_by("_v", F.when(F.col("_name") == concept, order))
    wide = rows.filter(F.col("_name").isin(*CONCEPTS)).groupBy(key, "series_id", "class_id").agg(
        *[pick(c).alias(f"_{f}") for c, f in CONCEPTS.items()]
    )
    return wide.select(
        key, "series_id", "class_id", *[scaled_percent(F.col(f"_{f}"))[0].alias(f) for f in CONCEPTS.values()],
        F.greatest(*[scaled_percent(F.col(f"_{f}"))[1] for f in CONCEPTS.values()]).alias("implausible"),
    ).filter("management_fee IS NOT NULL OR total_annual_expenses IS NOT NULL")


def first_with_facts(filings: DataFrame, fees: DataFrame) -> DataFrame:
    """Newest filing with facts for each class, however far back it lies.

    ``filings`` is (series_id, accession_no, filing_date).
    """
    hits = filings.join(fees, ["series_id", "accession_no"])
    cols = [c for c in hits.columns if c not in ("series_id", "class_id")]
    newest = F.max_by(F.struct(*cols), F.struct("filing_date", "accession_no"))
    return hits.groupBy("series_id", "class_id").agg(newest.alias("f")).select("series_id", "class_id", "f.*")


# -- choosing a source ---------------------------------------------------------------

SOURCES = ("class_table", "prose", "summary_parsed", "summary_table", "tagged")


def fee_cascade(candidates: DataFrame, key: str = "class_id") -> DataFrame:
    """One fee row per class from candidates of several sources.

    Sources in rank order: class-column tables, prose sections, parsed summary
    prospectus, summary prospectus table, tagged facts.  A summary table without
    any ratio gives way to tagged facts but lends them its turnover and load.
    A summary table only counts when its filing was matched to the ticker.
    """
    c = F.col
    usable = (
        (c("source").isin("class_table", "prose") & c("total_annual_expenses").isNotNull())
        | ((c("source") == "summary_parsed") & (c("management_fee").isNotNull() | c("total_annual_expenses").isNotNull() | c("net_expenses").isNotNull()))
        | ((c("source") == "summary_table") & c("ticker_matched") & (c("management_fee").isNotNull() | c("total_annual_expenses").isNotNull()))
        | ((c("source") == "tagged") & (c("management_fee").isNotNull() | c("total_annual_expenses").isNotNull()))
    )
    parts = [c(f) for f in ("management_fee", "twelve_b1_fee", "other_expenses", "acquired_fund_fees")]
    total = F.coalesce(
        c("total_annual_expenses"),
        F.when(c("source") == "summary_table", synthetic_total(*parts, facts=False)),
        F.when(c("source") == "tagged", synthetic_total(*parts, facts=True)),
    )
    rows = candidates.filter(usable).withColumn("total_annual_expenses", total)
    ratio = F.coalesce(c("net_expenses"), c("total_annual_expenses"))
    body = F.struct("source", *FEE_FIELDS, "portfolio_turnover", "max_sales_load")
    of = lambda s: F.max(F.when(c("source") == s, body))
    wide = rows.withColumn("_ratio", ratio).groupBy(key).agg(
        *[of(s).alias(s) for s in SOURCES],
        F.max(F.when(c("source") == "summary_table", c("_ratio"))).alias("_table_ratio"),
        F.max(F.when(c("source") == "tagged", c("_ratio"))).alias("_tagged_ratio"),
    )
    tagged_wins = c("_table_ratio").isNull() & c("_tagged_ratio").isNotNull()
    chosen = F.coalesce(
        c("class_table"), c("prose"), c("summary_parsed"),
        F.when(tagged_wins, c("tagged")).otherwise(F.coalesce("summary_table", "tagged")),
    )
    lend = F.coalesce("class_table", "prose", "summary_parsed").isNull() & tagged_wins
    out = wide.select(key, chosen.alias("f"), F.when(lend, c("summary_table")).alias("_lender"))
    return out.select(
        key, "f.source", *[c(f"f.{f}").alias(f) for f in FEE_FIELDS],
        F.coalesce("f.portfolio_turnover", "_lender.portfolio_turnover").alias("portfolio_turnover"),
        F.coalesce("f.max_sales_load", "_lender.max_sales_load").alias("max_sales_load"),
    )


def match_filings(wanted: DataFrame, header_rows: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Filing that covers each ticker: by header ticker, else class id, else series id when the series has
    one class, else a ticker standing in the body.

    ``wanted`` is (ticker, class_id, series_id, single_class); ``header_rows`` is the header table with
    ``accession_no`` and ``filing_date``; ``bodies`` is (accession_no, filing_date, html).
    """
    newest = F.min(F.struct((-F.unix_date(F.col("filing_date"))).alias("age"), "accession_no", "filing_date")).alias("b")

    def by(which: Column, rows: DataFrame, value: str, column: str, how: int) -> DataFrame:
        # one row for each value before it meets the tickers: a word that every filing holds costs one row a task
        first = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(newest)
        return wanted.filter(which).join(first, F.col(column) == F.col("_value")).select(
            "ticker", "b.accession_no", "b.filing_date", F.lit(how).alias("how"))

    # inside one filing the kinds of match are alternatives; the newest filing with any of them wins
    rows = (
        by(F.lit(True), header_rows.withColumnRenamed("ticker", "_t"), "_t", "ticker", 1)
        .unionByName(by(F.lit(True), header_rows, "class_id", "class_id", 2))
        .unionByName(by(F.col("single_class"), header_rows, "series_id", "series_id", 3))
    )
    if bodies is not None:
        # every upper-case word of a body that could be a ticker, once per filing
        tokens = F.array_distinct(F.regexp_extract_all("html", F.lit(r"[A-Z][A-Z0-9]{2,}"), F.lit(0)))
        words = bodies.select("accession_no", "filing_date", F.explode(tokens).alias("_w"))
        rows = rows.unionByName(by(F.lit(True), words, "_w", "ticker", 4))
    best = F.min(F.struct(
        F.when(F.col("how") == 4, 1).otherwise(0).alias("late"), (-F.unix_date(F.col("filing_date"))).alias("age"),
        "how", "accession_no", "filing_date",
    ))
    return rows.groupBy("ticker").agg(best.alias("b")).select(
        "ticker", "b.accession_no", "b.filing_date",
        F.element_at(F.array(*[F.lit(x) for x in ("header_ticker", "class_id", "series_id", "body")]), F.col("b.how")).alias("matched_by"),
    )
