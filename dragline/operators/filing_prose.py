"""Facts from prose filings: statements of additional information, shareholder reports, merger proxies.

Every parser maps one document row to its facts with regular expressions and
array functions; only the carry-down of broker rows needs a window, over the
rows of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline.functions import text as X
from dragline.functions.expr import if_any, let

# fixed values ---------------------------------------------------------------
COMMISSION_STARTS = (
    r"aggregate\s+brokerage\s+commissions.*?(?:follows|table)",
    r"brokerage\s+commissions.*?(?:paid|following\s+table)",
)
COMMISSION_ENDS = (
    r"(?:changes\s+to\s+brokerage|securities\s+of\s+regular)",
    r"(?:the\s+funds?\s+did\s+not|portfolio\s+transactions)",
)
COMMISSION_SKIP = ("total", "aggregate", "year", "turnover", "fund(s)", "fiscal")
REPORT_STARTS = (
    r"brokerage\s+commissions?\s+paid",
    r"aggregate\s+brokerage\s+commissions",
    r"total\s+brokerage\s+commissions",
    r"commissions?\s+on\s+portfolio\s+transactions",
)
REPORT_ENDS = (
    r"(?:securities\s+of\s+regular|directed\s+brokerage)",
    r"(?:other\s+information|financial\s+highlights)",
    r"(?:additional\s+information|board\s+of)",
)
REPORT_SKIP = ("total", "aggregate", "year", "fiscal", "fund(s)", "directed")
BROKER_ROW_SKIP = ("fund(s)", "fiscal", "broker", "affiliated", "percentage", "commission", "ommission")
PAY_STARTS = (
    r"compensation\s+generally\s+consists\s+of\s+a\s+fixed\s+base",
    r"portfolio\s+manager.*?compensation\s+generally\s+consists",
    r"compensation\s+of.*?investment\s+committee\s+members\s+includes",
    r"compensation\s+includes\s+a\s+base\s+salary",
    r"base\s+salary.*?bonus.*?(?:equity|deferred|incentive)",
)
PAY_ENDS = (
    r"(?:fund\s+shares?\s+owned|dollar\s+range|other\s+accounts?\s+managed)",
    r"(?:proxy\s+voting|code\s+of\s+ethics)",
    r"(?:securities\s+held|potential\s+conflicts)",
)
PAY_FLAGS = {
    "has_base_salary": (r"base\s+salary",),
    "has_bonus": (r"bonus",),
    "has_equity": (r"equity\s+ownership|stock\s+option|restricted\s+stock|equity.based",),
    "has_deferred": (r"deferred\s+compensation",),
    "linked_to_performance": (
        r"(?:bonus|incentive|variable).*?(?:performance|benchmark|return|alpha|beat)",
        r"(?:performance|investment\s+return).*?(?:bonus|incentive|variable)",
    ),
    "linked_to_assets": (r"(?:bonus|compensation).*?(?:assets?\s+under|size\s+of|asset\s+growth)",),
    "linked_to_firm_profit": (r"(?:bonus|compensation).*?(?:profitability|firm.s?\s+profit|company\s+profit)",),
    "not_linked_to_performance": (
        r"(?:compensation|bonus).*?not\s+(?:linked|tied|based).*?(?:performance|return)",
        r"not\s+(?:linked|tied).*?(?:distribution|volume\s+of\s+assets)",
    ),
}
SOFT_STARTS = (
    r"section\s+28\(e\)", r"soft\s+dollar", r"commission\s+uses?\s+program", r"research\s+services.*?brokerage",
)
SOFT_ENDS = (
    r"(?:regular\s+broker|affiliated\s+broker|commission\s+recapture)",
    r"(?:securities\s+of\s+regular|other\s+information)",
)
SOFT_FLAGS = {
    "has_soft_dollar": (r"(?:soft\s+dollar|section\s+28\(e\)|research\s+services.*?commission)",),
    "uses_commission_sharing": (r"(?:commission\s+sharing|commission\s+uses?\s+program|unbundle)",),
}
BOARD_STARTS = (
    r"basis\s+for\s+(?:the\s+)?board.s?\s+approv",
    r"board\s+consideration\s+of\s+(?:the\s+)?(?:investment|advisory)",
    r"approval\s+of\s+(?:the\s+)?(?:investment|advisory)\s+(?:management|advisory)\s+(?:contract|agreement)",
)
BOARD_ENDS = (r"(?:financial\s+statements|report\s+of\s+independent)", r"(?:proxy\s+voting|shareholder\s+meeting)")
BOUNDARY = r">[\s]*Statement\s+of\s+Additional\s+Information[\s]*<"
BOUNDARY_PHRASE = r"This\s+Statement\s+of\s+Additional\s+Information"
_NAME = r"[A-Z][A-Za-z0-9 &\.\-\/]{4,100}?Fund"
# what must follow a name for its cue to match: the name alone is tried at every letter, so it is tried where this is found
_BECOMES = r"\s+(?:will\s+be|is\s+being|shall\s+be)\s+(?:reorganized|acquired|merged)"
_CALLED = r"\s*\(\s*(?:the\s+)?[\"“]?(?:{})\s+Fund"
CUE_NEEDS = {
    0: rf"(?i)Fund{_BECOMES}", 2: rf"(?i)Fund{_CALLED.format('Acquired|Target')}",
    6: rf"(?i)Fund{_CALLED.format('Acquiring|Surviving|Successor')}",
}
TARGET_CUES = (
    rf"(?i)(?:the\s+)?({_NAME})\s+(?:will\s+be|is\s+being|shall\s+be)\s+(?:reorganized|acquired|merged)",
    rf"(?i)reorganization\s+of\s+(?:the\s+)?({_NAME})\b",
    rf"(?i)({_NAME})\s*\(\s*(?:the\s+)?[\"“]?(?:Acquired|Target)\s+Fund",
    rf"(?i)merger\s+of\s+(?:the\s+)?({_NAME})\s+with\s+and\s+into",
)
ACQUIRER_CUES = (
    rf"(?i)(?:reorganized|merged|acquired)\s+(?:with\s+and\s+)?into\s+(?:the\s+)?({_NAME})\b",
    rf"(?i)shares\s+of\s+(?:the\s+)?({_NAME})\s+(?:will\s+be|shall\s+be)\s+issued",
    rf"(?i)({_NAME})\s*\(\s*(?:the\s+)?[\"“]?(?:Acquiring|Surviving|Successor)\s+Fund",
    rf"(?i)into\s+(?:the\s+)?({_NAME}),\s+a\s+series",
)
SNIPPET = r"(?i)(?:proposed reorganization|purpose of the reorganization|reorganization agreement)[^.]{20,}\."
# ----------------------------------------------------------------------------


def after_boundary(html: Column) -> Column:
    """The statement part of a combined document: first header past the middle, else the last header,
    else the introductory phrase, else everything.

    Where the document has one header, as most have, that is the answer, and the rest is scanned for a second one only."""
    def of_several() -> Column:
        middle = F.floor(F.length(html) / 2).cast("int")
        late = X.from_first(F.substring(html, middle + 2, F.length(html)), BOUNDARY)
        return F.coalesce(late, X.first_match(html, rf"(?i)^(?s:.*)((?:{BOUNDARY})(?s:.*))"))

    return let(X.from_first(html, BOUNDARY), lambda first: F.when(
        first.isNull(), F.coalesce(X.from_first(html, BOUNDARY_PHRASE), html)).when(
        ~F.substring(first, F.lit(2), F.length(first)).rlike(f"(?i){BOUNDARY}"), first).otherwise(of_several()))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text in small letters holds one of the words; the Kelvin sign is the one other character that becomes a letter of theirs."""
    return text.rlike("(?i)" + "|".join(w.replace("(", r"\(").replace(")", r"\)").replace("k", "[k\u212a]") for w in words))


def _tables(part: Column) -> Column:
    """Rows of cells of the tables of a section that have at least two rows, in order."""
    parsed = F.transform(X.tables(part), lambda t: F.transform(X.table_rows(t), lambda r: X.row_cells(r)))
    return F.filter(parsed, lambda rows: F.size(rows) >= 2)


def _amount(c: Column, report: bool) -> Column:
    """Dollar amount of a cell; numbers that look like years are none.  Statements also leave out
    small numbers, which are percentages."""

    def keep(v: Column) -> Column:
        year_like = (v > 2019) & (v < 2031)
        return F.when(~year_like if report else ((v > 100) & ~year_like) | (v == 0), v)

    for mark in "$, ":
        c = F.replace(c, F.lit(mark), F.lit(""))
    return let(_number(c), keep)


def _number(text: Column) -> Column:
    """Text as a double, else null.  A cast that fails throws, which costs far more than a look: what does not begin like a
    number, infinity or NaN is not cast."""
    return F.when(text.rlike(r"(?i)^[\x00-\x20]*+[+-]?+(?:\.?[0-9]|inf|nan)"), text.try_cast("double"))


def _year(cell: Column, pattern: str, group: int) -> Column:
    return if_any(F.regexp_extract(cell, pattern, group)).cast("int")


_PLACE = 1 << 20  # rows of a table, in the number that orders rows
_FOUND = "array<struct<fund_name:string,year:int,amount:double,at:bigint>>"


def _joined(tables: Column, rows_of) -> Column:
    return F.flatten(F.transform(tables, lambda t, n: let(t, lambda rows: rows_of(rows, n)).cast(_FOUND)))


def _year_columns(rows: Column, table: Column, report: bool) -> Column:
    """(fund_name, year, amount, at) of a table with a column for each year.

    Years come from the rows above the first one with a dollar amount, newest first, and are paired with the amounts of
    each row in order.
    """
    skip = REPORT_SKIP if report else COMMISSION_SKIP

    def years(amounts: Column) -> Column:
        first = F.array_position(F.transform(amounts, lambda r: F.exists(r, lambda v: v.isNotNull())), F.lit(True))
        heads = let(first, lambda f: F.slice(rows, F.lit(1), F.when(f > 0, f - 1).otherwise(F.size(rows)).cast("int")))
        return F.sort_array(F.array_distinct(F.filter(
            F.transform(F.flatten(heads), lambda c: _year(c, r"20\d{2}", 0)), lambda y: y.isNotNull())), asc=False)

    def paired(cells: Column, at: Column, years: Column, all_amounts: Column) -> Column:
        name = F.coalesce(F.get(cells, F.lit(0)), F.lit(""))
        own = F.get(all_amounts, at)
        amounts = F.filter(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda v: v.isNotNull())
        named = (name != "") & ~name.rlike(r"^[\$\d,\.\s]+$") & ~_has_any(name, skip)
        pairs = let(amounts, lambda a: F.transform(
            F.slice(years, F.lit(1), F.least(F.size(years), F.size(a))), lambda y, i: F.struct(
                name.alias("fund_name"), y.alias("year"), F.get(a, i).alias("amount"), (table * _PLACE + at).cast("bigint").alias("at"))))
        # names, the dearer test, only of rows that have something to pair
        return F.when((F.size(amounts) > 0) & named, pairs)

    def of(amounts: Column) -> Column:
        return let(years(amounts), lambda ys: F.when(F.size(ys) > 0, F.flatten(F.filter(
            F.transform(rows, lambda cells, at: paired(cells, at, ys, amounts)), lambda x: x.isNotNull()))).otherwise(F.array().cast(_FOUND)))

    # the amount of each cell, once
    return let(F.transform(rows, lambda r: F.transform(r, lambda c: _amount(c, report))), of)


def _broker_rows(rows: Column, table: Column) -> Column:
    """(fund_name, year, amount, at) of a table with one row per fund, year and broker.

    Fund and year are written once and hold for the rows below them, so the rows are folded from top to bottom.
    """
    def step(state: Column, cells: Column) -> Column:
        first = F.trim(F.get(cells, F.lit(0)))
        named = (F.length(first) > 5) & ~first.rlike(r"^[\d\$%,.\s\-]+$") & ~_has_any(first, BROKER_ROW_SKIP)
        years = F.filter(F.transform(cells, lambda c: _year(F.trim(c), r"^(20\d{2})$", 1)), lambda y: y.isNotNull())
        amounts = F.filter(F.transform(cells, lambda c, i: F.when(
            F.trim(c) == "$", _number(F.replace(F.get(cells, i + 1), F.lit(","), F.lit(""))))), lambda v: v.isNotNull() & (v > 100))
        fund = F.when(F.coalesce(named, F.lit(False)), first).otherwise(state["fund"])
        year = F.coalesce(let(years, lambda ys: F.get(ys, F.size(ys) - 1)), state["year"])

        def after(now: Column) -> Column:
            new = F.when(now["fund"].isNotNull() & now["year"].isNotNull(), F.transform(amounts, lambda v: F.struct(
                now["fund"].alias("fund_name"), now["year"].alias("year"), v.alias("amount"), state["at"].alias("at"))))
            return F.struct(now["fund"].alias("fund"), now["year"].alias("year"), (state["at"] + 1).alias("at"),
                            F.concat(state["found"], F.coalesce(new, F.array().cast(_FOUND))).alias("found"))

        unchanged = F.struct(state["fund"].alias("fund"), state["year"].alias("year"), (state["at"] + 1).alias("at"), state["found"].alias("found"))
        return F.when(F.size(cells) >= 3, let(F.struct(fund.alias("fund"), year.alias("year")), after)).otherwise(unchanged)

    start = F.struct(F.lit(None).cast("string").alias("fund"), F.lit(None).cast("int").alias("year"),
                     (table * _PLACE + 1).cast("bigint").alias("at"), F.array().cast(_FOUND).alias("found"))
    below = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.aggregate(below, start, step, lambda s: s["found"])


def commissions(docs: DataFrame, key: str, html: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Year-column tables; where they give nothing, or nothing of 1,000 dollars, broker rows instead.

    A document's tables are cut once, and both readings of them are arrays, so nothing is shuffled before the sums.
    ``also`` are columns that depend on the key and are carried along.
    """
    def chosen(tables: Column) -> Column:
        def pick(wide: Column) -> Column:
            enough = F.coalesce(F.array_max(F.transform(wide, lambda x: x["amount"])) >= 1000, F.lit(False))
            return let(enough, lambda e: F.struct(
                e.alias("wide"), F.when(e, wide).otherwise(_joined(tables, _broker_rows)).alias("rows")))

        return let(_joined(tables, lambda rows, n: _year_columns(rows, n, False)), pick)

    part = X.section(after_boundary(F.col(html)), COMMISSION_STARTS, COMMISSION_ENDS)
    rows = docs.select(key, *also, F.inline(F.array(let(_tables(part), chosen)))).select(key, *also, "wide", F.inline("rows"))
    sums = rows.groupBy(key, *also, "fund_name", "year").agg(
        F.max("wide").alias("_wide"), F.max_by("amount", "at").alias("_last"), F.sum(F.col("amount").cast("decimal(28,2)")).cast("double").alias("_sum"))
    return sums.select(key, *also, "fund_name", "year", F.when(F.col("_wide"), F.col("_last")).otherwise(F.col("_sum")).alias("amount"))


def report_commissions(docs: DataFrame, key: str, html: str) -> DataFrame:
    """Commissions by fund and year from a shareholder report, where small amounts count too; the largest stays."""
    part = X.section(F.col(html), REPORT_STARTS, REPORT_ENDS)
    rows = docs.select(key, F.inline(let(_tables(part), lambda tables: _joined(tables, lambda rows, n: _year_columns(rows, n, True)))))
    return rows.groupBy(key, "fund_name", "year").agg(F.max("amount").alias("amount"))


def report_facts(docs: DataFrame, key: str, html: str) -> DataFrame:
    """What a shareholder report says, one row each: commissions, turnover history, the board's approval text."""
    money = report_commissions(docs, key, html).groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("fund_name", "year", "amount"))).alias("commissions"))
    turnover = turnover_history(docs, key, html).groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("fund_name", "year", "turnover_pct"))).alias("turnover"))
    return docs.select(key, board_approval(F.col(html)).alias("board_approval")).join(money, key, "left").join(
        turnover, key, "left")


def turnover_history(docs: DataFrame, key: str, html: str) -> DataFrame:
    """Turnover by year from every financial-highlights section."""
    parts = F.filter(F.split(F.col(html), r"(?i)(?=financial\s+highlights)"), lambda s: s.rlike(r"(?i)^financial\s+highlights"))
    s = docs.select(key, F.posexplode(parts).alias("part", "s"))
    row = F.regexp_extract("s", r"(?is)(portfolio\s+turnover\s+rate.*?)(?:</tr>|$)", 1)
    above = F.regexp_extract("s", r"(?is)^(.*?)portfolio\s+turnover\s+rate", 1)
    name = F.regexp_extract(above, r"(?i)(?:fund|portfolio|class)\s*[:\-—]\s*([A-Za-z][\w\s&\-]+)", 1)
    rows = s.select(
        key, "part", X.plain_text(name, "report").alias("fund_name"),
        F.regexp_extract_all(row, F.lit(r"(\d+)\s*%"), F.lit(1)).alias("pcts"),
        F.sort_array(F.array_distinct(F.regexp_extract_all(above, F.lit(r"(20\d{2})"), F.lit(1))), asc=False).alias("years"),
    ).filter((F.size("pcts") > 0) & (F.size("years") > 0))
    return rows.select(
        key, "part", "fund_name",
        F.explode(F.slice(F.arrays_zip("years", "pcts"), 1, F.least(F.size("years"), F.size("pcts")))).alias("z"),
    ).select(key, "part", "fund_name", F.col("z.years").cast("int").alias("year"), F.col("z.pcts").cast("double").alias("turnover_pct"))


def board_approval(html: Column) -> Column:
    return X.plain_text(X.section(html, BOARD_STARTS, BOARD_ENDS), "report")


def _split_outside(pattern: str, mark: str) -> list[str]:
    """Parts of a pattern between ``mark``s that stand in no group."""
    parts, depth, at = [""], 0, 0
    while at < len(pattern):
        if depth == 0 and pattern.startswith(mark, at):
            parts.append("")
            at += len(mark)
            continue
        size = 2 if pattern[at] == "\\" else 1
        depth += {"(": 1, ")": -1}.get(pattern[at], 0)
        parts[-1] += pattern[at : at + size]
        at += size
    return parts


def _in_order(text: Column, pattern: str) -> Column:
    """Whether the terms of ``a.*?b.*?c`` come one after the other: each is looked for once, behind the first place of
    the one before it, so a long text takes one pass however often the first term occurs."""
    if pattern.startswith("(?:") and len(_split_outside(pattern, ".*?")) == 1 and ".*?" in pattern and len(_split_outside(pattern[:-1], "|")) == 1:
        pattern = pattern[3:-1]
    hit = F.lit(False)
    for one in _split_outside(pattern, "|"):
        *before, last = _split_outside(one, ".*?")
        rest = text
        for term in before:
            rest = F.get(F.split(rest, term, 2), F.lit(1))
        hit = hit | F.coalesce(rest.rlike(last), F.lit(False))
    return hit


def _flags(part: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """STRUCT of booleans from a cleaned section, null when it is missing or under 100 characters."""

    def judge(text: Column) -> Column:
        hits = []
        for name, patterns in table.items():
            hit = F.lit(False)
            for p in patterns:
                hit = hit | _in_order(text, p)
            hits.append(hit.alias(name))
        return F.when(F.length(text) >= 100, F.struct(*hits))

    return let(F.lower(X.plain_text(part)), judge)


def pay_flags(html: Column) -> Column:
    return _flags(X.section(html, PAY_STARTS, PAY_ENDS), PAY_FLAGS)


def soft_flags(html: Column) -> Column:
    return _flags(X.section(html, SOFT_STARTS, SOFT_ENDS), SOFT_FLAGS)


def statement_facts(docs: DataFrame, key: str, html: str) -> DataFrame:
    """Pay and soft-dollar flags per document; pay is looked for in the whole document when the
    statement part does not mention a base salary."""
    part = docs.select(key, html, after_boundary(F.col(html)).alias("_part"))
    found = part.select(key, html, pay_flags(F.col("_part")).alias("_pay"), soft_flags(F.col("_part")).alias("soft"))
    lacking = F.coalesce(~F.col("_pay.has_base_salary"), F.lit(True))
    retry = found.withColumn("_again", F.when(lacking, pay_flags(F.col(html))))
    better = F.coalesce(F.col("_again.has_base_salary"), F.lit(False))
    return retry.select(key, F.when(better, F.col("_again")).otherwise(F.col("_pay")).alias("pay"), "soft")


def merger_facts(docs: DataFrame, key: str, html: str, company: str) -> DataFrame:
    """Names on both sides of a merger, its kind and a summary sentence, from the whole document."""
    d = docs.select(key, F.col(company).alias("_company"), F.col(html).isNotNull().alias("_body"),
                    X.plain_text(F.coalesce(F.col(html), F.lit("")), "merger").alias("_t"))

    def hits(cue: str) -> Column:
        found, need = F.regexp_extract_all("_t", F.lit(cue), F.lit(1)), CUE_NEEDS.get((*TARGET_CUES, *ACQUIRER_CUES).index(cue))
        return F.when(F.col("_t").rlike(need), found).otherwise(F.array().cast("array<string>")) if need else found

    names = lambda cues: F.array_distinct(F.filter(F.transform(
        F.concat(*map(hits, cues)), F.trim), lambda n: n != ""))
    f = d.select(
        key, "_company", "_body", names(TARGET_CUES).alias("_targets"), names(ACQUIRER_CUES).alias("_acquirers"),
        F.trim(F.regexp_extract("_t", SNIPPET, 0)).alias("summary"),
    )
    root = F.upper(F.get(F.split(F.trim(F.coalesce("_company", F.lit(""))), r"\s+"), F.lit(0)))
    t, a = F.size("_targets") > 0, F.size("_acquirers") > 0
    same = (root != "") & F.forall(F.concat("_targets", "_acquirers"), lambda n: F.upper(n).contains(root))
    kind = (
        F.when(~F.col("_body"), "unknown").when(t & a, F.when(same, "same-complex").otherwise("cross-complex"))
        .when(t | a, "partial").when(F.col("summary") != "", "reorganization").otherwise("filing-available")
    )
    return f.select(
        key, kind.alias("reorganization_type"), F.col("_targets").alias("targets"),
        F.col("_acquirers").alias("acquirers"), "summary",
    )
