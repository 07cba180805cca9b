"""Holdings and census XML, parsed inside the JVM with fixed schemas.

Input is a table of documents with a string column of XML.  Elements are
matched by local name; absent elements are null; malformed documents give no
rows.  Only the elements named in the schemas are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dragline.functions.expr import let
from dragline.operators.holdings import is_derivative

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _strings(*names: str) -> dict:
    return {n: _S for n in names}


# -- holdings -------------------------------------------------------------------

_PARTY = T.ArrayType(_struct(**_strings("counterpartyName", "counterpartyLei")))
_DERIV = _struct(
    counterpartyInfo=_PARTY, counterparties=_PARTY,
    **_strings("counterpartyName", "counterpartyLei", "amtCurSold", "curSold", "notionalAmt", "curCd", "unrealizedAppr"),
)
# fixed values: typed subtrees in the order they are looked for
INSTRUMENTS = ("fwdDeriv", "swapDeriv", "futrDeriv", "optionSwaptionWarrantDeriv", "otherDeriv")
HOLDING = _struct(
    **_strings("name", "cusip", "balance", "valUSD", "pctVal", "assetCat", "issuerCat", "invCountry"),
    identifiers=_struct(isin=_struct(_value=_S)),
    derivativeInfo=_struct(**{i: _DERIV for i in INSTRUMENTS}),
)
#: Which elements of a position each column of ``holdings_of`` is read from; its name decides whether it counts at all.
HOLDING_COLUMNS = {
    "name": ("name",), "cusip": ("cusip",), "isin": ("identifiers",), "balance": ("balance",), "value_usd": ("valUSD",),
    "pct_of_net_assets": ("pctVal",), "asset_category": ("assetCat",), "issuer_category": ("issuerCat",), "country": ("invCountry",),
    **{c: ("assetCat", "derivativeInfo")
       for c in ("instrument_type", "notional_usd", "counterparty_name", "counterparty_lei", "unrealized_usd")},
}


def holdings_form(columns: Iterable[str]) -> T.StructType:
    """Schema of a form with the elements that ``columns`` need; the parser steps over all others, which costs far less."""
    needed = {e for c in columns for e in ("name", *HOLDING_COLUMNS[c])}
    positions = {"invstOrSecs": _struct(invstOrSec=T.ArrayType(T.StructType([f for f in HOLDING if f.name in needed])))} if needed else {}
    return _struct(formData=_struct(
        genInfo=_struct(**_strings("seriesId", "repPdDate", "repPdEnd")), fundInfo=_struct(**_strings("netAssets")), **positions))


def text(c: Column) -> Column:
    """Trimmed element text, null when empty."""
    return F.nullif(F.trim(c), F.lit(""))


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def yes(c: Column) -> Column:
    return F.coalesce(text(c) == "Y", F.lit(False))


def parse_holdings_form(docs: DataFrame, xml: str = "xml", columns: Iterable[str] = tuple(HOLDING_COLUMNS)) -> DataFrame:
    """One row per readable document: keys of ``docs`` plus header fields and the raw positions.

    ``columns`` names what ``holdings_of`` is to find in the positions; with none of them there are no positions.

    A document whose own series id differs from ``docs.series_id`` is dropped;
    one without a series id is taken at its word.  The document is parsed once,
    inside the generator, which leaves out what cannot be used; a filter on
    parsed fields would make Spark parse it again.
    """
    columns = tuple(columns)
    attributes = {} if "isin" in columns else {"excludeAttribute": "true"}  # no other column is read from one
    body = F.from_xml(F.col(xml), holdings_form(columns), {"mode": "PERMISSIVE", **attributes})

    def usable(f: Column) -> Column:
        gen = f["formData"]["genInfo"]
        own = F.coalesce(F.trim(gen["seriesId"]), F.lit(""))
        row = F.struct(
            F.coalesce(text(gen["repPdDate"]), text(gen["repPdEnd"])).try_cast("date").alias("period_end"),
            number(f["formData"]["fundInfo"]["netAssets"]).alias("net_assets"),
            *([f["formData"]["invstOrSecs"]["invstOrSec"].alias("positions")] if columns else []),
        )
        return F.when(f["formData"].isNotNull() & own.isin("", F.col("series_id").cast("string")), F.array(row))

    return docs.select(*[c for c in docs.columns if c != xml], F.inline(let(body, usable)))


def holdings_of(form: DataFrame) -> DataFrame:
    """Positions as rows, with the columns whose elements were read; nameless ones are left out; derivative fields only
    for derivatives.

    Every typed subtree has the same fields, so the first one present is picked
    once, as a struct, and read from there.
    """
    keys = [c for c in form.columns if c not in ("positions", "net_assets", "period_end")]
    read = set(form.schema["positions"].dataType.elementType.names)
    named = F.filter("positions", lambda p: F.trim(p["name"]) != "")
    rows = form.select(*keys, F.explode(named).alias("h"))
    h = F.col("h")
    plain = {
        "name": lambda: F.trim(h["name"]), "cusip": lambda: text(h["cusip"]),
        "isin": lambda: F.nullif(h["identifiers"]["isin"]["_value"], F.lit("")),
        "balance": lambda: number(h["balance"]), "value_usd": lambda: number(h["valUSD"]), "pct_of_net_assets": lambda: number(h["pctVal"]),
        "asset_category": lambda: text(h["assetCat"]), "issuer_category": lambda: text(h["issuerCat"]), "country": lambda: text(h["invCountry"]),
    }
    plain = [make().alias(c) for c, make in plain.items() if read.issuperset(HOLDING_COLUMNS[c])]
    if "derivativeInfo" not in read:
        return rows.select(*keys, *plain)
    d = h["derivativeInfo"]
    deriv = is_derivative(text(h["assetCat"]))
    rows = rows.select(
        *keys, "h", F.when(deriv, F.coalesce(*[d[i] for i in INSTRUMENTS])).alias("s"),
        F.when(deriv, F.coalesce(*[F.when(d[i].isNotNull(), F.lit(i)) for i in INSTRUMENTS])).alias("kind"))
    s, kind = F.col("s"), F.col("kind")
    party = lambda f: F.coalesce(
        F.trim(F.get(s["counterpartyInfo"], F.lit(0))[f]), F.trim(F.get(s["counterparties"], F.lit(0))[f]), F.trim(s[f])
    )
    face = F.when(kind == "fwdDeriv", F.when(F.trim(s["curSold"]) == "USD", s["amtCurSold"])).when(
        F.coalesce(F.trim(s["curCd"]), F.lit("")).isin("", "USD"), s["notionalAmt"]
    )
    return rows.select(
        *keys, *plain, kind.alias("instrument_type"), F.abs(number(face)).alias("notional_usd"),
        party("counterpartyName").alias("counterparty_name"), party("counterpartyLei").alias("counterparty_lei"),
        number(s["unrealizedAppr"]).alias("unrealized_usd"),
    )


# -- census ---------------------------------------------------------------------

_DEALER = T.ArrayType(_struct(**_strings(
    "brokerDealerName", "brokerDealerCommission", "brokerDealerFileNo", "brokerDealerCrdNo", "brokerDealerLei")))
_BROKER = T.ArrayType(_struct(**_strings("brokerName", "grossCommission", "brokerFileNo", "brokerCrdNo", "brokerLei")))
_PRINCIPAL = T.ArrayType(_struct(**_strings(
    "principalName", "principalTotalPurchaseSale", "principalFileNo", "principalLei")))
_LENDING = T.ArrayType(_struct(**_strings("securitiesAgentName", "securitiesAgentLei", "isSecuritiesAgentAffiliated")))
_LENDER = T.ArrayType(_struct(**_strings("_creditInstitutionName", "_creditInstitutionLei", "_creditInstitutionFileNo")))
_CREDIT = T.ArrayType(_struct(
    **_strings("isCreditLineCommitted", "isCreditLineUsed", "lineOfCreditSize", "maxBorrowedDuringPeriod",
               "maxLineOfCreditOutstanding", "maxOutstandingBalance", "averageLineOfCreditBorrowed", "averageOutstanding"),
    lineOfCreditInstitutions=_struct(lineOfCreditInstitution=_LENDER), lineOfCreditInstitution=_LENDER,
    sharedCreditType=_struct(_creditType=_S, creditUser=T.ArrayType(_struct(_fundName=_S))),
))
_USE = T.ArrayType(_struct(**_strings(
    "derivativeType", "type", "instrumentType", "derivativeNotional", "notional", "notionalValue", "notionalAmount",
    "purpose", "strategy", "counterparty", "counterpartyName", "derivCounterparty")))
# fixed values
DERIVATIVE_RECORDS = ("derivativeInstrument", "derivativesTransaction", "derivativesInvestment", "derivativeTransaction")
DERIVATIVE_FLAGS = {
    "isForwardCurrency": "forwardCurrency",
    "isForwardOther": "forwardOther",
    "isFuturesContract": "future",
    "isOption": "option",
    "isSwaption": "swaption",
    "isSwap": "swap",
    "isCreditDefaultSwap": "creditDefaultSwap",
    "isInterestRateSwap": "interestRateSwap",
    "isTotalReturnSwap": "totalReturnSwap",
    "isWarrant": "warrant",
    "isStructuredNote": "structuredNote",
}


def _flag_notionals(flag: str, kind: str) -> list[str]:
    bare = flag[2].lower() + flag[3:]
    return [f"{bare}Notional", f"{kind}Notional", f"{kind}NotionalValue"]


_FLAG_FIELDS = sorted({n for f, k in DERIVATIVE_FLAGS.items() for n in [f, *_flag_notionals(f, k)]})
# child lists may sit in a plural wrapper or directly in the section
_LISTS = {
    "brokerDealer": ("brokerDealers", _DEALER), "broker": ("brokers", _BROKER),
    "principalTransaction": ("principalTransactions", _PRINCIPAL), "securityLending": ("securityLendings", _LENDING),
    "investmentAdviser": ("investmentAdvisers", T.ArrayType(_struct(investmentAdviserName=_S))),
    "admin": ("admins", T.ArrayType(_struct(**_strings("adminName", "isAdminAffiliated")))),
    "transferAgent": ("transferAgents", T.ArrayType(_struct(**_strings("transferAgentName", "isTransferAgentAffiliated")))),
    "custodian": ("custodians", T.ArrayType(_struct(custodianName=_S))),
    **{r: (f"{r}s", _USE) for r in DERIVATIVE_RECORDS},
}
SECTION = _struct(
    **_strings(
        "mgmtInvFundName", "mgmtInvSeriesId", "mgmtInvLei", "aggregateCommission", "isBrokerageResearchPayment",
        "mnthlyAvgNetAssets", "isNonDiversifiedCompany", "isSwingPricing", "fundType", "principalAggregatePurchase",
        "isFundSecuritiesLending", "avgPortfolioSecuritiesValue", "netIncomeSecuritiesLending",
        "isInterfundLending", "isInterfundBorrowing", *_FLAG_FIELDS,
    ),
    lineOfCredit=_struct(_hasLineOfCredit=_S, lineOfCreditDetails=_struct(lineOfCreditDetail=_CREDIT), lineOfCreditDetail=_CREDIT),
    **{one: kind for one, (_, kind) in _LISTS.items()},
    **{many: _struct(**{one: kind}) for one, (many, kind) in _LISTS.items()},
)
CENSUS_FORM = _struct(
    formData=_struct(managementInvestmentQuestionSeriesInfo=_struct(managementInvestmentQuestion=T.ArrayType(SECTION)))
)


def census_number(c: Column) -> Column:
    return F.when(text(c) != "N/A", number(c))


def _list(section: Column, one: str) -> Column:
    many, kind = _LISTS[one]
    return F.concat(F.coalesce(section[many][one], F.array().cast(kind)), F.coalesce(section[one], F.array().cast(kind)))


def parse_census_form(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per (document, fund section), as column ``s``, with the reporting period.

    With a ``series_id`` column in ``docs`` only the matching section stays; a
    lone section without an id also matches.
    """
    sections = F.from_xml(F.col(xml), CENSUS_FORM, {"mode": "PERMISSIVE"})[
        "formData"]["managementInvestmentQuestionSeriesInfo"]["managementInvestmentQuestion"]
    period = F.regexp_extract(F.col(xml), r"<(?:\w+:)?reportCalendarOrQuarter>\s*([0-9-]+)", 1)
    keep = [c for c in docs.columns if c not in (xml, "series_id")]
    wanted = F.col("series_id").cast("string") if "series_id" in docs.columns else None

    def matching(all_sections: Column) -> Column:
        def own(s: Column) -> Column:
            return F.coalesce(F.trim(s["mgmtInvSeriesId"]), F.lit(""))

        kept = all_sections
        if wanted is not None:
            kept = F.filter(kept, lambda s: (own(s) == wanted) | ((own(s) == "") & (F.size(all_sections) == 1)))
        return F.transform(kept, lambda s: F.struct(
            (wanted if wanted is not None else own(s)).alias("series_id"), s.alias("s")))

    return docs.select(*keep, period.try_cast("date").alias("period_end"), F.inline(let(sections, matching)))


def census_fund(sections: DataFrame) -> DataFrame:
    """Identity, commissions, flags, lending, credit line and providers of each section."""
    s = F.col("s")
    keep = [c for c in sections.columns if c != "s"]
    head = lambda one, field: text(F.get(_list(s, one), F.lit(0))[field])
    lending = yes(s["isFundSecuritiesLending"])
    details = F.concat(
        F.coalesce(s["lineOfCredit"]["lineOfCreditDetails"]["lineOfCreditDetail"], F.array().cast(_CREDIT)),
        F.coalesce(s["lineOfCredit"]["lineOfCreditDetail"], F.array().cast(_CREDIT)),
    )
    nonzero = lambda c: F.nullif(census_number(c), F.lit(0.0))
    first = lambda value: F.get(F.filter(F.transform(details, value), lambda v: v.isNotNull()), F.lit(0))
    lenders = F.flatten(F.transform(details, lambda d: F.concat(
        F.coalesce(d["lineOfCreditInstitutions"]["lineOfCreditInstitution"], F.array().cast(_LENDER)),
        F.coalesce(d["lineOfCreditInstitution"], F.array().cast(_LENDER)))))
    users = F.flatten(F.transform(details, lambda d: F.coalesce(
        d["sharedCreditType"]["creditUser"], F.array().cast("array<struct<_fundName:string>>"))))
    named = lambda xs, f: F.filter(F.transform(xs, lambda x: text(x[f])), lambda v: v.isNotNull())
    size = first(lambda d: census_number(d["lineOfCreditSize"]))
    # a zero in one of the alternatives falls through to the next; the last one is taken as it is
    peak = first(lambda d: F.coalesce(nonzero(d["maxBorrowedDuringPeriod"]), nonzero(d["maxLineOfCreditOutstanding"]),
                                      census_number(d["maxOutstandingBalance"])))
    mean = first(lambda d: F.coalesce(nonzero(d["averageLineOfCreditBorrowed"]), census_number(d["averageOutstanding"])))
    return sections.select(
        *keep,
        text(s["mgmtInvFundName"]).alias("fund_name"), text(s["mgmtInvLei"]).alias("lei"),
        census_number(s["aggregateCommission"]).alias("commissions"),
        yes(s["isBrokerageResearchPayment"]).alias("has_soft_dollar"),
        census_number(s["mnthlyAvgNetAssets"]).alias("average_net_assets"),
        yes(s["isNonDiversifiedCompany"]).alias("is_non_diversified"), yes(s["isSwingPricing"]).alias("is_swing_pricing"),
        text(s["fundType"]).alias("fund_type"),
        census_number(s["principalAggregatePurchase"]).alias("principal_aggregate"),
        lending.alias("is_lending"),
        F.when(lending, head("securityLending", "securitiesAgentName")).alias("lending_agent"),
        F.coalesce(lending & (head("securityLending", "isSecuritiesAgentAffiliated") == "Y"), F.lit(False))
        .alias("is_lending_agent_affiliated"),
        F.when(lending, census_number(s["avgPortfolioSecuritiesValue"])).alias("average_on_loan"),
        F.when(lending, census_number(s["netIncomeSecuritiesLending"])).alias("lending_net_income"),
        yes(s["isInterfundLending"]).alias("is_interfund_lending"), yes(s["isInterfundBorrowing"]).alias("is_interfund_borrowing"),
        F.coalesce(F.upper(s["lineOfCredit"]["_hasLineOfCredit"]) == "Y", F.lit(False)).alias("has_credit_line"),
        first(lambda d: text(d["isCreditLineCommitted"])).alias("credit_line_type"),
        F.exists(details, lambda d: F.coalesce(F.upper(text(d["isCreditLineUsed"])) == "Y", F.lit(False))).alias("is_credit_line_used"),
        size.alias("facility_size"), peak.alias("max_outstanding"), mean.alias("average_outstanding"),
        F.exists(details, lambda d: F.coalesce(F.lower(F.trim(d["sharedCreditType"]["_creditType"])) == "shared", F.lit(False)))
        .alias("is_facility_shared"),
        named(lenders, "_creditInstitutionName").alias("lenders"), named(users, "_fundName").alias("co_borrowers"),
        head("investmentAdviser", "investmentAdviserName").alias("adviser"), head("admin", "adminName").alias("administrator"),
        F.coalesce(head("admin", "isAdminAffiliated") == "Y", F.lit(False)).alias("is_admin_affiliated"),
        head("transferAgent", "transferAgentName").alias("transfer_agent"),
        F.coalesce(head("transferAgent", "isTransferAgentAffiliated") == "Y", F.lit(False)).alias("is_transfer_agent_affiliated"),
        head("custodian", "custodianName").alias("custodian"),
    )


def census_brokers(sections: DataFrame) -> DataFrame:
    """Affiliated dealers and other brokers as rows in filing order; a missing amount counts as zero."""
    s = F.col("s")
    keep = [c for c in sections.columns if c != "s"]

    def side(one: str, name: str, amount: str, file_no: str, crd: str, lei: str, affiliated: bool) -> DataFrame:
        return sections.select(*keep, F.posexplode(_list(s, one)).alias("position", "b")).filter(
            text(F.col(f"b.{name}")).isNotNull()
        ).select(
            *keep, "position", F.trim(f"b.{name}").alias("broker_name"),
            F.coalesce(census_number(F.col(f"b.{amount}")), F.lit(0.0)).alias("gross_commission"),
            text(F.col(f"b.{file_no}")).alias("file_no"), text(F.col(f"b.{crd}")).alias("crd_no"),
            text(F.col(f"b.{lei}")).alias("lei"), F.lit(affiliated).alias("is_affiliated"),
        )

    return side("brokerDealer", "brokerDealerName", "brokerDealerCommission", "brokerDealerFileNo", "brokerDealerCrdNo",
                "brokerDealerLei", True).unionByName(
        side("broker", "brokerName", "grossCommission", "brokerFileNo", "brokerCrdNo", "brokerLei", False))


def census_principals(sections: DataFrame) -> DataFrame:
    keep = [c for c in sections.columns if c != "s"]
    return sections.select(*keep, F.explode(_list(F.col("s"), "principalTransaction")).alias("p")).filter(
        text(F.col("p.principalName")).isNotNull()
    ).select(
        *keep, F.trim("p.principalName").alias("name"),
        F.coalesce(census_number(F.col("p.principalTotalPurchaseSale")), F.lit(0.0)).alias("total_purchase_sale"),
        text(F.col("p.principalFileNo")).alias("file_no"), text(F.col("p.principalLei")).alias("lei"),
    )


def census_derivative_records(sections: DataFrame) -> DataFrame:
    """Typed derivative records, one row each."""
    s = F.col("s")
    keep = [c for c in sections.columns if c != "s"]
    records = F.concat(*[_list(s, r) for r in DERIVATIVE_RECORDS])
    nonzero = lambda f: F.nullif(census_number(F.col(f"u.{f}")), F.lit(0.0))
    kind = F.coalesce(*[text(F.col(f"u.{f}")) for f in ("derivativeType", "type", "instrumentType")])
    return sections.select(*keep, F.explode(records).alias("u")).select(
        *keep, kind.alias("derivative_type"),
        F.coalesce(nonzero("derivativeNotional"), nonzero("notional"), nonzero("notionalValue"),
                   census_number(F.col("u.notionalAmount"))).alias("notional"),
        F.coalesce(text(F.col("u.purpose")), text(F.col("u.strategy"))).alias("purpose"),
        F.coalesce(*[text(F.col(f"u.{f}")) for f in ("counterparty", "counterpartyName", "derivCounterparty")]).alias("counterparty"),
    ).filter(F.col("derivative_type").isNotNull())


def census_derivative_flags(sections: DataFrame) -> DataFrame:
    """Types that are only flagged Y, with the notional of a sibling element if there is one."""
    s = F.col("s")
    keep = [c for c in sections.columns if c != "s"]
    flags = F.array_compact(F.array(*[
        F.when(F.upper(text(s[flag])) == "Y", F.struct(
            F.lit(kind).alias("derivative_type"),
            F.coalesce(*[census_number(s[n]) for n in _flag_notionals(flag, kind)]).alias("notional"),
        ))
        for flag, kind in DERIVATIVE_FLAGS.items()
    ]))
    return sections.select(*keep, F.inline(flags))
