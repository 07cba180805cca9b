"""Fund-name normalisation and candidate names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values ---------------------------------------------------------------
CLASS_TOKENS = (
    r"class [a-z0-9]+", r"investor shares?", r"admiral shares?", r"institutional shares?", r"retail shares?",
    r"- [a-z]+ shares?",
)
CLASS_SUFFIX = (
    r"(?i)\s*[,;:]?\s*\b(Institutional(?:\s+Shares?)?|Institutional\s+Class|Investor(?:\s+Shares?)?|"
    r"Admiral(?:\s+Shares?)?|Retail(?:\s+Shares?)?|Class\s+[A-Z0-9]+|Service\s+Class|SL\s+Agency\s+Shares?|"
    r"Agency\s+Shares?)\s*$"
)
ABBREVIATIONS = {
    "Mkt": "Markets",
    "Mkts": "Markets",
    "Dev": "Developed",
    "Devs": "Developed",
    "Intl": "International",
    "Int'l": "International",
    "Emg": "Emerging",
    "Em": "Emerging",
    "Sml": "Small",
    "Lg": "Large",
    "Mid": "Mid",
    "Cap": "Cap",
    "Corp": "Corporate",
    "Govt": "Government",
    "Tr": "Treasury",
    "Muni": "Municipal",
    "Univ": "Universal",
}
EMBEDDED_TICKER = r"\(([A-Z]{3,5}X)\)"
PREFIX = r"^(?:.*?)\s*[-:]\s*((?:[A-Z]|[a-z][A-Z])[A-Za-z0-9].+)$"
# ----------------------------------------------------------------------------


def normalised(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.trim(name)), r"\s*\([^)]*\)\s*", " ")
    for t in CLASS_TOKENS:
        n = F.regexp_replace(n, rf"\b{t}\b", " ")
    n = F.regexp_replace(n, r"[\.\,\;\:\-]+", " ")
    n = F.regexp_replace(n, r"\bthe\b", " ")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def expanded(name: Column) -> Column:
    for short, full in ABBREVIATIONS.items():
        name = F.regexp_replace(name, rf"(?i)\b{short}\b", full)
    return name


def peeled(name: Column) -> Column:
    """Without a leading registrant, when what is left looks like a name."""
    rest = F.trim(F.regexp_extract(F.trim(name), PREFIX, 1))
    return F.when(F.length(rest) >= 5, rest).otherwise(name)


def embedded_ticker(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, EMBEDDED_TICKER, 1), F.lit(""))


def isin_cusip(isin: Column) -> Column:
    return F.when(isin.startswith("US") & (F.length(isin) == 12), F.substring(isin, 3, 9))


def candidates(name: Column) -> Column:
    """Ordered distinct names worth looking up: as given, peeled once and twice, tails cut, class suffix cut."""
    tidy = lambda x: F.regexp_replace(x, r"^[,;\-:\s]+|[,;\-:\s]+$", "")
    one = peeled(name)
    base = F.array(*[tidy(x) for x in (name, one, peeled(one))])
    cut = F.flatten(F.transform(base, lambda c: F.array(
        tidy(F.substring_index(c, ";", 1)), tidy(F.substring_index(c, ",", 1)))))
    whole = F.concat(base, cut)
    bare = F.transform(whole, lambda c: tidy(F.trim(F.regexp_replace(c, CLASS_SUFFIX, ""))))
    return F.array_distinct(F.filter(F.concat(whole, bare), lambda c: F.length(c) >= 5))
