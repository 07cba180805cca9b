"""Text and markup functions, all built-in expressions so that they stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dragline.functions.expr import if_any, let

# fixed values ---------------------------------------------------------------
WORD = r"(?U)\b[a-zA-Z]+\b"
PARTICIPLES = r"(?:\w+ed|bought|sold|made|put|set|held|taken|given|sent|shown)"
PASSIVE = (
    rf"\b(?:is|are|was|were|been|be)\s+{PARTICIPLES}\b",
    r"\b(?:is|are|was|were|been|being|be)\s+being\s+\w+",
    rf"\b(?:is|are|was|were)\s+not\s+{PARTICIPLES}\b",
)
FOOTNOTE = r"(?i)(?:\(\d+\)|\*{1,3}|†|‡)\s*(?:see|refer|as\s+described)"
CROSS_REFERENCE = r'(?i)(?:see\s+"|refer\s+to\s+"|as\s+(?:described|discussed)\s+(?:in|under))'
FEE_TERMS = "expense|fee|commission|cost|charge"
ENTITIES = {
    "statement": {
        "&#160;": " ", "&nbsp;": " ", "&#8217;": "'", "&#8216;": "'", "&#8220;": '"', "&#8221;": '"',
        "&amp;": "&", "&#38;": "&", "&mdash;": "—", "&#8212;": "—", "&ndash;": "–", "&#8211;": "–",
        "&#174;": "®", "&reg;": "®", "&lt;": "<", "&gt;": ">",
    },
    "report": {"&nbsp;": " ", "&#160;": " ", "&amp;": "&", "&#38;": "&", "&mdash;": "—", "&#8212;": "—"},
    "merger": {"&nbsp;": " ", "&amp;": "&"},
    "class_table": {
        "&nbsp;": " ", "&#160;": " ", "&mdash;": "--", "&ndash;": "-", "&amp;": "&",
        "&lsquo;": "'", "&rsquo;": "'", "&ldquo;": '"', "&rdquo;": '"',
    },
    "prose": {
        "&nbsp;": " ", "&#160;": " ", "&#169;": "(c)", "&#174;": "(r)", "&copy;": "(c)", "&reg;": "(r)",
        "&mdash;": "--", "&ndash;": "-", "&amp;": "&", "&lsquo;": "'", "&rsquo;": "'", "&ldquo;": '"', "&rdquo;": '"',
    },
}
# ----------------------------------------------------------------------------


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def plain_text(html: Column, variant: str = "statement") -> Column:
    """Markup to text in one of the five filing-specific variants."""
    x = html
    if variant in ("class_table", "prose"):  # entities first, so that an encoded tag is not taken for one
        for e, c in ENTITIES[variant].items():
            x = F.replace(x, F.lit(e), F.lit(c))
        x = F.regexp_replace(x, r"<[^>]+>", " ")
    else:
        x = F.regexp_replace(x, r"<[^>]+>", " ")
        for e, c in ENTITIES[variant].items():
            x = F.replace(x, F.lit(e), F.lit(c))
    if variant == "merger":
        x = F.regexp_replace(x, r"&[a-z]+;", " ")
    return squeeze(x)


def dollar_amounts(text: Column, context: int = 50) -> Column:
    """ARRAY<STRUCT<amount, context>>: every $ amount with its surroundings."""
    amount = r"\$\s*([\d,]+(?:\.\d+)?)"
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(amount), F.lit(1)).alias("values"),
        F.regexp_extract_all(text, F.lit(amount), F.lit(0)).alias("found"), F.split(text, amount).alias("between"),
    )

    def rows(p: Column) -> Column:
        at = lambda i: F.concat(
            F.right(F.get(p["between"], i), F.lit(context)), F.get(p["found"], i), F.left(F.get(p["between"], i + 1), F.lit(context))
        )
        return F.transform(p["values"], lambda v, i: F.struct(
            F.replace(v, F.lit(","), F.lit("")).try_cast("double").alias("amount"), at(i).alias("context")))

    return F.filter(let(parts, rows), lambda r: r["amount"].isNotNull())


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match or null, with a single evaluation of the pattern."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def from_first(text: Column, pattern: str) -> Column:
    """The text from the first match of ``pattern`` on; null when it does not occur."""
    return first_match(text, rf"(?i)(?:{pattern})(?s:.*)", 0)


def section(text: Column, starts: tuple[str, ...], ends: tuple[str, ...]) -> Column:
    """From the first start pattern that occurs to the first end pattern that occurs behind it.

    Patterns are tried in order.  Without an end the section runs to the end of
    the document; nothing is cut to a fixed length.  Null when nothing starts.
    """

    def cut(start: str):
        def ended(rest: Column) -> Column:
            # the start is taken as it was found (atomic), the end is the first behind it: one scan for each end pattern
            hits = [if_any(F.regexp_extract(rest, rf"(?i)^((?>{start}){_until(end)})(?:{end})", 1)) for end in ends]
            return F.when(rest.isNotNull(), F.coalesce(*hits, rest))

        return ended  # of one argument: a second one, even with a default, would get the place in the array

    return let(text, lambda t: F.coalesce(*[let(from_first(t, p), cut(p)) for p in starts]))


def _until(end: str) -> str:
    """A pattern for everything up to ``end``.  Where each of its alternatives begins with a letter, only places with such a letter
    are tried; the rest is skipped in runs."""
    alternatives = re.fullmatch(r"\(\?:([^()]*)\)", end)
    begins = [re.match(r"[A-Za-z](?![?*{])", a) for a in (alternatives[1] if alternatives else end).split("|")]
    if not all(begins):
        return r"(?s:.*?)"
    letters = "".join(sorted({c for b in begins for c in b[0].lower() + b[0].upper()}))
    return rf"[^{letters}]*+(?:(?!{end})[{letters}][^{letters}]*+)*+"


# -- tables in markup ----------------------------------------------------------


# Bodies run from tag to tag with possessive quantifiers: one step a tag instead of one a character, and no stack.
# The case is ignored behind the "<" only, as a search for one plain character is the fastest.


def tables(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<(?i)table\b[^<]*+(?:<(?!/table>)[^<]*+)*+(?:</table>)?"), F.lit(0))


def table_rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<(?i)tr\b[^<]*+(?:<(?!tr\b|/tr>|/table>)[^<]*+)*+"), F.lit(0))


def row_cells(row: Column, *, heads: bool = True) -> Column:
    """Cell texts; tags inside a cell vanish together with the blanks around them."""
    kind = "[dh]" if heads else "d"
    raw = F.regexp_extract_all(
        row, F.lit(rf"<(?i)t{kind}\b[^>]*+>([^<]*+(?:<(?!t[dh]\b|/t[dh]>|/tr>)[^<]*+)*+)"), F.lit(1))

    def clean(cell: Column) -> Column:
        c = F.regexp_replace(cell, r"\s*<[^>]+>\s*", "")
        for e, ch in {"&nbsp;": " ", "&#160;": " ", "&amp;": "&", "&mdash;": "—", "&#8212;": "—", "\u00a0": " "}.items():
            c = F.replace(c, F.lit(e), F.lit(ch))
        # most cells have nothing to clean
        return F.when(cell.rlike(r"(?U)[<&\u00a0]|^\s|\s$"), strip(c)).otherwise(cell)

    return F.transform(raw, clean)


# -- readability ------------------------------------------------------------------


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[.!?]+"), strip)
    return F.filter(parts, lambda s: F.length(s) > 10)


def words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)


def syllables(word: Column) -> Column:
    """Vowel groups, without a silent final e, with a syllabic -le; at least one."""
    w = F.lower(F.trim(word))
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = F.when(w.endswith("e") & (groups > 1), 1).otherwise(0)
    syllabic = F.when(w.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return (
        F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1)
        .otherwise(F.greatest(groups - silent + syllabic, F.lit(1)))
    )


def is_passive(sentence: Column) -> Column:
    return sentence.rlike("(?iU)" + "|".join(PASSIVE))


def nesting_depth(html: Column, tag: str = "table") -> Column:
    """Deepest nesting of ``tag``; unbalanced closing tags count below zero, as they come."""
    marks = F.regexp_extract_all(html, F.lit(rf"(?i)</?{tag}[^>]*>"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(acc: Column, m: Column) -> Column:
        d = acc["depth"] + F.when(m.startswith("</"), -1).otherwise(1)
        return F.struct(d.alias("depth"), F.greatest(acc["deepest"], F.when(m.startswith("</"), 0).otherwise(d)).alias("deepest"))

    return F.aggregate(marks, start, step, lambda acc: acc["deepest"])


def fee_term_spread(text: Column) -> tuple[Column, Column]:
    """(number of fee terms, characters between the first and the last one)."""
    n = F.regexp_count(text, F.lit(f"(?i){FEE_TERMS}"))
    first = F.length(F.regexp_extract(text, rf"(?is)^(.*?)(?:{FEE_TERMS})", 1))
    last = F.length(F.regexp_extract(text, rf"(?is)^(.*)(?:{FEE_TERMS})", 1))
    return n, last - first
