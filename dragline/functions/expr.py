"""Small Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

REPORTED, CALCULATED, ESTIMATED = "REPORTED", "CALCULATED", "ESTIMATED"
UNAVAILABLE, NOT_DISCLOSED = "UNAVAILABLE", "NOT_DISCLOSED"


def rnd(x: Column | str, n: int = 2) -> Column:
    """Round half up on an 8-digit decimal, so that ties do not depend on binary noise."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("decimal(28,8)"), n).cast("double")


def money(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(MONEY)


def dbl(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is null or zero."""
    return a / F.nullif(b, F.lit(0.0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Large Column expressions repeat their inputs; binding one through a
    one-element ``transform`` keeps the plan small and the work single.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def if_any(text: Column) -> Column:
    """The text, null when it is empty.  Inside a lambda ``nullif`` evaluates its argument twice."""
    return let(text, lambda t: F.when(t != "", t))


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """A constant mapping as one CASE expression (stays inside code generation)."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def sum_present(*cols: Column) -> Column:
    """Sum that skips nulls and is null only when every part is null."""
    everything_null = reduce(lambda a, b: a & b, [c.isNull() for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.when(~everything_null, total)


def is_available(value: Column, tag: Column) -> Column:
    return value.isNotNull() & ~tag.isin(UNAVAILABLE, NOT_DISCLOSED)


def tagged(value: Column, tag: Column | str, source: Column | None = None, note: Column | None = None) -> Column:
    """STRUCT<value, tag, source_filing, note>: a number with its provenance."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    null = F.lit(None).cast("string")
    return F.struct(
        dbl(value).alias("value"),
        tag.alias("tag"),
        (source if source is not None else null).alias("source_filing"),
        (note if note is not None else null).alias("note"),
    )


def dollars(x: Column) -> Column:
    """$1.2T / $3.4B / $5.6M / $7,890."""
    a = F.abs(x)
    return (
        F.when(a >= 1e12, F.format_string("$%.1fT", x / 1e12))
        .when(a >= 1e9, F.format_string("$%.1fB", x / 1e9))
        .when(a >= 1e6, F.format_string("$%.1fM", x / 1e6))
        .when(x.isNotNull(), F.concat(F.lit("$"), F.format_number(x, 0)))
    )


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def hidden_grade(mid: Column) -> Column:
    return (
        F.when(mid < 10, "A").when(mid < 25, "B").when(mid < 50, "C").when(mid < 100, "D")
        .when(mid.isNotNull(), "F")
    )


def readability_grade(score: Column) -> Column:
    return (
        F.when(score < 20, "A").when(score < 35, "B").when(score < 50, "C").when(score < 70, "D")
        .when(score.isNotNull(), "F")
    )
