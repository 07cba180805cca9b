"""Ticker masters, filing indexes, filing headers and plain-text inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dragline.operators.history import CLASS_FORMS, label_event
from dragline.operators.portfolio import valid_ticker

MASTER_SCHEMA = "fields array<string>, data array<array<string>>"
INDEX_SCHEMA = (
    "cik string, name string, filings struct<recent: struct<form: array<string>, filingDate: array<string>,"
    " accessionNumber: array<string>, primaryDocument: array<string>>>"
)


def ticker_master(raw: DataFrame) -> DataFrame:
    """Column-array JSON ({fields, data}) to one row per share class; tickers upper-cased."""
    return raw.select(F.explode("data").alias("r")).select(
        F.get("r", F.lit(0)).try_cast("bigint").alias("cik"), F.get("r", F.lit(1)).alias("series_id"),
        F.get("r", F.lit(2)).alias("class_id"), F.upper(F.coalesce(F.get("r", F.lit(3)), F.lit(""))).alias("ticker"),
    )


def read_ticker_master(spark: SparkSession, path: str) -> DataFrame:
    return ticker_master(spark.read.schema(MASTER_SCHEMA).json(path, multiLine=True))


def census(raw: DataFrame, position: Column) -> DataFrame:
    """Series/class census: usable rows only, the last row of a ticker wins."""
    col = {c.lstrip("﻿"): c for c in raw.columns}
    f = lambda n: F.trim(F.coalesce(F.col(f"`{col[n]}`"), F.lit("")))
    rows = raw.select(
        F.upper(f("Class Ticker")).alias("ticker"), F.regexp_replace(f("CIK Number"), "^0+", "").alias("cik"),
        f("Series ID").alias("series_id"), f("Class ID").alias("class_id"), position.alias("_at"),
    ).filter("ticker <> '' AND cik <> '' AND series_id <> '' AND class_id <> ''")
    last = F.max_by(F.struct(F.col("cik").try_cast("bigint").alias("cik"), "series_id", "class_id"), "_at")
    return rows.groupBy("ticker").agg(last.alias("b")).select("ticker", "b.*")


def read_census(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    return census(raw.withColumn("_pos", F.monotonically_increasing_id()), F.col("_pos")).drop("_pos")


def filing_index(raw: DataFrame) -> DataFrame:
    """Parallel arrays to rows in feed order, cut to the shortest required array."""
    r = "filings.recent"
    n = F.least(F.size(f"{r}.form"), F.size(f"{r}.filingDate"), F.size(f"{r}.accessionNumber"))
    return raw.select(
        "cik", "name",
        F.posexplode(F.slice(F.arrays_zip(
            F.col(f"{r}.form"), F.col(f"{r}.filingDate"), F.col(f"{r}.accessionNumber"), F.col(f"{r}.primaryDocument")
        ), 1, n)).alias("position", "f"),
    ).select(
        "cik", "name", "position", F.col("f.form").alias("form"), F.col("f.filingDate").alias("filing_date"),
        F.col("f.accessionNumber").alias("accession_no"), F.coalesce("f.primaryDocument", F.lit("")).alias("primary_document"),
    )


def of_form(index: DataFrame, form: str, n: int, keys: tuple[str, ...] = ("cik",)) -> DataFrame:
    """The first ``n`` filings per filer whose form contains ``form``."""
    w = Window.partitionBy(*keys).orderBy("position")
    return (
        index.filter(F.col("form").contains(form)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )


def class_filings(index: DataFrame) -> DataFrame:
    """Filings whose headers list share classes."""
    return index.filter(F.col("form").isin(*CLASS_FORMS))


def series_filings(rows: DataFrame) -> DataFrame:
    """Series-scoped list: repeated accession numbers keep their first row."""
    body = F.min_by(F.struct("position", "form", "filing_date"), "position")
    return rows.groupBy("series_id", "accession_no").agg(body.alias("b")).select("series_id", "accession_no", "b.*")


# layout of a form index line: form, company, filer number, date, path
INDEX_LINE = r"^(\S+(?: \S+)*)\s{2,}(\S.*?)\s{2,}(\d{1,10})\s+(\d{4}-\d{2}-\d{2})\s+(\S+)\s*$"


def form_index(lines: DataFrame, line: str = "value") -> DataFrame:
    """Deregistrations and mergers from quarterly form indexes, whatever the column widths.

    Headings and rulers do not look like data lines and fall out.
    """
    g = lambda i: F.regexp_extract(line, INDEX_LINE, i)
    keep = [c for c in lines.columns if c != line]
    wanted = F.col(line).startswith("N-8F") | F.col(line).startswith("N-14")
    return (
        lines.filter(wanted & F.col(line).rlike(INDEX_LINE))
        .select(
            *keep, g(1).alias("form"), g(2).alias("company"), g(3).cast("bigint").alias("cik"),
            g(4).cast("date").alias("date_filed"), g(5).alias("filing_path"),
        )
        .withColumn("event", label_event(F.col("form")))
    )


def mend_event_dates(rows: DataFrame) -> DataFrame:
    """Stored event files that broke the date: glue the day at the head of the path back on."""
    day = F.regexp_extract("filing_path", r"^-?(\d{2})\s+(\S+)$", 1)
    broken = F.col("date_filed").rlike(r"^\d{4}-\d{2}-?$") & (day != "")
    return rows.select(
        *[c for c in rows.columns if c not in ("date_filed", "filing_path")],
        F.when(broken, F.concat(F.regexp_replace("date_filed", "-$", ""), F.lit("-"), day))
        .otherwise(F.col("date_filed")).try_cast("date").alias("date_filed"),
        F.when(broken, F.regexp_extract("filing_path", r"^-?(\d{2})\s+(\S+)$", 2)).otherwise(F.col("filing_path")).alias("filing_path"),
    )


def header_classes(headers: DataFrame, text: str = "header_text") -> DataFrame:
    """Share classes named in filing headers: one row per (filing, series, class).

    A header lists series, below each its classes, below each its ticker; a
    class belongs to the series block it stands in.
    """
    keep = [c for c in headers.columns if c != text]
    block = r"(?is)<SERIES-ID>\s*(S\d+)\b(.*?)(?=<SERIES-ID>|$)"
    entry = r"(?is)<CLASS-CONTRACT-ID>\s*(C\d+)\b(.*?)(?=<CLASS-CONTRACT-ID>|$)"
    cik = F.regexp_extract(text, r"(?i)CENTRAL INDEX KEY:\s*(\d+)", 1)
    name = F.trim(F.regexp_extract(text, r"COMPANY CONFORMED NAME:\s+([^\r\n]+)", 1))
    series = headers.select(
        *keep, F.nullif(cik, F.lit("")).cast("bigint").alias("cik"), F.nullif(name, F.lit("")).alias("registrant"),
        F.explode(F.arrays_zip(
            F.regexp_extract_all(text, F.lit(block), F.lit(1)).alias("id"), F.regexp_extract_all(text, F.lit(block), F.lit(2)).alias("body")
        )).alias("b"),
    )
    classes = series.select(
        *keep, "cik", "registrant", F.upper("b.id").alias("series_id"),
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all("b.body", F.lit(entry), F.lit(1)).alias("id"),
            F.regexp_extract_all("b.body", F.lit(entry), F.lit(2)).alias("body"),
        )).alias("position", "c"),
    )
    tag = lambda t, p: F.nullif(F.trim(F.regexp_extract("c.body", rf"(?i)<{t}>\s*({p})", 1)), F.lit(""))
    return classes.select(
        *keep, "cik", "registrant", "series_id", F.upper("c.id").alias("class_id"), "position",
        tag("CLASS-CONTRACT-NAME", r"[^\r\n<]+").alias("class_name"),
        F.upper(tag("CLASS-CONTRACT-TICKER-SYMBOL", r"[A-Za-z0-9.\-]+")).alias("ticker"),
    )


def ticker_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    t = F.upper(F.trim(line))
    return lines.select(*[c for c in lines.columns if c != line], t.alias("ticker")).filter(
        (F.col("ticker") != "") & ~F.col("ticker").startswith("#")
    )


def portfolio_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Ticker and weight from free text; ``error`` says what is wrong with a line.

    Blank lines and comments leave; separators are blanks, tabs, commas and
    colons; a percent sign is ignored.  Pass line numbers along as a column.
    """
    keep = [c for c in lines.columns if c != line]
    bare = F.trim(line)
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(bare, "[,:\\t]", " "), "%", ""), r"\s+"), lambda x: x != "")
    rows = lines.filter((bare != "") & ~bare.startswith("#")).select(*keep, F.col(line).alias("line_text"), parts.alias("p"))
    ticker, weight = F.upper(F.get("p", F.lit(0))), F.get("p", F.lit(1)).try_cast("double")
    return rows.select(
        *keep, "line_text", ticker.alias("ticker"), weight.alias("weight"),
        F.when(F.size("p") < 2, "expected ticker and weight").when(weight.isNull(), "weight is not a number")
        .when(~valid_ticker(ticker), "not a fund ticker").alias("error"),
    )
