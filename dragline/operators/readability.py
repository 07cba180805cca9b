"""Readability score of filing text: one narrow pass over the corpus, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline.functions import text as X
from dragline.functions.expr import readability_grade, rnd

# fixed values
WEIGHTS = {"readability": 0.30, "length": 0.15, "complexity": 0.20, "fragmentation": 0.15, "passive": 0.20}


def _clamp(x: Column, top: float = 100.0) -> Column:
    return F.greatest(F.least(x, F.lit(top)), F.lit(0.0))


def score(docs: DataFrame, key: str, text: str = "text", html: str | None = None, tag: str = "table") -> DataFrame:
    """Component scores (0-100), raw measures, overall score and grade per document.

    Documents under 20 characters, or without a sentence or word, score zero and get no grade.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    markup = F.col(html) if html else F.lit("")
    base = docs.select(key, t.alias("_t"), F.coalesce(markup, F.lit("")).alias("_h"))
    parsed = base.select(
        key, "_t", "_h", F.when(F.length("_t") >= 20, X.sentences(F.col("_t"))).otherwise(F.array().cast("array<string>")).alias("_s"),
        F.when(F.length("_t") >= 20, F.transform(X.words(F.col("_t")), X.syllables)).otherwise(F.array().cast("array<int>")).alias("_y"),
    )
    terms, spread = X.fee_term_spread(F.col("_t"))
    counts = parsed.select(
        key,
        F.size("_y").alias("word_count"), F.size("_s").alias("sentence_count"),
        F.aggregate("_y", F.lit(0), lambda a, y: a + y).alias("_syl"),
        F.size(F.filter("_y", lambda y: y >= 3)).alias("_complex"),
        F.size(F.filter("_s", X.is_passive)).alias("_passive"),
        F.length("_t").alias("_len"), terms.alias("_terms"), spread.alias("_spread"),
        F.regexp_count("_h", F.lit(X.FOOTNOTE)).alias("footnote_count"),
        F.regexp_count("_h", F.lit(X.CROSS_REFERENCE)).alias("cross_reference_count"),
        X.nesting_depth(F.col("_h"), tag).alias("nesting_depth"),
    )
    ok = (F.col("word_count") > 0) & (F.col("sentence_count") > 0)
    w, s = F.col("word_count").cast("double"), F.col("sentence_count").cast("double")
    when = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
    measured = counts.select(
        "*", ok.alias("_ok"),
        when(rnd(0.39 * (w / s) + 11.8 * (F.col("_syl") / w) - 15.59, 1)).alias("flesch_kincaid_grade"),
        when(rnd(0.4 * (w / s + 100 * (F.col("_complex") / w)), 1)).alias("gunning_fog_index"),
        when(rnd(F.col("_passive") / s * 100, 1)).alias("passive_voice_pct"),
        when(rnd(w / s, 4)).alias("avg_sentence_length"), when(rnd(F.col("_syl") / w, 4)).alias("avg_word_syllables"),
    )
    grade = (F.col("flesch_kincaid_grade") + F.col("gunning_fog_index")) / 2
    parts = measured.select(
        "*",
        when(rnd(_clamp((grade - 10) * 8.33), 1)).alias("readability_score"),
        when(F.when(w < 3000, 0.0).otherwise(rnd(_clamp((w - 3000) / 270), 1))).alias("length_score"),
        when(rnd(
            F.least(F.col("footnote_count") * 3.3, F.lit(33.0)) + F.least(F.col("cross_reference_count") * 5.5, F.lit(33.0))
            + F.least(F.col("nesting_depth") * 11.0, F.lit(34.0)), 1)).alias("complexity_score"),
        when(F.when(F.col("_terms") > 2, rnd(F.least(F.col("_spread") / F.col("_len") * 120, F.lit(100.0)), 1)).otherwise(0.0))
        .alias("fragmentation_score"),
        when(rnd(_clamp((F.col("passive_voice_pct") - 10) * 4), 1)).alias("passive_score"),
    )
    overall = sum((F.col(f"{n}_score") * x for n, x in WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("overall_score", when(rnd(overall, 1))).select(
        key,
        *[F.when(F.col("_ok"), F.col(c)).otherwise(0).alias(c) for c in
          ("word_count", "sentence_count", "footnote_count", "cross_reference_count", "nesting_depth")],
        "avg_sentence_length", "avg_word_syllables", "flesch_kincaid_grade", "gunning_fog_index", "passive_voice_pct",
        "readability_score", "length_score", "complexity_score", "fragmentation_score", "passive_score", "overall_score",
        F.when(F.col("_ok"), readability_grade(F.col("overall_score"))).otherwise("").alias("grade"),
    )
