"""Mixing documents to target domain weights, with soft membership.

**Posteriors.**  A table of labels names the domain of some documents.  One half of the training sample gives document
frequencies of hashed words in each domain, the other half fits a softmax model on those words' log-odds and on a few
shape features, so the model sees only words it was not counted on.  Every document gets a posterior over the domains.

**Rates.**  Document i has n_i tokens (words), b_i bytes and posterior p_i; rates r_i >= 0 shall make the expected domain
totals sum_i r_i n_i p_i equal the targets.  Among the rates that do, those with the least sum_i b_i (r_i - 1)^2 are
taken, so that few bytes are added or left out.  Projected gradient descent on the squared distance to the targets starts
from r = 1 and is lazy: gradients add up before they are projected, so after any steps r_i = max(0, 1 - n_i / b_i p_i s) with one
short vector s, no rate is stored, and the step that counts is the step of s.  Each step's metric is the sum of
n^2 / b p p' over the documents that are free at that point (tokens, and a rate above zero); one aggregation tries
``LENGTHS`` of the step at once, adding up distance, gradient and metric for each.  The distance weighs little
(``SOFT``) of the deviation, so it has one least point even where no rates reach the targets.  Steps end when the targets
are met, or when no length brings that point closer; the totals reached are returned with the rates and logged, as a
warning where they miss the targets.

A rate is realised as floor(rate + u) copies, u uniform by a hash of id and text.

The training sample is at most about ``TRAIN_ROWS`` labelled rows, by hash of the id (all where there are fewer).
Defined cases: null, empty and other texts without tokens cannot help any target and keep rate 1; null ids
have no label; an id with several labels takes the largest domain; null labels are no labels; with no training rows
every posterior is equal; domains beyond the reach of any rates are matched as closely as rates allow; repeated
rows get equal rates; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 used as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline.llm.shared import stored, unused
from dragline.llm.words import PUNCTUATION, column_bytes, pieces, running, span_hashes, spans
from dragline.scale import settle

TRAIN_ROWS = 100_000
SLOTS = 1 << 18
TOLERANCE = 1e-6  # of the tokens wanted
SOFT = 1e-9
LENGTHS = 0.5 ** np.arange(12)
_PIECE = 32 << 20  # bytes of repeated rows handed on at once
_COPIES = 1 << 16  # rows numbered at once
_log = logging.getLogger(__name__)
_SLOT = np.uint64(64 - 18)
_SHAPES = 8
_UPPER, _DIGIT, _LINE = (np.array([a <= c <= b for c in range(256)]) for a, b in ((65, 90), (48, 57), (10, 10)))


# ---- features

def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their texts, and per text: bytes, upper-case letters, digits, signs, line ends."""
    data, offsets = column_bytes(column)
    words, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, piece, borders in pieces(data, offsets, PUNCTUATION):
        first, last = spans(piece, borders, PUNCTUATION)
        words.append(span_hashes(running(piece), first, last))
        texts.append(np.searchsorted(offsets, first + low, side="right") - 1)
    kinds = [np.diff(offsets)]
    for kind in (_UPPER, _DIGIT, PUNCTUATION, _LINE):
        kinds.append(np.diff(np.r_[0, np.cumsum(kind[data])][offsets]))
    return np.concatenate(words), np.concatenate(texts), np.column_stack(kinds)


def _distinct(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((words, texts))
    words, texts = words[order], texts[order]
    new = np.r_[True, (words[1:] != words[:-1]) | (texts[1:] != texts[:-1])] if len(words) else np.zeros(0, bool)
    return words[new], texts[new]


def features(column: pa.Array, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text (a row each) and its number of words.  ``odds``: domains x slots."""
    n, k = len(column), len(odds)
    words, texts, kinds = _words(column)
    count = np.bincount(texts, minlength=n)
    repeats = np.bincount(texts[1:][(words[1:] == words[:-1]) & (texts[1:] == texts[:-1])], minlength=n) if n else count
    each, of = _distinct(words, texts)
    types = np.bincount(of, minlength=n)
    size, more = np.maximum(kinds[:, 0], 1), np.maximum(count, 1)
    out = np.zeros((n, _SHAPES + 2 * k))
    out[:, 0] = 1
    out[:, 1] = np.log1p(count) / 5
    out[:, 2] = types / more
    out[:, 3] = repeats / more
    out[:, 4:8] = kinds[:, 1:] / size[:, None] * 5
    slot = (each >> _SLOT).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    for d in range(k):
        w = odds[d][slot].astype(float)
        out[:, _SHAPES + d] = np.bincount(of, w, minlength=n) / np.maximum(types, 1)
        if len(begin):
            out[of[begin], _SHAPES + k + d] = np.maximum.reduceat(w, begin)
    return out, count


# ---- classifier

@dataclass
class Classifier:
    odds: np.ndarray  # domains x slots, log-odds of a word's presence
    weights: np.ndarray  # features x domains

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _training(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(body, domain, half): the training sample; its ids are broadcast, at most about TRAIN_ROWS of them."""
    known = settle(labels.filter(F.col("doc_id").isNotNull() & F.col("domain").isNotNull())
                   .groupBy(F.col("doc_id").alias("id")).agg(F.max("domain").cast("int").alias("domain")))
    share = min(1.0, TRAIN_ROWS / max(known.count(), 1))
    mix = F.xxhash64("id", F.lit("mixing"))
    sample = known.filter(F.pmod(mix, F.lit(1 << 20)) < int(share * (1 << 20))).withColumn(
        "half", F.pmod(F.shiftright(mix, 21), F.lit(2)).cast("int"))
    return stored(rows.join(F.broadcast(sample), "id").select("body", "domain", "half"), "mixing-training")


def _word_odds(training: DataFrame, k: int) -> np.ndarray:
    """Log-odds of words' presence in a domain's documents against all others'."""

    def count(batches):
        total = np.zeros((k, SLOTS + 1), np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                domain = batch.column(1).to_numpy(zero_copy_only=False)
                words, texts, _ = _words(batch.column(0))
                slot, of = _distinct(words >> _SLOT, texts)
                for d in range(k):
                    total[d, :SLOTS] += np.bincount(slot[domain[of] == d].astype(np.int64), minlength=SLOTS)
                    total[d, SLOTS] += int((domain == d).sum())
        for d in range(k):
            used = np.flatnonzero(total[d])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), d, np.int32)), pa.array(used.astype(np.int32)), pa.array(total[d, used])],
                names=["domain", "slot", "n"])

    counts = np.zeros((k, SLOTS + 1))
    rows = training.filter("half = 0").select("body", "domain").mapInArrow(count, "domain int, slot int, n long")
    for d, slot, n in rows.groupBy("domain", "slot").agg(F.sum("n")).toLocalIterator():  # at most domains x slots rows
        counts[d, slot] = n
    docs, words = counts[:, SLOTS], counts[:, :SLOTS]
    inside = np.log((words + 0.5) / (docs[:, None] + 1))
    outside = np.log((words.sum(axis=0) - words + 0.5) / (docs.sum() - docs[:, None] + 1))
    return np.where(words.sum(axis=0) >= 3, inside - outside, 0.0).astype(np.float32)


def _softmax(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Newton's method with a ridge."""
    f, target = x.shape[1], np.eye(k)[y]
    w = np.zeros((f, k))
    for _ in range(25):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (target - p) - 0.1 * w
        bend = 0.1 * np.eye(f * k)
        for a in range(k):
            for b in range(a, k):
                block = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                bend[a * f : (a + 1) * f, b * f : (b + 1) * f] += block
                if a != b:
                    bend[b * f : (b + 1) * f, a * f : (a + 1) * f] += block.T
        step = np.linalg.solve(bend, slope.T.ravel()).reshape(k, f).T
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: DataFrame, labels: DataFrame, k: int) -> Classifier:
    training = _training(rows, labels)
    odds = _word_odds(training, k)
    shared = rows.sparkSession.sparkContext.broadcast(odds)
    width = _SHAPES + 2 * k

    def columns(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                x, _ = features(batch.column(0), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    # at most about TRAIN_ROWS / 2 short rows
    fit = training.filter("half = 1").select("body", "domain").mapInArrow(columns, "x array<double>, y int").collect()
    if not fit:
        return Classifier(odds, np.zeros((width, k)))
    x, y = np.array([r[0] for r in fit]), np.array([r[1] for r in fit])
    order = np.lexsort((*x.T, y))
    return Classifier(odds, _softmax(x[order], y[order], k))


def posteriors(rows: DataFrame, model: Classifier) -> DataFrame:
    """(id, even, n, size, p) for rows of id, even and body; ``size``: bytes of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                x, n = features(batch.column(2), shared.value.odds)
                p = shared.value.posteriors(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n), pa.compute.binary_length(batch.column(2)).cast(pa.int64()),
                     pa.array(list(p), pa.list_(pa.float64()))], names=["id", "even", "n", "size", "p"])

    kind = rows.schema["id"].dataType.simpleString()
    return settle(rows.select("id", "even", "body").mapInArrow(run, f"id {kind}, even double, n long, size long, p array<double>"))


# ---- rates

def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, k)


@dataclass
class Fit:
    """Summed steps, the expected totals that their rates reach, and the bytes that these rates stand for."""

    steps: np.ndarray
    totals: np.ndarray
    size: float
    passes: int


def rates_of(n: np.ndarray, size: np.ndarray, p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of documents after all steps; 1 for a text without tokens."""
    return np.maximum(1.0 - n / np.maximum(size, 1) * (p @ steps), 0.0)


def evaluated(n: np.ndarray, size: np.ndarray, p: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """For each of the ``tried`` sums of steps: sum b r^2 / 2, sum b r, totals sum n r p, metric sum n^2 / b p p' over r > 0."""
    use = n > 0
    n, size, p = n[use].astype(float), np.maximum(size[use], 1).astype(float), p[use]
    out = []
    for s in tried:
        r = rates_of(n, size, p, s)
        metric = p.T @ (p * (n * n / size * (r > 0))[:, None])
        out.append(np.r_[(size * r * r).sum() / 2, (size * r).sum(), (n * r) @ p, metric.ravel()])
    return np.array(out)


def _sums(members: DataFrame, tried: np.ndarray) -> np.ndarray:
    """``evaluated`` over all documents, added up in the order of partitions."""
    k = tried.shape[1]

    def run(batches):
        total = np.zeros((len(tried), 2 + k + k * k))
        for batch in batches:
            if batch.num_rows:
                n, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                total += evaluated(n, size, _matrix(batch.column(2), k), tried)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["total"])

    parts = members.select("n", "size", "p").mapInArrow(run, "total array<double>").select("total", F.spark_partition_id()).collect()
    ordered = [r[0] for r in sorted(parts, key=lambda r: r[1])]
    return np.array([math.fsum(part[i] for part in ordered) for i in range(len(tried) * (2 + k + k * k))]).reshape(len(tried), -1)


def fit_rates(members: DataFrame, targets: np.ndarray) -> Fit:
    """Rates that bring the expected domain totals to ``targets`` (tokens), or as close as rates can."""
    return descend(lambda tried: _sums(members, tried), np.asarray(targets, float))


def descend(sums, targets: np.ndarray) -> Fit:
    """``fit_rates`` by a function that gives the sums of ``evaluated`` for an array of tried sums of steps."""
    k = len(targets)
    unit = max(float(targets.sum()), 1.0)
    at, here, passes = np.zeros(k), sums(np.zeros((1, k)))[0], 1
    square = here[2 + k:].reshape(k, k)
    soft = SOFT * (square + 1e-6 * max(float(np.trace(square)), 1e-300) * np.eye(k))  # of all documents

    def value(s, row):  # convex in s; its least point is the least distance
        return row[0] + targets @ s + s @ soft @ s / 2

    while True:
        away = here[2:2 + k] - targets
        slope = soft @ at - away
        if np.abs(away).max() <= TOLERANCE * unit:
            break
        step = -np.linalg.solve(here[2 + k:].reshape(k, k) + soft, slope)
        tried = at + LENGTHS[:, None] * step
        rows, passes = sums(tried), passes + 1
        values = [value(s, row) for s, row in zip(tried, rows, strict=True)]
        best = int(np.argmin(values))
        near = values[best] >= value(at, here) - 1e-13 * abs(value(at, here))  # sums cannot tell the two apart
        if near:
            slopes = [np.abs(soft @ s - row[2:2 + k] + targets).max() for s, row in zip(tried, rows, strict=True)]
            best = int(np.argmin(slopes))
            if slopes[best] > 0.5 * np.abs(slope).max():
                break
        at, here = tried[best], rows[best]
    met = np.abs(here[2:2 + k] - targets).max() <= TOLERANCE * unit
    _log.log(logging.INFO if met else logging.WARNING, "domain totals %s of targets %s after %d passes, %.0f bytes",
             here[2:2 + k].tolist(), targets.tolist(), passes, here[1])
    return Fit(at, here[2:2 + k], float(here[1]), passes)


def _even(key: Column, text: Column) -> Column:
    """A number in [0, 1) from a row's id and text."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("copies"), text), 11) / F.lit(float(1 << 53))


def _fitted(rows: DataFrame, labels: DataFrame, shares: tuple[float, ...], tokens: float | None):
    k = len(shares)
    model = train(rows, labels, k)
    members = posteriors(rows, model)
    if tokens is None:
        tokens = float(members.agg(F.sum("n")).first()[0] or 0)
    return model, members, fit_rates(members, tokens * np.array(shares) / sum(shares))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), _even(F.col(key), F.col(text)).alias("even"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))


def rate_table(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...], tokens: float | None = None,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_tokens, posterior (array), rate and copies.

    ``labels``: doc_id and domain (from 0).  Domain k gets the share ``shares[k]`` of ``tokens`` (default: as many as now).
    """
    _, members, fit = _fitted(_rows(docs, key, text), labels, shares, tokens)

    def run(batches):
        for batch in batches:
            n, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            r = rates_of(n, size, _matrix(batch.column(4), len(shares)), fit.steps) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=["id", "even", "n", "size", "p", "rate"])

    kind = members.schema["id"].dataType.simpleString()
    out = members.select("id", "even", "n", "size", "p").mapInArrow(
        run, f"id {kind}, even double, n long, size long, p array<double>, rate double")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_tokens"), F.col("p").alias("posterior"), "rate",
                      F.floor(F.col("rate") + F.col("even")).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...], tokens: float | None = None,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each row as many times as its rate realises."""
    model, _, fit = _fitted(_rows(docs, key, text), labels, shares, tokens)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    even, body, kept = unused(docs, "even"), unused(docs, "body"), docs.columns

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                x, n = features(batch.column(batch.num_columns - 1), shared.value.odds)
                rows, size = batch.select(kept), pa.compute.binary_length(batch.column(batch.num_columns - 1)).to_numpy()
                rate = rates_of(n, size, shared.value.posteriors(x), fit.steps)
                copies = np.floor(rate + batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)).astype(np.int64)
                ends = np.cumsum(copies)
                for done in range(0, int(ends[-1]) if len(ends) else 0, _COPIES):
                    order = np.searchsorted(ends, np.arange(done, min(done + _COPIES, int(ends[-1]))), side="right")
                    piece = np.cumsum(size[order]) // _PIECE
                    for begin in np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]):
                        yield rows.take(pa.array(order[begin : np.searchsorted(piece, piece[begin], side="right")]))

    filled = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({even: _even(F.col(key), F.col(text)), body: filled}).mapInArrow(run, docs.schema)
