"""Toxicity scores of deobfuscated texts.

**Noisy channel.**  A writer's letters reach us through a channel that swaps letters for look-alike signs, puts signs
between them, repeats them or spaces them out.  A word that shows such marks becomes a lattice of characters: each
place offers the letters that may stand behind the sign, leaving the sign out, or leaving a repetition out, each with
the channel's cost.  Viterbi's algorithm finds the path that is likeliest under a character trigram model and the
channel together, whatever the word's length; a sign that stands for no letter may also be a border of words joined
without a space.  Runs of single letters and look-alike signs are decoded with their gaps as optional word borders.  Words without marks
have one path and pass as they are.  Restored text is what gets scored.

**Scores.**  Evidence is a word or one of its beginnings (4 to 8 bytes).  What toxic training documents share is
counted exactly over the training documents; a piece of evidence gives the smoothed share of toxic documents among its
documents (a training document's own label left out).  A logistic model maps a document's two strongest words and its
number of words to a score.

Learns from all labelled training rows.  Labels meet their documents in a join by hash; a bitmap of ``BITS`` bits, a
fixed size, first tells most documents without a label, whose texts then stay where they are.  The logistic model's
sums are added up by tasks in whole numbers, so no order of rows changes them.  The evidence kept is at most
``MOST_EVIDENCE``.  Every document is scored over its whole text.

Defined cases: null and empty texts have no evidence and get the model's score for that; a null id counts as the empty
text for the split and has no label; several labels for an id count as toxic if one is; null labels are no labels; with
no training rows every score is 0; repeated rows get equal scores; an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline.llm.shared import stored, unused
from dragline.llm.words import SPACE, column_bytes, mixed, pieces, running, span_hashes, spans
from dragline.scale import settle

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
BITS = 1 << 24  # of the bitmap that tells documents that may have a label
MOST_EVIDENCE = 1 << 18
MIN_SUPPORT = 3  # toxic training documents that must share a piece of evidence
PRIOR = 10.0  # documents' worth of the overall share in each smoothed share
PREFIXES = (4, 5, 6, 7, 8)
# fixed values: letters behind look-alike signs
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c",
    "*": "aeiou",
}
#: Costs of the channel, natural logarithms.
SWAPPED, LEFT_OUT, LEFT_OUT_DIGIT, REPEATED, GAP = -2.0, -2.0, -8.0, -1.0, -0.5
_EDGE = "^"  # before the first and after the last letter
_LONGEST = 60  # letters of a word worth remembering; longer ones are restored anew each time
_RUN = re.compile(r"(.)\1\1+", re.DOTALL)
_KEEP = 1 << 17  # restored words remembered by a worker
_WHOLE = float(1 << 32)  # the sums of the logistic model are in these parts


def in_held_out_fold(key: str) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == HELD_OUT


# ---- noisy channel

@dataclass
class Letters:
    """Character trigrams, smoothed by bigrams and single letters."""

    counts: dict[str, int]  # of trigrams; words stand between edges

    def __post_init__(self) -> None:
        self.pairs, self.heads, self.ones, self.total = Counter(), Counter(), Counter(), 0
        for gram, n in self.counts.items():
            self.pairs[gram[1:]] += n
            self.ones[gram[2]] += n
            self.total += n
        self.contexts = Counter()
        for gram, n in self.counts.items():
            self.contexts[gram[:2]] += n
        for pair, n in self.pairs.items():
            self.heads[pair[0]] += n
        self.known: dict[str, float] = {}

    def log(self, gram: str) -> float:
        value = self.known.get(gram)
        if value is None:
            one = (self.ones[gram[2]] + 0.5) / (self.total + 0.5 * (len(self.ones) + 1))
            two = (self.pairs[gram[1:]] + 5 * one) / (self.heads[gram[1]] + 5)
            value = self.known[gram] = math.log((self.counts.get(gram, 0) + 5 * two) / (self.contexts[gram[:2]] + 5))
        return value


class Restorer:
    def __init__(self, letters: Letters) -> None:
        self.letters, self.memory = letters, {}

    def word(self, text: str, spaced: bool = False) -> str:
        """The likeliest text behind a marked word, or behind a run of single letters (``spaced``)."""
        if len(text) > _LONGEST:
            return self._decode(text, spaced)
        got = self.memory.get((text, spaced))
        if got is None:
            if len(self.memory) >= _KEEP:
                self.memory.clear()
            got = self.memory[text, spaced] = self._decode(text, spaced)
        return got

    def _decode(self, text: str, spaced: bool) -> str:
        log = self.letters.log
        runs = {i for m in _RUN.finditer(text) for i in range(*m.span())}  # a double letter is spelling
        paths = {(_EDGE * 2, ""): (0.0, None)}  # (last two letters, sign before) -> (weight, letters so far, linked)
        for i, sign in enumerate(text):
            here: dict = {}

            def offer(key, weight, trail, here=here):
                if key not in here or weight > here[key][0]:
                    here[key] = (weight, trail)

            for (last, before), (weight, trail) in paths.items():
                starts = [(last, weight, trail)]
                if spaced and i:  # the gap may be a border between words, or part of the disguise
                    border = weight + log(last + _EDGE)
                    starts = [(last, weight + GAP, trail), (_EDGE * 2, border, (trail, " "))]
                for last_, weight_, trail_ in starts:
                    if sign.isalpha():
                        offer((last_[1] + sign, sign), weight_ + log(last_ + sign), (trail_, sign))
                        if i in runs and sign == before and last_[1] == sign:
                            offer((last_, sign), weight_ + REPEATED, trail_)
                    else:
                        for letter in LOOKALIKES.get(sign, ""):
                            offer((last_[1] + letter, sign), weight_ + SWAPPED + log(last_ + letter), (trail_, letter))
                        offer((last_, sign), weight_ + (LEFT_OUT_DIGIT if sign.isdigit() else LEFT_OUT), trail_)
                        if not sign.isdigit() and sign not in LOOKALIKES and not spaced:  # it may join words
                            offer((_EDGE * 2, sign), weight_ + log(last_ + _EDGE), (trail_, " "))
            paths = here
        trail = max(((w + log(last + _EDGE), t) for (last, _), (w, t) in paths.items()), key=lambda x: x[0])[1]
        out = []
        while trail is not None:
            trail, letter = trail
            out.append(letter)
        return "".join(reversed(out))


_LETTER = np.array([97 <= c < 123 or c >= 0x80 for c in range(256)])
_SWAP = np.zeros(256, bool)
_SWAP[[ord(c) for c in LOOKALIKES if c.isascii()]] = True
_WIDE_SIGNS = [np.frombuffer(c.encode(), np.uint8) for c in LOOKALIKES if not c.isascii()]


def _wide_signs(data: np.ndarray) -> np.ndarray:
    """Whether a byte belongs to a look-alike sign of several bytes."""
    out = np.zeros(len(data), bool)
    for sign in _WIDE_SIGNS:
        at = np.flatnonzero(data[: max(len(data) - len(sign) + 1, 0)] == sign[0])
        for k in range(1, len(sign)):
            at = at[data[at + k] == sign[k]]
        for k in range(len(sign)):
            out[at + k] = True
    return out


def _singles(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a word is one character, a letter or a look-alike sign."""
    head, size = data[first], last - first
    out = (size == 1) & (_LETTER | _SWAP)[head]
    wide = np.flatnonzero((size > 1) & (size == np.where(head < 0xC0, 1, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, 4)))))
    for i in wide:
        sign = data[first[i] : last[i]].tobytes().decode(errors="replace")
        out[i] = sign.isalpha() or sign in LOOKALIKES
    return out


def marked_words(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Cores (first to last letter) of a piece's words, which words are marked, and runs of single letters and signs.

    Words without a letter have an empty core.  Marked: a sign between letters, a look-alike at the edge of a letter, or
    a letter three times in a row.
    """
    wide = _wide_signs(data)
    letter = _LETTER[data] & ~wide
    sums = np.r_[0, np.cumsum(letter)]
    places = np.flatnonzero(letter)
    n = sums[last] - sums[first]
    has = n > 0
    low, high = first.copy(), first.copy()
    low[has] = places[sums[first[has]]]
    high[has] = places[sums[last[has]] - 1] + 1
    marked = has & (sums[high] - sums[low] < high - low)
    swap = np.r_[_SWAP[data] | wide, False]
    signs = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    marked |= has & (low > first) & swap[low - 1]
    after = high < last
    # a sign behind the last letter: two at most stand for letters, more are decoration; "!" there is punctuation
    tail = swap[np.minimum(high, len(data))] & (np.r_[data, 0][np.minimum(high, len(data))] != ord("!"))
    marked |= has & after & tail & (signs[last] - signs[high] <= 2)
    if len(data) > 2:
        triple = np.flatnonzero((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] >= 97) & (data[2:] < 123))
        if len(triple) and len(first):
            of = np.searchsorted(first, triple, side="right") - 1
            marked[of[triple + 2 < last[of]]] = True
    single = _singles(data, first, last)
    edge = np.diff(np.r_[0, single.view(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= 3
    return low, high, marked, begin[long], end[long]


_WORDS = re.compile(r"[^\W\d_]+")


def _features(sums, first, last) -> np.ndarray:
    """Hashes of the spans and of their beginnings; 0 where a word is no longer than the beginning."""
    out = np.zeros((len(first), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = span_hashes(sums, first, last)
    for k, size in enumerate(PREFIXES, 1):
        fits = last - first > size
        out[fits, k] = mixed(span_hashes(sums, first[fits], first[fits] + size) + np.uint64(k))
    return out


def evidence(column: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(features, text number) of every word of the restored texts; the texts are lower case."""
    data, offsets = column_bytes(column)
    rows, texts, restored, of = [np.zeros((0, 1 + len(PREFIXES)), np.uint64)], [np.zeros(0, np.int64)], [], []
    for low_, piece, borders in pieces(data, offsets, SPACE):
        first, last = spans(piece, borders, SPACE)
        low, high, marked, begin, end = marked_words(piece, first, last)
        doc = np.searchsorted(offsets, first + low_, side="right") - 1
        clean = (high > low) & ~marked
        rows.append(_features(running(piece), low[clean], high[clean]))
        texts.append(doc[clean])
        raw = piece.tobytes()
        for i in np.flatnonzero(marked):
            word = raw[first[i] : last[i]].decode(errors="replace")
            restored.append(restorer.word(word))
            of.append(doc[i])
        for a, b in zip(begin, end, strict=True):
            for x, y in _one_text(doc, a, b):
                letters = b"".join(raw[first[k] : last[k]] for k in range(x, y)).decode(errors="replace")
                if y - x >= 3 and len(set(letters)) > 1 and any(map(str.isalpha, letters)):
                    restored.append(restorer.word(letters, spaced=True))
                    of.append(doc[x])
    if restored:
        more, numbers = [], []
        for text, n in zip(restored, of, strict=True):
            for word in _WORDS.findall(text):
                more.append(word.encode())
                numbers.append(n)
        joined = np.frombuffer(b" ".join(more), np.uint8)
        if len(more):
            size = np.fromiter(map(len, more), np.int64, len(more))
            last = np.cumsum(size + 1) - 1
            rows.append(_features(running(joined), last - size, last))
            texts.append(np.array(numbers, np.int64))
    return np.concatenate(rows), np.concatenate(texts)


def _one_text(doc: np.ndarray, a: int, b: int):
    cut = np.flatnonzero(np.diff(doc[a:b])) + a + 1
    edges = [a, *cut.tolist(), b]
    return zip(edges, edges[1:], strict=False)


# ---- learning

@dataclass
class Model:
    letters: dict[str, int]
    keys: np.ndarray  # sorted
    toxic: np.ndarray
    all: np.ndarray
    share: float
    weights: np.ndarray | None = None

    def strongest(self, features: np.ndarray, texts: np.ndarray, n: int, labels: np.ndarray | None = None) -> np.ndarray:
        """For each of ``n`` texts: the two strongest words and the number of words, as columns of a logistic model.

        ``labels`` are given for training texts, whose own part in the counts is taken out.
        """
        weight = np.full(len(features), -9.0)
        for column in features.T:
            at = np.minimum(np.searchsorted(self.keys, column), max(len(self.keys) - 1, 0))
            hit = (self.keys[at] == column) if len(self.keys) else np.zeros(len(column), bool)
            toxic, every = self.toxic[at[hit]].astype(float), self.all[at[hit]].astype(float)
            if labels is not None:
                toxic, every = toxic - labels[texts[hit]], every - 1
            p = (toxic + PRIOR * self.share) / (every + PRIOR)
            weight[hit] = np.maximum(weight[hit], np.log(p) - np.log1p(-p))
        out = np.full((n, 2), self.base())
        order = np.lexsort((features[:, 0], -weight, texts))
        order = order[weight[order] > -9.0]
        t, w, key = texts[order], weight[order], features[order, 0]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        out[t[first], 0] = np.maximum(w[first], self.base())
        other = np.ones(len(t), bool)
        if len(t):
            head = first[np.searchsorted(first, np.arange(len(t)), side="right") - 1]
            other = key != key[head]  # the second strongest is another word
        t, w = t[other], w[other]
        second = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        out[t[second], 1] = np.maximum(w[second], self.base())
        words = np.bincount(texts, minlength=n)
        return np.column_stack([np.ones(n), out, np.log1p(words)])

    def base(self) -> float:
        return float(np.log(self.share) - np.log1p(-self.share))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share if len(self.keys) else 0.0)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _batches(batches):
    for whole in batches:
        for begin in range(0, whole.num_rows, 1024):
            yield whole.slice(begin, 1024)


def _may_be_labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` without most of those that have no label: by a bit for each label's hash, in pages of 2^15 bits."""
    place = F.xxhash64("id").bitwiseAND(F.lit(BITS - 1)) + 1
    pages = known.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    # at most BITS / 8 bytes of pages
    return rows.withColumn("page", F.bitmap_bucket_number(place)).join(F.broadcast(pages), "page").filter(marked).select(*rows.columns)


def _training(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(body, toxic): all training rows that have a label."""
    known = settle(
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_held_out_fold("doc_id"))
        .groupBy(F.col("doc_id").cast(rows.schema["id"].dataType).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    # never as a broadcast, which few labels would be: shuffle and disk then grow with the input at every size
    return _may_be_labelled(rows.filter(~F.col("held_out")), known).join(known.hint("merge"), "id").select("body", "toxic")


def _trigrams(training: DataFrame) -> dict[str, int]:
    def run(batches):
        grams: Counter = Counter()
        for batch in _batches(batches):
            words: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words.update(set(text.split()))
            for raw, n in words.items():
                word = raw.decode(errors="replace")
                if word.isalpha() and all(c < "ƀ" for c in word):
                    padded = f"{_EDGE}{_EDGE}{word}{_EDGE}"
                    for i in range(len(word) + 1):
                        grams[padded[i : i + 3]] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    # letters below U+0180 only, so the number of trigrams is bounded
    return dict(training.select("body").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n")).collect())


def _each_once(features: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text) pairs."""
    flat, where = features.ravel(), np.repeat(texts, features.shape[1])
    where, flat = where[flat != 0], flat[flat != 0]
    order = np.lexsort((flat, where))
    where, flat = where[order], flat[order]
    new = np.r_[True, (flat[1:] != flat[:-1]) | (where[1:] != where[:-1])] if len(flat) else np.zeros(0, bool)
    return flat[new], where[new]


def _counted(training: DataFrame, letters: dict[str, int], only: np.ndarray | None) -> DataFrame:
    """(key, n): documents of ``training`` that hold each piece of evidence, or each of ``only``."""
    shared = training.sparkSession.sparkContext.broadcast((letters, only))

    def run(batches):
        letters, only = shared.value
        restorer, found = Restorer(Letters(letters)), []
        for batch in _batches(batches):
            keys, _ = _each_once(*evidence(batch.column(0), restorer))
            if only is not None:
                at = np.minimum(np.searchsorted(only, keys), max(len(only) - 1, 0))
                keys = keys[only[at] == keys] if len(only) else keys[:0]
            found.append(keys)
            if sum(map(len, found)) > 4_000_000:
                yield send(found)
                found = []
        if found:
            yield send(found)

    def send(found):
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return training.select("body").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, labels: DataFrame) -> Model:
    training = stored(_training(rows, labels), "toxic-training")
    counts = dict(training.groupBy("toxic").count().collect())
    total = sum(counts.values())
    if not counts.get(1):
        return Model({}, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1e-6)
    letters = _trigrams(training)
    shared_by = _counted(training.filter("toxic = 1"), letters, None).filter(F.col("n") >= MIN_SUPPORT)
    top = shared_by.orderBy(F.desc("n"), "key").limit(MOST_EVIDENCE).toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, toxic = keys[order], top["n"].to_numpy()[order]
    clean = np.zeros(len(keys), np.int64)
    found = _counted(training.filter("toxic = 0"), letters, keys).toArrow()  # at most MOST_EVIDENCE rows
    clean[np.searchsorted(keys, found["key"].to_numpy().view(np.uint64))] = found["n"].to_numpy()
    share = counts[1] / total
    model = Model(letters, keys, toxic, toxic + clean, min(max(share, 1e-6), 1 - 1e-6))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def columns(batches):
        restorer = Restorer(Letters(shared.value.letters))
        for batch in _batches(batches):
            y = batch.column(1).to_numpy().astype(np.int64)
            x = shared.value.strongest(*evidence(batch.column(0), restorer), batch.num_rows, y)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T[1:]), pa.array(y)], names=["a", "b", "c", "y"])

    model.weights = _logistic(stored(
        training.select("body", "toxic").mapInArrow(columns, "a double, b double, c double, y long"), "toxic-columns"))
    return model


def _logistic(data: DataFrame) -> np.ndarray:
    """Newton's method with a slight ridge over columns a, b, c and the label y."""

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            total = np.zeros(4 + 16, np.int64)
            for batch in batches:
                a, b, c, y = (batch.column(i).to_numpy().astype(float) for i in range(4))
                x = np.column_stack([np.ones(len(a)), a, b, c])
                p = 1 / (1 + np.exp(-np.clip((x * w).sum(axis=1), -30, 30)))
                part = np.column_stack([x * (y - p)[:, None], ((x * (p * (1 - p))[:, None])[:, :, None] * x[:, None, :]).reshape(-1, 16)])
                total += np.rint(part * _WHOLE).astype(np.int64).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(total)], names=["cell", "value"])

        found = data.mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect()
        out = np.zeros(20)
        for cell, value in found:
            out[cell] = float(value) / _WHOLE
        return out[:4], out[4:].reshape(4, 4)

    w = np.zeros(4)
    for _ in range(30):
        slope, bend = sums(w)
        step = np.linalg.solve(bend + 1e-3 * np.eye(4), slope - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---- scoring

def _scored(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        model, restorer = shared.value, None
        for batch in _batches(batches):
            restorer = restorer or Restorer(Letters(model.letters))
            if model.weights is None:
                score = np.zeros(batch.num_rows)
            else:
                score = model.scores(model.strongest(*evidence(batch.column(3), restorer), batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(score)], names=["id", "at", "held_out", "score"])

    return rows.select("id", "at", "held_out", "body").mapInArrow(
        run, f"id {kind}, at long, held_out boolean, score double")


def _rows(docs: DataFrame, key: str, text: str, at: Column) -> DataFrame:
    return docs.select(
        F.col(key).alias("id"), at.alias("at"), in_held_out_fold(key).alias("held_out"),
        F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("body"))


def score_table(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: held_out, score, predicted."""
    rows = _rows(docs, key, text, F.monotonically_increasing_id())
    scored = _scored(rows, train(rows, labels))
    return scored.select(
        F.col("id").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score stays under the threshold, with all their columns."""
    model = train(_rows(docs, key, text, F.lit(0)), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    body, kept = unused(docs, "body"), docs.columns

    def run(batches):
        model = shared.value
        restorer = Restorer(Letters(model.letters))
        for batch in _batches(batches):
            rows = batch.select(kept)
            if model.weights is not None:
                found = evidence(batch.column(batch.num_columns - 1), restorer)
                rows = rows.filter(pa.array(model.scores(model.strongest(*found, batch.num_rows)) < THRESHOLD))
            yield rows

    lowered = F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    return docs.withColumn(body, lowered).mapInArrow(run, docs.schema)
