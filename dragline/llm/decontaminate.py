"""Benchmark decontamination by spaced seeds.

A mask of ones and zeros is laid over the words at every position; the words under ones are hashed, those under zeros
are ignored, so a substituted word there does not hide the match.  Seeds of the benchmark and of the documents are
joined by hash; around each hit the two texts are aligned on its diagonal and the best-scoring stretch (a matching word
+1, a differing word -1) is verified: at least ``MIN_MATCH`` equal words (or the whole item, if shorter) and at least
``MIN_IDENTITY`` of the words in the stretch.  If it fails, the stretch of that identity with the most equal words is
taken, so a diagonal is given up only when none of its stretches passes.

Document seeds meet a bitmap of benchmark seeds first (``BITS`` bits, whatever the benchmark's size, so its broadcast
is bounded); only hits leave the scan, with the words around them.  The exact join decides, so a full bitmap costs time,
not results.

Words: lower case, parted by white space and ASCII punctuation.  Defined cases: null and empty texts match nothing;
items under ``MIN_WORDS`` words are not searched; equal items count as the one with the smallest id (null ids last);
repeated document rows are reported alike; an empty table on either side gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dragline.llm.shared import content_keys, unused
from dragline.llm.words import PUNCTUATION, mixed, word_hashes
from dragline.scale import settle

#: Care positions: together they survive a substitution at every third, fourth or fifth word, whatever its phase.
MASKS = ("11111", "1101011", "101100101", "11001101")
MIN_WORDS = 5
MIN_MATCH = 10
MIN_IDENTITY = 0.65
_EQUAL, _DIFFERENT = 7, 13  # a stretch has MIN_IDENTITY if 7 for an equal word less 13 for a differing one is not negative
BITS = 1 << 26
_PAGE = 1 << 15  # bits in one row of Spark's bitmap functions


def seed_keys(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The mask's hash at every position where it fits (int64)."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = np.full(n, number + 1, np.uint64)
        for k, care in enumerate(mask):
            if care == "1":
                key = key * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mixed(key).view(np.int64)


def _lowered(text: str):
    return F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words, n): distinct items of enough words; ``words`` are the hashes as bytes."""

    def run(batches):
        for batch in batches:
            hashes, starts = word_hashes(batch.column(1), PUNCTUATION)
            cut = [hashes[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cut, pa.binary()), pa.array(np.diff(starts), pa.int64())],
                names=["item", "words", "n"])

    rows = benchmark.select(F.col(key).alias("item"), _lowered(text).alias("body"))
    cut = rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, words binary, n long")
    return settle(cut.filter(F.col("n") >= MIN_WORDS).groupBy("words", "n").agg(F.min("item").alias("item")))


def _seeds(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for item, words in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                hashes = np.frombuffer(words, np.uint64)
                for number, mask in enumerate(MASKS):
                    keys = seed_keys(hashes, mask, number)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array([item.as_py()] * len(keys), batch.schema.field(0).type),
                         pa.array(np.arange(len(keys)))], names=["key", "item", "item_pos"])

    kind = items.schema["item"].dataType.simpleString()
    return items.select("item", "words").mapInArrow(run, f"key long, item {kind}, item_pos long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit for each of ``BITS`` values of a seed; at most BITS / 8 bytes reach the driver."""
    place = F.pmod(F.col("key"), F.lit(BITS)) + 1  # Spark's bit positions begin at 1
    pages = seeds.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for page, bits in pages.collect():
        out[(page - 1) * _PAGE // 8 :][: _PAGE // 8] = np.frombuffer(bits, np.uint8)
    return out


def _regions(docs: DataFrame, seeds: DataFrame, longest: int) -> DataFrame:
    """(id, at, start, words, hits): stretches of a document around seeds in the bitmap."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    hit_type = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64())]))

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            hashes, starts = word_hashes(batch.column(2), PUNCTUATION)
            where, keys = [], []
            for number, mask in enumerate(MASKS):
                key = seed_keys(hashes, mask, number)
                place = (key & (BITS - 1)).astype(np.int64)
                hit = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                doc = np.searchsorted(starts, hit, side="right") - 1
                whole = hit + len(mask) <= starts[doc + 1]  # seeds do not reach into the next text
                where.append(hit[whole])
                keys.append(key[hit[whole]])
            pos, key = np.concatenate(where), np.concatenate(keys)
            if not len(pos):
                continue
            order = np.argsort(pos, kind="stable")
            pos, key = pos[order], key[order]
            doc = np.searchsorted(starts, pos, side="right") - 1
            new = np.flatnonzero(np.r_[True, (np.diff(doc) > 0) | (np.diff(pos) > longest)])
            rows: list[tuple] = []
            for a, b in zip(new, np.r_[new[1:], len(pos)], strict=True):
                d = int(doc[a])
                low = max(int(starts[d]), int(pos[a]) - longest)
                high = min(int(starts[d + 1]), int(pos[b - 1]) + longest)
                origin = int(starts[d])
                rows.append((d, low - origin, hashes[low:high].tobytes(),
                             [{"key": int(k), "pos": int(p) - origin} for k, p in zip(key[a:b], pos[a:b], strict=True)]))
            docs_of, start, words, hits = zip(*rows, strict=True)
            take = pa.array(docs_of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int64()),
                 pa.array(words, pa.binary()), pa.array(hits, hit_type)], names=["id", "at", "start", "words", "hits"])

    kind = docs.schema["id"].dataType.simpleString()
    return settle(docs.mapInArrow(
        run, f"id {kind}, at long, start long, words binary, hits array<struct<key:long,pos:long>>"))


def most_equal(same: np.ndarray) -> tuple[int, int]:
    """The stretch of at least MIN_IDENTITY with the most equal words, then the shortest, then the first."""
    score, count = np.r_[0, np.cumsum(np.where(same, _EQUAL, -_DIFFERENT))], np.r_[0, np.cumsum(same)]
    # the farthest begin for each end: the first place whose score is no higher
    begin = np.minimum(np.searchsorted(-np.minimum.accumulate(score), -score), np.arange(len(score)))
    places = np.flatnonzero(same)  # differing words at either end go
    first, last = places[np.minimum(count[begin], len(places) - 1)], places[np.maximum(count - 1, 0)] + 1
    equal = count - count[begin]
    best = np.lexsort((first, last - first, -equal))[0]
    return int(first[best]), int(last[best])


def _verified(pairs: DataFrame) -> DataFrame:
    """Best stretch on the diagonal of each row of (id, at, start, words, item, item_words, diagonal)."""

    def run(batches):
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            good, matched, length, begin, n_words = [], [], [], [], []
            for i in range(batch.num_rows):
                words = np.frombuffer(c["words"][i].as_buffer(), np.uint64)
                item = np.frombuffer(c["item_words"][i].as_buffer(), np.uint64)
                start, diagonal = c["start"][i].as_py(), c["diagonal"][i].as_py()
                low = max(0, start - diagonal)
                high = min(len(item), start + len(words) - diagonal)
                same = item[low:high] == words[low + diagonal - start : high + diagonal - start]
                if not same.any():
                    continue
                total = np.r_[0, np.cumsum(np.where(same, 1, -1))]
                end = int(np.argmax(total - np.minimum.accumulate(total)))
                first = int(np.argmin(total[: end + 1]))
                equal, enough = int(same[first:end].sum()), min(MIN_MATCH, len(item))
                if equal < enough or equal < MIN_IDENTITY * (end - first):
                    first, end = most_equal(same)
                    equal = int(same[first:end].sum())
                if equal >= enough and equal >= MIN_IDENTITY * (end - first):
                    good.append(i)
                    matched.append(equal)
                    length.append(end - first)
                    begin.append(low + first + diagonal)
                    n_words.append(len(item))
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [c["id"].take(take), c["at"].take(take), c["item"].take(take),
                 *(pa.array(x, pa.int64()) for x in (n_words, matched, length, begin))],
                names=["id", "at", "item", "item_words", "matched_words", "overlap_words", "first_word"])

    kinds = {name: pairs.schema[name].dataType.simpleString() for name in ("id", "item")}
    return pairs.mapInArrow(run, f"id {kinds['id']}, at long, item {kinds['item']}, item_words long, matched_words long, "
                                 "overlap_words long, first_word long")


def overlaps(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps of (id, at, body) rows with benchmark items: the best one of each row and item."""
    items = _items(benchmark, item_key, item_text)
    seeds = settle(_seeds(items))
    longest = items.agg(F.max("n")).first()[0] or 0
    regions = _regions(docs, seeds, longest)
    hits = regions.select("at", "start", F.inline("hits")).join(seeds, "key").select(
        "at", "start", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    pairs = hits.join(regions.select("id", "at", "start", "words"), ["at", "start"]).join(
        items.select("item", F.col("words").alias("item_words")), "item")
    wide = pairs.select("id", "at", "start", "words", "item", "item_words", "diagonal")
    best = F.max(F.struct("matched_words", (-F.col("overlap_words")).alias("less"), (-F.col("first_word")).alias("early"),
                          "item_words", "id"))
    return _verified(wide).groupBy("at", "item").agg(best.alias("b")).select(
        F.col("b.id").alias("id"), "at", "item", F.col("b.item_words").alias("item_words"),
        F.col("b.matched_words").alias("matched_words"), (-F.col("b.less")).alias("overlap_words"),
        (-F.col("b.early")).alias("first_word"))


def leak_table(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each contaminated document and benchmark item: where they overlap and in how many words."""
    rows = docs.select(
        F.col(key).alias("id"), F.monotonically_increasing_id().alias("at"), _lowered(text).alias("body"))
    return overlaps(rows, benchmark).select(
        F.col("id").alias(key), F.col("item").alias("item_id"), "item_words", "matched_words", "overlap_words", "first_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that overlap with no benchmark item, with all their columns."""
    a, b = unused(docs, "key_a"), unused(docs, "key_b")
    one, two = content_keys(key, text)
    found = overlaps(docs.select(two.alias("id"), one.alias("at"), _lowered(text).alias("body")), benchmark)
    leaks = settle(found.select(F.col("at").alias(a), F.col("id").alias(b)).distinct())
    return docs.withColumns({a: one, b: two}).join(leaks, [a, b], "left_anti").select(*docs.columns)
