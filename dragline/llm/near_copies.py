"""One document of each group of near copies: word shingles of five words, Jaccard similarity of 0.8 or more.

Candidates come from two places.  SimHash fingerprints of the shingles link by the pigeonring chains of ``simhash``; at a
similarity of 0.8 fingerprints differ in about 10 of 64 bits, though, and no chain of segments that is selective enough
for a join key reaches that far.  So a text's shingles (a set of n) are put into one order for all texts, rare ones first
(counts of hashed shingles in a table of fixed size, then the hash), and each of the first n/5 + 1 is a key: two texts at
0.8 or more share a key, whatever the order, and from the first key they share (places i and j) the sets have
min(n - i, m - j) shingles in common at most.  No pair is left out.

A key's texts are first compared with its least and its greatest member, which joins large groups of near copies at two
rows a text.  Then every pair of a key's texts that still lie in different groups, and whose sizes and places allow the
similarity, is compared; texts of popular keys are dealt out as pairs of parts of about ``PART``.  There a bitmap comes
before the sets: a text's shingles are dealt over ``BITS`` places, and a bit is one where their number is odd.  Bits that
differ are no more than the shingles that only one of two texts has, so pairs with too many of them leave the join there.

Every candidate pair is checked on its whole shingle sets (40 bits a shingle); documents that are linked, however far,
are a group, of which the row with the smallest id stays.

Defined cases: A-Z are lower-cased, words parted by ASCII white space; a text of fewer words is one shingle; texts
without words, nulls included, are equal to each other; null ids come last; of rows that repeat id and text one stays;
an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline.llm.components import roots
from dragline.llm.line_dedup import SLOTS, rarity, slot_counts
from dragline.llm.shared import content_keys, giving_back, stored, unused
from dragline.llm.simhash import links
from dragline.llm.words import column_bytes, mixed, word_hashes
from dragline.scale import settle

SHINGLE = 5
SIMILARITY = 0.8
PART = 2048
BITS = 512  # of a text's bitmap; tells pairs of up to about a thousand shingles apart
_SLICE = 1 << 22  # bytes of text at once
_WIDTH = 5  # bytes of a shingle in a set
_CUT = np.uint64(64 - 8 * _WIDTH)
_SLOT = np.uint64(8 * _WIDTH - (SLOTS - 1).bit_length())  # a shingle's slot is the head of its bytes
_TEXTS = 1 << 12  # whose bitmaps are made at once
_DOC, _RANK = np.uint64(48), np.uint64(40)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        block = column_bytes(batch.column(column))[1][:-1] // _SLICE
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]).tolist()
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(b, e - b)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and where each text's shingles begin (one entry more than texts)."""
    words, begin = word_hashes(column)
    count = np.diff(begin)
    with np.errstate(over="ignore"):
        value = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            value = mixed(value * _STEP + words[j : j + len(value)])
        n = np.maximum(count - SHINGLE + 1, 0)
        whole = np.repeat(begin[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = value[whole]
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            n[short] = 1
            ends = np.r_[0, np.cumsum(n)]
            out = np.empty(ends[-1], np.uint64)
            mask = np.ones(len(out), bool)
            mask[ends[short]] = False
            out[mask] = found
            for i in short.tolist():
                one = np.uint64(int(count[i]))
                for w in words[begin[i] : begin[i + 1]]:
                    one = mixed(one * _STEP + w)
                out[ends[i]] = one
            return out, ends
    return found, np.r_[0, np.cumsum(n)]


def sketch(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SimHash fingerprint of each text."""
    n = np.diff(begin)
    some = np.flatnonzero(n)
    at = begin[:-1][some]
    fp = np.zeros(len(n), np.uint64)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at)
            fp[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
    return fp


def prefixes(hashes: np.ndarray, begin: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The size of each text's set, the keys of its prefix in order, where each text's keys begin, and its bitmap."""
    sizes, keys, posts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bitmaps = [np.zeros(0, np.int64)]
    for low in range(0, len(begin) - 1, 1 << 16):  # a text's number has 16 bits
        ends = begin[low : low + (1 << 16) + 1]
        member = hashes[ends[0] : ends[-1]] >> _CUT
        of = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
        rank = classes[(member >> _SLOT).astype(np.int64)].astype(np.uint64)
        all_ = np.sort((of << _DOC) | (rank << _RANK) | member)
        all_ = all_[np.r_[True, all_[1:] != all_[:-1]]] if len(all_) else all_
        of = (all_ >> _DOC).astype(np.int64)
        size = np.bincount(of, minlength=len(ends) - 1)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        # n - ceil(0.8 n) + 1 shingles
        taken = np.where(size > 0, size - (4 * size + 4) // 5 + 1, 0)
        keys.append((all_ & np.uint64((1 << 40) - 1))[place < taken[of]].astype(np.int64))
        sizes.append(size)
        posts.append(taken)
        edges = np.r_[0, np.cumsum(size)]
        for first in range(0, len(size), _TEXTS):
            last = min(first + _TEXTS, len(size))
            cell = slice(edges[first], edges[last])
            at = (of[cell] - first) * BITS + (all_[cell] & np.uint64(BITS - 1)).astype(np.int64)
            odd = (np.bincount(at, minlength=(last - first) * BITS) & 1).astype(np.uint8)
            bitmaps.append(np.packbits(odd, bitorder="little").view(np.int64))
    return np.concatenate(sizes), np.concatenate(keys), np.r_[0, np.cumsum(np.concatenate(posts))], np.concatenate(bitmaps)


def _shingle_slots(column: pa.Array) -> Iterator[np.ndarray]:
    for part in _slices(pa.record_batch([column], names=["body"]), 0):
        yield (shingles(part.column(0))[0] >> _CUT >> _SLOT).astype(np.int64)


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, a, b, t, fp, size, prefix, bits): a and b name a row by its content, t its text."""
    one, two = content_keys(key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    counted = slot_counts(docs.select(body.cast("binary").alias("body")), _shingle_slots)
    classes = docs.sparkSession.sparkContext.broadcast(rarity(counted))

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole, 4)):
            hashes, begin = shingles(batch.column(4))
            size, keys, posts, bitmaps = prefixes(hashes, begin, classes.value)
            prefix = pa.ListArray.from_arrays(pa.array(posts, pa.int32()), pa.array(keys))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (BITS // 64), pa.int32()), pa.array(bitmaps))
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(sketch(hashes, begin).view(np.int64)), pa.array(size, pa.int64()), prefix, bits],
                names=["id", "a", "b", "t", "fp", "size", "prefix", "bits"])

    rows = docs.select(F.col(key).alias("id"), one.alias("a"), two.alias("b"), F.xxhash64(body, F.lit("copy")).alias("t"), body.cast("binary").alias("body"))
    kind = docs.schema[key].dataType.simpleString()
    return stored(
        rows.mapInArrow(giving_back(run), f"id {kind}, a long, b long, t long, fp long, size long, prefix array<long>, bits array<long>"), "sketches")


def _posted(sketched: DataFrame) -> DataFrame:
    """(key, t, size, place, low, high) of each key that several texts post; low and high are its ends."""
    post = F.struct("t", "size", "place")
    of_key = Window.partitionBy("key")
    rows = sketched.dropDuplicates(["t"]).select("t", "size", F.posexplode("prefix").alias("place", "key"))
    ends = rows.withColumns({"low": F.min(post).over(of_key), "high": F.max(post).over(of_key)})
    return stored(ends.filter("low.t < high.t"), "shingle-posts")


def _may_link(a: Column, b: Column) -> Column:
    """Whether sets can be similar enough that first share a key at these places (structs with size and place)."""
    n, m = a["size"], b["size"]
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * F.least(n - a["place"], m - b["place"]) >= 4 * (n + m))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("t <> o").select(F.greatest("t", "o").alias("u"), F.least("t", "o").alias("v")).distinct()


def candidates(sketched: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """(u, v), u > v: pairs of texts to compare first."""
    posted = _posted(sketched) if posted is None else posted
    ends = (
        posted.withColumn("own", F.struct("size", "place")).withColumn("end", F.explode(F.array("low", "high")))
        .filter(_may_link(F.col("own"), F.col("end"))).select("t", F.col("end.t").alias("o")))
    fps = sketched.groupBy("fp").agg(F.min_by("t", "size").alias("low"))  # texts without words meet one of their own
    equal = sketched.select("t", "fp").distinct().join(fps, "fp").select("t", F.col("low").alias("o"))
    near = links(fps.select("fp"))
    a, b = (fps.select(F.col("fp").alias(c), F.col("low").alias(t)) for c, t in (("a", "t"), ("b", "o")))
    ring = near.join(a, "a").join(b, "b").select("t", "o")
    return _ordered(ends.union(equal).union(ring))


def _bits_allow(a: Column, b: Column) -> Column:
    """Whether bitmaps differ in no more bits than similar sets may have shingles apart: a ninth of both sizes."""
    apart = sum((F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(BITS // 64)), F.lit(0))
    return 9 * apart <= a["size"] + b["size"]


def between_groups(posted: DataFrame, joined: DataFrame, sketched: DataFrame | None = None) -> DataFrame:
    """(u, v), u > v: all pairs of texts of different groups that share a key and may be similar enough.

    ``sketched`` has the bitmaps of the texts; without it only sizes and places are looked at.
    """
    rows = posted.join(joined.withColumnRenamed("node", "t"), "t", "left").select(
        "key", "t", F.struct("size", "place").alias("own"), F.coalesce("root", "t").alias("root"))
    split = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter(
        "low < high").select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    meeting, may = rows.join(split, "key"), _may_link(F.col("x"), F.col("y"))
    if sketched is not None:
        bitmaps = sketched.select("t", "bits").dropDuplicates(["t"])
        meeting = meeting.join(bitmaps, "t").withColumn("own", F.struct("own.*", "bits")).drop("bits")
        may = may & _bits_allow(F.col("x"), F.col("y"))
    dealt = settle(meeting.withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = dealt.select("key", F.col("part").alias("i"), every.alias("j"), F.col("t").alias("u"), F.col("own").alias("x"), F.col("root").alias("ru"))
    y = dealt.select("key", every.alias("i"), F.col("part").alias("j"), F.col("t").alias("v"), F.col("own").alias("y"), F.col("root").alias("rv"))
    met = x.join(y, ["key", "i", "j"]).filter((F.col("u") > F.col("v")) & (F.col("ru") != F.col("rv")) & may)
    return met.select("u", "v").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(t, members): shingle sets of the wanted texts, sorted."""

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            hashes, begin = shingles(batch.column(1))
            out = []
            for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                members = np.unique(hashes[b:e] >> np.uint64(64 - 8 * _WIDTH))
                out.append(members.view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["t", "members"])

    one, two = content_keys(key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"_a": one, "_b": two}).join(wanted, ["_a", "_b"]).select("_t", body.cast("binary").alias("body"))
    return stored(rows.mapInArrow(giving_back(run), "t long, members binary"), "shingle-sets")


def _members(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // _WIDTH, 8), np.uint8)
    wide[:, :_WIDTH] = np.frombuffer(packed, np.uint8).reshape(-1, _WIDTH)
    return wide.view(np.uint64).ravel()


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two packed sets; 1 for two empty ones."""
    x, y = _members(a), _members(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def linked(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [min(len(x), len(y)) >= least * max(len(x), len(y)) and similarity(x, y) >= least for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("t").alias("u"), F.col("members").alias("x")), sets.select(F.col("t").alias("v"), F.col("members").alias("y"))
    # of rows that repeat id and text each has a set: a pair may come more than once, which changes nothing
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(giving_back(run), "u long, v long").distinct()


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each group of near copies the row with the smallest id, all columns."""
    a, b, place = (unused(docs, c) for c in ("key_a", "key_b", "place"))
    sketched = _sketched(docs, key, text)
    posted = _posted(sketched)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")
    first = settle(sketched.groupBy("t").agg(F.min(order).alias("first")))
    kept = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))

    def similar(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("t")).distinct()
        wanted = first.join(ends, "t").select(F.col("first.a").alias("_a"), F.col("first.b").alias("_b"), F.col("t").alias("_t"))
        return settle(linked(pairs, _sets(kept, wanted, "id", "body")))

    pairs = settle(candidates(sketched, posted))
    edges = similar(pairs)
    joined = roots(edges)
    rest = settle(between_groups(posted, joined, sketched).join(pairs, ["u", "v"], "left_anti"))
    if not rest.isEmpty():
        joined = roots(edges.union(similar(rest)))
    stay = (
        first.join(joined, first["t"] == joined["node"], "left")
        .groupBy(F.coalesce("root", "t").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.a").alias(a), F.col("first.b").alias(b))
    )
    one, two = content_keys(key, text)
    rows = docs.withColumns({a: one, b: two}).join(stay, [a, b], "left_semi")
    in_order = Window.partitionBy(a, b).orderBy(a)
    return rows.withColumn(place, F.row_number().over(in_order)).filter(F.col(place) == 1).select(*docs.columns)
