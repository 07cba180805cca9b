"""Collocations by vertical partitioning: groups of word prefixes, one depth-truncated suffix subtree each.

The suffixes of a text are what follows each of its words, cut after ``DEPTH`` words; they form a tree whose nodes are
phrases, and a phrase occurs as often as its node has leaves below.

    1. words are counted for each language; a word that is too rare for any candidate parts the text, as nothing that
       holds it can be frequent;
    2. vertical partitioning: words are prefixes; a word with more occurrences than half the memory budget is extended
       by the next word, those pairs are counted, and so on.  Prefixes are dealt into groups by hash, with so many
       groups that none is above the budget;
    3. suffixes are made in one pass, equal ones of a batch combined, and shuffled by group; a task builds the subtree
       of one group at a time (sorted suffixes: a node is a run of equal beginnings) and adds up leaves for each node;
    4. frequent nodes are joined with the counts of their parts, and with the most frequent longer phrase around them.

Words are 64-bit hashes of (language, word), so languages are apart everywhere; counting them with a second hash beside
the first finds out whether two words share one, and then takes another seed.  Texts of words are fetched at the end.
What is broadcast: a bitmap of fixed size over frequent words (its false positives cost time, not results), short codes
of at most ``CODES`` of the most frequent words (a suffix of such words is shuffled as two numbers, any other as its
hashes), and the extended prefixes, at most 2 / budget of all occurrences; the budget grows beyond ``MOST_GROUPS``
groups.  A hot word or pair is spread over its extensions, an always repeated 4-word suffix is one row a batch.

Defined cases: a null text counts as empty, a null lang as ``und``; repeated rows count as often as they occur; very long
texts are cut into pieces at white space, without effect on the result; an empty table, or a language without a phrase
that is left, gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dragline.llm.shared import arrow_batches_of, stored
from dragline.llm.words import column_bytes, mixed, pieces, running, span_hashes, spans

DEPTH = 4
LEAST = 30  # occurrences of a candidate
ABSORBED = 80  # per cent of a phrase's occurrences that lie in one longer phrase
TOP = 2000
BUDGET = 1 << 20  # suffixes of a subtree
MOST_GROUPS = 1 << 23
SALTS = 16
CODES = (1 << 20) - 1  # words with a short code in the shuffle
_CODE = 20  # bits of a code
_BITS = 1 << 26
_PAGE = 1 << 15  # bits of a page of Spark's bitmaps
_BATCH = "8m"
_POSITIVE = (1 << 63) - 1

_PARTS_WORDS = np.zeros(256, bool)
_PARTS_PIECES = np.zeros(256, bool)
_PARTS_PIECES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PARTS_WORDS[[0x20, 0x09]] = True
_PARTS_WORDS |= _PARTS_PIECES
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

KEY = [f"w{i}" for i in range(DEPTH)]


def _lang_hash(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=seed.to_bytes(8, "big")).digest(), "big")


class _Words:
    """The words of a batch of texts: where they lie, their hashes, and whether each follows the one before it."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        self.langs, self.lang_of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True) if batch.num_rows else ([], [])
        self.data, offsets = column_bytes(batch.column(1))
        hashes, first, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, piece, borders in pieces(self.data, offsets, _PARTS_WORDS):
            begin, end = spans(piece, borders, _PARTS_WORDS)
            hashes.append(span_hashes(running(piece), begin, end))
            first.append(begin + low)
            last.append(end + low)
        self.first, self.last = np.concatenate(first), np.concatenate(last)
        text = np.searchsorted(offsets, self.first, side="right") - 1
        self.lang = np.asarray(self.lang_of, np.int64)[text]
        self.salt = np.array([_lang_hash(x, seed) for x in self.langs], np.uint64)
        self.plain = np.concatenate(hashes)
        self.hash = mixed(self.plain ^ self.salt[self.lang]) if len(self.lang) else self.plain.copy()
        self.hash[self.hash <= CODES] = CODES + 1  # zero stands for no word, small numbers for codes
        piece = np.searchsorted(np.flatnonzero(_PARTS_PIECES[self.data]), self.first) + text
        self.follows = np.r_[False, piece[1:] == piece[:-1]] if len(piece) else np.zeros(0, bool)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))


def _vocabulary(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(h, lang, n) of words that occur at least ``least`` times; ``torn`` is set where two words share a hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(batch, seed)
            ends = np.r_[0, np.cumsum(words.last - words.first)]
            body = _LOWER[words.data[~_PARTS_WORDS[words.data]]]
            coded = pa.Array.from_buffers(pa.large_binary(), len(words.first), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
            # equal words of a language, told apart by their letters: words that share a hash give two rows
            _, at, n = np.unique(words.lang * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_index=True, return_counts=True)
            h = words.hash[at]
            second = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.take(coded.indices.take(pa.array(at))).to_pylist()], np.uint64)
            yield pa.record_batch([_long(h), _long(words.salt[words.lang[at]]), _long(second), pa.array(n.astype(np.int64))],
                                  names=["h", "lang", "second", "n"])

    found = texts.mapInArrow(count, "h long, lang long, second long, n long").groupBy("h").agg(
        F.min("lang").alias("lang"), F.sum("n").alias("n"),
        ((F.min("second") != F.max("second")) | (F.min("lang") != F.max("lang"))).alias("torn"))
    return stored(found.filter(F.col("torn") | (F.col("n") >= least)), "vocabulary")


def _totals(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, name, n): hash, name and number of all words of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(batch, seed)
            n = np.bincount(words.lang, minlength=len(words.langs)).astype(np.int64)
            yield pa.record_batch([_long(words.salt), pa.array(list(words.langs), pa.string()), pa.array(n)], names=["lang", "name", "n"])

    return texts.mapInArrow(count, "lang long, name string, n long").groupBy("lang", "name").agg(F.sum("n").alias("n"))


def _named(texts: DataFrame, hashes: DataFrame, seed: int) -> DataFrame:
    """(h, word): texts of the words with these hashes, and perhaps of some others."""
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(hashes))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(batch, seed)
            h, at = np.unique(words.hash, return_index=True)
            in_bits = _within(h, bits.value)
            data = _LOWER[words.data].tobytes()
            text = [data[b:e].decode(errors="replace") for b, e in zip(words.first[at[in_bits]].tolist(), words.last[at[in_bits]].tolist(), strict=True)]
            yield pa.record_batch([_long(h[in_bits]), pa.array(text, pa.string())], names=["h", "word"])

    return texts.mapInArrow(find, "h long, word string").distinct()


def _bitmap(words: DataFrame) -> np.ndarray:
    """One bit for each of ``_BITS`` values of a hash; at most _BITS / 8 bytes reach the driver."""
    place = F.pmod(F.col("h"), F.lit(_BITS)) + 1  # Spark's bit positions begin at 1
    pages = words.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(_BITS // 8, np.uint8)
    for page, bits in pages.collect():
        out[(page - 1) * _PAGE // 8:][: _PAGE // 8] = np.frombuffer(bits, np.uint8)
    return out


def _within(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = (h & np.uint64(_BITS - 1)).astype(np.int64)
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _frequent_only(words: _Words, bits: np.ndarray) -> np.ndarray:
    """(word, up to DEPTH - 1 words behind it) for every word, zeros behind the end of a piece or before a rare word."""
    w = np.where(_within(words.hash, bits), words.hash, np.uint64(0))
    follows = np.r_[words.follows[1:], False]
    columns = [w]
    for k in range(1, DEPTH):
        behind = np.zeros_like(w)
        behind[:-k] = w[k:]
        reach = follows.copy()  # words i .. i + k lie in one piece
        for j in range(1, k):
            reach[:-j] &= follows[j:]
            reach[len(reach) - j:] = False
        columns.append(np.where(reach & (columns[-1] != 0), behind, np.uint64(0)))
    return np.stack(columns, axis=1)


def _combined(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs (a row may come twice if another shares its mixed value)."""
    mix = np.zeros(len(suffixes), np.uint64)
    with np.errstate(over="ignore"):
        for column in suffixes.T:
            mix = mixed(mix * np.uint64(0x9E3779B97F4A7C15) + column)
    suffixes = suffixes[np.argsort(mix)]
    begin = np.flatnonzero(np.r_[True, (suffixes[1:] != suffixes[:-1]).any(axis=1)]) if len(suffixes) else np.zeros(0, np.int64)
    return suffixes[begin], np.diff(np.r_[begin, len(suffixes)])


class Groups:
    """Vertical partition: the group of a suffix.  Level 1 is by the first word, hot prefixes move to deeper levels."""

    def __init__(self, first: int):
        self.first = first
        self.level_ends = [first]
        self.hot: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # mixed prefix (sorted), prefix, base, number

    @staticmethod
    def _mix(prefixes: np.ndarray) -> np.ndarray:
        mix = np.zeros(len(prefixes), np.uint64)
        with np.errstate(over="ignore"):
            for column in prefixes.T:
                mix = mixed(mix * np.uint64(0xD6E8FEB86659FD93) + column)
        return mix

    def extend(self, prefixes: np.ndarray, counts: np.ndarray, budget: int) -> None:
        """Hot prefixes of the last level get groups of their own, dealt by the next word."""
        mix = self._mix(prefixes)
        order = np.argsort(mix, kind="stable")
        number = np.maximum(1, -(-2 * counts[order] // budget)).astype(np.int64)
        base = self.level_ends[-1] + np.cumsum(number) - number
        self.hot.append((mix[order], prefixes[order], base, number))
        self.level_ends.append(self.level_ends[-1] + int(number.sum()))

    def hot_rows(self, suffixes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose first ``level`` words are a hot prefix, and which."""
        mixes, prefixes, _, _ = self.hot[level - 1]
        if not len(mixes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mix = self._mix(suffixes[:, :level])
        at = np.searchsorted(mixes, mix)
        at[at == len(mixes)] = 0
        rows, found = np.flatnonzero((mixes[at] == mix) & (prefixes[at] == suffixes[:, :level]).all(axis=1)), at
        return rows, found[rows]

    def of(self, suffixes: np.ndarray) -> np.ndarray:
        group = ((suffixes[:, 0] & np.uint64(_POSITIVE)) % np.uint64(self.first)).astype(np.int64)
        for level, (_, _, base, number) in enumerate(self.hot, 1):
            rows, at = self.hot_rows(suffixes, level)
            group[rows] = base[at] + ((suffixes[rows, level] & np.uint64(_POSITIVE)) % number[at].astype(np.uint64)).astype(np.int64)
        return group

    def level(self, group: int) -> int:
        return 1 + int(np.searchsorted(self.level_ends, group, side="right"))


def _pass(texts: DataFrame, bits, seed: int, make: Callable, schema: str) -> DataFrame:
    """Suffixes of every batch of texts, given to ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suffixes = _frequent_only(_Words(batch, seed), bits.value)
            yield make(suffixes[suffixes[:, 1] != 0])  # single words are counted already

    return texts.mapInArrow(run, schema)


def _long(column: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(column).view(np.int64))


def partition(texts: DataFrame, words: DataFrame, bits, seed: int, budget: int, most_groups: int = MOST_GROUPS) -> tuple[Groups, list[DataFrame]]:
    """The groups, and the counts of hot prefixes of two words and more (nodes above the subtrees)."""
    spark = texts.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-4 * total // most_groups))
    share = max(1, budget // 2)
    hot = words.filter(F.col("n") > share).select(F.col("h").alias("w0"), "n").toPandas()  # at most 2 * total / budget
    cool = words.filter(F.col("n") <= share)
    first = max(1, -(-2 * total // budget))
    while True:
        load = cool.groupBy((F.col("h").bitwiseAND(F.lit(_POSITIVE)) % first).alias("group")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if load <= budget or first > most_groups:
            break
        first *= 2
    groups, above = Groups(first), []
    for level in range(1, DEPTH):
        if not len(hot):
            break
        prefixes = np.stack([hot[c].to_numpy().astype(np.int64).view(np.uint64) for c in KEY[:level]], axis=1)
        groups.extend(prefixes, hot["n"].to_numpy().astype(np.int64), budget)
        if level == DEPTH - 1:
            break
        told = spark.sparkContext.broadcast(groups)

        def longer(suffixes, told=told, level=level):
            rows, _ = told.value.hot_rows(suffixes, level)
            found = suffixes[rows, :level + 1]
            # a phrase is no more frequent than its last words: those must be a hot prefix, too
            rows, _ = told.value.hot_rows(found[:, 1:], level)
            found, n = _combined(found[rows])
            return pa.record_batch([*(_long(c) for c in found.T), pa.array(n)], names=[*KEY[:level + 1], "n"])

        counted = _pass(texts, bits, seed, longer, ", ".join(f"{c} long" for c in [*KEY[:level + 1], "n"]))
        counted = stored(counted.groupBy(*KEY[:level + 1]).agg(F.sum("n").alias("n")).filter(F.col("n") > share), "hot-prefixes")
        above.append(counted)
        hot = counted.toPandas()  # at most 2 * total / budget
    return groups, above


def subtree_nodes(suffixes: np.ndarray, n: np.ndarray, level: int, least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Frequent nodes of the subtree over ``suffixes``, for each depth from max(2, level): their words, their leaves."""
    order = np.lexsort(suffixes.T[::-1])
    leaves, n = suffixes[order], n[order]
    nodes, counts = [], []
    border = np.zeros(len(leaves), bool)
    border[:1] = True
    for depth in range(1, DEPTH + 1):
        border[1:] |= leaves[1:, depth - 1] != leaves[:-1, depth - 1]
        if depth < max(2, level):
            continue
        begin = np.flatnonzero(border)
        total = np.add.reduceat(n, begin) if len(begin) else np.zeros(0, np.int64)
        frequent = (total >= least) & (leaves[begin, depth - 1] != 0)
        found = leaves[begin[frequent]].copy()
        found[:, depth:] = 0
        nodes.append(found)
        counts.append(total[frequent])
    return nodes, counts


class Codes:
    """Short codes, from 1, of the most frequent words: four of them and a count fit into two numbers."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.of_code = np.r_[np.uint64(0), self.hashes]

    def of(self, words: np.ndarray) -> np.ndarray:
        """Codes; -1 for a word without one."""
        if not len(self.hashes):
            return np.where(words == 0, 0, -1)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(words == 0, 0, np.where(self.hashes[at] == words, at + 1, -1))

    def packed(self, suffixes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows have codes throughout, and the two numbers of these."""
        codes = np.stack([self.of(c) for c in suffixes.T], axis=1).astype(np.int64)
        short = (codes >= 0).all(axis=1) & (n < 1 << 31)
        codes, n = codes[short], n[short]
        return short, codes[:, 0] << 2 * _CODE | codes[:, 1] << _CODE | codes[:, 2], codes[:, 3] << 32 | n

    def unpacked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (1 << _CODE) - 1
        codes = (a >> 2 * _CODE, a >> _CODE & mask, a & mask, b >> 32)
        return np.stack([self.of_code[c] for c in codes], axis=1), b & 0xFFFFFFFF


def _most_frequent(words: DataFrame, most: int) -> np.ndarray:
    """Hashes of at most ``most`` of the most frequent words; of those at the last frequency that has room, as many as fit, chosen by hash.

    No sort, of which every task would send its first rows to the driver: one row for each frequency (their number grows
    with the root of all occurrences), then the hashes alone.
    """
    levels = words.groupBy("n").count().toArrow()
    n, count = (levels[c].to_numpy() for c in ("n", "count"))
    order = np.argsort(-n)
    n, count = n[order], count[order]
    whole = int(np.searchsorted(np.cumsum(count), most, side="right"))  # levels that fit as a whole
    chosen = F.col("n") >= F.lit(int(n[whole - 1])) if whole else F.lit(False)
    room = most - int(count[:whole].sum())
    if whole < len(n) and room:
        chosen = chosen | ((F.col("n") == int(n[whole])) & (F.pmod(F.xxhash64("h"), F.lit(int(count[whole]))) < room))
    # where the choice by hash is a few too many, words of that level go
    found = words.filter(chosen).select("h", "n").toArrow()
    first = np.argsort(-found["n"].to_numpy(), kind="stable")[:most]
    return found["h"].to_numpy()[first].view(np.uint64)


_ROW = ["group", "a", "b", "wide"]


def _suffix_rows(groups: Groups, codes: Codes, suffixes: np.ndarray) -> pa.RecordBatch:
    found, n = _combined(suffixes)
    group = groups.of(found)
    short, a, b = codes.packed(found, n)
    long = np.ascontiguousarray(np.concatenate([found[~short], n[~short, None].astype(np.uint64)], axis=1))
    width, none = 8 * (DEPTH + 1), [None] * len(a)
    wide = [long[i].tobytes() for i in range(len(long))] if len(long) else []
    zeros = np.zeros(len(long), np.int64)
    assert all(len(w) == width for w in wide)
    return pa.record_batch([pa.array(np.r_[group[short], group[~short]]), pa.array(np.r_[a, zeros]), pa.array(np.r_[b, zeros]),
                            pa.array(none + wide, pa.binary()) if wide else pa.nulls(len(a), pa.binary())], names=_ROW)


def _read_rows(codes: Codes, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes and counts of a group's rows."""
    short = table["wide"].is_null().to_numpy()
    suffixes, n = codes.unpacked(table["a"].to_numpy()[short], table["b"].to_numpy()[short])
    if not short.all():
        long = np.frombuffer(b"".join(table["wide"].drop_null().to_pylist()), np.uint64).reshape(-1, DEPTH + 1)
        suffixes, n = np.concatenate([suffixes, long[:, :DEPTH]]), np.r_[n, long[:, DEPTH].astype(np.int64)]
    return suffixes, n


def _subtrees(texts: DataFrame, bits, seed: int, groups: Groups, codes: Codes, least: int) -> DataFrame:
    """(w0 .. w3, a): frequent phrases of two words and more, but for those above the subtrees."""
    told = texts.sparkSession.sparkContext.broadcast((groups, codes))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def done():
            suffixes, n = _read_rows(told.value[1], pa.Table.from_batches(parts))
            for nodes, counts in zip(*subtree_nodes(suffixes, n, told.value[0].level(now), least), strict=True):
                yield pa.record_batch([*(_long(c) for c in nodes.T), pa.array(counts.astype(np.int64))], names=[*KEY, "a"])

        for batch in batches:
            group = batch["group"].to_numpy()
            borders = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else []
            for begin, end in zip(borders[:-1], borders[1:], strict=True):
                if parts and group[begin] != now:
                    yield from done()
                    parts = []
                now = int(group[begin])
                parts.append(batch.slice(begin, end - begin))
        if parts:
            yield from done()

    rows = _pass(texts, bits, seed, lambda suffixes: _suffix_rows(*told.value, suffixes), "group long, a long, b long, wide binary")
    dealt = rows.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(build, ", ".join(f"{c} long" for c in [*KEY, "a"]))


def _padded(columns: list[Column], n: Column) -> list[Column]:
    return [*(c.alias(k) for c, k in zip(columns + [F.lit(0).cast("long")] * (DEPTH - len(columns)), KEY, strict=True)), n.alias("a")]


def frequent_phrases(texts: DataFrame, least: int = LEAST, budget: int = BUDGET, codes: int = CODES) -> tuple[DataFrame, DataFrame, int]:
    """(words, phrases, seed): (h, lang, n) of frequent words; (w0 .. w3, a) of all phrases of up to DEPTH words."""
    spark: SparkSession = texts.sparkSession
    with arrow_batches_of(spark, _BATCH):
        for seed in range(1 << 16):
            words = _vocabulary(texts, least, seed)
            if not words.filter("torn").limit(1).count():
                break
        bits = spark.sparkContext.broadcast(_bitmap(words))
        coded = _most_frequent(words, codes)
        groups, above = partition(texts, words, bits, seed, budget)
        found = _subtrees(texts, bits, seed, groups, Codes(coded), least)
        for counted in above:
            level = len(counted.columns) - 1
            found = found.union(counted.filter(F.col("n") >= least).select(*_padded([F.col(c) for c in KEY[:level]], F.col("n"))))
        phrases = stored(found, "phrases")
    return words, words.select(*_padded([F.col("h")], F.col("n"))).union(phrases), seed


def _part(begin: int, end: int) -> Column:
    """Words begin .. end - 1 as a key."""
    return F.struct(*[(F.col(KEY[begin + i]) if begin + i < end else F.lit(0).cast("long")).alias(KEY[i]) for i in range(DEPTH)])


def _size() -> Column:
    return sum((F.col(k) != 0).cast("int") for k in KEY)


def _looked_up(rows: DataFrame, on: str, table: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """``rows`` with values of ``table`` where ``on`` equals its key (unique); a popular key is spread over SALTS tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)))
    copies = table.select(key.alias(on), *[v.alias(k) for k, v in values.items()],
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    # always merged: the copies are not in Spark's estimate of the size, which would broadcast a table 16 times above it
    return salted.join(copies.hint("merge"), [on, "salt"]).drop("salt", on)


def scored(phrases: DataFrame) -> DataFrame:
    """(w0 .. w3, a, l, r, score) for candidates of two words and more: the cut with the lowest score, then the first."""
    candidates = phrases.filter(F.col(KEY[1]) != 0)
    key = _part(0, DEPTH)
    cuts = []
    for size in range(2, DEPTH + 1):
        of_size = [F.struct(F.lit(k).alias("k"), _part(0, k).alias("left"), _part(k, size).alias("right")) for k in range(1, size)]
        cuts.append(F.when(_size() == size, F.array(*of_size)))
    cut = candidates.select(*KEY, "a", F.explode(F.coalesce(*cuts)).alias("cut")).select(
        *KEY, "a", "cut.k", "cut.left", "cut.right")
    both = _looked_up(_looked_up(cut, "left", phrases, key, {"l": F.col("a")}), "right", phrases, key, {"r": F.col("a")})
    # exact: the product is a decimal of up to 28 digits
    score = F.expr("(cast(a AS decimal(20,0)) * cast(2000000 AS decimal(8,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy(*KEY, "a").agg(best).select(*KEY, "a", "best.l", "best.r", "best.score")


def not_absorbed(candidates: DataFrame, phrases: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Candidates without a longer one around them that holds ``absorbed`` per cent of their occurrences."""
    inside = []
    for size in range(3, DEPTH + 1):
        inside.append(F.when(_size() == size, F.array(*[_part(b, b + n) for n in range(2, size) for b in range(size - n + 1)])))
    longer = phrases.filter(F.col(KEY[2]) != 0).select("a", F.explode(F.coalesce(*inside)).alias("part"))
    most = longer.groupBy(*[F.col(f"part.{k}").alias(k) for k in KEY]).agg(F.max("a").alias("longest"))
    joined = candidates.join(most.hint("merge"), KEY, "left")  # parts are not in Spark's estimate of the size either
    return joined.filter(F.col("longest").isNull() | (100 * F.col("longest") < absorbed * F.col("a"))).drop("longest")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, absorbed: int = ABSORBED,
                 top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    texts = _texts(docs, text, lang)
    words, phrases, seed = frequent_phrases(texts, least, budget)
    left = not_absorbed(scored(phrases), phrases, absorbed).withColumn("at", F.col(KEY[0]))
    left = _looked_up(left, "at", words, F.col("h"), {"lang": F.col("lang")})
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    # ties stay, so that none of the first is lost, before texts are fetched
    left = stored(left.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top).drop("place"), "first-phrases")
    used = left.select(F.explode(F.array(*KEY)).alias("h")).filter("h <> 0").distinct()
    with arrow_batches_of(docs.sparkSession, _BATCH):
        names = stored(_named(texts, used, seed), "words")
        totals = stored(_totals(texts, seed), "totals")
    names = names.union(names.sparkSession.createDataFrame([(0, None)], "h long, word string"))
    for i, w in enumerate(KEY):
        left = _looked_up(left.withColumn("at", F.col(w)), "at", names, F.col("h"), {f"word{i}": F.col("word")})
    phrase = F.concat_ws(" ", *[f"word{i}" for i in range(DEPTH)])
    in_order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = left.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select(
        F.col("name").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
