"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: A-Z lower-cased, words are runs without white space, 3-word shingles with repeats, XXH64 (seed 42) of
each; a bit is one if over half the hashes have it.  Fingerprints link at ``TAU`` = 3 or fewer differing bits.

Candidates: a fingerprint is a ring of four 16-bit segments.  If two differ in at most 3 bits, some segment starts a
chain whose cumulative differences stay within the proportional budgets 0, 1, 2, 3 (the pigeonring principle).  Hence
in that chain the first segment is equal; of the second one half is equal (at most 1 difference); of the third one of
three parts is equal (at most 2 differences).  Those 29 bits are the join key: 4 starts x 2 halves x 3 parts = 24
postings for each distinct fingerprint, and no link is missed.  The chain budgets are tested before the full count.

Equal fingerprints are one node, so copies cost nothing; only linked pairs of distinct fingerprints leave the join, and
their components are found by star contraction.

Defined cases: null and wordless texts have fingerprint zero, linked like any other; fewer than three words make one
shingle; null ids are ignored as component ids unless the whole component has none; repeated rows get the same
component; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dragline.llm.components import roots
from dragline.llm.shared import content_keys, unused
from dragline.scale import settle

TAU = 3
SHINGLE = 3
SEED = 42
_BLOCK = 1 << 16  # shingles whose bits are unpacked at once


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only the six ASCII white-space bytes part words
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = hashes[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``fp``, its fingerprint as a long."""
    others = [c for c in docs.columns if c != text]

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"") for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*others, "fp"])

    rows = docs.select(*others, F.col(text).cast("binary").alias(text))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{schema}, fp long")


def _bits(x: Column, start: int, length: int) -> Column:
    return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << length) - 1))


def _turned(x: Column, by: int) -> Column:
    """The ring turned so that bit ``by`` comes first."""
    return x if by == 0 else F.shiftrightunsigned(x, by).bitwiseOR(F.shiftleft(x, 64 - by))


def _postings(fps: DataFrame) -> DataFrame:
    """(key, start, ring): 24 rows for each fingerprint; ``ring`` begins with the chain's first segment."""
    halves, parts = ((16, 8), (24, 8)), ((32, 5), (37, 5), (42, 6))
    rows = []
    for start in range(4):
        ring = _turned(F.col("fp"), 16 * start)
        for h, half in enumerate(halves):
            for p, part in enumerate(parts):
                kind = (start * 2 + h) * 3 + p
                key = F.shiftleft(F.lit(kind).cast("long"), 32).bitwiseOR(
                    F.shiftleft(_bits(ring, 0, 16), 14)).bitwiseOR(
                    F.shiftleft(_bits(ring, *half), 6)).bitwiseOR(_bits(ring, *part))
                rows.append(F.struct(key.alias("key"), F.lit(start).alias("start"), ring.alias("ring")))
    return fps.select(F.inline(F.array(*rows)))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most three bits; ``fps`` has no repeats."""
    posted = _postings(fps)
    a, b = posted.alias("a"), posted.alias("b")
    x = F.col("a.ring").bitwiseXOR(F.col("b.ring"))
    chain = F.lit(True)
    for segments, budget in ((2, 1), (3, 2)):  # cumulative differences against 3/4 of a bit for each segment
        chain = chain & (F.bit_count(_bits(x, 0, 16 * segments)) <= budget)
    found = a.join(
        b, (F.col("a.key") == F.col("b.key")) & (F.col("a.ring") < F.col("b.ring")) & chain & (F.bit_count(x) <= TAU))
    back = F.when(F.col("start") == 0, F.col("r"))
    for start in (1, 2, 3):
        back = back.when(F.col("start") == start, _turned(F.col("r"), 64 - 16 * start))
    pair = found.select(F.col("a.start").alias("start"), F.col("a.ring").alias("ra"), F.col("b.ring").alias("rb"))
    for name, r in (("a", "ra"), ("b", "rb")):
        pair = pair.withColumn("r", F.col(r)).withColumn(name, back)
    return pair.select("a", "b").distinct()


def components(hashed: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint: the smallest id of all rows linked to it, however far."""
    nodes = settle(hashed.groupBy("fp").agg(F.min("id").alias("least")))
    joined = roots(links(nodes.select("fp")))
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def component_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, its fingerprint (16 hex digits) and component_id."""
    hashed = settle(fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), "body"))
    return hashed.join(components(hashed), "fp").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component the row with the smallest id, all columns."""
    a, b, place = (unused(docs, c) for c in ("key_a", "key_b", "place"))
    one, two = content_keys(key, text)
    named = docs.select(F.col(key).alias("id"), one.alias("a"), two.alias("b"), F.col(text).alias("body"))
    hashed = settle(fingerprints(named, "body"))
    # the first row of each fingerprint, then of each component: both minima combine before the shuffle
    order = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")
    first = settle(hashed.groupBy("fp").agg(F.min(order).alias("first")))
    joined = roots(links(first.select("fp")))
    stay = (
        first.join(joined, first["fp"] == joined["node"], "left")
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.a").alias(a), F.col("first.b").alias(b))
    )
    rows = docs.withColumns({a: one, b: two}).join(stay, [a, b], "left_semi")
    # of rows that repeat id and text, one
    in_order = Window.partitionBy(a, b).orderBy(a)
    return rows.withColumn(place, F.row_number().over(in_order)).filter(F.col(place) == 1).select(*docs.columns)
