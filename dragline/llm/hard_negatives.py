"""Hard negatives by secondary sort: scores as sort keys, and one pass over each anchor's sorted rows.

Vectors become integers, so scores are exact.  Anchors (a stated query set) meet all rows in cells of a grid, a block of
anchors by a stripe of rows; a cell streams its rows past its anchors and keeps, for each anchor and window, the first
few by (score descending, id).  What no cell keeps cannot be among the first of all rows.

    1. the first positives of each anchor, from the rows of its label; each positive opens a window of scores;
    2. the first rows of other labels in each window, cell by cell;
    3. positives and candidates, packed into (anchor, descending score, kind, id) keys, are dealt by anchor and sorted
       inside partitions (the DataFrame form of ``repartitionAndSortWithinPartitions``); an iterator opens a window where
       a positive comes by, numbers the negatives that fall into it and closes it below its lower bound or when it is
       full.  It holds the open windows of one anchor, never its rows.

A cell holds at most ``BLOCK`` anchors with their kept rows, whatever the table's size; a row is shuffled once for every
block of anchors.  Labels play no part in how rows are dealt, so a label of a third of all rows is no hot key.

Defined cases: rows with a null label, a null vector or a component that is null or not finite take no part; other rows
with a null id do, as positives or negatives that come last among ties, never as anchors.  Repeated rows are rows of
their own, anchors included.  Only vectors of equal length are compared; empty vectors score 0 with each other.
Components are taken as at most ``LARGEST`` from zero and scores as at most 2^56, so that 90 times a score is a long.
An anchor without positives, or a positive of negative score (its window is empty), gives no rows; an empty table gives
an empty table.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragline.llm.shared import parallelism, stored

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SCALE = 256
LARGEST = 1 << 20
BLOCK = 1 << 14  # anchors held by a cell
STRIPE = 1 << 12  # rows of a cell at least, while cells are fewer than cores
_ENTRIES = 1 << 20  # scores computed at once
_MOST = 1 << 56
_KEY = np.dtype([("at", ">u8"), ("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("none", "u1"), ("id", ">u8")])
_TOP = np.uint64(1 << 63)


def quantised(vectors: DataFrame, key: str, vector: str, label: str, is_anchor: Column, scale: int = SCALE) -> DataFrame:
    """(at, id, label, q, d, anchor): rows that take part, components as integers; ``at`` names a row."""
    usable = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(
        F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(usable).select(
        F.monotonically_increasing_id().alias("at"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        whole.alias("q"), F.size(vector).alias("d"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, block: int) -> DataFrame:
    """Anchors (kind 0, first) and rows (kind 1) of every cell, cell by cell inside each partition."""
    blocks = max(1, -(-n_anchors // block))
    wanted = -(-2 * parallelism(rows.sparkSession) // blocks)
    stripes = max(1, min(wanted, -(-n_rows // STRIPE)))
    place = F.abs(F.xxhash64("at") % (1 << 40))
    told = anchors.select("d", (place % blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"),
                          F.lit(0).alias("kind"), "at", "id", "label", "q", "scores")
    seen = rows.select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), (place % stripes).cast("int").alias("stripe"),
                       F.lit(1).alias("kind"), "at", "id", "label", "q", F.array().cast("array<long>").alias("scores"))
    cell = ["d", "block", "stripe"]
    return told.union(seen).repartition(max(1, min(2 * blocks * stripes, 4 * parallelism(rows.sparkSession))), *cell).sortWithinPartitions(*cell, "kind")


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    return np.clip((a.astype(kind) @ b.astype(kind).T).astype(np.int64), -_MOST, _MOST)


class _Cell:
    """The anchors of a cell, and the rows kept so far for each of their windows."""

    def __init__(self, table: pa.Table, d: int, bounds: tuple[int, int] | None, keep: int):
        """``bounds``: the window in per cent of each positive's score; None: rows of the anchor's own label, any score."""
        self.at, self.ids = table["at"].to_numpy(), table["id"].to_numpy()
        self.label = table["label"].to_numpy()
        self.q = _matrix(table["q"].combine_chunks(), d)
        self.same, self.keep = bounds is None, keep
        if bounds is None:
            self.low, self.high = np.full((len(self.at), 1), -_MOST), np.full((len(self.at), 1), _MOST)
        else:
            scores = table["scores"].to_pylist()
            width = max(map(len, scores), default=0)
            scores = np.array([[*x, *[-1] * (width - len(x))] for x in scores], np.int64).reshape(len(scores), width)
            self.low, self.high = -(-bounds[0] * scores // 100), bounds[1] * scores // 100
            self.low[scores < 0], self.high[scores < 0] = 1, 0  # empty
        self.kept = [np.zeros(0, np.int64) for _ in range(5)]  # window number, score, id, whether it is null, at

    def see(self, at: np.ndarray, ids: np.ndarray, none: np.ndarray, label: np.ndarray, q: np.ndarray) -> None:
        scores = _products(q, self.q)
        fits = label[:, None] == self.label[None, :]
        if not self.same:
            fits = ~fits
        fits &= at[:, None] != self.at[None, :]
        new = [self.kept]
        width = self.low.shape[1]
        for k in range(width):
            r, a = np.nonzero(fits & (scores <= self.high[:, k]) & (scores >= self.low[:, k]))
            new.append([a * width + k, scores[r, a], ids[r], none[r], at[r]])
        if sum(len(x[0]) for x in new[1:]):
            self._keep_first([np.concatenate(x) for x in zip(*new, strict=True)])

    def _keep_first(self, rows: list[np.ndarray]) -> None:
        window, score, ids, none, at = rows
        order = np.lexsort((at, ids, none, -score, window))
        window, score = window[order], score[order]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        place = np.arange(len(window)) - np.repeat(first, np.diff(np.r_[first, len(window)]))
        self.kept = [x[order[place < self.keep]] for x in rows]
        full = place == self.keep - 1  # what is below the last row of a full window is left out from now on
        width = self.low.shape[1]
        self.low[window[full] // width, window[full] % width] = score[full]

    def rows(self) -> tuple[np.ndarray, ...]:
        """(anchor's at, anchor's id, score, id, null id, at), each row once for an anchor."""
        window, score, ids, none, at = self.kept
        anchor = window // max(1, self.low.shape[1])
        _, once = np.unique(np.stack([anchor, at]), axis=1, return_index=True)
        anchor = anchor[once]
        return self.at[anchor], self.ids[anchor], score[once], ids[once], none[once], at[once]


def _cells(batches: Iterator[pa.RecordBatch], bounds: tuple[int, int] | None, keep: int) -> Iterator[tuple[np.ndarray, ...]]:
    now, cell, anchors = None, None, []
    step = 256
    for batch in batches:
        where = np.stack([batch[c].to_numpy() for c in ("d", "block", "stripe", "kind")])
        borders = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(axis=0), True]) if batch.num_rows else []
        for begin, end in zip(borders[:-1], borders[1:], strict=True):
            place, kind, part = tuple(where[:3, begin]), where[3, begin], batch.slice(begin, end - begin)
            if place != now:
                if cell is not None:
                    yield cell.rows()
                now, cell, anchors, step = place, None, [], 256
            if kind == 0:
                anchors.append(part)
                continue
            if not anchors:
                continue  # no anchor in this block has this length
            if cell is None:
                cell = _Cell(pa.Table.from_batches(anchors), int(place[0]), bounds, keep)
            q = _matrix(part["q"], int(place[0]))
            none = part["id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = part["id"].fill_null(0).to_numpy()
            at, label = part["at"].to_numpy(), part["label"].to_numpy()
            low = 0
            while low < len(at):  # short steps first: they raise the bounds for the long ones
                high = low + step
                cell.see(at[low:high], ids[low:high], none[low:high], label[low:high], q[low:high])
                low, step = high, max(1, min(2 * step, _ENTRIES // len(cell.at)))
    if cell is not None:
        yield cell.rows()


def _positives(grid: DataFrame, keep: int) -> DataFrame:
    """(anchor, found): the first rows of the anchor's label, best first."""

    def search(batches):
        for anchor, _, score, ids, none, at in _cells(batches, None, keep):
            yield pa.record_batch([pa.array(anchor), pa.array(score), pa.array(ids, mask=none.astype(bool)), pa.array(at)],
                                  names=["anchor", "score", "id", "at"])

    order = F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("none"), "id", "at")
    # at most ``keep`` rows an anchor from each of its cells
    return grid.mapInArrow(search, "anchor long, score long, id long, at long").groupBy("anchor").agg(
        F.slice(F.sort_array(F.collect_list(order)), 1, keep).alias("found"))


def packed(anchor: np.ndarray, anchor_id: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray, none: np.ndarray) -> pa.Array:
    """Sort keys as bytes: anchor (row, then id), descending score, positives before negatives, id with nulls last."""
    keys = np.empty(len(anchor), _KEY)
    keys["at"], keys["kind"], keys["none"] = anchor.astype(np.uint64), kind, none
    keys["anchor"] = anchor_id.astype(np.uint64) ^ _TOP
    keys["down"] = (-score).astype(np.uint64) ^ _TOP
    keys["id"] = ids.astype(np.uint64) ^ _TOP
    width = _KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [
        None, pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * width), pa.py_buffer(keys.tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _KEY)


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined_windows(sorted_keys: Iterator[pa.RecordBatch], positives: int, negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """One pass over sorted keys: a positive opens its window, negatives inside are numbered and come out."""
    anchor, opened, windows = None, 0, []
    for batch in sorted_keys:
        out = []
        keys = _unpacked(batch["key"])
        down = -((keys["down"].astype(np.uint64) ^ _TOP).astype(np.int64))
        ids = (keys["id"].astype(np.uint64) ^ _TOP).astype(np.int64)
        anchors = (keys["anchor"].astype(np.uint64) ^ _TOP).astype(np.int64)
        for row, this, score, kind, none, i in zip(
                keys["at"].tolist(), anchors.tolist(), down.tolist(), keys["kind"].tolist(), keys["none"].tolist(), ids.tolist(), strict=True):
            if row != anchor:
                anchor, opened, windows = row, 0, []
            i = None if none else i
            if kind == 0:
                opened += 1
                if opened <= positives and score >= 0:
                    windows.append([high * score, low * score, i, score, 0])
                continue
            full = False
            for window in windows:
                if window[1] <= 100 * score <= window[0]:
                    window[4] += 1
                    out.append((this, window[2], window[4], i, window[3], score))
                    full |= window[4] == negatives
                elif 100 * score < window[1]:
                    full = True
            if full:
                windows = [w for w in windows if w[4] < negatives and 100 * score >= w[1]]
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor`` picks."""
    rows = stored(quantised(vectors, key, vector, label, is_anchor), "vectors")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    anchors = rows.filter("anchor")
    nothing = F.array().cast("array<long>").alias("scores")
    found = stored(_positives(_grid(rows, anchors.select("*", nothing), n_rows, n_anchors, block), positives), "positives")
    with_windows = anchors.join(
        found.select(F.col("anchor").alias("at"), F.transform("found", lambda x: -x["down"]).alias("scores")), "at")

    def search(batches):
        for anchor, anchor_id, score, ids, none, _ in _cells(batches, (low, high), negatives):
            yield pa.record_batch([packed(anchor, anchor_id, score, 1, ids, none)], names=["key"])

    def pack(batches):
        for b in batches:
            none = b["id"].is_null().to_numpy(zero_copy_only=False)
            key = packed(b["at"].to_numpy(), b["anchor_id"].to_numpy(), b["score"].to_numpy(), 0, b["id"].fill_null(0).to_numpy(), none)
            yield pa.record_batch([key], names=["key"])

    openers = anchors.select("at", F.col("id").alias("anchor_id")).join(
        found.select(F.col("anchor").alias("at"), F.explode("found").alias("p")), "at").select(
        "at", "anchor_id", (-F.col("p.down")).alias("score"), "p.id")
    keys = openers.mapInArrow(pack, "key binary").union(
        _grid(rows, with_windows, n_rows, n_anchors, block).mapInArrow(search, "key binary"))
    in_order = keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")
    return in_order.mapInArrow(lambda batches: mined_windows(batches, positives, negatives, low, high), _MINED)
