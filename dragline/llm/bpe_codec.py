"""Byte-level BPE over a table of distinct words: each word is encoded once, ids come back by position.

    1. texts are split into the words within which merges happen, some megabytes of texts at a time; a run of such
       slices has distinct words and, for every position, the number of the word there;
    2. the distinct words of all runs are shuffled by word, so each is encoded once, and its ids go back to the runs
       that have it (a row for each run, not for each occurrence);
    3. a run's ids and its positions meet, and the ids are laid out by position;
    4. decoding lists the distinct ids of a block of texts, joins each with its piece (a table of the vocabulary's size,
       which is broadcast) and lays the pieces out by position as they stream by.

Word borders follow the tokenizer's pattern (contractions, letters, digits, signs, white space, the first three with a
space before them) as array operations over code points; the class of a code point is asked of the tokenizer itself.

Memory: a task holds one run: about ``_RUN`` bytes of text, or one document if that is longer.  A frequent word has one
row a run, so no key grows with its occurrences.  The documents are read twice, so they must be a table or another input
that gives the same rows in the same order when it is read again; checks of each run's words fail the job if it does not.

Defined cases: a null text counts as empty and has no ids; special strings inside texts become their special token, as
the library does by default; rows that repeat are encoded as often as they occur; ids that the vocabulary lacks or nulls
decode to nothing, bytes that are not UTF-8 to U+FFFD; a null list of ids decodes as an empty one; an empty table gives
an empty table; other columns are not looked at by ``encode`` and are kept by ``decode``.
"""

from __future__ import annotations

import array
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dragline.llm.shared import give_back, giving_back
from dragline.llm.words import column_bytes

_SLICE = 1 << 22  # bytes of text split at once
_RUN = 1 << 24
_WORDS_SENT = 1 << 17  # encoded words that go back to their runs at once
_TOKENS = 1 << 19  # decoded at once; one row, if that has more
_RUN_WORDS = 1 << 20
_NUMBER = 24  # bits of a word's number in its run
_PLACE = 14  # bits of a run's place in its partition
_PIECE = 1 << 20  # bytes split at once; longer where no safe place to part them comes
_LETTER, _DIGIT, _SIGN, _SPACE = range(4)


def _byte_of() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Splitter:
    """Where the words of byte-level BPE begin."""

    def __init__(self, description: str, kind: np.ndarray | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        read = json.loads(description)
        if read.get("normalizer") or read["pre_tokenizer"]["type"] != "ByteLevel" or read["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without a normalizer and without a space before texts is needed")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in read["added_tokens"]):
            raise ValueError("added tokens that reach beyond their own string are not handled")
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((a["content"].encode() for a in read["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.kind = self._classes() if kind is None else kind

    def _classes(self) -> np.ndarray:
        """Letter, digit, sign or space for every code point, by what the tokenizer joins it with."""
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        kind = np.full(0x110000, _SIGN, np.uint8)
        for _, (begin, end) in split("".join(map(chr, points))):
            one = chr(points[end - 1])  # a word's last character has the class of all but a space before them
            found = next((k for k, with_it in ((_LETTER, "a"), (_DIGIT, "1"), (_SIGN, "!")) if len(split(with_it + one)) == 1), _SPACE)
            kind[points[begin]: points[end - 1] + 1] = found
        kind[0x20], kind[0x27] = _SPACE, _SIGN
        return kind

    def _piece(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Places where words begin; nothing reaches over ``borders`` or beyond the piece."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(lead)
        points = data if n == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        new = np.zeros(n + 1, bool)
        new[np.searchsorted(lead, borders)] = True
        new[[0, n]] = True
        run = new.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        start = run[:n].copy()
        last = (kind == _SPACE) & run[1:] & ~new[1:]  # the last white space before something else
        start[last] = True
        start[np.flatnonzero(last & (points == 0x20)) + 1] = False  # a space goes with what follows
        mark = np.flatnonzero((points == 0x27) & start & run[1:] & ~new[1:])
        if len(mark):
            one = points[mark + 1].astype(np.uint32)
            two = np.where((mark + 2 < n) & ~new[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0).astype(np.uint32)
            short = np.isin(one, [*b"stmd"])
            long = np.isin(one * 256 + two, [a * 256 + b for a, b in (b"re", b"ve", b"ll")]) & (one < 128) & (two < 128)
            start[mark[short | long] + 1] = False
            after = np.r_[mark[short] + 2, mark[long & ~short] + 3]
            after = after[after < n]
            start[after[(kind[after] == _LETTER) & ~new[after]]] = True
        return lead[start]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte places where words begin in texts that lie end to end."""
        special, borders = np.zeros((0, 2), np.int64), offsets
        if self.special:
            found = [m.span() for m in self.special.finditer(data)]
            text = np.searchsorted(offsets, [b for b, _ in found], side="right")
            torn = [x for x, t in zip(found, text, strict=True) if x[1] > offsets[t]]
            if torn:  # a match that lies in two texts may hide others
                found = [(m.start() + b, m.end() + b) for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                         for m in self.special.finditer(data[b:e])]
            special = np.array(found, np.int64).reshape(-1, 2)
            borders = np.union1d(offsets, special)
        word = (data | 0x20) - 0x61 < 26  # ASCII letters
        out, low = [], 0
        while low < len(data):
            size, high = _PIECE, 0
            while not high:
                end = low + size
                if end >= len(data):
                    high = len(data)
                    break
                tail = max(low + 1, end - min(size, 4096))
                safe = np.flatnonzero(word[tail - 1: end - 1] & (data[tail:end] == 0x20) & word[tail + 1: end + 1])
                if len(safe):
                    high = tail + int(safe[-1])
                elif (border := int(borders[np.searchsorted(borders, end, side="right") - 1])) > low:
                    high = border
                size *= 2
            inside = borders[np.searchsorted(borders, low): np.searchsorted(borders, high)] - low
            out.append(low + self._piece(data[low:high], inside))
            low = high
        found = np.concatenate(out) if out else np.zeros(0, np.int64)
        if len(special):
            at = np.searchsorted(special[:, 0], found, side="right") - 1
            found = found[(at < 0) | (found == special[at, 0]) | (found >= special[at, 1])]
        return found

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


_splitters: dict[int, Splitter] = {}


def _splitter(told: tuple[str, np.ndarray]) -> Splitter:
    """One for each Python worker, whatever the number of its tasks."""
    if (name := hash(told[0])) not in _splitters:
        _splitters[name] = Splitter(*told)
    return _splitters[name]


def _valid(column: pa.Array) -> pa.Array:
    """Bytes of texts; what is not UTF-8 is replaced as in a Python string."""
    try:
        column.cast(pa.string()).validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([x.decode(errors="replace").encode() for x in column.to_pylist()], pa.binary())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``_SLICE`` bytes of text, or one row."""
    if batch.num_rows:
        block = column_bytes(batch.column(1))[1][:-1] // _SLICE
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]).tolist()
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(b, e - b)


def _as_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _zipped(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _unzipped(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd", 3).decompress(data[8:], size, asbytes=True) if size else b""


def _packed(numbers: np.ndarray) -> bytes:
    """Low bytes, then higher ones, compressed: small numbers leave the higher bytes empty."""
    return _zipped(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(_unzipped(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _by_first_use(numbers: np.ndarray, before: int) -> np.ndarray:
    """Zero where a word comes first in its run, else its number plus one; words are numbered as they come."""
    most = np.maximum.accumulate(np.r_[before - 1, numbers])
    return np.where(numbers > most[:-1], 0, numbers + 1)


def _numbers(coded: np.ndarray, before: int) -> np.ndarray:
    return np.where(coded == 0, before + np.cumsum(coded == 0) - 1, coded - 1)


def _check(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) & 0xFF


def _runs(docs: DataFrame, told, key: str, text: str, make: Callable, schema) -> DataFrame:
    """``make`` of each slice of texts: its run, keys, words in each text, the number of each word, the run's words before
    and with it and the new ones among them.

    A run is named by its partition and place, so both readings of ``docs`` (and repeated tasks) name it alike.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(told.value)
        run, size, seen, check = TaskContext.get().partitionId() << _PLACE, 0, {}, 0
        for batch in (b for whole in batches for b in _slices(whole)):
            data, offsets = column_bytes(_valid(batch.column(1)))
            if seen and (size + len(data) > _RUN or len(seen) > _RUN_WORDS):
                run, size, seen, check = run + 1, 0, {}, 0
            begin = splitter.starts(data, offsets)
            ends = np.r_[begin, len(data)].astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
            before, size = len(seen), size + len(data)
            words = coded.dictionary.to_pylist()
            number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
            new = [w for w, n in zip(words, number.tolist(), strict=True) if n >= before]
            check = zlib.crc32(bytes(map(_check, new)), check)
            yield make(run, batch.column(0), np.diff(np.searchsorted(begin, offsets)), number[coded.indices.to_numpy()], before, new, check)

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(giving_back(split), schema)


def _new_words(run, keys, words, numbers, before, new, check) -> pa.RecordBatch:
    at = (run << _NUMBER) + before + np.arange(len(new))
    return pa.record_batch([pa.array(at), pa.array([w.decode() for w in new], pa.string())], names=["at", "word"])


def _positions(run, keys, words, numbers, before, new, check) -> pa.RecordBatch:
    return pa.record_batch([
        pa.array([run], pa.int64()), _as_list(keys), _as_list(pa.array(words.astype(np.int32))),
        pa.array([_packed(_by_first_use(numbers, before))], pa.binary()), pa.array([before], pa.int64()),
        pa.array([before + len(new)], pa.int64()), pa.array([check], pa.int64())],
        names=["part", "keys", "words", "numbers", "before", "known", "check"])


_SENT = ["numbers", "lengths", "ids", "checks"]


def _sent_back(at: list[np.ndarray], codes: list[bytes], width: int) -> pa.RecordBatch:
    """A row for each run: numbers of words (as differences), how many ids each has, the ids, a check of each word."""
    at = np.concatenate(at)
    order = np.argsort(at)
    at = at[order]
    begin = np.flatnonzero(np.r_[True, np.diff(at >> _NUMBER) > 0])
    rows = []
    for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
        here = [codes[i] for i in order[b:e].tolist()]
        lengths = np.array([(len(c) - 1) // width for c in here], np.int64)
        number = at[b:e] & ((1 << _NUMBER) - 1)
        rows.append((int(at[b]) >> _NUMBER, _packed(np.diff(number, prepend=0)), _packed(lengths),
                     _zipped(b"".join(c[1:] for c in here)), _zipped(bytes(c[0] for c in here))))
    columns = list(zip(*rows, strict=True))
    return pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["run", *_SENT])


def encode_words(rows: DataFrame, told, wide: bool = False) -> DataFrame:
    """Ids for rows of (at, word), packed for each run: equal words meet in one task, which encodes them once.

    An id takes two bytes, four if ``wide``.
    """
    kind, width = ("I", 4) if wide else ("H", 2)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, last, last_code = _splitter(told.value), None, None
        at, codes = [], []
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = bool(words) and words[0] == last  # the words are sorted: only the first can be known
            found = [last_code] if known else []
            for word, ids in zip(words[known:], splitter.encode(words[known:]), strict=True):
                found.append(bytes([_check(word.encode())]) + array.array(kind, ids).tobytes())
            if words:
                last, last_code = words[-1], found[-1]
            at.append(batch.column(0).to_numpy())
            codes += [found[i] for i in coded.indices.to_pylist()]
            if len(codes) >= _WORDS_SENT:
                yield _sent_back(at, codes, width)
                at, codes = [], []
        if codes:
            yield _sent_back(at, codes, width)

    schema = "run long, " + ", ".join(f"{c} binary" for c in _SENT)
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(giving_back(encode), schema)


def words_sent(table: pa.Table, wide: bool = False) -> tuple[pa.ListArray, bytes]:
    """The ids of a run's words in the order of their numbers, and the checks."""
    rows = table.select(_SENT).to_pylist()
    gather = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
    numbers = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_unpacked(r["numbers"])) for r in rows)])
    lengths = np.concatenate([np.zeros(0, np.int64), *(_unpacked(r["lengths"]) for r in rows)])
    ids = gather([_unzipped(r["ids"]) for r in rows], "<u4" if wide else "<u2").astype(np.int32)
    checks = gather([_unzipped(r["checks"]) for r in rows], np.uint8)
    order = np.argsort(numbers)
    if not np.array_equal(numbers[order], np.arange(len(numbers))):
        raise RuntimeError("the input changed between two readings")
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(ids))
    return lists.take(pa.array(order)), checks[order].tobytes()


def _vocabulary(tokenizer_file: str) -> str:
    with open(tokenizer_file, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row.  ``tokenizer_file`` is read on the driver and broadcast with the classes of code points."""
    description = _vocabulary(tokenizer_file)
    told = docs.sparkSession.sparkContext.broadcast((description, Splitter(description).kind))
    wide = max(json.loads(description)["model"]["vocab"].values(), default=0) + len(json.loads(description)["added_tokens"]) > 0xFFFF
    of_run = T.StructType([T.StructField("part", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), *T._parse_datatype_string(
        "words array<int>, numbers binary, before long, known long, check long").fields])
    positions = _runs(docs, told, key, text, _positions, of_run)
    codes = encode_words(_runs(docs, told, key, text, _new_words, "at long, word string"), told, wide)

    def lay_out(run: pa.Table, words: pa.Table) -> pa.Table:
        lists, checks = words_sent(words, wide)
        out = []
        for row in (run.slice(i, 1) for i in range(len(run))):
            if len(checks) < row["known"][0].as_py() or zlib.crc32(checks[: row["known"][0].as_py()]) != row["check"][0].as_py():
                raise RuntimeError("the input changed between two readings")
            keys, sizes = (row[c].combine_chunks().flatten() for c in ("keys", "words"))
            here = lists.take(pa.array(_numbers(_unpacked(row["numbers"][0].as_py()), row["before"][0].as_py())))
            ends = here.offsets.to_numpy()[np.r_[0, np.cumsum(sizes.to_numpy())]]
            out.append(pa.table({key: keys, "ids": pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), here.flatten())}))
        if not out:
            raise RuntimeError("the input changed between two readings")
        del lists, checks
        give_back()
        return pa.concat_tables(out)

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return positions.groupBy("part").cogroup(codes.groupBy("run")).applyInArrow(lay_out, schema)


def pieces(spark, tokenizer_file: str) -> DataFrame:
    """(id, piece): the bytes of each id; as many rows as the vocabulary has."""
    read = json.loads(_vocabulary(tokenizer_file))
    byte_of = _byte_of()
    names = {i: t for t, i in read["model"]["vocab"].items()} | {a["id"]: a["content"] for a in read["added_tokens"]}
    as_bytes = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    return spark.createDataFrame([(i, bytearray(as_bytes(t))) for i, t in names.items()], "id int, piece binary")


def _few_tokens(batch: pa.RecordBatch, ids: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``_TOKENS`` ids, or one row."""
    if batch.num_rows:
        sizes = pc.fill_null(pc.list_value_length(batch[ids]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(sizes) - sizes) // _TOKENS
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]).tolist()
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(b, e - b)


def decode(coded: DataFrame, tokenizer_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with the column ``ids`` replaced by the decoded ``text``."""
    keep = [c for c in coded.columns if c != ids]
    kept = T.StructType([coded.schema[c] for c in keep])
    lists = T.StructType([T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(kept.fields)])
    head = [*lists.names, "sizes", "numbers"]

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _few_tokens(whole, ids)):
            listed = batch[ids]
            flat = listed.flatten()
            coded = flat.fill_null(-1).dictionary_encode()
            sizes = pc.fill_null(pc.list_value_length(listed), 0)
            yield pa.record_batch([*(_as_list(batch[c]) for c in keep), _as_list(sizes),
                                   pa.array([_packed(coded.indices.to_numpy())], pa.binary()), _as_list(coded.dictionary)], names=[*head, "distinct"])

    blocks = coded.mapInArrow(giving_back(by_block), T.StructType([*lists.fields, *T._parse_datatype_string(
        "sizes array<int>, numbers binary, distinct array<int>").fields]))
    # a block's positions go along with its first id only
    listed = blocks.select(*head, F.posexplode_outer("distinct").alias("pos", "id"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    listed = listed.select(*[F.when(first, F.col(c)).alias(c) for c in head], "pos", "id")
    joined = listed.join(F.broadcast(pieces(coded.sparkSession, tokenizer_file)), "id", "left").select(
        *head, F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("piece", F.lit(b"")).alias("piece"))

    def string_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def done():
            block = pa.Table.from_batches(parts)
            if not np.array_equal(block["pos"].to_numpy(), np.arange(len(block))):
                raise RuntimeError("the ids of a block did not stay together")
            row = block.slice(0, 1)
            numbers = _unpacked(row["numbers"][0].as_py())
            data, offsets = column_bytes(block["piece"].combine_chunks().cast(pa.large_binary()).take(pa.array(numbers)))
            ends = offsets[np.r_[0, np.cumsum(row["sizes"].combine_chunks().flatten().to_numpy())]].tolist()
            texts = [data[b:e].tobytes().decode(errors="replace") for b, e in zip(ends[:-1], ends[1:], strict=True)]
            return pa.record_batch([*(row[c].combine_chunks().flatten() for c in lists.names), pa.array(texts, pa.string())], names=[*keep, text])

        for batch in batches:
            first = batch["pos"].to_numpy() == 0
            cuts = np.flatnonzero(np.r_[True, first[1:], True]).tolist() if batch.num_rows else []
            for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                if first[b] and parts:
                    yield done()
                    parts = []
                parts.append(batch.slice(b, e - b))
        if parts:
            yield done()

    return joined.mapInArrow(giving_back(string_together), T.StructType([*kept.fields, T.StructField(text, T.StringType())]))
