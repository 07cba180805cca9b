"""Token counts by compiled finite-state transducers.

Two deterministic transducers in a row count the tokens of a byte-pair vocabulary with word ends:

* ``Splitter``: over character classes, five states; its transitions say where a word of the pre-tokenizer begins.  The
  text is cut into chunks of equal length regardless of words.  Every chunk's map from entry state to exit state is
  computed for all chunks at once, the maps are composed by a parallel prefix scan, and the entry states that come out
  let every chunk emit its word starts.
* ``PairTransducer``: over the bytes of a word; each transition is annotated with the change it makes to the number of
  emitted tokens.  A state holds what the encoding of any prefix needs to go on: for each place where a token could
  still be open, the vocabulary trie node reached since, the token that ended there, and the count there less the count
  now.  States and transitions are compiled when first met and kept in tables that all words run through in lockstep.

The encoding of a prefix ends in exactly one token that, set behind the encoding of what precedes it, no merge would
change; so the last token at each place follows from the places before it, which is what makes the transducer
deterministic.

Counts equal those of the public library for the same file: Unicode composition and lower case as its normaliser does,
its special strings counted as one token each.  Defined cases: null and empty texts have no tokens; a text of any
length is read whole, its memory is a small multiple of its bytes; repeated rows, null ids and other columns pass
without effect; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
CHUNK = 1024  # bytes of a chunk of the scan
_BLOCK = 1 << 20  # bytes of text put together for one pass
_MAX_STATES = 1 << 17  # compiled states kept; beyond that the tables start anew (time, not results)
_WORD_END = "</w>"

# classes of bytes
_SPACE, _LETTER, _NUMBER, _OTHER, _SHORT, _LONG, _INSIDE = range(7)
# fixed values: the contractions of the pre-tokenizer's pattern
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = _LETTER
        elif kind == "N":
            kinds[c] = _NUMBER
    kinds[list(_SPACES)] = _SPACE
    return kinds


class Splitter:
    """Word starts of the pre-tokenizer: contractions, letter runs, single numbers, runs of other signs."""

    # states: between words, in letters, in signs, one or two bytes before the end of a contraction
    _NONE, _LETTERS, _SIGNS, _LAST, _LAST_TWO = range(5)

    def __init__(self) -> None:
        n = self._NONE
        self.next = np.zeros((5, 7), np.uint8)
        self.starts = np.zeros((5, 7), bool)
        for state in (self._NONE, self._LETTERS, self._SIGNS):
            self.next[state] = (n, self._LETTERS, n, self._SIGNS, self._LAST, self._LAST_TWO, state)
            self.starts[state] = (0, state != self._LETTERS, 1, state != self._SIGNS, 1, 1, 0)
        # inside a run of signs an apostrophe is one of them
        self.next[self._SIGNS, [_SHORT, _LONG]] = self._SIGNS
        self.starts[self._SIGNS, [_SHORT, _LONG]] = False
        self.next[self._LAST] = n
        self.next[self._LAST_TWO] = self._LAST

    def classes(self, text: str, data: np.ndarray) -> np.ndarray:
        """Class of each byte of ``data``, the UTF-8 form of ``text``."""
        out = np.full(len(data), _INSIDE, np.uint8)
        out[(data & 0xC0) != 0x80] = _classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        quotes = np.flatnonzero(data == 0x27)
        if len(quotes):
            after = np.concatenate([data, np.zeros(2, np.uint8)])
            for word in _CONTRACTIONS:
                fits = after[quotes + 1] == ord(word[1])
                if len(word) == 3:
                    fits &= after[quotes + 2] == ord(word[2])
                out[quotes[fits]] = _SHORT if len(word) == 2 else _LONG
        return out

    def word_starts(self, classes: np.ndarray) -> np.ndarray:
        n_chunks = -(-len(classes) // CHUNK)
        padded = np.full(n_chunks * CHUNK, _INSIDE, np.uint8)
        padded[: len(classes)] = classes
        columns = np.ascontiguousarray(padded.reshape(n_chunks, CHUNK).T)
        flat = self.next.ravel()
        maps = np.tile(np.arange(5, dtype=np.uint8), (n_chunks, 1))
        for column in columns:
            maps = flat[maps * np.uint8(7) + column[:, None]]
        before = self._prefix(maps)
        state = np.zeros(n_chunks, np.uint8)
        state[1:] = before[:-1, self._NONE]
        marks, out = self.starts.ravel(), np.empty((CHUNK, n_chunks), bool)
        for k, column in enumerate(columns):
            step = state * np.uint8(7) + column
            out[k] = marks[step]
            state = flat[step]
        return out.T.ravel()[: len(classes)]

    @staticmethod
    def _prefix(maps: np.ndarray) -> np.ndarray:
        """Composition of each chunk's map with all before it, in logarithmically many steps."""
        done, reach = maps.copy(), 1
        while reach < len(done):
            later = np.take_along_axis(done[reach:], done[:-reach], axis=1)
            done[reach:] = later
            reach *= 2
        return done


class PairTransducer:
    """Token counts of words under a byte-pair vocabulary, compiled state by state."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): r for r, m in enumerate(merges)}
        byte_of = self._byte_alphabet()
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[str | None] = [None]
        self.symbols: dict[str, list[str]] = {}
        for token in vocabulary:
            body = token.removesuffix(_WORD_END)
            if not body or any(c not in byte_of for c in body):
                continue  # special strings are no words
            pieces = list(body)
            path = [byte_of[c] for c in body]
            if body != token:
                pieces[-1] += _WORD_END
                path[-1] += 256
            node = 0
            for symbol in path:
                if symbol not in self.children[node]:
                    self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    self.token_at.append(None)
                node = self.children[node][symbol]
            self.token_at[node] = token
            self.symbols[token] = pieces
        self.fits: dict[tuple, bool] = {}
        self._start()

    @staticmethod
    def _byte_alphabet() -> dict[str, int]:
        """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _start(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.ids = {self.states[0]: 0}
        self.column = np.full(256, -1, np.int64)
        self.used = 0
        self.next = np.full((1024, 64), -1, np.int32)
        self.gain = np.zeros((1024, 64), np.int8)
        self.last = np.full((1024, 64), -128, np.int8)

    def _encoded(self, pieces: list[str]) -> list[str]:
        pieces = list(pieces)
        while len(pieces) > 1:
            rank, at = min((self.ranks.get(p, sys.maxsize), i) for i, p in enumerate(zip(pieces, pieces[1:], strict=False)))
            if rank == sys.maxsize:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces

    def _stands(self, before: str | None, token: str) -> bool:
        """Whether the two tokens side by side are what their letters encode to."""
        known = self.fits.get((before, token))
        if known is None:
            want = [token] if before is None else [before, token]
            known = self._encoded([s for t in want for s in self.symbols[t]]) == want
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[before, token] = known
        return known

    def _step(self, state: tuple, symbol: int) -> tuple[tuple | None, int]:
        """The next state and the change in the count; no next state after a word's last symbol."""
        found, open_ = None, []
        for node, before, behind in state:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if found is None and token is not None and self._stands(before, token):
                found = (token, behind + 1)
            if self.children[child]:
                open_.append((child, before, behind))
        token, gain = found
        if symbol >= 256:
            return None, gain
        return (*((c, b, behind - gain) for c, b, behind in open_), (0, token, 0)), gain

    def _compile(self, state: int, byte: int, column: int, final: bool) -> None:
        after, gain = self._step(self.states[state], byte + 256 * final)
        if final:
            self.last[state, column] = gain
            return
        to = self.ids.get(after)
        if to is None:
            to = self.ids[after] = len(self.states)
            self.states.append(after)
            if to >= len(self.next):
                for name, empty in (("next", -1), ("gain", 0), ("last", -128)):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.full_like(old, empty)]))
        self.next[state, column], self.gain[state, column] = to, gain

    def _columns(self, data: np.ndarray) -> np.ndarray:
        for byte in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)):
            if self.used == self.next.shape[1]:
                for name, empty in (("next", -1), ("gain", 0), ("last", -128)):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.full_like(old, empty)], axis=1))
            self.column[byte] = self.used
            self.used += 1
        return self.column[data]

    def _missing(self, state: np.ndarray, byte: np.ndarray, column: np.ndarray, final: bool) -> None:
        for key in np.unique(state.astype(np.int64) * 256 + byte):
            self._compile(int(key >> 8), int(key & 255), int(self.column[key & 255]), final)

    def counts(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of tokens of each word, given as a place and a length in ``data``."""
        if len(self.states) > _MAX_STATES:
            self._start()
        columns = self._columns(data)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        total, state = np.zeros(len(first), np.int64), np.zeros(len(first), np.int32)
        going = np.searchsorted(-length, -np.arange(1, length[0] + 1 if len(length) else 1), side="right")
        for k in range(len(going)):
            n = going[k]  # words of more than k bytes
            m = going[k + 1] if k + 1 < len(going) else 0  # of these, words that go on
            place = first[:n] + k
            column = columns[place]
            ends = self.last[state[m:n], column[m:]]
            if (gone := ends == -128).any():
                self._missing(state[m:n][gone], data[place[m:]][gone], column[m:][gone], True)
                ends = self.last[state[m:n], column[m:]]
            total[m:n] += ends
            here, column = state[:m], column[:m]
            to = self.next[here, column]
            if (gone := to < 0).any():
                self._missing(here[gone], data[place[:m]][gone], column[gone], False)
                to = self.next[here, column]
            total[:m] += self.gain[here, column]
            state[:m] = to
        out = np.empty_like(total)
        out[order] = total
        return out


class TokenCounter:
    """Counts the tokens of texts as the library does for a tokenizer file of this kind."""

    def __init__(self, description: str) -> None:
        read = json.loads(description)
        self.specials = [t["content"] for t in read["added_tokens"]]
        self.splitter = Splitter()
        self.pairs = PairTransducer(read["model"]["vocab"], read["model"]["merges"])

    def _normal(self, text: str) -> tuple[str, int]:
        special = 0
        for s in self.specials:
            if s in text:
                special += text.count(s)
                text = text.replace(s, " ")  # parts its neighbours as the library does
        if text.isascii():
            return text.lower(), special
        # letter by letter, so without the rule for a sigma at the end of a word
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower(), special

    def _block(self, texts: list[str]) -> np.ndarray:
        joined = " ".join(texts)
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        classes = self.splitter.classes(joined, data)
        starts = self.splitter.word_starts(classes)
        first = np.flatnonzero(starts)
        stops = np.flatnonzero(starts | (classes == _SPACE))
        at = np.searchsorted(stops, first, side="right")
        length = np.r_[stops, len(data)][at] - first
        # a space sign of several bytes ends a word at its first byte; the rest of it belongs to none
        tokens = np.r_[0, np.cumsum(self.pairs.counts(data, first, length))]
        sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        begin = np.r_[0, np.cumsum(sizes + 1)]
        return np.diff(tokens[np.searchsorted(first, begin)])

    def count(self, texts: list[str]) -> np.ndarray:
        out, block, size, special = [], [], 0, np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            text, special[i] = self._normal(text)
            block.append(text)
            size += len(text)
            if size >= _BLOCK:
                out.append(self._block(block))
                block, size = [], 0
        if block:
            out.append(self._block(block))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)) + special


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: the key, n_bytes, n_tokens, over_limit.

    ``tokenizer_file`` is read on the driver and broadcast (its size does not depend on the documents).
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        description = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        if tokenizer_file not in _counters:  # one for each Python worker, whatever the number of its tasks
            _counters[tokenizer_file] = TokenCounter(description.value)
        counter = _counters[tokenizer_file]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
