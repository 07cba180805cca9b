import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from awkward_rows import ROWS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dragline.llm import bpe_codec

FILE = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "b", "'", "s", "t", "re", "ll", "ve", "m", "d", "S", " ", "  ", "\n", "\t", "1", "2", "!", ".", "é", "漢", "🙂", " ", "　",
         "<|endoftext|>", "<|", "|>", "endoftext", "٣", "́", "ſ", "\x00", "\x85", "​", " ", "Ⅷ", "½"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def splitter():
    return bpe_codec.Splitter(open(FILE, encoding="utf-8").read())


def split(splitter, texts):
    parts = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = splitter.starts(data, np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64))
    return [bytes(data[b:e]).decode() for b, e in zip(begin, np.r_[begin[1:], len(data)], strict=True)]


def words(library, texts):
    out = []
    for text in texts:
        for n, part in enumerate(text.split("<|endoftext|>")):
            out += ["<|endoftext|>"] * (n > 0) + [part[b:e] for _, (b, e) in library.pre_tokenizer.pre_tokenize_str(part)]
    return out


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_words_begin_where_the_library_begins_them(splitter, library, monkeypatch, piece):
    monkeypatch.setattr(bpe_codec, "_PIECE", piece)
    rnd = random.Random(piece)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for _ in range(150):
        texts = ["".join(rnd.choice(SIGNS) if rnd.random() < 0.8 else chr(rnd.choice(points)) for _ in range(rnd.randint(0, 80))) for _ in range(4)]
        assert split(splitter, texts) == words(library, texts), texts


def codes(spark_rows):
    return sorted(((str(r.doc_id), list(r.ids), r.decoded) for r in spark_rows), key=str)


def brute(library, rows):
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    return sorted(((str(i), x, library.decode(x, skip_special_tokens=False)) for i, x in ids), key=str)


def both_ways(docs):
    coded = bpe_codec.encode(docs, FILE)
    return bpe_codec.decode(coded.withColumn("copy", F.col("ids")), FILE, ids="copy", text="decoded").collect()


def test_awkward_rows(awkward, library):
    assert codes(both_ways(awkward)) == brute(library, ROWS)


def test_random_texts(table, library):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 60)))) for i in range(600)]
    assert codes(both_ways(table(rows).repartition(7))) == brute(library, rows)


def test_a_long_text_without_spaces(table, library):
    rows = [(1, "ab1" * 400_000), (2, "z" * 50_000), (3, "ok")]
    assert codes(both_ways(table(rows))) == brute(library, rows)


def test_empty_tables(nothing, table):
    assert both_ways(nothing) == []
    assert codes(both_ways(table([(1, None), (2, ""), (2, "")]))) == [("1", [], ""), ("2", [], ""), ("2", [], "")]


def test_decoding_any_ids(spark, library):
    rows = [(1, [50256, 0, 5, 99999, None, 40], "x"), (2, [], "y"), (None, None, "z"), (3, [187, 50255], "w"), (4, [153, 104], "v")]
    got = bpe_codec.decode(spark.createDataFrame(rows, "pos long, ids array<int>, piece string"), FILE)
    assert got.columns == ["pos", "piece", "text"]
    known = [(str(i), p, library.decode([x for x in ids or [] if x is not None and x < 50257], skip_special_tokens=False)) for i, ids, p in rows]
    assert sorted((str(r.pos), r.piece, r.text) for r in got.collect()) == sorted(known)


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    told = spark.sparkContext.broadcast((open(FILE, encoding="utf-8").read(), np.zeros(1, np.uint8)))
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def encode(self, words):
            calls.add(len(words))
            return [[len(w)] for w in words]

    monkeypatch.setattr(bpe_codec, "_splitter", lambda told: Counting())
    monkeypatch.setattr(bpe_codec, "_WORDS_SENT", 1000)
    frame = spark.range(30_000).selectExpr("(id % 2) * (16777216L) + (id div 2) AS at", "concat('w', (id div 2) % 50) word")
    got = bpe_codec.encode_words(frame, told).toArrow().to_pylist()
    for run in (0, 1):
        lists, checks = bpe_codec.words_sent(pa.Table.from_pylist([r for r in got if r["run"] == run]))
        assert lists.to_pylist() == [[len(f"w{i % 50}")] for i in range(15_000)] and len(set(checks[:50])) > 10
    assert calls.value == 50


def test_runs_of_many_slices(table, library, monkeypatch):
    """Words are numbered on from slice to slice, and anew in each run."""
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randint(0, 400)}" for _ in range(40))) for i in range(300)] + [(900, ""), (901, None)]
    docs = table(rows).coalesce(2)
    for run, words in ((1 << 14, 1 << 20), (1 << 30, 150), (1 << 30, 1 << 20)):
        for name, value in (("_SLICE", 1 << 11), ("_RUN", run), ("_RUN_WORDS", words)):
            monkeypatch.setattr(bpe_codec, name, value)
        assert codes(both_ways(docs)) == brute(library, rows)


def test_input_that_changes_is_noticed(spark):
    def new_texts(frames):
        import uuid
        for f in frames:
            yield f.assign(text=[f"word{uuid.uuid4().hex}" for _ in range(len(f))])

    changing = spark.range(400).selectExpr("id AS doc_id").mapInPandas(new_texts, "doc_id long, text string")
    with pytest.raises(Exception, match="input changed"):
        bpe_codec.encode(changing, FILE).collect()
