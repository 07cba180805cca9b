import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from awkward_rows import ROWS
from pyspark.sql import functions as F

from dragline.llm import toxicity
from dragline.llm.words import SPACE, spans

BAD = ("idiot", "moron", "scum", "worthless", "pathetic")
DISGUISES = {"idiot": "id1ot", "moron": "m0r0n", "scum": "$cum", "worthless": "w o r t h l e s s", "pathetic": "paaathetic"}


@pytest.fixture(scope="module")
def restorer():
    grams = Counter()
    plain = "the and of their nation theirs another intern stand ready reason tion ingest either".split()
    for w, n in [(w, 50) for w in plain] + [(w, 20) for w in BAD] + [("tree", 30), ("class", 30)]:
        padded = f"^^{w}^"
        for i in range(len(w) + 1):
            grams[padded[i : i + 3]] += n
    return toxicity.Restorer(toxicity.Letters(grams))


def test_viterbi_restores(restorer):
    for disguised, word in (("id1ot", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("s.c.u.m", "scum"), ("idiooooot", "idiot"),
                            ("w0rthle$s", "worthless"), ("tree", "tree"), ("cla$$", "class")):
        assert restorer.word(disguised) == word
    assert restorer.word("scum", spaced=True) == "scum" and restorer.word("worthless", spaced=True) == "worthless"


def corpus(n):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice(["the", "an", "er", "in", "ti", "on", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))], i % 5 == 0
        if toxic:
            for _ in range(3):
                bad = rnd.choice(BAD)
                words.insert(rnd.randint(0, len(words)), DISGUISES[bad] if rnd.random() < 0.5 else bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy(spark, table):
    rows, labels = corpus(1500)
    # the labels of held-out rows are turned round: they must not matter
    turned = [(i, t if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t, x) for i, t, x in labels]
    scored = toxicity.score_table(table(rows), spark.createDataFrame(turned, "doc_id long, toxic int, score string")).collect()
    held = [r for r in scored if r.held_out]
    assert len(scored) == 1500 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.98


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (9, None), (5, 1), (10, 0)], "doc_id long, toxic int")
    assert toxicity.score_table(awkward, labels).count() == len(ROWS)
    kept = toxicity.accepted_documents(awkward, labels.limit(0))
    assert kept.columns == awkward.columns and kept.count() == len(ROWS)
    assert all(r.score == 0 for r in toxicity.score_table(awkward, labels.limit(0)).collect())
    assert toxicity.score_table(nothing, labels).count() == 0


def test_disguises_in_long_words_mixed_runs_and_currency_signs(restorer):
    """Each disguise gives the evidence of the plain word."""
    plain = lambda word: {*toxicity.evidence(pa.array([word.encode()]), restorer)[0][:, 0].tolist()}
    joined = "/".join(["the", "nation"] * 8 + ["id1ot"] + ["their", "reason"] * 8)
    for disguised, word in (
        ("idi" + "o" * 200 + "t", "idiot"), (joined, "idiot"), (joined.replace("/", "_"), "idiot"), (joined.replace("/", ","), "idiot"),
        ("the i d 1 o t", "idiot"), ("the $ c u m and", "scum"), ("w 0 r t h l € $ s", "worthless"), ("worthl€ss", "worthless"),
        ("wor£d w0rth£ess", "worthless"), ("s¢um", "scum"), ("¢lass", "class"), ("the€", "the"),
    ):
        assert plain(word) <= plain(disguised), disguised
    assert not toxicity.evidence(pa.array(["1 2 3 4 € 5".encode()]), restorer)[0].size


def test_runs_hold_any_single_letter_or_sign():
    data = np.frombuffer("one é $ € m two a 漢 1 .".encode(), np.uint8)
    first, last = spans(data, np.zeros(0, np.int64), SPACE)
    low, high, _, begin, end = toxicity.marked_words(data, first, last)
    assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [(1, 5), (6, 9)] and low[3] == high[3]


def test_all_labelled_rows_are_learned_from(spark, table):
    """Labels of any number, the bitmap of which is crowded, each meet their document, and no other row does."""
    n = 160_000  # 120,000 of them are not held out
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS toxic")
    docs = spark.range(0, 2 * n, 2).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    got = toxicity._training(toxicity._rows(docs, "doc_id", "text", F.lit(0)), labels)
    want = {(str(i).encode(), int(i % 3 == 0)) for i in range(0, n, 2) if zlib.crc32(str(i).encode()) % 4 != 2}
    rows = [(bytes(r.body), r.toxic) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    all_ = [(str(i).encode(), int(i % 3 == 0)) for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    every = toxicity._training(toxicity._rows(labels.selectExpr("doc_id", "CAST(doc_id AS STRING) AS text"), "doc_id", "text", F.lit(0)), labels)
    assert every.count() == len(all_)


def test_weights_by_sums_of_tasks(spark):
    """The distributed steps reach the maximum: the slope vanishes there."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(5000, 3))
    y = (rnd.random(5000) < 1 / (1 + np.exp(-(x @ [1.5, -2.0, 0.5] - 1)))).astype(int)
    data = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y long")
    w = toxicity._logistic(data)
    full = np.column_stack([np.ones(len(x)), x])
    slope = full.T @ (y - 1 / (1 + np.exp(-full @ w))) - 1e-3 * w
    assert np.abs(slope).max() < 1e-4
    assert (toxicity._logistic(data.repartition(5)) == w).all()


def test_few_labels_meet_their_documents_as_many_do(spark, table):
    """The join with labels never turns into a broadcast: its shuffle grows with the input from the smallest size on."""
    rows = [(i, f"word{i} text") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)], "doc_id long, toxic int")
    training = toxicity._training(toxicity._rows(table(rows), "doc_id", "text", F.lit(0)), labels)
    assert training.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 400, 3))
    training.collect()
    plan = training._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # the pages of bits
