import random
import re
from collections import Counter

import numpy as np
import pytest
from awkward_rows import ROWS
from pyspark.sql import functions as F

from dragline.llm import collocations


def brute(rows, least=30, absorbed=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from counts of all runs of one to four words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = {}
    longest = Counter()
    candidates = [(lang, g) for (lang, g), a in f.items() if len(g) > 1 and a >= least]
    for lang, g in candidates:
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                longest[lang, g[i:i + k]] = max(longest[lang, g[i:i + k]], f[lang, g])
    for lang, g in candidates:
        a = f[lang, g]
        if 100 * longest[lang, g] >= absorbed * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
                  for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def frame(spark, rows, parts=4):
    schema = "lang string, text string, doc_id long, n long, rank string, w0 string, score string, h string"
    return spark.createDataFrame([(*r, i, 1, "?", "?", "?", "?") for i, r in enumerate(rows)], schema).repartition(parts)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(t in ("bigint", "string") for _, t in df.dtypes)
    return sorted(map(tuple, df.collect()))


def texts(n, seed):
    rnd = random.Random(seed)
    common = ["Of", "the", "In", "a", "ß", "New", "york", "CITY"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(0, 60)):
            x = rnd.random()
            words += (["new", "york", "city", "hall"] if x < 0.05 else ["in", "the", "of"] if x < 0.1 else [rnd.choice(common)] if x < 0.8
                      else [f"w{rnd.randint(0, 3000)}"])
            words.append(rnd.choice(["", "", "", "", "\t", "  ", ". ", "\n", ",", "?!"]))
        out.append((rnd.choice(["en", "en", "fr", None, "und"]), " ".join(words)))
    return out


@pytest.mark.parametrize(("budget", "codes", "least"), [(1 << 20, 1 << 19, 30), (64, 3, 5), (600, 0, 12)])
def test_same_as_counting_everything(spark, monkeypatch, budget, codes, least):
    """Small budgets extend prefixes to three words; few codes send suffixes as hashes."""
    monkeypatch.setattr(collocations.frequent_phrases, "__defaults__", (least, budget, codes))
    rows = texts(400, 7)
    want = brute(rows, least)
    assert {len(r[2].split()) for r in want} == {2, 3, 4} and len({r[0] for r in want}) == 3
    assert got(collocations.collocations(frame(spark, rows), least=least, budget=budget)) == want


def test_first_phrases_and_ties(spark):
    rows = [("en", f"x{i % 40} y{i % 40}. z{i % 40} q{i % 40}") for i in range(40 * 6)] + [("fr", "a b")] * 5
    for top in (1, 7, 60):
        assert got(collocations.collocations(frame(spark, rows), least=5, top=top)) == brute(rows, 5, top=top)


def test_awkward_rows(spark, awkward, nothing):
    pairs = [(None, t) for _, t in ROWS]
    assert got(collocations.collocations(awkward, least=30)) == brute(pairs)
    assert got(collocations.collocations(awkward, least=2)) == brute(pairs, 2)
    assert got(collocations.collocations(nothing)) == []
    assert got(collocations.collocations(frame(spark, [("en", None), (None, ""), ("fr", " . ")]), least=1)) == []


def test_products_beyond_64_bits(spark):
    big = 9 * 10**15
    phrases = spark.createDataFrame([(1, 0, 0, 0, big), (2, 0, 0, 0, big + 7), (1, 2, 0, 0, big - 3)], "w0 long, w1 long, w2 long, w3 long, a long")
    r = collocations.scored(phrases).collect()
    assert [(x.a, x.l, x.r, x.score) for x in r] == [(big - 3, big, big + 7, 2_000_000 * (big - 3) // (2 * big + 7))]


def test_groups_keep_to_the_budget(spark):
    """The occurrences of the prefixes of a group; a full path of four words may be above."""
    rows = texts(400, 3)
    t = collocations._texts(frame(spark, rows), "text", "lang")
    words = collocations._vocabulary(t, 5, 0)
    bits = spark.sparkContext.broadcast(collocations._bitmap(words))
    groups, above = collocations.partition(t, words, bits, 0, 100)
    assert len(groups.hot) == 3 and len(above) == 2

    def loads(suffixes):
        import pyarrow as pa
        return pa.record_batch([pa.array(groups.of(suffixes)), pa.array(suffixes.view(np.int64)[:, 2])], names=["g", "w"])

    got = collocations._pass(t, bits, 0, loads, "g long, w long").groupBy("g").agg(F.count("*").alias("n")).collect()
    deep = groups.level_ends[2]
    assert max((r.n for r in got if r.g < groups.level_ends[0]), default=0) <= 100
    assert np.median([r.n for r in got]) <= 100 and all(r.n <= 300 for r in got if r.g < deep)


def test_words_that_share_a_hash_are_noticed(spark, monkeypatch):
    real = collocations._Words.__init__

    def few_hashes(self, batch, seed):
        real(self, batch, seed)
        self.hash &= np.uint64(0xFF)

    # workers import the class, so what they run is given to them by value
    class Few(collocations._Words):
        __init__ = few_hashes

    monkeypatch.setattr(collocations, "_Words", Few)
    t = collocations._texts(frame(spark, [("en", " ".join(f"w{i}" for i in range(600)))] * 3), "text", "lang")
    assert collocations._vocabulary(t, 1, 0).filter("torn").count()


def test_tables_that_grow_behind_an_explode_are_not_broadcast(spark):
    """The planner does not see the copies of a looked-up table, so its size estimate may not choose the join."""
    phrases = spark.createDataFrame([(1, 0, 0, 0, 9), (2, 0, 0, 0, 8), (3, 0, 0, 0, 8), (1, 2, 0, 0, 7), (1, 2, 3, 0, 7)], "w0 long, w1 long, w2 long, w3 long, a long")
    left = collocations.not_absorbed(collocations.scored(phrases), phrases)
    assert [(x.w0, x.w1, x.w2) for x in left.collect()] == [(1, 2, 3)]
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()


def test_short_codes_go_to_the_most_frequent_words(spark):
    words = spark.range(1000).selectExpr("id * 7919 as h", "if(id < 10, 500 + id, if(id < 300, 40, 30)) as n", "id as lang")
    n_of = {r.h: r.n for r in words.collect()}
    for most in (0, 1, 10, 15, 299, 300, 700, 1000, 5000):
        found = collocations._most_frequent(words, most).view(np.int64).tolist()
        assert len(found) == len(set(found)) <= most and (most not in (0, 1, 10, 300, 1000, 5000) or len(found) == min(most, 1000))
        left_out = max((n_of[h] for h in set(n_of) - set(found)), default=0)
        assert min((n_of[h] for h in found), default=1000) >= left_out
    assert not len(collocations._most_frequent(words.filter("false"), 5))
