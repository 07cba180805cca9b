import random

import numpy as np
from awkward_rows import ROWS

from dragline.llm import decontaminate


def words(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, at string")


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_copies_substitutions_and_parts(spark, table):
    item = words(36, 1)
    swap = lambda every, phase: [("other" if k % every == phase else w) for k, w in enumerate(item)]
    docs = {1: item, 2: [w.upper() + "," for w in item], 3: item[:14], 4: item[:9], 5: words(36, 2), 6: sorted(item)}
    docs |= {10 + p: swap(5, p) for p in range(5)} | {20 + p: swap(4, p) for p in range(4)} | {30 + p: swap(3, p) for p in range(3)}
    rows = [(i, " ".join([*words(50, i + 100), *d, *words(30, i + 200)])) for i, d in docs.items()]
    found = pairs(decontaminate.leak_table(table(rows), benchmark(spark, [(7, " ".join(item)), (8, " ".join(words(30, 3)))])))
    assert found == {(i, 7) for i in docs if i not in (4, 5, 6)}


def test_every_planted_item_in_a_long_text(spark, table):
    items = [(i, " ".join(words(20 + i, i))) for i in range(30)]
    text = " ".join(f"{t} {' '.join(words(5, i + 900))}" for i, t in items)
    clean = [(100 + i, " ".join(words(200, 5000 + i))) for i in range(50)]
    got = decontaminate.leak_table(table([(1, text), (2, text), *clean]), benchmark(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 2) for i, _ in items}
    assert all(r.matched_words == r.item_words == r.overlap_words for r in got)
    place = {r.item_id: r.first_word for r in got if r.doc_id == 1}
    assert all(text.split()[place[i] : place[i] + 3] == t.split()[:3] for i, t in items)


def test_awkward_rows(spark, awkward, nothing):
    items = benchmark(spark, [(3, ROWS[0][1]), (2, ROWS[0][1]), (4, None), (5, ""), (6, "two words"), (None, ROWS[0][1])])
    left = decontaminate.clean_documents(awkward, items)
    assert left.columns == awkward.columns
    hit = {1, 4, 8, 11}  # the same eight words, whatever their case and spacing
    assert pairs(decontaminate.leak_table(awkward, items)) == {(i, 2) for i in hit}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in ROWS if i not in hit)
    none = items.limit(0)
    assert decontaminate.leak_table(awkward, none).count() == 0
    assert decontaminate.leak_table(nothing, items).count() == 0
    assert decontaminate.clean_documents(awkward, none).count() == len(ROWS)


def test_parts_of_an_item_in_place(spark, table):
    """Equal runs that join over gaps to less than the identity count by themselves."""
    item = words(48, 1)
    parts = [w if k < 10 or 19 <= k < 29 or k >= 38 else "other" for k, w in enumerate(item)]
    rows = [(1, " ".join([*words(20, 2), *parts, *words(20, 3)]))]
    got = decontaminate.leak_table(table(rows), benchmark(spark, [(7, " ".join(item))])).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].matched_words >= 0.65 * got[0].overlap_words


def test_most_equal_is_exact():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        same = rnd.random(rnd.integers(1, 40)) < rnd.choice([0.3, 0.5, 0.7])
        if not same.any():
            continue
        want = max((int(same[a:b].sum()), a - b, -a) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                   if 20 * same[a:b].sum() >= 13 * (b - a))
        a, b = decontaminate.most_equal(same)
        assert (int(same[a:b].sum()), a - b, -a) == want
