import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from awkward_rows import ROWS

from dragline.llm import near_copies


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([b" ".join(words)] if 0 < len(words) < 5 else [b" ".join(words[i:i + 5]) for i in range(len(words) - 4)])


def similar_pairs(sets):
    """Pairs of different texts at 0.8 or more, by comparing all that share a shingle."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for held in holders.values():
        for n, i in enumerate(held):
            for j in held[:n]:
                shared[i, j] += 1
    return {(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}


def brute(rows):
    """Ids that stay, by components of all similar pairs."""
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    empty = [i for i, s in enumerate(sets) if not s]
    for i, j in [*similar_pairs(sets), *zip(empty, empty[1:], strict=False)]:
        parent[top(i)] = top(j)
    least = {}
    for i, t in rows:
        root = top(texts.index(t or ""))
        least[root] = min(least.get(root, (True, 0)), (i is None, i or 0))
    return sorted(str(None if none else i) for none, i in least.values())


def kept(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_shingles_and_similarity():
    texts = ["a b c d e f", "A  b\tc d E f", "a b", "", "b a", "x", "a b c d e"]
    hashes, begin = near_copies.shingles(pa.array([t.encode() for t in texts]))
    each = [frozenset(hashes[b:e].tolist()) for b, e in zip(begin, begin[1:], strict=False)]
    assert [len(s) for s in each] == [2, 2, 1, 0, 1, 1, 1] and each[0] == each[1] and each[6] < each[0] and len({each[2], each[4], each[5]}) == 3
    packed = lambda s: (np.array(sorted(s), np.uint64) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    assert near_copies.similarity(packed(each[0]), packed(each[6])) == 0.5 and near_copies.similarity(b"", b"") == 1


def test_awkward_rows(awkward, nothing):
    got = near_copies.one_of_each_group(awkward)
    assert got.columns == awkward.columns and kept(got) == brute(ROWS)
    assert near_copies.one_of_each_group(nothing).count() == 0


def variants(n, seed):
    """Groups of edited copies at similarities around the bound, and texts that share boilerplate only."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    plate = [word() for _ in range(60)]
    rows = []
    for g in range(n):
        base = [word() for _ in range(rnd.randint(40, 300))]
        rows.append(base)
        for _ in range(rnd.choice([0, 1, 3, 12])):
            copy = list(base)
            for _ in range(int(len(base) * rnd.choice([0, 0.005, 0.01, 0.02, 0.03, 0.1]))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(copy)
        rows.append([word() for _ in range(30)] + plate)
    rows = [" ".join(r) for r in rows] + ["short text"] * 3 + ["short  TEXT", "other text"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_recall_and_no_clean_document_goes(spark, table):
    rows = variants(60, 5)
    sets = [shingle_set(t) for _, t in rows]
    pairs = similar_pairs(sets)
    sketched = near_copies._sketched(table(rows), "doc_id", "text").collect()
    found = {frozenset((r.u, r.v)) for r in near_copies.candidates(near_copies._sketched(table(rows), "doc_id", "text")).collect()}
    name = {r.id: r.t for r in sketched}
    direct = [(i, j) for i, j in pairs if name[i] == name[j] or frozenset((name[i], name[j])) in found]
    assert len(pairs) > 300 and len(direct) > 0  # pairs in large groups meet through the group's ends
    stay, want = set(kept(near_copies.one_of_each_group(table(rows)))), set(brute(rows))
    assert want <= stay  # whatever goes has a similar document
    assert len(stay - want) <= 0.02 * (len(rows) - len(want))


def test_every_pair_at_the_bound_links(spark, table):
    """Pairs just above and below 0.8, groups linked in chains only, and a popular passage: exactly the brute force's rows."""
    rnd = random.Random(31)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    plate = [word() for _ in range(40)]
    rows = []
    for g in range(500):  # sets of 96 shingles that differ in 10 or 11 at one end: 86 / 106 and 85 / 107
        base = [word() for _ in range(100)]
        rows += [base, base[:-10 - g % 5 // 4] + [word() for _ in range(10 + g % 5 // 4)]]
    for _ in range(3):  # each is similar to the next, not to the ends
        walk = [word() for _ in range(400)]
        rows += [walk[k * 10 : k * 10 + 110] for k in range(25)]
    rows += [plate + [word() for _ in range(7)] for _ in range(120)]
    rnd.shuffle(rows)
    rows = list(enumerate(" ".join(r) for r in rows))
    assert kept(near_copies.one_of_each_group(table(rows))) == brute(rows)


def test_popular_keys_are_dealt_as_pairs_of_parts(spark, monkeypatch):
    """All pairs of a key's texts in different groups come, once, whatever the number of parts."""
    monkeypatch.setattr(near_copies, "PART", 3)
    rows = [(7, t, 100 + t, 0) for t in range(20)] + [(8, t, 100, 15) for t in range(20)]
    posted = spark.createDataFrame(rows, "key long, t long, size long, place long")
    joined = spark.createDataFrame([(1, 0), (2, 0), (5, 4)], "node long, root long")
    got = [(r.u, r.v) for r in near_copies.between_groups(posted, joined).collect()]
    root = {1: 0, 2: 0, 5: 4}
    want = {(u, v) for u in range(20) for v in range(u) if root.get(u, u) != root.get(v, v)}
    assert len(got) == len(want) and set(got) == want


def test_pairs_far_apart_do_not_leave_the_join_of_a_popular_passage(spark, table):
    """Texts that share a passage only are told apart by bitmaps before their sets are fetched; no similar pair is."""
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    plate = [word() for _ in range(40)]
    rows = [plate + [word() for _ in range(7)] for _ in range(120)]
    rows += [rows[i][:-2] + [word() for _ in range(2)] for i in range(20)]
    rows = list(enumerate(" ".join(r) for r in rows))
    sketched = near_copies._sketched(table(rows), "doc_id", "text")
    name = {r.id: r.t for r in sketched.collect()}
    apart = spark.createDataFrame([], "node long, root long")
    found = {frozenset((r.u, r.v)) for r in near_copies.between_groups(near_copies._posted(sketched), apart, sketched).collect()}
    want = {frozenset((name[i], name[j])) for i, j in similar_pairs([shingle_set(t) for _, t in rows])}
    assert len(want) >= 20 and want <= found and len(found) <= 5 * len(want)
