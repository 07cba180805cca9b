import random

import xxhash
from awkward_rows import ROWS

from dragline.llm import components, simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if grams and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(keys, linked):
    """Least member of each key's component."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_links_are_complete(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(4):
            fps.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))))
    fps |= {0, 7, (1 << 64) - 1, (1 << 64) - 8}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {frozenset(((r.a + (1 << 64)) % (1 << 64), (r.b + (1 << 64)) % (1 << 64))) for r in simhash.links(df).collect()}
    assert found == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(rnd.randint(300, 360), rnd.randint(300, 360)) for _ in range(45)] + [(7, 7)]
    nodes = {x for e in edges for x in e}
    near = {frozenset(e) for e in edges}
    want = groups(nodes, lambda a, b: frozenset((a, b)) in near)
    got = {n: n for n in nodes} | {r.node: r.root for r in components.roots(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_awkward_rows(awkward, nothing):
    fps = [fingerprint(t) for _, t in ROWS]
    root = groups(set(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    ids = {}
    for (i, _), f in zip(ROWS, fps, strict=True):
        if i is not None:
            ids[root[f]] = min(ids.get(root[f], i), i)
    want = sorted((str(i), f"{f:016x}", str(ids.get(root[f]))) for (i, _), f in zip(ROWS, fps, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.component_table(awkward).collect())
    assert got == want
    left = simhash.one_of_each_group(awkward)
    assert left.columns == awkward.columns and left.count() == len(set(root.values()))
    assert simhash.component_table(nothing).count() == 0 and simhash.one_of_each_group(nothing).count() == 0
