import hashlib
import random
import re

from awkward_rows import ROWS

from dragline.llm import exact_dedup


def brute(rows):
    groups = {}
    for n, (i, text) in enumerate(rows):
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((i is None, i, n))
    return sorted(
        (str(i), str(min(g, key=lambda x: (x[0], x[1] or 0))[1]), len(g), sha, n == min(g, key=lambda x: (x[0], x[1] or 0))[2])
        for sha, g in groups.items() for _, i, n in g)


def got(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256, r.kept) for r in df.collect())


def test_awkward_rows(awkward):
    assert got(exact_dedup.duplicate_table(awkward)) == brute(ROWS)


def test_frequent_and_rare_texts(table):
    rnd = random.Random(3)
    rows = [(i, "hot text" if i % 3 == 0 else f"t{rnd.randint(0, 150)}  x") for i in range(900)]
    rnd.shuffle(rows)
    for support in (1 / 512, 0.2, 0.9):
        assert got(exact_dedup.duplicate_table(table(rows), support=support)) == brute(rows)


def test_frequent_digests_leave_before_the_shuffle(table):
    digests = table([(i, "hot" if i % 2 else str(i)) for i in range(100)]).selectExpr("doc_id id", "text digest", "doc_id at")
    assert [r.digest for r in exact_dedup.winners(digests, 0.1).collect()] == ["hot"]


def test_rows_that_stay_keep_all_columns(awkward):
    kept = exact_dedup.distinct_documents(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(x[4] for x in brute(ROWS))


def test_empty_table(nothing):
    assert exact_dedup.duplicate_table(nothing).count() == 0
    assert exact_dedup.distinct_documents(nothing).count() == 0
