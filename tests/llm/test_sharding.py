import zlib
from collections import Counter

import numpy as np
from awkward_rows import ROWS

from dragline.llm import sharding


def test_matrix_has_exact_margins():
    for counts, shards in (([5, 0, 17, 3], 4), ([1], 24), ([], 3), ([1000, 1, 999], 7)):
        sizes = sharding.shard_sizes(sum(counts), shards)
        matrix = sharding.communication_matrix(counts, sizes, 1)
        assert (matrix.sum(axis=0) == sizes).all() and matrix.sum(axis=1).tolist() == counts and (matrix >= 0).all()
        assert sizes.max() - sizes.min() <= 1


def test_matrix_is_uniform():
    drawn = np.array([sharding.communication_matrix([6, 6], np.array([4, 4, 4]), s)[0, 0] for s in range(4000)])
    # of 12 rows, 6 fall to the first partition: hypergeometric mean 2, variance 4 * .5 * .5 * 8 / 11
    assert abs(drawn.mean() - 2) < 0.05 and abs(drawn.var() - 8 / 11) < 0.06


def test_large_urns_keep_their_margins():
    counts = [3_000_000_000, 1_500_000_000]
    sizes = sharding.shard_sizes(sum(counts), 5)
    matrix = sharding.communication_matrix(counts, sizes, 2)
    assert (matrix.sum(axis=0) == sizes).all() and matrix.sum(axis=1).tolist() == counts and (matrix >= 0).all()


def test_table(table):
    docs = table([(i, "é" * (i % 7)) for i in range(1000)]).repartition(5)
    rows = sharding.shard_table(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 1000 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        body = ("é" * (r.doc_id % 7)).encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)
    by_place = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert abs(np.corrcoef([r.doc_id for r in by_place], range(1000))[0, 1]) < 0.15


def test_awkward_rows_and_all_columns(awkward, nothing):
    out = sharding.sharded(awkward, 3)
    assert out.columns == [*awkward.columns, "shard_", "slot_"]
    assert sorted(Counter(r.shard_ for r in out.collect()).values()) == [4, 5, 5]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, _ in ROWS)
    assert sharding.shard_table(nothing).count() == 0 and sharding.sharded(nothing).count() == 0
