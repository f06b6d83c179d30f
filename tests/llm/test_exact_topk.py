import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltflow.llm import exact_topk


def brute(rows, k, asked=lambda i: i % 20 == 0):
    """rows of (id, vector) in order; each query's (id, score) list."""
    ok = [(n, i, [math.floor(64 * x) if abs(x) < 2**53 else int(x) * 64 for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if asked(i):
            s = [(-min(max(sum(a * b for a, b in zip(q, c)), -(2**63) + 1), 2**63 - 1), j, m) for m, j, c in ok if m != n and len(c) == len(q)]
            out += [(i, r, j, -x) for r, (x, j, _) in enumerate(sorted(s)[:k], 1)]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 6), st.integers(1, 9), st.sampled_from([1, 3, 2**20, 2**40, 2**70]), st.randoms())
def test_a_block_gives_the_best(k, dim, n, size, random):
    numbers = np.array([[random.choice([0, 0, 1, -2, size]) for _ in range(dim)] for _ in range(n)], object if size > 2**62 else np.int64).reshape(n, dim)
    ids = np.array([random.randrange(4) for _ in range(n)])
    block = exact_topk.Postings(ids, np.arange(n), numbers)
    q = np.array([[random.choice([0, 1, -1, size]) for _ in range(dim)] for _ in range(3)], numbers.dtype).reshape(3, dim)
    a, b, s = block.best(np.array([0, n + 1, n - 1]), q, k)
    for j, own in enumerate([0, n + 1, n - 1]):
        want = sorted((-min(max(sum(int(x) * int(y) for x, y in zip(q[j], numbers[r])), -(2**63) + 1), 2**63 - 1), int(ids[r]), r) for r in range(n) if r != own)[:k]
        mine = sorted(zip((-s[a == j]).tolist(), block.ids[b[a == j]].tolist(), block.keys[b[a == j]].tolist()))
        assert mine == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * j) % 7 - 3) / 3.0 for j in range(1, 9)]) for i in range(130)]
    rows += [(20, [0.5] * 8), (20, [0.5] * 8), (40, [0.0] * 8), (None, [1.0] * 8), (60, None), (80, [1.0, None] + [0.0] * 6), (100, [nan] * 8), (120, [inf] * 8)]
    rows += [(140, []), (141, []), (160, [1.0]), (180, [1e300] * 8), (181, [-1e300] * 8), (200, [2.0**40] * 8)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<double>, v string, row int").coalesce(1)
    got = exact_topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("split", [{"GROUP_QUERIES": 3, "SHARD_ROWS": 40, "BLOCK_ROWS": 9, "LEAST_ROWS": 1}, {"SIDE_BY_SIDE": 2}])
def test_blocks_shards_and_groups_change_nothing(spark, monkeypatch, split):
    for name, v in split.items():
        monkeypatch.setattr(exact_topk, name, v)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * (rng.random(6) < 0.3)]) for i in rng.permutation(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plain = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())) == brute(plain, 5)
