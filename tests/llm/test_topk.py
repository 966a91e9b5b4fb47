"""Top-k against all inner products, ties and odd vectors included."""

from math import floor

import numpy as np
import pytest

from wavemill.llm import topk


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: v for i, v in ok if i % every == 0}.items()):
        best = sorted((-int(v @ w), j) for j, w in ok if j != q and len(w) == len(v))[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, shard int").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, **kw).collect())


@pytest.mark.parametrize("kind", ["normal", "clusters", "ties", "sparse"])
def test_against_all_products(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16))
    if kind == "clusters":
        x = x * 0.2 + rng.standard_normal((5, 16))[rng.integers(0, 5, 400)]
    if kind == "ties":
        x[50:300] = x[3]
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in zip(rng.permutation(1000)[:400], x)]
    assert run(spark, rows, every=20, shard=90, block=4) == brute(rows, 5, 20)


@pytest.mark.parametrize("levels", [1, 2, 4, 16])
def test_stops_before_the_last_segment(levels):
    rng = np.random.default_rng(5)
    x = rng.integers(-4, 5, (3000, 32)).astype(float)
    x[7] = 200
    index = topk.ImpactIndex(np.arange(3000), x, levels)
    ids, scores = index.top(1, np.abs(x[1]) + 50, 1)
    assert ids == [7] and scores[0] == x[7] @ (np.abs(x[1]) + 50) and (levels < 4 or index.rescored <= 0.05 * 3000)


def test_the_bar_and_levels_leave_few_rows_to_rescore():
    """On clustered vectors, a third of all in one cluster: results are exact, most rows are never scored."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((30, 64))
    of = np.where(rng.random(8000) < 0.33, 0, rng.integers(0, 30, 8000))
    x = np.floor(256 * (centre[of] + 0.3 * rng.standard_normal((8000, 64))))
    exact, share = x[:40] @ x.T, {}
    for bars in (False, True):
        index = topk.ImpactIndex(np.arange(8000), x)
        for q in range(40):
            want = sorted((-int(s), j) for j, s in enumerate(exact[q]) if j != q)[:5]
            ids, scores = index.top(q, x[q], 5, float(-want[-1][0]) if bars else -float("inf"))
            assert [(-s, i) for i, s in zip(ids, scores)] == want
        share[bars] = index.rescored / (40 * 8000)
    assert share[True] <= share[False] < 0.3


@pytest.mark.parametrize("large", [[1e30, 1.0], [3e38, -3e38], [2.0**44, 0.5], [1e9, 1e9]])
def test_components_of_any_size(spark, large):
    rows = [(0, large), (1, [1.0, -1.0]), (2, large[::-1]), (3, [x / 2 for x in large]), (4, [0.25, 0.5]), (50, [1.0, 1.0]), (5, [-x for x in large]), (6, [x * 0.99 for x in large])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = []
    ints = {i: [floor(x * 256) for x in v] for i, v in rows}
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want += [(q, r, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(best, 1)]
    assert run(spark, rows, shard=3) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (200, [1.0, None]), (1, [0.5, -0.5]), (2, []), (3, [1.0]), (None, [9.0, 9.0]), (250, [0.0, 0.0]), (0, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 5, 50)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
