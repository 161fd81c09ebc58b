import numpy as np

from tessera.operators import kernels

RNG = np.random.default_rng(1)
X = RNG.normal(size=(300, 12))


def test_nearest_equals_a_full_sort():
    for metric in ("ip", "l2sqr", "l2", "l1", "linf", "cosine"):
        got = kernels.nearest(np.arange(5), X[:5], np.arange(300), X, 7, metric, False)
        for q in range(5):
            far = sorted((float(kernels.sums(X[i], X[q], metric)), i) for i in range(300) if i != q)[:7]
            assert [(i, d) for g, i, d in got if g == q] == [(i, d) for d, i in far], metric


def test_fewer_points_than_asked():
    assert len(kernels.nearest(np.arange(2), X[:2], np.arange(3), X[:3], 9, "ip", False)) == 4


def test_best_first_over_a_complete_graph_is_exact():
    found, cost = kernels.best_first(lambda p: range(300), X, X[0], [5], 10, lambda a, b: kernels.sums(a, b[None], "l2sqr"))
    assert cost == 300 and [p for _, p in found] == [i for _, i in sorted((float(kernels.sums(X[i], X[0], "l2sqr")), i) for i in range(300))[:10]]


def test_spanning_forest_keeps_the_degree():
    edges = kernels.spanning_forest(X, np.arange(60), 3, "l2sqr")
    degree = np.bincount([e for a, b, _ in edges for e in (a, b)])
    assert degree.max() <= 3 and 40 <= len(edges) <= 59
    full = kernels.spanning_forest(X, np.arange(60), 60, "l2sqr")
    assert len(full) == 59


def test_balanced_leaves_cover_all():
    leaves = kernels.balanced_leaves(X, np.arange(300), 40, np.random.default_rng(0))
    assert sorted(np.concatenate(leaves).tolist()) == list(range(300)) and max(map(len, leaves)) <= 40


def test_diverse_keeps_no_neighbour_that_is_nearer_to_a_kept_one():
    vectors = {i: X[i] for i in range(300)}
    cand = [(float(kernels.sums(X[i], X[0], "l2sqr")), i) for i in range(1, 60)]
    kept = kernels.diverse(X[0], cand, vectors, 20, "l2sqr")
    for n, (d, c) in enumerate(kept):
        assert all(kernels.sums(X[k], X[c], "l2sqr") >= d for _, k in kept[:n])
