"""Exact neighbours: ties by id whatever rounding says, and folds that are searched exactly."""

import numpy as np

from codonloom.learn import neighbors


def brute(x, own, y, ids, k):
    out = []
    for i, v in enumerate(x):
        gap = np.sqrt(((v - y) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, gap)) if own is None or ids[j] != own[i]][:k]
        out += [(i, int(ids[j])) for j in order]
    return out


def test_copies_and_far_vectors_rank_by_id():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(700, 6)) + 1000.0  # far from the origin: rounding is large beside the distances
    y = np.concatenate([base, base, base, base[:1].repeat(9000, 0)])
    ids = rng.permutation(len(y))
    for own in (None, ids[:600]):
        at, to, gap = neighbors.closest(y[:600], own, y, ids, 4)
        assert [(int(a), int(ids[b])) for a, b in zip(at, to, strict=True)] == brute(y[:600], own, y, ids, 4)
        assert np.array_equal(gap, np.sqrt(((y[:600][at] - y[to]) ** 2).sum(1)))


def test_few_rows():
    y, ids = np.array([[0.0, 1.0], [2.0, 0.0]]), np.array([5, 3])
    at, to, _ = neighbors.closest(y, ids, y, ids, 3)
    assert at.tolist() == [0, 1] and to.tolist() == [1, 0]
    assert len(neighbors.closest(y[:1], ids[:1], y[:1], ids[:1], 3)[0]) == 0
