"""Components of arrays and of voxels against a plain search."""

import time

import numpy as np
import pytest

from scanloom.functions.unions import unite
from scanloom.operators import clusters


def plain(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        p, q = sorted((find(i), find(j)))
        root[q] = p
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_unite(seed):
    dice = np.random.default_rng(seed)
    n = 200
    i, j = dice.integers(0, n, 150), dice.integers(0, n, 150)
    root = np.arange(n)
    for at in range(0, 150, 40):  # some links at a time
        root = unite(root, i[at : at + 40], j[at : at + 40])
    assert root.tolist() == plain(n, zip(i.tolist(), j.tolist()))
    assert unite(np.arange(3), np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1, 2]


def test_a_long_chain():
    n = 20_000
    order = np.random.default_rng(1).permutation(n)
    assert not unite(np.arange(n), order[:-1], order[1:]).any()


@pytest.mark.parametrize("seed", range(4))
def test_voxels(seed):
    dice = np.random.default_rng(seed)
    rows, columns = 6, 9
    cells = np.unique(np.stack([dice.integers(-2, 9, 120), dice.integers(0, columns, 120), dice.integers(-3, 12, 120)], axis=1), axis=0)
    links = []
    for i, (r, c, d) in enumerate(cells.tolist()):
        for j, (s, e, f) in enumerate(cells.tolist()):
            near = abs(r - s) <= 1 and (c - e) % columns in (0, 1, columns - 1) and abs(d - f) <= 1
            if i < j and near and (0 <= r < rows or 0 <= s < rows):
                links.append((i, j))
    assert clusters._components(cells, rows, columns).tolist() == plain(len(cells), links)
    assert len(clusters._components(np.zeros((0, 3), int), rows, columns)) == 0


def test_many_voxels_take_a_second():
    dice = np.random.default_rng(3)
    cells = np.unique(np.stack([dice.integers(0, 14, 150_000), dice.integers(0, 180, 150_000), dice.integers(0, 400, 150_000)], axis=1), axis=0)
    began = time.perf_counter()
    clusters._components(cells, 14, 180)
    assert len(cells) > 100_000 and time.perf_counter() - began < 5
