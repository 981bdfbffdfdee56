"""Elias-Fano sequences: decoding and searching the bits give the same."""

import numpy as np
import pytest

from scanloom.llm import elias_fano

CASES = {
    "one": ([7], 1 << 64),
    "few": ([0, 1, 99], 100),
    "a block": (range(0, 640, 10), 1 << 20),
    "a block and one": (range(0, 650, 10), 1 << 20),
    "all": (range(5000), 5000),
    "wide": (np.random.default_rng(1).integers(0, 1 << 62, 20_000), 1 << 62),
    "clustered": ([*range(900), *range(1 << 50, (1 << 50) + 70_000, 13), *range(1 << 60, (1 << 60) + 90)], 1 << 61),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("sparse", [0, 10, 1 << 40])
def test_sequence(monkeypatch, name, sparse):
    monkeypatch.setattr(elias_fano, "SPARSE", sparse)
    values, universe = CASES[name]
    values = np.unique(np.array(list(values), dtype=np.uint64))
    found = elias_fano.Sequence(elias_fano.encode(values, universe))
    rng = np.random.default_rng(2)
    for n in (1, 40, 3000):
        queries = np.unique(np.concatenate([rng.choice(values, min(n, len(values))), rng.integers(0, min(universe, 1 << 62), n).astype(np.uint64), values[-1:] + np.uint64(1)]))
        assert np.array_equal(found.find(queries), np.where(np.isin(queries, values), np.searchsorted(values, queries), -1))
        index = np.unique(rng.integers(0, len(values), n))
        assert np.array_equal(found.get(index), values[index])
        at, value = found.last_not_above(queries)
        assert np.array_equal(at, np.searchsorted(values, queries, "right") - 1) and np.array_equal(value[at >= 0], values[at[at >= 0]])


def test_empty():
    found = elias_fano.Sequence(elias_fano.encode(np.zeros(0, np.uint64), 10))
    assert len(found) == 0 and found.find(np.array([3], np.uint64)).tolist() == [-1]


def test_files(tmp_path):
    arrays = elias_fano.named("x", elias_fano.encode(np.arange(1000, dtype=np.uint64) ** 2, 1 << 20)) | {"codes": np.arange(5, dtype=np.uint8), "none": np.zeros(0, np.uint64)}
    elias_fano.write(f"file://{tmp_path}/a/b", arrays)
    elias_fano.write(f"file://{tmp_path}/a/b", arrays)  # a task that runs again
    back = elias_fano.open_mapped(f"file://{tmp_path}/a/b")
    assert all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in arrays.items())
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b"]
