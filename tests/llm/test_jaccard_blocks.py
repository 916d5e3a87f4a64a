"""op8's search of one block that holds a large group of drifted copies, few of which link."""

import time

import numpy as np
import pytest

from lexloom.llm import jaccard_join


def _drifted(m: int, seed: int) -> list[np.ndarray]:
    """Sets that keep 60 to 100 % of one base of 146 tokens, the rest being their own, sorted by size."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 146).astype(np.uint64)
    sets = []
    for share in rng.uniform(0.6, 1, m):
        keep = base[rng.random(146) < share]
        sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 62, rng.integers(0, 147 - len(keep))).astype(np.uint64)))))
    return sorted(sets, key=len)


def _brute(sets: list[np.ndarray], percent: int) -> list[int]:
    flat = np.unique(np.concatenate(sets))
    held = np.zeros((len(sets), len(flat)), np.float32)
    for i, s in enumerate(sets):
        held[i, np.searchsorted(flat, s)] = 1
    both, n = (held @ held.T).astype(np.int64), np.array([len(s) for s in sets])
    on = 100 * both >= percent * (n[:, None] + n - both)
    least = np.arange(len(sets))
    while True:
        new = np.array([least[row].min() for row in on])
        if (new == least).all():
            return least.tolist()
        least = new


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_drifted_copies_equal_brute_force(percent):
    sets = _drifted(300, percent)
    assert jaccard_join.local_links(list(sets), percent) == _brute(sets, percent)


@pytest.mark.parametrize("cost", [0, 16, 1 << 20])
def test_divide_skip_counts_alike_however_it_merges(cost, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PROBE_COST", cost)
    rng = np.random.default_rng(4)
    lists = [np.flatnonzero(rng.random(200) < share) * step for step in (1, 1000) for share in rng.uniform(0, 1, 40)]
    for need in (1, 5, 20, 40):
        docs, hits = jaccard_join.divide_skip(lists, need)
        want, n = np.unique(np.concatenate(lists), return_counts=True)
        assert dict(zip(docs.tolist(), hits.tolist(), strict=True)) == dict(zip(want[n >= need].tolist(), n[n >= need].tolist(), strict=True))


def test_a_large_group_of_drifted_copies_is_short_work():
    """Merged entry by entry over a heap, these took minutes."""
    start = time.process_time()
    jaccard_join.local_links(_drifted(4000, 1), 90)
    assert time.process_time() - start < 30
