"""Components too wide for one table are solved exactly by trying values."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from helixframe.operators import groups as C


def test_trials_find_the_greatest_sum():
    rng = np.random.default_rng(4)
    for n in (3, 6, 9):
        tables = [((i, j), rng.integers(0, 9, (2, 2)).astype(float)) for i, j in combinations(range(n), 2)]
        tables.append(((0, 1), np.array([[0.0, -np.inf], [-np.inf, 0.0]])))
        mask = np.arange(1 << n)
        sums = sum(t[mask >> i & 1, mask >> j & 1] for (i, j), t in tables)
        for cells in (2, 4, 16, 1 << 20):
            value = C.maximise(tables, cells, 1 << 12)
            assert sums[sum(x << v for v, x in value.items())] == sums.max()
    assert C.maximise(tables, 4, 1) is None
    never = [((0, 1), np.full((2, 2), -np.inf)), *tables[1:-1]]
    assert C.maximise(never, 4, 1 << 12) is None


def test_orientations_without_large_tables(monkeypatch):
    """The same weight whether the tables hold all or values are tried."""
    rng = random.Random(6)
    pairs = list(combinations(range(6), 2))
    u, v = (np.array(x) for x in zip(*pairs))
    for _ in range(4):
        w = np.array([[rng.randint(0, 9) for _ in range(4)] for _ in pairs], float)
        told = np.full((len(pairs), 3), -1)
        worth = lambda found: sum(w[k, s] for k, (_, _, s) in enumerate(found))  # noqa: B023, E731
        whole = worth(C.orientations(u, v, w, told))
        with monkeypatch.context() as m:
            m.setattr(C.maximise, "__defaults__", (1 << 6, 0))
            m.setattr(C, "TRIED_CELLS", 1 << 6, raising=False)
            assert worth(C.orientations(u, v, w, told)) == whole
