"""Components solved inside tasks, against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.operators import groups as C
from helixframe.operators import solve as P
from test_exact import best_paths
from test_library import brute_objective


def _bundles(rng, pairs):
    return [(a, b, *(float(rng.randint(0, 9)) for _ in range(4))) for a, b in sorted(pairs)]


def test_tasks_find_the_greatest_weight():
    rng = random.Random(7)
    for _ in range(25):
        rows = _bundles(rng, {tuple(sorted(rng.sample(range(5), 2))) for _ in range(rng.randint(1, 6))})
        u, v, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
        none = np.full((len(rows), 3), -1)
        assert sum(w[k][s] for k, (_, _, s) in enumerate(C.orientations(u, v, w, none))) == brute_objective(rows)
        assert sum(w[k][s] for k, (_, _, s) in enumerate(C.paths(u, v, w, none)) if s >= 0) == best_paths(rows)


def test_exact_beyond_the_width_of_rounds(spark):
    """A grid of contigs is too wide for rounds with 1 neighbour, and exact inside a task."""
    cells = [(i, j) for i in range(4) for j in range(4)]
    rows = _bundles(random.Random(3), {(10 * i + j, 10 * k + m) for (i, j), (k, m) in combinations(cells, 2) if abs(i - k) + abs(j - m) == 1})
    found = P.solve(spark.createDataFrame(rows, schemas.BUNDLE), max_width=1).agg(F.min("status"), F.max("status"), F.sum("weight")).first()
    nodes = sorted({n for r in rows for n in r[:2]})
    at = {n: i for i, n in enumerate(nodes)}
    mask = np.arange(1 << len(nodes))
    best = sum(np.where((mask >> at[a] & 1) == (mask >> at[b] & 1), max(w[0], w[3]), max(w[1], w[2])) for a, b, *w in rows).max()
    assert tuple(found) == ("exact", "exact", best)


def test_too_wide_or_forbidden_is_left():
    clique = [((i, j), np.zeros((2, 2))) for i, j in combinations(range(5), 2)]
    assert C.maximise(clique, 16) is None and C.maximise(clique, 32) is not None
    assert C.maximise([((0,), np.array([-np.inf, -np.inf]))]) is None
