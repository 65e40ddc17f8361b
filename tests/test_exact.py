"""Elimination, the path model, strong components, cycle breaking, separation pairs and orders against brute force."""

from __future__ import annotations

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.operators import decompose as D
from helixframe.operators import digraph as R
from helixframe.operators import elimination as E
from helixframe.operators import graph as G
from helixframe.operators import links as L
from helixframe.operators import solve as P


def test_elimination(spark):
    """Random sums of small tables with forbidden rows, some variables set beforehand."""
    rng = random.Random(1)
    rows, problems, fixed = [], [], {}
    for p in range(12):
        n, factors = rng.randint(1, 9), []
        for k in range(rng.randint(1, 11)):
            scope = rng.sample(range(n), min(n, rng.randint(1, 3)))
            table = {bits: rng.randint(0, 20) for bits in product((0, 1), repeat=len(scope)) if not k or rng.random() < 0.95}
            factors.append((scope, table))
            rows += [(f"{p}.{k}", [(f"{p}v{v:02d}", b) for v, b in zip(scope, bits)], float(w)) for bits, w in table.items()]
        if p % 3 == 0:
            fixed[p] = rng.randrange(n)
        problems.append((n, factors))
    tables = spark.createDataFrame(rows, "f string, pairs array<struct<var:string,bit:int>>, v double").select(*E.factor(F.col("f"), F.col("pairs"), F.col("v")))
    known = spark.createDataFrame([(f"{p}v{v:02d}", 1) for p, v in fixed.items()], "var string, bit int")
    found = E.eliminate(E.condition(tables, known))
    assert found.core.isEmpty()
    bits = {r["var"]: r["bit"] for r in found.assign().union(known.select("var", F.col("bit").cast("long"))).collect()}
    worth = lambda factors, a: sum(t.get(tuple(a[v] for v in s), -1e9) for s, t in factors)
    for p, (n, factors) in enumerate(problems):
        best = max(worth(factors, a) for a in product((0, 1), repeat=n) if p not in fixed or a[fixed[p]])
        if best >= 0:
            assert worth(factors, [bits.get(f"{p}v{v:02d}", 0) for v in range(n)]) == best
    # A clique of five variables is too wide for 2, and only a core is left.
    clique = spark.createDataFrame([("c%d%d" % (i, j), [("x%d" % i, 1), ("x%d" % j, 1)], 1.0) for i, j in combinations(range(5), 2)], "f string, pairs array<struct<var:string,bit:int>>, v double")
    left = E.eliminate(clique.select(*E.factor(F.col("f"), F.col("pairs"), F.col("v"))), 2)
    assert not left.rounds and left.core.count() == 5


def best_paths(bundles):
    """Greatest weight by trying all orientations and uses."""
    nodes = sorted({n for a, b, *_ in bundles for n in (a, b)})
    best = 0
    for uses in product((None, 0, 1), repeat=len(bundles)):
        ways = [(a, b) if x == 0 else (b, a) for (a, b, *_), x in zip(bundles, uses) if x is not None]
        if len({s for s, _ in ways}) < len(ways) or len({d for _, d in ways}) < len(ways):
            continue
        if any((x, y) in ways and (y, z) in ways and (z, x) in ways for t in combinations(nodes, 3) for x, y, z in (t, t[::-1])):
            continue
        for bits in product((0, 1), repeat=len(nodes)):
            s = dict(zip(nodes, bits))
            best = max(best, sum(w[2 * s[a] + s[b] if x == 0 else 3 - 2 * s[a] - s[b]] for (a, b, *w), x in zip(bundles, uses) if x is not None))
    return best


def test_path_model(spark):
    rng = random.Random(4)
    w = lambda: [float(rng.randint(0, 9)) for _ in range(4)]
    pieces = [
        [(0, 1, *w()), (1, 2, *w()), (0, 2, *w())],
        [(10, 11, *w()), (10, 12, *w()), (10, 13, *w()), (10, 14, *w())],
        [(20, 21, *w()), (21, 22, *w()), (22, 23, *w()), (20, 23, *w()), (21, 23, *w())],
        [(30, 31, *w())],
    ]
    bundles = spark.createDataFrame([b for p in pieces for b in p], schemas.BUNDLE)
    solved = P.solve_paths(bundles).cache()
    assert {r.status for r in solved.collect()} == {"exact"} and solved.count() == bundles.count()
    got = {r.p: r.w for r in solved.groupBy(F.floor(F.col("u") / 10).alias("p")).agg(F.sum("weight").alias("w")).collect()}
    assert got == {i: best_paths(p) for i, p in enumerate(pieces)}
    assert G.degrees(P.directed_ways(solved)).where("in_degree > 1 or out_degree > 1").isEmpty()
    assert all(r.n == 0 for r in P.violations(solved.where("state is not null"), L.triangles(bundles)).collect())


def closure(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.fixture(scope="module")
def ways():
    rng = random.Random(9)
    return sorted({(p * 100 + a, p * 100 + b) for p in range(4) for a, b in (rng.sample(range(9), 2) for _ in range(11 + 2 * p))})


def test_strong_components(spark, ways):
    reach = closure(ways)
    wanted = {}
    for a, b in reach:
        if (b, a) in reach:
            wanted[a] = max(wanted.get(a, a), b)
    df = spark.createDataFrame(ways, "src long, dst long")
    assert {r.node: r.component for r in R.strong_components(df.union(spark.createDataFrame([(5, 5)], df.schema))).collect()} == wanted and wanted
    kept = {tuple(r) for r in R.break_components(df).collect()}
    assert kept == {(a, b) for a, b in ways if a not in wanted}


def test_lightest_edges_of_cycles(spark, ways):
    """One edge at a time: the lightest that lies on a cycle goes."""
    weight = {e: (7 * e[0] + 3 * e[1]) % 5 for e in ways}
    left, gone = set(ways), set()
    while True:
        reach = closure(left)
        on = [e for e in left if (e[1], e[0]) in reach]
        if not on:
            break
        worst = min(on, key=lambda e: (weight[e], e))
        left.discard(worst)
        gone.add(worst)
    df = spark.createDataFrame([(*e, w) for e, w in weight.items()], "src long, dst long, weight long")
    assert {(r.src, r.dst) for r in R.lightest_of_cycles(df).collect()} == gone and gone
    assert {(r.src, r.dst) for r in R.break_lightest(df).collect()} == left
    assert R.lightest_of_cycles(df.where("src < dst")).isEmpty()


def test_separation_pairs_and_orders(spark):
    rng = random.Random(3)
    edges = sorted({(p * 20 + min(a, b), p * 20 + max(a, b)) for p in range(3) for a, b in (rng.sample(range(8), 2) for _ in range(12))})
    named = D.named_blocks(G.blocks(spark.createDataFrame(edges, "u long, v long"))).cache()
    blocks = {}
    for r in named.collect():
        blocks.setdefault(r.block, []).append((r.u, r.v))
    wanted = set()
    for block, own in blocks.items():
        nodes = {n for e in own for n in e}
        for a, b in combinations(sorted(nodes), 2):
            rest = nodes - {a, b}
            reach = closure({(x, y) for u, v in own for x, y in ((u, v), (v, u)) if x in rest and y in rest}) | {(n, n) for n in rest}
            if len(nodes) > 3 and any((x, y) not in reach for x in rest for y in rest):
                wanted.add((block, a, b))
    assert {tuple(r) for r in G.separation_pairs(named).collect()} == wanted and wanted
    assert G.separation_pairs(named, max_work=1).isEmpty() and G.large_blocks(named, max_work=1).count() >= 1
    rows = G.block_cut_orders(named).collect()
    by_root = {}
    for r in rows:
        by_root.setdefault(r.root, []).append(r)
    for tree in by_root.values():
        assert sorted(r.pre for r in tree) == sorted(r.post for r in tree) == list(range(len(tree)))
        assert [r.kind for r in tree if r.pre == 0] == ["B"] and max(tree, key=lambda r: r.post).pre == 0
