"""Operators on hand-made cases and against brute force."""

from __future__ import annotations

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.functions import links as X
from helixframe.operators import decompose as D
from helixframe.operators import graph as G
from helixframe.operators import links as L
from helixframe.operators import paths as H
from helixframe.operators import scaffolds as S
from helixframe.operators import scores as C
from helixframe.operators import solve as P
from helixframe.sources import text as T


def paths(spark, rows):
    """rows: scaffold, then contig, size, gap before it."""
    out = [(s, pos, c, size, float(gap), 0) for s, contigs in rows for pos, (c, size, gap) in enumerate(contigs, 1)]
    return spark.createDataFrame(out, "scaf_name string, pos long, comp_name string, size long, gap double, orien long")


@pytest.fixture(scope="module")
def agps(spark):
    size = {"c1": 100, "c2": 50, "c3": 40, "c4": 70, "c5": 60}
    ref = [("s1", [("c1", size["c1"], 0), ("c2", size["c2"], 10), ("c3", size["c3"], 20)]), ("s2", [("c4", size["c4"], 0), ("c5", size["c5"], 30)])]
    test = [("t1", [("c1", size["c1"], 0), ("c2", size["c2"], 12), ("c4", size["c4"], 25)]), ("t2", [("c3", size["c3"], 0), ("c5", size["c5"], 5)])]
    return S.scaffold_rows(paths(spark, ref)).cache(), S.scaffold_rows(paths(spark, test)).cache()


def test_scaffold_coordinates(spark):
    rows = S.scaffold_rows(paths(spark, [("s", [("a", 100, 0), ("b", 50, 10.5), ("c", 70, -3.2)])])).orderBy("scaf_idx").collect()
    assert [(r.scaf_idx, r.comp_type, r.scaf_start, r.scaf_stop) for r in rows] == [(1, "W", 1, 100), (2, "N", 101, 111), (3, "W", 112, 162), (4, "N", 163, 170), (5, "W", 171, 241)]
    assert [r.comp_stop - r.comp_start for r in rows if r.comp_type == "N"] == [9, 6]


def test_scores(agps):
    row = C.evaluate(*agps, "x", "y").first()
    assert (row.A, row.B, row.C, row.D) == (1, 2, 2, 15)
    assert row.sensitivity == row.ppv == pytest.approx(1 / 3) and row.mcc == pytest.approx(11 / 51) and row.gap_dev == pytest.approx(2 / 9)
    assert row.n50 == 98 and row.tp50 == 59
    assert S.n50(S.scaffold_sizes(agps[1])).first().n50 == 218
    n, m = 5 * 4, 3
    assert m == row.A + row.C and n - m == row.B + row.D


def test_sizes_of_one_scaffold_have_no_late_n50(spark):
    one = spark.createDataFrame([(10,)], "size long")
    assert S.n50(one, True).first().n50 is None and S.n50(one).first().n50 == 10


def test_agp_text_round_trip(spark, agps, tmp_path):
    numbered = agps[0].withColumn("line_no", F.when(F.col("scaf_name") == "s1", F.col("scaf_idx")).otherwise(F.col("scaf_idx") + 5))
    path = str(tmp_path / "a.agp")
    T.write_agp(numbered, path, runtime=1.5)
    back = T.read_agp(spark, path)
    assert set(back.columns) == set(schemas.AGP.names)
    key = ["scaf_name", "scaf_start", "scaf_stop", "scaf_idx", "comp_type", "comp_name", "comp_orien"]
    assert sorted(map(tuple, back.where("comp_type = 'W'").select(key).collect())) == sorted(map(tuple, numbered.where("comp_type = 'W'").select(key).collect()))
    lengths = {r.scaf_idx: r.comp_stop for r in back.where("comp_type = 'N' and scaf_name = 's1'").collect()}
    assert lengths == {2: 9, 4: 19}  # a written gap is one shorter
    assert T.read_runtime(spark, path).first().runtime == 1.5
    assert T.agp_violations(back).count() == 0
    broken = back.where("scaf_name = 's1' and scaf_idx <> 2")
    assert {r.rule for r in T.agp_violations(broken).collect()} == {"index", "missing gap"}
    by_line = S.adjacencies(back, by_line=True)
    assert {tuple(r) for r in by_line.collect()} == {("c1", "c2"), ("c2", "c3"), ("c4", "c5")}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    rows = T.read_lines(spark, str(path)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and all(r.value == f"line {r.line_no}" for r in rows)


def test_tables_and_small_files(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "a", 300, 0, 0, 0), (1, "b", 400, 1, 0, 0)], schemas.CONTIG)
    T.write_table(contigs, str(tmp_path / "nodes"))
    assert sorted(map(tuple, T.read_contigs(spark, str(tmp_path / "nodes")).collect())) == sorted(map(tuple, contigs.collect()))
    (tmp_path / "bad.txt").write_text("0\tx\tnope\t0\t0\t0\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|FAILFAST|NumberFormat"):
        T.read_contigs(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "x.sam").write_text("@HD\nr1/1\t0\tc1\nr2/1\t0\t*\nr3/1\t0\tc2\nr1/1\t4\tc2\nshort\t1\n")
    assert {tuple(r) for r in T.read_alignment_ids(spark, str(tmp_path / "x.sam"), "/1").collect()} == {("r1", -1), ("r3", 3)}
    assert T.read_alignment_ids(spark, str(tmp_path / "x.sam"), "/1", cutoff=0).count() == 1
    (tmp_path / "x.gff").write_text("# head\na\ts\tf\t5\t9\nzzz\ts\tf\t1\t2\n")
    assert [tuple(r) for r in T.read_masks(spark, str(tmp_path / "x.gff"), contigs).collect()] == [("a", 5, 9)]
    (tmp_path / "clusters").write_text("b + a - 10 2 3\n")
    assert [tuple(r) for r in T.read_cluster_pairs(spark, str(tmp_path / "clusters")).collect()] == [("a", "b")]
    (tmp_path / "old").write_text("1 2 0 1 1 0\n2 3 0 0 0 1\n")
    oriented, forced = T.read_previous_solution(spark, str(tmp_path / "old"))
    assert {tuple(r) for r in oriented.collect()} == {(1, 0), (2, 0), (3, 0)} and forced.count() == 2
    lines = "stage=0\ttype=N\tidx=0,,\tset=1,2,3,\nstage=1\ttype=N\tidx=0,4\tset=1,2,\nstage=1\ttype=E\tidx1=0,4\tidx2=0,5\tcut=2\nstage=1\ttype=R\tidx=0,4\nstage=2\ttype=E\tidx1=0,4,1\tidx2=0,4,2\tcut=5,6,\n"
    (tmp_path / "decomp").write_text(lines)
    tables = T.read_decomposition(spark, str(tmp_path / "decomp"))
    nodes, edges, roots = tables
    assert {(r.stage, tuple(r.path), tuple(r.members)) for r in nodes.collect()} == {(0, (0,), (1, 2, 3)), (1, (0, 4), (1, 2))}
    assert {(tuple(r.a), tuple(r.b), tuple(r.cut)) for r in edges.collect()} == {((0, 4), (0, 5), (2,)), ((0, 4, 1), (0, 4, 2), (5, 6))} and roots.first().path == [0, 4]
    T.write_decomposition(*tables, str(tmp_path / "again"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "again")).collect()) == sorted(lines.splitlines())


def test_pair_table(spark):
    rows = [(a, b, ao, bo) for a, b in ((1, 2), (2, 1)) for ao in (0, 1) for bo in (0, 1)]
    got = spark.createDataFrame(rows, "ctg_a_idx int, ctg_b_idx int, read_a_orien int, read_b_orien int").select("*", X.orientation_class().alias("c")).collect()
    assert [r.c for r in got] == [0, 1, 2, 3, 3, 1, 2, 0]


def test_directions_are_the_feasible_ones(spark):
    rows = [(s, a, b) for s in range(4) for a in (0, 1) for b in (0, 1)]
    got = {(r.s, r.a, r.b): r.w for r in spark.createDataFrame(rows, "s int, a int, b int").select("*", X.direction("s", "a", "b").alias("w")).collect()}
    forward = {(0, 0): 0, (0, 1): 1, (1, 0): 2, (1, 1): 3}
    assert all(w == (1 if s == forward[a, b] else -1 if s == 3 - forward[a, b] else None) for (s, a, b), w in got.items())


def test_masks(spark):
    links = spark.createDataFrame([("l", 1, 2, 0, 100, 10, 60)], "link_id string, ctg_a_idx long, ctg_b_idx long, read_a_left_pos long, read_a_right_pos long, read_b_left_pos long, read_b_right_pos long")
    masks = spark.createDataFrame([(1, 10, 30), (1, 20, 40), (1, 95, 200), (2, 0, 5)], "node_idx long, start long, end long")
    row = L.read_weights(links, masks, bin_width=16).first()
    assert row.a_overlap == pytest.approx(0.65) and row.b_overlap == 1.0 and row.a_coverage == 1.0


def brute_blocks(edges):
    """Edges of one block lie on a common cycle: joined while removing any one node leaves them connected."""
    nodes = {n for e in edges for n in e}

    def parts(without):
        parent = {n: n for n in nodes if n != without}

        def find(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, b in edges:
            if without not in (a, b):
                parent[find(a)] = find(b)
        return {n: find(n) for n in parent}

    cuts = {x: parts(x) for x in nodes}
    whole = parts(None)

    def together(e, f):
        if whole[e[0]] != whole[f[0]]:
            return False
        for x in nodes:
            a, b = [n for n in e if n != x], [n for n in f if n != x]
            if cuts[x][a[0]] != cuts[x][b[0]]:
                return False
        return True

    return {frozenset(f for f in edges if together(e, f)) for e in edges}


def test_blocks(spark):
    rng = random.Random(7)
    edges = set()
    for base, n, m in ((0, 8, 9), (100, 7, 6), (200, 9, 14), (300, 12, 15)):
        for _ in range(m):
            a, b = rng.sample(range(base, base + n), 2)
            edges.add((min(a, b), max(a, b)))
    found = G.blocks(spark.createDataFrame(sorted(edges), "u long, v long")).cache()
    got = {}
    for r in found.collect():
        got.setdefault(r.block, set()).add((r.u, r.v))
    wanted = brute_blocks(sorted(edges))
    assert {frozenset(s) for s in got.values()} == wanted
    members = {b: {n for e in es for n in e} for b, es in got.items()}
    cuts = {n for n in {x for s in members.values() for x in s} if sum(n in s for s in members.values()) > 1}
    assert {r.node for r in G.articulation_points(found).collect()} == cuts
    assert {(r.block, r.cut) for r in G.block_cut_tree(found).collect()} == {(b, n) for b, s in members.items() for n in s & cuts}
    assert all(len(r.shared) == 1 for r in G.shared_members(G.block_members(found).withColumnRenamed("block", "set")).collect())


def brute_objective(bundles):
    nodes = sorted({n for a, b, *_ in bundles for n in (a, b)})
    best = 0
    for bits in product((0, 1), repeat=len(nodes)):
        s = dict(zip(nodes, bits))
        options = [((w[2 * s[a] + s[b]], 1), (w[3 - 2 * s[a] - s[b]], -1)) for a, b, *w in bundles]
        for way in product((0, 1), repeat=len(bundles)):
            d = {}
            for (a, b, *_), o, k in zip(bundles, options, way):
                d[a, b], d[b, a] = o[k][1], -o[k][1]
            circle = any(d.get((x, y)) == d.get((y, z)) == d.get((z, x)) != None for x, y, z in combinations(nodes, 3) if (x, y) in d and (y, z) in d and (z, x) in d)  # noqa: E711
            if not circle:
                best = max(best, sum(o[k][0] for o, k in zip(options, way)))
    return best


def test_solver(spark):
    rng = random.Random(11)
    w = lambda: [float(rng.randint(0, 9)) for _ in range(4)]
    pieces = [
        [(0, 1, *w()), (1, 2, *w()), (0, 2, *w())],
        [(10, 11, 9.0, 0.0, 0.0, 1.0), (11, 12, 9.0, 0.0, 0.0, 1.0), (10, 12, 1.0, 0.0, 0.0, 9.0)],
        [(20, 21, *w()), (21, 22, *w()), (22, 23, *w()), (20, 23, *w()), (23, 24, *w())],
        [(30, 31, *w()), (30, 32, *w()), (30, 33, *w())],
    ]
    bundles = spark.createDataFrame([b for p in pieces for b in p], schemas.BUNDLE)
    solution = P.solve(bundles).cache()
    assert all(r.n == 0 for r in P.violations(solution, L.triangles(bundles)).collect())
    by_piece = {r.p: r.w for r in solution.groupBy(F.floor(F.col("u") / 10).alias("p")).agg(F.sum("weight").alias("w")).collect()}
    assert by_piece == {i: brute_objective(p) for i, p in enumerate(pieces)}
    assert {r.status for r in solution.collect()} == {"exact"}
    flipped = solution.withColumns(X.flipped())
    assert all(r.n == 0 for r in P.violations(flipped, L.triangles(bundles)).collect())
    rough = P.solve(bundles, max_width=1)
    assert {r.rule: r.n for r in P.violations(rough, L.triangles(bundles)).collect()} == {"xor": 0, "one direction": 0, "direction": 0, "no circle of three": 0}


def test_dense_blocks_keep_the_constraints(spark):
    """Complete graphs of 5 to 10 contigs; the larger ones are too wide to be eliminated."""
    rng = random.Random(5)
    bundles = spark.createDataFrame([(100 * n + a, 100 * n + b, *(float(rng.randint(0, 9)) for _ in range(4))) for n in range(5, 11) for a, b in combinations(range(n), 2)], schemas.BUNDLE)
    solution = P.solve(bundles).cache()
    assert {r.rule: r.n for r in P.violations(solution, L.triangles(bundles)).collect()} == {"xor": 0, "one direction": 0, "direction": 0, "no circle of three": 0}
    status = {r.n: r.status for r in solution.select(F.floor(F.col("u") / 100).alias("n"), "status").distinct().collect()}
    assert status[5] == "exact" and status[10] == "heuristic" and solution.count() == bundles.count()
    total, most = solution.agg(F.sum("weight"), F.sum("most")).first()
    assert 0.6 * most < total <= most


def test_forced_values_hold(spark):
    """A cycle and a chain with contigs of two blocks forced against their weights, against trying all."""
    rng = random.Random(2)
    rows = [(a, b, *(float(rng.randint(0, 9)) for _ in range(4))) for a, b in ((1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6), (20, 21))]
    forced = {1: 0, 3: 1, 6: 1, 21: 1}
    bundles = spark.createDataFrame(rows, schemas.BUNDLE)
    solved = P.solve(bundles, orientations=spark.createDataFrame(list(forced.items()), "node long, orien int"), directions=spark.createDataFrame([(6, 5, 1, 0)], "idxa long, idxb long, patha int, pathb int")).collect()
    orien = {n: o for r in solved for n, o in ((r.u, r.orien_a), (r.v, r.orien_b))}
    assert {n: orien[n] for n in forced} == forced and all(r.held for r in solved) and all(r.weight == [r.w0, r.w1, r.w2, r.w3][r.state] for r in solved)
    best = max(
        sum(max(w[2 * s[a] + s[b]], w[3 - 2 * s[a] - s[b]]) for a, b, *w in rows)
        for bits in product((0, 1), repeat=8)
        for s in [dict(zip((1, 2, 3, 4, 5, 6, 20, 21), bits))]
        if all(s[n] == o for n, o in forced.items())
    )
    assert sum(r.weight for r in solved) == best
    # Only pairs whose ends are both forced have their direction forced: (5, 6) has not.
    both = P.solve(bundles, orientations=spark.createDataFrame([(5, 0), (6, 0)], "node long, orien int"), directions=spark.createDataFrame([(6, 5, 1, 0)], "idxa long, idxb long, patha int, pathb int"))
    assert both.where("u = 5").select("orien_a", "orien_b", "X", "Y").first() == (0, 0, 0, 1)


def test_paths(spark):
    edges = [(1, 2, 5), (2, 3, 9), (3, 1, 4), (4, 5, 7), (5, 6, 7), (6, 4, 7), (7, 8, 1), (7, 9, 3), (10, 8, 2)]
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    matched = G.match_paths(df).cache()
    assert G.nonlinear_nodes(matched).count() == 0
    kept = {(r.src, r.dst) for r in G.break_cycles(matched).collect()}
    assert kept == {(7, 9), (10, 8)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src long, dst long")
    order = {r.node: (r.path, r.pos) for r in G.order_paths(chain).collect()}
    assert order == {i: (0, i) for i in range(21)} | {50: (50, 0), 51: (50, 1)}
    assert {(r.src, r.dst) for r in G.best_incoming(df).collect()} == {(3, 1), (1, 2), (2, 3), (6, 4), (4, 5), (5, 6), (10, 8), (7, 9)}


def test_shortest_paths(spark):
    df = spark.createDataFrame([(1, 2, 4.0), (1, 3, 1.0), (3, 2, -2.0), (2, 4, 1.0)], "src long, dst long, weight double")
    assert {r.node: r.distance for r in G.shortest_paths(df, 1).collect()} == {1: 0, 2: -1, 3: 1, 4: 0}
    with pytest.raises(ValueError, match="negative cycle"):
        G.shortest_paths(spark.createDataFrame([(1, 2, -1.0), (2, 1, 0.0)], "src long, dst long, weight double"), 1)


def test_partial_solutions(spark):
    nodes = "node long, orien int"
    merged, conflicts = P.apply_partial(spark.createDataFrame([(1, 0), (2, 1)], nodes), spark.createDataFrame([(2, 0), (3, 1)], nodes))
    assert {tuple(r) for r in merged.collect()} == {(1, 0), (2, 0), (3, 1)} and [r.node for r in conflicts.collect()] == [2]
    solved = "u long, v long, state int, X int, Y int"
    both = P.merge_partial(spark.createDataFrame([(1, 2, 0, 1, 0), (2, 3, 1, 0, 0)], solved), spark.createDataFrame([(1, 2, 3, 0, 1), (4, 5, 2, 0, 1)], solved))
    assert {tuple(r) for r in both.select("u", "v", "state", "X", "Y").collect()} == {(1, 2, 0, 1, 0), (2, 3, 1, 0, 0), (4, 5, 2, 0, 1)}


def test_buckets(spark):
    members = spark.createDataFrame([(n, n // 3) for n in range(300)] + [(1000 + n, 999) for n in range(20)], "node long, root long")
    rows = G.bucket_small(members, 10).collect()
    assert len(rows) == 101 and [r.root for r in rows if r.bucket is None] == [999]
    assert max(sum(r.size for r in rows if r.bucket == b) for b in {r.bucket for r in rows if r.bucket is not None}) <= 12


def test_greatest_matching(spark):
    rng = random.Random(4)
    for _ in range(60):
        edges = sorted({(rng.randint(0, 4), rng.randint(5, 9)): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}.items())
        rows = [(a, b, w) for (a, b), w in edges]
        got = [rows[i] for i in H.best_matching(rows)]
        assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
        valid = [c for k in range(len(rows) + 1) for c in combinations(rows, k) if len({a for a, _, _ in c}) == len({b for _, b, _ in c}) == len(c)]
        assert (len(got), sum(w for *_, w in got)) == max((len(c), sum(w for *_, w in c)) for c in valid)
    chain = spark.createDataFrame([(1, 2, 5), (3, 2, 6), (3, 4, 5)], "src long, dst long, weight long")
    assert {(r.src, r.dst) for r in H.match_maximum(chain).collect()} == {(1, 2), (3, 4)}
    assert {(r.src, r.dst) for r in H.match_maximum(chain, max_edges=1).collect()} == {(3, 2)}


def brute_branching(rows):
    best = 0
    for k in range(len(rows) + 1):
        for c in combinations(rows, k):
            into = {b: a for a, b, _ in c}
            if len(into) < len(c):
                continue
            closed = False
            for n in into:
                seen = set()
                while n in into and n not in seen:
                    seen.add(n)
                    n = into[n]
                closed |= n in seen
            if not closed:
                best = max(best, sum(w for *_, w in c))
    return best


def test_branching(spark):
    rng = random.Random(9)
    cases, rows = [], []
    for case in range(12):
        own = [(100 * case + a, 100 * case + b, w) for (a, b), w in {tuple(rng.sample(range(5), 2)): rng.randint(1, 9) for _ in range(9)}.items()]
        cases.append(own)
        rows += own
    got = H.branching(spark.createDataFrame(rows, "src long, dst long, weight long")).collect()
    assert len({r.dst for r in got}) == len(got)
    for case, own in enumerate(cases):
        assert sum(r.weight for r in got if r.src // 100 == case) == brute_branching(own)


def test_trees(spark):
    tree = spark.createDataFrame([(1, 2), (1, 5), (2, 3), (2, 4), (5, 6), (6, 7), (10, 9)], "src long, dst long")
    got = {r.node: (r.parent, r.root, r.pre, r.post) for r in G.tree_orders(tree).collect()}
    assert {n: p[2] for n, p in got.items()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 10: 0, 9: 1}
    assert {n: p[3] for n, p in got.items()} == {3: 0, 4: 1, 2: 2, 7: 3, 6: 4, 5: 5, 1: 6, 9: 0, 10: 1} and got[7][:2] == (6, 1)
    assert {(r.src, r.dst) for r in G.long_paths(tree).collect()} == {(1, 5), (5, 6), (6, 7), (2, 3), (10, 9)}
    edges = tree.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    sizes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("size", F.lit(1))
    merged = {r.node: (r.merged, r.size) for r in G.contract_tree(edges, sizes, 3).collect()}
    assert all(n <= 3 for _, n in merged.values()) and len(merged) == 9 and len({m for m, _ in merged.values()}) < 9


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 2), (3, 1, 4), (7, 8, 1), (9, 10, 3), (10, 9, 3)], "src long, dst long, weight long")
    assert {(r.src, r.dst) for r in G.break_cycles_lightest(edges).collect()} == {(1, 2), (3, 1), (7, 8), (10, 9)}
    assert {(r.src, r.dst) for r in G.break_cycles_last(edges).collect()} == {(1, 2), (2, 3), (7, 8), (9, 10)}


def test_decomposition(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (20, 21)], "u long, v long")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 20, 21, 30)], "node long")
    pieces, links, roots = D.decompose(nodes, edges)
    sets = {(r.stage, tuple(r.members)) for r in D.listed(pieces).collect()}
    assert sets == {(0, (1, 2, 3, 4, 5, 6)), (0, (20, 21)), (0, (30,)), (1, (1, 2, 3)), (1, (3, 4)), (1, (4, 5, 6))}
    assert sorted(r.cut[0] for r in links.collect()) == [3, 4] and roots.count() == 1
    blocks = G.blocks(edges)
    assert {(r.root, r.biconnected) for r in G.biconnected_components(blocks, G.components(nodes, edges)).collect()} == {(1, False), (20, True), (30, False)}
    assert {r.s for r in G.common_block(blocks, spark.createDataFrame([(1, 3), (1, 4), (4, 6)], "s long, t long")).collect()} == {1, 4}
    parts = G.set_connectivity(spark.createDataFrame([(0, 1), (0, 2), (0, 5), (1, 4)], "set long, node long"), edges)
    assert {(r.set, r.n, r.parts) for r in parts.collect()} == {(0, 3, 2), (1, 1, 1)}


def test_n50_of_many_sizes(spark):
    rng = random.Random(6)
    for sizes in ([rng.randint(-1, 10**6) for _ in range(500)], [5] * 7, [-1, -1, 0], [3, 2, 2, -1]):
        total, ordered = sum(sizes), sorted(sizes, reverse=True)
        before, late, plain_ = 0, None, None
        for x in ordered:
            if plain_ is None and 2 * (before + x) >= total:
                plain_ = x
            if late is None and total - before <= int(total / 2):
                late = x
            before += x
        df = spark.createDataFrame([(x,) for x in sizes], "size long")
        assert (S.n50(df).first().n50, S.n50(df, True).first().n50) == (plain_, late), sizes[:4]
