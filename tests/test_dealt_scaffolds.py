"""Masked reads as one row a link, and scaffold rows that are dealt by a number."""

from __future__ import annotations

import random

from helixframe.operators import graph as G
from helixframe.operators import links as L
from helixframe.operators import scaffolds as S
from helixframe.operators import scores as C
from helixframe.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_reads_look_up_one_bin(spark):
    """A read longer than the bins, empty and unmasked reads; a link keeps its columns and has one row in both joins."""
    rng = random.Random(1)
    masks = sorted({(c, s, s + rng.randrange(1, 40)) for c in range(3) for s in rng.sample(range(500), 12)})
    reads = [(i, rng.randrange(4), rng.randrange(4), a, a + rng.choice((0, 5, 90, 300)), b, b + rng.choice((0, 100))) for i in range(60) for a, b in [(rng.randrange(400), rng.randrange(400))]]
    columns = "id long, ctg_a_idx long, ctg_b_idx long, read_a_left_pos long, read_a_right_pos long, read_b_left_pos long, read_b_right_pos long"
    got = L.read_weights(spark.createDataFrame(reads, columns), spark.createDataFrame(masks, "node_idx long, start long, end long"), 16, key=("id",), tasks=3)
    covered = {(c, x) for c, s, e in masks for x in range(s, e)}
    free = lambda c, s, e: round(sum((c, x) not in covered for x in range(s, e)) / (e - s), 9) if s < e else None
    wanted = {i: (free(a, s, e), free(b, t, f)) for i, a, b, s, e, t, f in reads}
    near = lambda x: None if x is None else round(x, 9)
    assert {r.id: (near(r.a_overlap), near(r.b_overlap)) for r in got.collect()} == {i: w for i, w in wanted.items() if w != (None, None)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "bin" in plan and "inline" not in plan


def test_keyed_paths_are_shuffled_once(spark):
    """Rows dealt by the scaffold's number need no shuffle by its name, and are the same."""
    keyed = S.scaffold_rows(fixtures.keyed_paths(spark, SF, "path_test"))
    plain = S.scaffold_rows(fixtures.view(spark, SF, "path_test"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(keyed).count("Exchange hashpartitioning") == 1 < plan(plain).count("Exchange hashpartitioning")
    rows = lambda df: sorted(map(repr, df.select(plain.columns).collect()))
    assert rows(keyed) == rows(plain)


def test_break_scaffolds_by_key(spark):
    """Only the good gaps are told to the scaffold, by its number or its name."""
    keyed = S.scaffold_rows(fixtures.keyed_paths(spark, SF, "path_test")).where("scaf_key < 200")
    good = S.adjacencies(keyed).where("hash(lo, hi) % 2 = 0")
    one, other = S.break_scaffolds(keyed, good), S.break_scaffolds(keyed.drop("scaf_key"), good)
    assert one.columns == [*keyed.columns, "piece"]
    assert sorted(map(repr, one.drop("scaf_key").collect())) == sorted(map(repr, other.collect()))
    kept = {(r.lo, r.hi) for r in S.adjacencies(one).collect()}
    wanted = {(r.lo, r.hi) for r in good.collect()}
    assert wanted <= kept | wanted and one.where("comp_type = 'N'").count() == S.scaffold_digraph(keyed).selectExpr("least(src, dst) AS lo", "greatest(src, dst) AS hi").join(good, ["lo", "hi"]).count()


def test_paths_across_chunks(spark):
    """Parts of paths in several ranges and chunks are put in order, whatever the ids."""
    rng = random.Random(2)
    names = [f"n{i:03}" for i in range(300)]
    rng.shuffle(names)
    chains = [names[i : i + 25] for i in range(0, 300, 25)]
    edges = spark.createDataFrame([e for c in chains for e in zip(c, c[1:])], "src string, dst string")
    assert {(r.node, r.path, r.pos) for r in G.order_paths(edges).collect()} == {(x, c[0], i) for c in chains for i, x in enumerate(c)}
    assert G.order_paths(edges.limit(0)).isEmpty()


def test_evaluate_with_and_without_tasks(spark):
    """The score row is that of its parts, whatever deals the rows."""
    ref, test = (S.scaffold_rows(fixtures.keyed_paths(spark, SF, n)) for n in ("path_ref", "path_test"))
    dealt, plain = C.evaluate(ref, test, "a", "b", tasks=7), C.evaluate(ref.drop("scaf_key"), test.drop("scaf_key"), "a", "b")
    row = dealt.first()
    assert repr(row) == repr(plain.first()) or abs(row.gap_dev - plain.first().gap_dev) < 1e-9
    pairs = S.adjacencies(ref), S.adjacencies(test)
    counts = C.confusion(*pairs, ref.where("comp_type = 'W'")).first()
    assert tuple(row[2:6]) == tuple(counts) and abs(row.gap_dev - C.gap_deviation(ref, test).first()[0]) < 1e-9
    assert row.tp50 == S.n50(S.scaffold_sizes(S.break_scaffolds(test, pairs[0].join(pairs[1], ["lo", "hi"], "left_semi")), ("scaf_name", "piece")), True).first()[0]
