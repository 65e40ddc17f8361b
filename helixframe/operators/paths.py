"""Directed scaffold graphs: gaps and orientations on edges, path checks, matchings, branchings, ranks."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as X
from ..tables import materialize
from . import groups
from .graph import connected_components, degrees, match_paths

#: Fixed value: the weight of an edge between special contigs.
SPECIAL = 9999999.99
#: Fixed value: the support of a solved pair without a bundle.
NO_BUNDLE = 999999.0


def prune_negative(edges: DataFrame, gap: str = "gap") -> DataFrame:
    """Edges without those whose gap is less than minus three deviations; an edge without a gap stays."""
    return edges.where(F.col(gap).isNull() | (F.col(gap) >= -3 * X.DEVIATION))


def sane_gaps(bundles: DataFrame, gap: str = "gap") -> DataFrame:
    """Rows whose gap is no larger, either way, than the insert size and one times three deviations."""
    return bundles.where(F.abs(gap) <= (X.INSERT + 1) * 3 * X.DEVIATION)


def directed_pairs(solved: DataFrame) -> DataFrame:
    """(src, dst) of solved bundles (u, v, X, Y): u to v where X is set, else v to u where Y is; none without either."""
    forward = F.col("X") == 1
    return solved.where("X = 1 or Y = 1").select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("dst"))


def weighted_pairs(solved: DataFrame, bundles: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight) of solved bundles (u, v, state, X, Y): the bundle's weight of the state, cut to a whole number.

    Bundles without a direction, without support for their state, or absent from
    ``bundles`` are left out.  An edge with an end in ``special`` (node) gets a
    weight above all others.
    """
    support = bundles.select(X.smaller().alias("u"), X.larger().alias("v"), *(f"WT_{c}" for c in "ABCD"))
    weight = F.element_at(F.array(*(f"WT_{c}" for c in "ABCD")), F.col("state").cast("int") + 1)
    rows = solved.where("X + Y > 0").join(support, ["u", "v"]).withColumn("weight", weight).where("weight <> 0")
    forward = F.col("X") == 1
    edges = rows.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("dst"), "weight")
    if special is not None:
        marked = special.select("node").distinct()
        a, b = (marked.select(F.col("node").alias(x), F.lit(True).alias(f"at_{x}")) for x in ("src", "dst"))
        high = F.coalesce("at_src", "at_dst", F.lit(False))
        edges = edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", F.when(high, SPECIAL).otherwise(F.col("weight")).alias("weight"))
    return edges.withColumn("weight", F.col("weight").cast("long"))


def assign_gaps(edges: DataFrame, gaps: DataFrame) -> DataFrame:
    """Edges (src, dst) with the ``gap`` of their pair in ``gaps`` (lo, hi, gap), null without one."""
    keyed = edges.drop("gap").withColumns({"lo": X.smaller("src", "dst"), "hi": X.larger("src", "dst")})
    return keyed.join(gaps.select("lo", "hi", "gap"), ["lo", "hi"], "left").drop("lo", "hi")


def assign_orientations(nodes: DataFrame, solved: DataFrame, strict: bool = False) -> DataFrame:
    """(node, orien): the orientation that solved bundles (u, v, orien_a, orien_b) give each of ``nodes``; null, or with ``strict`` an error, without one."""
    ends = solved.select(F.inline(F.array(*(F.struct(F.col(n).alias("node"), F.col(f"orien_{x}").alias("orien")) for n, x in (("u", "a"), ("v", "b")))))).where("orien is not null")
    known = ends.groupBy("node").agg(F.max("orien").alias("orien"))
    out = nodes.select("node").join(known, "node", "left")
    return out.withColumn("orien", F.coalesce("orien", F.raise_error(F.concat(F.lit("no orientation of contig "), "node")).cast("int"))) if strict else out


def path_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): what keeps nodes (node, orien) and edges (src, dst, gap) from being disjoint paths.

    One edge in and one out at most, no component in which every node has an
    edge in, orientations 0 or 1, and a gap on every edge.
    """
    turns = degrees(edges)
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "path-components")
    starts = turns.where("in_degree = 0").join(found, "node").select("root").distinct()
    cycles = found.select("root").distinct().join(starts, "root", "left_anti")
    rules = {
        "in-degree": turns.where("in_degree > 1"), "out-degree": turns.where("out_degree > 1"), "cycle": cycles,
        "orientation": nodes.where("orien is null or orien not in (0, 1)"), "gap": edges.where("gap is null"),
    }
    return counted(rules)


def counted(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): the number of rows that break each rule."""
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


def order_by_support(solved: DataFrame, bundles: DataFrame) -> DataFrame:
    """(u, v, support, rank): solved pairs (u, v, state) by the weight of their state, from 0; of equals by u, v.

    A pair without a bundle has a support above all.  Ranks come from a range
    partitioning and the row counts of the ranges before, not from one window.
    """
    weights = bundles.select(X.smaller().alias("u"), X.larger().alias("v"), F.array(*(f"WT_{c}" for c in "ABCD")).alias("weights"))
    support = F.coalesce(F.element_at("weights", F.col("state").cast("int") + 1), F.lit(NO_BUNDLE))
    rows = solved.join(weights, ["u", "v"], "left").select("u", "v", support.alias("support"))
    return with_rank(rows, ["support", "u", "v"]).select("u", "v", "support", "rank")


def with_rank(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with ``rank``, the place of each row from 0 in the order of ``by``."""
    sorted_ = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "rank")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per range, so a running sum over them is small work.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return sorted_.withColumn("part", part).join(earlier, "part").withColumn("rank", at + F.col("before")).drop("part", "place", "before")


def best_matching(rows: list[tuple]) -> list[int]:
    """Of edges (src, dst, weight), the places of a matching of sources to targets with the most edges and, of those, the greatest weight.

    Sources join one by one along the heaviest alternating path to a free
    target; after k steps the matching is the heaviest of k edges.
    """
    out_of = defaultdict(list)
    for i, (a, b, w) in enumerate(rows):
        out_of[a].append((b, w, i))
    into: dict = {}  # target -> place of its edge
    goes: dict = {}  # source -> its target
    while True:
        # Greatest gain with which an alternating path from a free source reaches each source and target.
        gain, reached = {a: 0 for a in out_of if a not in goes}, {}
        front = dict.fromkeys(gain)
        while front:
            later: dict = {}
            for a in front:
                for b, w, i in out_of[a]:
                    there = gain[a] + w
                    if into.get(b) != i and (b not in reached or there > reached[b][0]):
                        reached[b] = (there, i)
                        if b in into:
                            c, _, taken = rows[into[b]]
                            if c not in gain or there - taken > gain[c]:
                                gain[c] = there - taken
                                later[c] = None
            front = later
        free = [(g, b) for b, (g, _) in reached.items() if b not in into]
        if not free:
            return sorted(into.values())
        b = max(free, key=lambda x: x[0])[1]
        while b is not None:
            i = reached[b][1]
            a = rows[i][0]
            into[b], goes[a], b = i, b, goes.get(a)


def match_maximum(edges: DataFrame, max_edges: int = 2000) -> DataFrame:
    """Edges (src, dst, weight) with at most one in and one out per node: as many as possible, and of greatest weight among those.

    Sources and targets are two sides, so an edge competes with those that share
    its source or its target.  Components of at most ``max_edges`` competing
    edges are matched exactly inside tasks, many a task; larger ones are matched by
    locally heaviest edges in rounds (:func:`.graph.match_paths`), to at least
    half of the greatest weight.
    """
    edges = materialize(edges.select("src", "dst", "weight").where("src <> dst"), "match-all")
    side = lambda x: F.concat(F.lit(x[0]), F.col(x).cast("string"))
    found = connected_components(edges.select(side("src").alias("u"), side("dst").alias("v")), "match-parts")

    def chosen(part: list[tuple]) -> list[int]:
        places = set(best_matching([e[:3] for e in part]))
        return [int(i in places) for i in range(len(part))]

    done, left = groups.label_edges(edges.withColumn("node", side("src")), found, "node", chosen, "int", max_edges, "match-done")
    exact = done.where("label = 1").select(edges.columns)
    return exact.union(match_paths(materialize(done.where(F.col("m") > max_edges).select(edges.columns), "match-large"))) if left else exact


def branching(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) of a branching of greatest weight: at most one edge into a node, no cycle; weights of 0 or less are left out.

    Every node takes its heaviest edge in.  Where those close cycles, each cycle
    becomes one node, an edge into it weighs what it adds over the edge that it
    replaces, and the next level does the same, at most as often as the number
    of nodes can be halved.  Then levels are undone from the last: a cycle
    loses the edge that the entering one replaces, or its lightest.
    """
    now = materialize(edges.select("src", "dst", "weight").where("src <> dst and weight > 0").withColumn("edge", F.monotonically_increasing_id()), "branch-edges")
    named = now
    levels = []
    while True:
        rank = F.struct("weight", -F.col("src"), -F.col("edge"))
        best = materialize(now.groupBy("dst").agg(F.max_by(F.struct("edge", "src", "weight"), rank).alias("e")).select("dst", "e.edge", "e.src", "e.weight"), "branch-best")
        cycle = materialize(_cycle_nodes(best), "branch-cycles")
        if cycle.isEmpty():
            break
        levels.append((now, best, cycle))
        inside = best.join(cycle, best.dst == cycle.node).groupBy("cycle").agg(F.min("weight").alias("least"))
        a, b = (cycle.select(F.col("node").alias(x), F.col("cycle").alias(f"c_{x}")) for x in ("src", "dst"))
        kept = best.select("dst", F.col("weight").alias("own"))
        moved = now.join(a, "src", "left").join(b, "dst", "left").where("c_src is null or c_dst is null or c_src <> c_dst").join(kept, "dst")
        moved = moved.join(inside.withColumnRenamed("cycle", "c_dst"), "c_dst", "left")
        weight = F.when(F.col("c_dst").isNull(), F.col("weight")).otherwise(F.col("weight") - F.col("own") + F.col("least"))
        moved = moved.select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst"), weight.alias("weight"), "edge").where("weight > 0")
        now = materialize(moved, "branch-edges")
    chosen = best.select("edge")
    for before, best, cycle in reversed(levels):
        entered = before.join(chosen, "edge", "left_semi").join(cycle.withColumnRenamed("node", "dst"), "dst").select("cycle", F.col("dst").alias("enters"))
        around = best.join(cycle.withColumnRenamed("node", "dst"), "dst").join(entered, "cycle", "left")
        lightest = around.groupBy("cycle").agg(F.min_by("edge", F.struct("weight", "edge")).alias("lightest"))
        kept = around.join(lightest, "cycle").where(F.when(F.col("enters").isNull(), F.col("edge") != F.col("lightest")).otherwise(F.col("dst") != F.col("enters"))).select("edge")
        chosen = materialize(chosen.union(kept), "branch-chosen")
    return named.join(chosen, "edge", "left_semi").select("src", "dst", "weight")


def _cycle_nodes(best: DataFrame) -> DataFrame:
    """(node, cycle): the nodes on cycles of edges (src, dst) with one edge in at most per node; cycle is the smallest of them.

    Whoever is still reached after going back more steps than there are nodes
    lies on a cycle.
    """
    found = connected_components(best.select(F.col("src").alias("u"), F.col("dst").alias("v")), "branch-parts")
    starts = found.join(best.select(F.col("dst").alias("node")), "node", "left_anti").select("root").distinct()
    closed = found.join(starts, "root", "left_anti")
    most = closed.groupBy("root").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    at = materialize(best.join(closed, best.dst == closed.node).select("node", F.col("src").alias("jump"), "root"), "branch-jumps")
    for _ in range(int(most or 0).bit_length()):
        far = at.select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        at = materialize(at.join(far, "jump").select("node", F.col("next").alias("jump"), "root"), "branch-jumps")
    on = at.select("root", F.col("jump").alias("node")).distinct()
    return on.join(on.groupBy("root").agg(F.min("node").alias("cycle")), "root").select("node", "cycle")


def solved_and_active(orientations: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of ``orientations`` (node, orien) that are set and in ``active`` (node)."""
    return orientations.where("orien is not null").join(active.select("node").distinct(), "node", "left_semi")


def incomplete(nodes: DataFrame, solved: DataFrame) -> DataFrame:
    """(rule, n): contigs (node, orien) without an orientation, and solved bundles (u, v, state, X, Y) without an end or a state."""
    return counted({"orientation": nodes.where("orien is null"), "ends": solved.where("u is null or v is null"), "state": solved.where("state is null")})


def path_degrees(solved: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree): contigs with more than one directed bundle in or out, which a solution made of paths must not have."""
    return degrees(directed_pairs(solved)).where("in_degree > 1 or out_degree > 1")
