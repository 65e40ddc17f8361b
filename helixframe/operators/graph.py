"""Graph operators as rounds of joins and grouped minima over edge tables.

Edges are (u, v) of comparable node ids.  Loops over rounds end when a checksum
or a count says so; only that reaches the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize, materialize_count, supersede
from . import groups

#: Edges of a component up to which it is worked on whole, many a task; larger ones go through rounds of joins.
WHOLE = 2000
#: Edges that a task puts together at a time.
_CHUNK = 1 << 18


def _chunk_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each of them reaches over these edges."""
    codes, names = pd.factorize(np.concatenate([u, v]), sort=True)
    a, b = codes[: len(u)], codes[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return names, names[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _chunks(batches):
    """Batches put together to frames of at least ``_CHUNK`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= _CHUNK:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _stars(batches):
    """Edges (u, v) put together a chunk at a time; a node has as many roots as it is in chunks."""
    for chunk in _chunks(batches):
        node, root = _chunk_roots(chunk["u"].to_numpy(), chunk["v"].to_numpy())
        yield pd.DataFrame({"node": node, "root": root})


def _fragments(batches):
    """(node, head, pos) of edges (src, dst) of paths, followed a chunk at a time; a path has as many heads as it has parts in chunks."""
    for chunk in _chunks(batches):
        after = dict(zip(chunk["src"].tolist(), chunk["dst"].tolist()))
        inner, rows = set(after.values()), []
        for head in [s for s in after if s not in inner]:
            at, pos = after.pop(head), 1
            rows.append((at, head, pos))
            while at in after:
                at, pos = after.pop(at), pos + 1
                rows.append((at, head, pos))
        if after:
            raise ValueError("paths must not run in circles")
        yield pd.DataFrame(rows, columns=["node", "head", "pos"])


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for edges (u, v) of any direction, ids being numbers or texts; root is the smallest id reachable.

    Edges go to tasks by ranges of their ends, and a task puts together what it
    has, a bounded chunk at a time.  Only where a node is in several chunks do
    their roots still have to meet, in rounds (:func:`star_components`), so
    graphs whose neighbours have neighbouring ids take no or few rounds.
    Nodes without an edge to another do not appear.
    """
    kind = edges.schema["u"].dataType.simpleString()
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), label)
    dealt = edges.repartitionByRange("u", "v").sortWithinPartitions("u", "v")
    stars = materialize(dealt.mapInPandas(_stars, f"node {kind}, root {kind}"), label)
    # Most nodes have one root; of the others, all roots lead to the smallest.
    least = stars.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("node", "least")
    links, n = materialize_count(stars.join(least, "node").where("root > least").select(F.col("root").alias("u"), F.col("least").alias("v")).distinct(), label)
    if not n:
        return supersede(edges, stars).distinct()
    joined = star_components(links, label).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return supersede(edges, stars).join(joined, "root", "left").select("node", F.coalesce("whole", "root").alias("root")).distinct()


def star_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for edges (u, v) of any direction and orderable ids; root is the smallest id reachable.

    Alternating large-star and small-star rounds: each round is grouped minima
    (combined before the shuffle) joined back to the edges, so a hub is never
    collected and its rows can be split.  Nodes without an edge to another do
    not appear.
    """

    def largest_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))

    def smallest_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()

    def checksum(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, label)
    seen = checksum(edges)
    while seen[0]:
        edges = supersede(edges, materialize(smallest_star(largest_star(edges).distinct()), label))
        now = checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every node, single ones too."""
    found = connected_components(edges)
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def bucket_small(members: DataFrame, cutoff: int) -> DataFrame:
    """(root, size, bucket): components of fewer than ``cutoff`` nodes in buckets of about ``cutoff``; large ones alone (null).

    Buckets only batch independent work.  Components are first dealt to equal
    shares by a hash, so the running sum inside a share is bounded, and
    bucket numbers are unique across shares.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    small = sizes.where(F.col("size") < cutoff).withColumn("share", F.pmod(F.xxhash64("root"), F.lit(1 << 10)))
    before = Window.partitionBy("share").orderBy("root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    binned = small.withColumn("bucket", F.shiftleft("share", 32) + F.floor((F.sum("size").over(before) - F.col("size")) / cutoff))
    return binned.select("root", "size", "bucket").union(sizes.where(F.col("size") >= cutoff).select("root", "size", F.lit(None).cast("long")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of directed edges (src, dst)."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.inline(ends)).groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def nonlinear_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with more than one edge in or out."""
    return degrees(edges).where("in_degree > 1 or out_degree > 1")


def break_nonlinear(edges: DataFrame) -> DataFrame:
    """Edges without those of nonlinear nodes."""
    bad = nonlinear_nodes(edges).select("node")
    return edges.join(bad.withColumnRenamed("node", "src"), "src", "left_anti").join(bad.withColumnRenamed("node", "dst"), "dst", "left_anti").select(edges.columns)


def best_incoming(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): per target the edge of highest weight, of equals that of the smallest source."""
    best = edges.groupBy("dst").agg(F.max_by(F.struct("src", "weight"), F.struct("weight", -F.col("src"))).alias("b"))
    return best.select("b.src", "dst", "b.weight")


def match_paths(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) of which every node keeps at most one in and one out, by locally heaviest choice.

    In rounds, an edge that is the heaviest at both its ends (of equals, by a
    hash) is taken and the edges that share an end with it go.  The result
    is a maximal matching of sources to targets of at least half the greatest
    weight; it is exact where no chain of three edges outweighs its middle.
    """
    left = materialize(edges.select("src", "dst", "weight").where("src <> dst"), "match-edges")
    taken = []
    while not left.isEmpty():
        rank = F.struct("weight", F.xxhash64("src", "dst"), "src", "dst")
        out_best = left.groupBy("src").agg(F.max(rank).alias("best_out"))
        in_best = left.groupBy("dst").agg(F.max(rank).alias("best_in"))
        chosen = left.join(out_best, "src").join(in_best, "dst").where((rank == F.col("best_out")) & (rank == F.col("best_in"))).select("src", "dst", "weight")
        chosen = materialize(chosen, "match-chosen")
        taken.append(chosen)
        left = materialize(left.join(chosen.select("src"), "src", "left_anti").join(chosen.select("dst"), "dst", "left_anti").select("src", "dst", "weight"), "match-edges")
    out = edges.select("src", "dst", "weight").limit(0)
    for part in taken:
        out = out.union(part)
    return out


def break_cycles(edges: DataFrame) -> DataFrame:
    """Matched edges (at most one in and out per node) without those of components that are cycles."""
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    rooted = edges.join(found.withColumnRenamed("node", "src"), "src")
    starts = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    open_roots = starts.join(found, "node").select("root").distinct()
    return rooted.join(open_roots, "root", "left_semi").select(edges.columns)


def order_paths(edges: DataFrame) -> DataFrame:
    """(node, path, pos): nodes of disjoint paths, pos from 0; path is its first node.

    Edges go to tasks by ranges of their sources, and a task follows what it has,
    a bounded chunk at a time.  Only the parts of paths that lie in several
    chunks are put in order in rounds (:func:`_path_rounds`).  Edges of cycles
    must be gone.
    """
    kind = edges.schema["src"].dataType.simpleString()
    edges = materialize(edges.select("src", "dst"), "path-edges")
    dealt = edges.repartitionByRange("src").sortWithinPartitions("src")
    parts = supersede(edges, materialize(dealt.mapInPandas(_fragments, f"node {kind}, head {kind}, pos bigint"), "path-parts"))
    heads = parts.where("pos = 1").select(F.col("head").alias("node"))
    links, n = materialize_count(parts.join(heads, "node", "left_semi").select(F.col("head").alias("src"), F.col("node").alias("dst"), F.col("pos").alias("steps")), "path-links")
    if not n:
        return parts.select("node", F.col("head").alias("path"), "pos").union(heads.select("node", "node", F.lit(0).cast("long")))
    placed = _path_rounds(links).select(F.col("node").alias("head"), "path", F.col("pos").alias("before"))
    starts = heads.join(links.select(F.col("dst").alias("node")), "node", "left_anti")
    whole = parts.join(placed, "head", "left").select("node", F.coalesce("path", "head").alias("path"), (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"))
    return whole.union(starts.select("node", "node", F.lit(0).cast("long")))


def _path_rounds(edges: DataFrame) -> DataFrame:
    """(node, path, pos) of paths with edges (src, dst, steps).

    Pointer doubling: after round r every node knows the node 2**r before it, so
    a path of n nodes takes log2(n) joins.
    """
    before = edges.select(F.col("dst").alias("node"), F.col("src").alias("jump"), "steps")
    heads = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti").distinct()
    at = materialize(before.union(heads.select("node", F.col("node").alias("jump"), F.lit(0).cast("long"))), "paths")
    ended = None
    while True:
        far = at.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("steps").alias("more"))
        at = supersede(at, materialize(at.join(far, "jump").select("node", F.col("next").alias("jump"), (F.col("steps") + F.col("more")).alias("steps")), "paths"))
        now = at.agg(F.sum("steps")).first()[0]
        if now == ended:
            return at.select("node", F.col("jump").alias("path"), F.col("steps").alias("pos"))
        ended = now


def shortest_paths(edges: DataFrame, source, max_rounds: int | None = None) -> DataFrame:
    """(node, distance, previous) from ``source`` over edges (src, dst, weight); negative weights are allowed.

    Each round looks at the edges out of nodes that came nearer in the one
    before, until there are none; any after as many rounds as there are nodes
    mean a negative cycle and are an error.  Rounds follow the number of edges
    of the longest shortest path.
    """
    spark = edges.sparkSession
    best = spark.createDataFrame([(source,)], edges.select(F.col("src").alias("node")).schema).select("node", F.lit(0.0).alias("distance"), F.col("node").alias("previous"), F.lit(True).alias("nearer"))
    nodes = max_rounds
    for done in itertools.count(1):
        front = best.where("nearer").select(F.col("node").alias("src"), "distance")
        step = edges.join(front, "src").select(F.col("dst").alias("node"), F.struct((F.col("distance") + F.col("weight")).cast("double").alias("distance"), F.col("src").alias("previous")).alias("b"))
        step = step.groupBy("node").agg(F.min("b").alias("b"))
        met = best.join(step, "node", "full_outer").withColumn("nearer", F.coalesce(F.col("b.distance") < F.col("distance"), F.col("b").isNotNull() & F.col("distance").isNull()))
        pick = lambda c: F.when(F.col("nearer"), F.col(f"b.{c}")).otherwise(F.col(c)).alias(c)
        best, changed = materialize_count(met.select("node", pick("distance"), pick("previous"), "nearer"), "distances", F.count_if("nearer"))
        if not changed:
            return best.select("node", "distance", "previous")
        if done > 64 or max_rounds:
            nodes = nodes or edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct().count()
            if done > nodes:
                raise ValueError("negative cycle")


def euler_tour(tree: DataFrame, roots: DataFrame, rooted: bool = False) -> DataFrame:
    """(node, parent, root, first, last): nodes of trees with edges (u, v), rooted at ``roots`` (node, root), as intervals of a walk around them.

    A node's subtree are the nodes of its root whose ``first`` lies in its
    interval; by ``first`` nodes are in preorder, by ``last`` and descending
    ``first`` in postorder.  With ``rooted``, u is the parent of v, and children
    are visited in ascending order.  The walk is a list of arcs that pointer
    doubling ranks (:func:`order_paths`), so rounds follow the logarithm of the
    number of nodes, not the depth.
    """
    kind = roots.schema["node"].dataType
    both = tree.select("u", "v", F.lit(rooted).alias("down")).union(tree.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False)))
    arcs = materialize(both.withColumn("arc", F.monotonically_increasing_id()), "tour-arcs")
    # An arc into b goes on to the neighbour of b after the one that it comes from, in a circle.
    order = Window.partitionBy("v").orderBy("down", "u")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    circle = arcs.withColumns({"next": F.lead("u").over(order), "least": F.first("u").over(whole)})
    circle = circle.join(roots.select(F.col("node").alias("v"), F.lit(True).alias("is_root")), "v", "left")
    steps = circle.where("next is not null or is_root is null").select("arc", F.col("v").alias("from"), F.coalesce("next", "least").alias("to"))
    linked = steps.join(arcs.select(F.col("u").alias("from"), F.col("v").alias("to"), F.col("arc").alias("then")), ["from", "to"])
    placed = order_paths(linked.select(F.col("arc").alias("src"), F.col("then").alias("dst")))
    at = materialize(arcs.join(placed.select(F.col("node").alias("arc"), "path", "pos"), "arc").select("u", "v", "path", "pos"), "tour-places")
    back = at.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("pos").alias("back"))
    down = at.join(back, ["u", "v"]).where("pos < back").select(F.col("v").alias("node"), F.col("u").alias("parent"), "path", (F.col("pos") + 1).alias("first"), F.col("back").alias("last"))
    starts = at.where("pos = 0").select("path", F.col("u").alias("root"))
    below = down.join(starts, "path").select("node", "parent", "root", "first", "last")
    sizes = below.groupBy("root").agg((F.max("last") + 1).alias("last"))
    tops = roots.select("node", F.col("node").alias("root")).distinct().join(sizes, "root", "left")
    tops = tops.select("node", F.lit(None).cast(kind).alias("parent"), "root", F.lit(0).cast("long").alias("first"), F.coalesce("last", F.lit(0)).alias("last"))
    return materialize(below.union(tops), "tour")


def spanning_tree_edges(edges: DataFrame) -> DataFrame:
    """(u, v): a spanning tree of each component of edges u < v.

    In every round each part picks its first edge out, by a hash of the edge,
    and parts that picked edges join are one part from then on: at least half of
    them go each time.
    """
    left = materialize(edges.select("u", "v", F.struct(F.xxhash64("u", "v").alias("h"), "u", "v").alias("rank"), F.col("u").alias("pu"), F.col("v").alias("pv")), "span-edges")
    picked = edges.select("u", "v").limit(0)
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("pu", "pv")).alias("part"), "rank", F.struct("pu", "pv").alias("parts"))
        best = ends.groupBy("part").agg(F.min_by(F.struct("rank.u", "rank.v", "parts.pu", "parts.pv"), "rank").alias("e"))
        chosen = materialize(best.select("e.*").distinct(), "span-chosen")
        picked = picked.union(chosen.select("u", "v"))
        parts = connected_components(chosen.select(F.col("pu").alias("u"), F.col("pv").alias("v")), "span-parts")
        pu, pv = (parts.select(F.col("node").alias(x), F.col("root").alias(f"new_{x}")) for x in ("pu", "pv"))
        left = left.join(pu, "pu").join(pv, "pv").where("new_pu <> new_pv").select("u", "v", "rank", F.col("new_pu").alias("pu"), F.col("new_pv").alias("pv"))
        left = materialize(left, "span-edges")
    return picked


def rooted_forest(edges: DataFrame) -> DataFrame:
    """A spanning tree of each component of edges (u, v), rooted at its smallest node, as :func:`euler_tour` gives it."""
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "forest-edges")
    found = connected_components(edges, "forest-components")
    return euler_tour(materialize(spanning_tree_edges(edges), "forest-tree"), found.where("node = root"))


def subtree_extremes(forest: DataFrame, values: DataFrame) -> DataFrame:
    """(node, lo, hi): the least ``lo`` and greatest ``hi`` of ``values`` (node, lo, hi) over each node's subtree, itself included.

    Positions are summed up in blocks of 1, 2, 4 and so on; an interval is at
    most two blocks of each size, so this is one join, whatever the depth.
    """
    bits = int(forest.agg(F.max("last")).first()[0] or 0).bit_length()
    levels = F.sequence(F.lit(0), F.lit(bits))
    at = forest.select("node", "root", "first").join(values, "node").select("root", "first", "lo", "hi", F.explode(levels).alias("k"))
    table = at.groupBy("root", "k", F.expr("shiftright(first, k)").alias("block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    left, right = F.expr("shiftright(first + shiftleft(1L, k) - 1, k)"), F.expr("shiftright(last + 1, k)")
    asked = forest.select("node", "root", "first", "last", F.explode(levels).alias("k")).select("node", "root", "k", left.alias("l"), right.alias("r")).where("l < r")
    wanted = F.array_compact(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)))
    asked = asked.select("node", "root", "k", F.explode(wanted).alias("block"))
    return asked.join(table, ["root", "k", "block"]).groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def tree_orders(tree: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(node, parent, root, pre, post): ranks from 0 in preorder and postorder of rooted trees of edges (src, dst), parent to child; children in ascending order.

    Trees of at most ``whole`` edges are walked inside tasks, many a task; larger
    ones by Euler tours (:func:`euler_tour`).
    """
    kind = tree.schema["src"].dataType.simpleString()
    tree = materialize(tree.select("src", "dst"), "order-trees")
    found = connected_components(tree.select(F.col("src").alias("u"), F.col("dst").alias("v")), "order-parts")
    done, left = groups.label_edges(tree, found, "src", groups.order_labels, f"struct<root: {kind}, pre: bigint, post: bigint>", whole, "orders")
    small = done.where(F.col("m") <= whole)
    below = small.select(F.col("dst").alias("node"), F.col("src").alias("parent"), "label.root", "label.pre", "label.post")
    tops = small.groupBy(F.col("label.root").alias("node")).agg(F.first("m").alias("post"))
    out = below.union(tops.select("node", F.lit(None).cast(kind), "node", F.lit(0).cast("long"), "post"))
    return out.union(_order_rounds(materialize(done.where(F.col("m") > whole).select("src", "dst"), "order-trees"))) if left else out


def _order_rounds(tree: DataFrame) -> DataFrame:
    roots = tree.select(F.col("src").alias("node")).join(tree.select(F.col("dst").alias("node")), "node", "left_anti").distinct().withColumn("root", F.col("node"))
    tour = euler_tour(tree.select(F.col("src").alias("u"), F.col("dst").alias("v")), roots, rooted=True)
    joined = tour.join(tree_depth(tour), "node")
    # Before a place in the walk lie arcs down and arcs up, and the depth there is their difference; each arc down is a node
    # that begins, each arc up one that ends.
    pre = ((F.col("first") + F.col("depth")) / 2).cast("long")
    post = ((F.col("last") - F.col("depth")) / 2).cast("long")
    return joined.select("node", "parent", "root", pre.alias("pre"), post.alias("post"))


def tree_depth(forest: DataFrame) -> DataFrame:
    """(node, depth) of rooted trees (node, parent), by pointer doubling."""
    at = materialize(forest.select("node", F.col("parent").alias("jump"), F.col("parent").isNotNull().cast("long").alias("depth")), "depth")
    while not at.where("jump is not null").isEmpty():
        far = at.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        at = supersede(at, materialize(at.join(far, "jump", "left").select("node", F.col("next").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depth"))
    return at.select("node", "depth")


def long_paths(tree: DataFrame) -> DataFrame:
    """Edges (src, dst) of disjoint paths in rooted trees (src, dst): each node goes on to the child below which the tree is deepest.

    The longest path from the root, then the longest in what is left, and so on;
    of equal depths the smaller child.
    """
    tree = materialize(tree.select("src", "dst"), "path-trees")
    roots = tree.select(F.col("src").alias("node")).join(tree.select(F.col("dst").alias("node")), "node", "left_anti").distinct().withColumn("root", F.col("node"))
    tour = euler_tour(tree.select(F.col("src").alias("u"), F.col("dst").alias("v")), roots, rooted=True)
    depth = materialize(tree_depth(tour), "path-depth")
    deepest = subtree_extremes(tour, depth.select("node", F.col("depth").alias("lo"), F.col("depth").alias("hi")))
    best = tree.join(deepest.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.max_by("dst", F.struct("hi", -F.col("dst"))).alias("dst"))
    return best.select("src", "dst")


def blocks(edges: DataFrame, forest: DataFrame | None = None, whole: int = WHOLE) -> DataFrame:
    """(u, v, block): the biconnected component of each edge u < v; block is the smallest tree node in it besides its top.

    Components of at most ``whole`` edges are searched inside tasks, many a task
    (:func:`.groups.block_labels`).  The others are worked on all at once: a
    spanning tree of each with its Euler
    tour, the first and last places that a subtree reaches over other edges,
    then connected components of tree edges that must lie on one cycle.  Rounds
    follow the logarithm of the number of nodes, and no such component is gathered
    anywhere.  With ``forest``, the :func:`rooted_forest` of the edges, all go that way.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "block-edges")
    if forest is not None:
        return _block_rounds(edges, forest)
    done, left = groups.label_edges(edges, connected_components(edges, "block-components"), "u", groups.block_labels, edges.schema["u"].dataType.simpleString(), whole, "blocks")
    small = done.where(F.col("m") <= whole).select("u", "v", F.col("label").alias("block"))
    if not left:
        return small
    return small.union(_block_rounds(materialize(done.where(F.col("m") > whole).select("u", "v"), "block-edges"), None))


def _block_rounds(edges: DataFrame, forest: DataFrame | None) -> DataFrame:
    info = rooted_forest(edges) if forest is None else forest
    short = info.select("node", "parent", "first", "last")
    a, b = (short.select(*(F.col(c).alias(f"{c}_{x}") for c in short.columns)) for x in "uv")
    ends = edges.join(a, edges.u == a.node_u).join(b, edges.v == b.node_v)
    under_v, under_u = F.coalesce(F.col("parent_u") == F.col("v"), F.lit(False)), F.coalesce(F.col("parent_v") == F.col("u"), F.lit(False))
    ends = materialize(ends.withColumn("is_tree", under_v | under_u), "block-ends")

    # What each node sees over edges that are not in the tree, then the extremes over its subtree.
    other = ends.where("not is_tree")
    sees = other.select(F.col("u").alias("node"), F.col("first_v").alias("to")).union(other.select(F.col("v").alias("node"), F.col("first_u").alias("to")))
    own = info.join(sees.groupBy("node").agg(F.min("to").alias("l"), F.max("to").alias("h")), "node", "left").select("node", F.least("first", "l").alias("lo"), F.greatest("first", "h").alias("hi"))
    span = subtree_extremes(info, own).join(info.select("node", "parent"), "node")

    # A tree edge is known by its lower node.
    cross = other.where("last_u < first_v or last_v < first_u").select("u", "v")
    up = info.select(F.col("node").alias("parent"), F.col("first").alias("p_first"), F.col("last").alias("p_last"), F.col("parent").alias("grand"))
    chained = span.join(up, "parent").where("grand is not null and (lo < p_first or hi > p_last)").select(F.col("node").alias("u"), F.col("parent").alias("v"))
    joined = connected_components(cross.union(chained), "block-joins")
    lower = F.when(F.col("is_tree"), F.when(under_v, F.col("u")).otherwise(F.col("v"))).otherwise(F.when(F.col("first_u") > F.col("first_v"), F.col("u")).otherwise(F.col("v")))
    named = ends.withColumn("node", lower).join(joined, "node", "left").select("u", "v", F.coalesce("root", "node").alias("block"))
    return materialize(named, "blocks")


def block_members(edge_blocks: DataFrame) -> DataFrame:
    """(block, node) of each block."""
    return edge_blocks.select("block", F.explode(F.array("u", "v")).alias("node")).distinct()


def articulation_points(edge_blocks: DataFrame) -> DataFrame:
    """(node): nodes in more than one block."""
    return block_members(edge_blocks).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")


def block_cut_tree(edge_blocks: DataFrame) -> DataFrame:
    """(block, cut): blocks and the articulation points in them, the edges of the block-cut tree."""
    return block_members(edge_blocks).join(articulation_points(edge_blocks), "node", "left_semi").select("block", F.col("node").alias("cut"))


def shared_members(members: DataFrame) -> DataFrame:
    """(i, j, shared): pairs of sets of ``members`` (set, node) that share nodes, i < j, with what they share."""
    a, b = members.select(F.col("set").alias("i"), "node"), members.select(F.col("set").alias("j"), "node")
    return a.join(b, "node").where("i < j").groupBy("i", "j").agg(F.sort_array(F.collect_list("node")).alias("shared"))


def block_cut_forest(edge_blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(block, cut): as :func:`block_cut_tree`, with a row for each block without a cut, and for each of ``nodes`` (node) without an edge as a block of its own (cut null)."""
    blocks_ = edge_blocks.select("block").distinct()
    lone = nodes.select(F.col("node").alias("block")).distinct().join(block_members(edge_blocks).select(F.col("node").alias("block")).distinct(), "block", "left_anti")
    # A lone node's number is no other block's: block numbers are nodes with an edge.
    return blocks_.union(lone).join(block_cut_tree(edge_blocks), "block", "left")


def block_cut_nodes(edge_blocks: DataFrame) -> DataFrame:
    """(kind, id, degree): the nodes of the block-cut tree, blocks (B) and cuts (C), with the number of their neighbours there."""
    tree = block_cut_tree(edge_blocks)
    cuts = tree.groupBy(F.col("cut").alias("id")).agg(F.count("*").alias("degree")).select(F.lit("C").alias("kind"), "id", "degree")
    joined = edge_blocks.select("block").distinct().join(tree, "block", "left").groupBy(F.col("block").alias("id")).agg(F.count("cut").alias("degree"))
    return cuts.union(joined.select(F.lit("B"), "id", "degree"))


def block_cut_orders(edge_blocks: DataFrame) -> DataFrame:
    """(kind, name, root, pre, post): the nodes of the block-cut tree, blocks (B) and cuts (C), with their ranks in preorder and postorder.

    The tree of each component starts at its smallest block (``root``); children
    are visited in ascending order, blocks before cuts.  ``edge_blocks`` names
    blocks by text (:func:`.decompose.named_blocks`).
    """
    typed = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    twigs = materialize(block_cut_tree(edge_blocks).select(typed("B", "block").alias("u"), typed("C", "cut").alias("v")), "block-cut-edges")
    # Blocks come before cuts as texts, so the smallest node of a tree is its smallest block.
    roots = connected_components(twigs, "block-cut-trees").where("node = root")
    rooted = euler_tour(twigs, roots).where("parent is not null").select(F.col("parent").alias("u"), F.col("node").alias("v"))
    tour = euler_tour(rooted, roots, rooted=True)
    lone = edge_blocks.select(typed("B", "block").alias("node")).distinct().join(tour, "node", "left_anti")
    joined = tour.join(tree_depth(tour), "node")
    pre, post = ((F.col("first") + F.col("depth")) / 2).cast("long"), ((F.col("last") - F.col("depth")) / 2).cast("long")
    out = joined.select("node", "root", pre.alias("pre"), post.alias("post")).union(lone.select("node", F.col("node").alias("root"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    return out.select(F.substring("node", 1, 1).alias("kind"), F.substr("node", F.lit(3)).alias("name"), F.substr("root", F.lit(3)).alias("root"), "pre", "post")


def separation_pairs(edge_blocks: DataFrame, max_work: int = 1_000_000) -> DataFrame:
    """(block, a, b), a < b: pairs of nodes of a block without which it falls apart.

    Every block is looked at once without each of its nodes, as a graph of its
    own; the articulation points of all these graphs, found in one pass
    (:func:`blocks`), are the other halves of pairs.  That copies a block's m
    edges for each of its n nodes, so blocks with n * m above ``max_work`` are
    left to :func:`large_blocks`.
    """
    sizes = _block_work(edge_blocks).where((F.col("n") > 3) & (F.col("n") * F.col("m") <= max_work)).select("block")
    inside = materialize(edge_blocks.join(sizes, "block", "left_semi"), "pair-blocks")
    gone = block_members(inside).select("block", F.col("node").alias("gone"))
    text = lambda c: F.col(c).cast("string")
    key = lambda c: F.concat_ws("/", text("block"), text("gone"), text(c))
    copies = inside.join(gone, "block").where("u <> gone and v <> gone").select("block", "gone", "u", "v", key("u").alias("ku"), key("v").alias("kv"))
    copies = materialize(copies, "pair-copies")
    cuts = articulation_points(blocks(copies.select(F.col("ku").alias("u"), F.col("kv").alias("v")))).withColumnRenamed("node", "key")
    names = copies.select("block", "gone", F.inline(F.array(*(F.struct(F.col(f"k{x}").alias("key"), F.col(x).alias("node")) for x in "uv"))))
    found = names.join(cuts, "key").select("block", F.least("gone", "node").alias("a"), F.greatest("gone", "node").alias("b"))
    return found.distinct()


def _block_work(edge_blocks: DataFrame) -> DataFrame:
    nodes = block_members(edge_blocks).groupBy("block").agg(F.count("*").alias("n"))
    return edge_blocks.groupBy("block").agg(F.count("*").alias("m")).join(nodes, "block")


def large_blocks(edge_blocks: DataFrame, max_work: int = 1_000_000) -> DataFrame:
    """(block, n, m): blocks that :func:`separation_pairs` leaves out."""
    return _block_work(edge_blocks).where(F.col("n") * F.col("m") > max_work).select("block", "n", "m")


def block_tree_node(edge_blocks: DataFrame) -> DataFrame:
    """(node, kind, id): where each node is in the block-cut tree: its only block (B), or itself if it is a cut (C)."""
    members = block_members(edge_blocks).groupBy("node").agg(F.count("*").alias("n"), F.min("block").alias("block"))
    cut = F.col("n") > 1
    return members.select("node", F.when(cut, "C").otherwise("B").alias("kind"), F.when(cut, F.col("node")).otherwise(F.col("block")).alias("id"))


def common_block(edge_blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, t, block): of ``pairs`` (s, t), those that lie in one block, with that block; two nodes share at most one."""
    m = block_members(edge_blocks)
    a, b = m.select(F.col("node").alias("s"), "block"), m.select(F.col("node").alias("t"), "block")
    return pairs.join(a, "s").join(b, ["t", "block"]).select("s", "t", "block")


def biconnected_components(edge_blocks: DataFrame, members: DataFrame) -> DataFrame:
    """(root, biconnected): whether each component of ``members`` (node, root) stays connected without any one of its nodes; one node alone does not count."""
    cuts = articulation_points(edge_blocks).withColumn("cut", F.lit(1))
    per = members.join(cuts, "node", "left").groupBy("root").agg(F.count("*").alias("n"), F.count("cut").alias("cuts"))
    return per.select("root", ((F.col("n") > 1) & (F.col("cuts") == 0)).alias("biconnected"))


def set_connectivity(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(set, n, parts): the nodes of each of ``sets`` (set, node) and the number of parts into which edges (u, v) inside the set join them; 1 is connected.

    All sets at once: nodes are told apart by their set.
    """
    key = lambda n: F.concat_ws("/", F.col("set"), n)
    a, b = sets.select("set", F.col("node").alias("u")), sets.select("set", F.col("node").alias("v"))
    inside = edges.select("u", "v").join(a, "u").join(b, ["set", "v"])
    roots = connected_components(inside.select(key(F.col("u")).alias("u"), key(F.col("v")).alias("v")), "set-parts")
    named = sets.withColumn("key", key(F.col("node"))).join(roots.withColumnRenamed("node", "key"), "key", "left")
    # Distinct in two steps: a set may be as large as the graph.
    parts = named.select("set", F.coalesce("root", "key").alias("part")).distinct().groupBy("set").agg(F.count("*").alias("parts"))
    return sets.groupBy("set").agg(F.count("*").alias("n")).join(parts, "set").select("set", "n", "parts")


def overlap_with_earlier(members: DataFrame) -> DataFrame:
    """(set, shared): how many nodes of each of ``members`` (set, node) a smaller set has too; in a tree of blocks at most one."""
    first = members.groupBy("node").agg(F.min("set").alias("first"))
    return members.join(first, "node").groupBy("set").agg(F.count_if(F.col("first") < F.col("set")).alias("shared"))


def first_component_of_size(members: DataFrame, above: int = 25, below: int = 100) -> DataFrame:
    """(root, size): the first component of ``members`` (node, root) with more than ``above`` and fewer than ``below`` nodes; none if there is none."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).where((F.col("size") > above) & (F.col("size") < below))
    return sizes.agg(F.min(F.struct("root", "size")).alias("f")).where("f is not null").select("f.root", "f.size")


def _cyclic(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) of components that are cycles, with the component's root; every node has one in and one out at most."""
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    starts = edges.select(F.col("src").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    open_roots = starts.join(found, "node").select("root").distinct()
    return materialize(edges.join(found.withColumnRenamed("node", "src"), "src").join(open_roots, "root", "left_anti"), "cycles")


def break_cycles_lightest(edges: DataFrame) -> DataFrame:
    """Matched edges (src, dst, weight), at most one in and out per node, without the lightest of each cycle; of equals the smallest source."""
    least = _cyclic(edges).groupBy("root").agg(F.min(F.struct("weight", "src", "dst")).alias("e")).select("e.src", "e.dst")
    return edges.join(least, ["src", "dst"], "left_anti").select(edges.columns)


def break_cycles_last(edges: DataFrame) -> DataFrame:
    """Matched edges, at most one in and out per node, without the one that leads back to the smallest node of each cycle."""
    last = _cyclic(edges).where("dst = root").select("src", "dst")
    return edges.join(last, ["src", "dst"], "left_anti").select(edges.columns)


def contract_tree(tree: DataFrame, sizes: DataFrame, cutoff: int) -> DataFrame:
    """(node, merged, size): nodes of a forest of edges (a, b), put together with their neighbours while the ``sizes`` (node, size) of both sum to at most ``cutoff``.

    In every round the edges with the smallest sum (of equals, by a hash) at
    both their ends are contracted at once.  ``merged`` is the smallest node,
    ``size`` counts shared members as often as they come.
    """
    tree = materialize(tree.select("a", "b"), "contract-tree")
    state = materialize(sizes.select("node", F.col("node").alias("merged"), F.col("size").cast("long").alias("size")), "contract")
    while True:
        name = lambda x: state.select(F.col("node").alias(x), F.col("merged").alias(f"m{x}"), F.col("size").alias(f"s{x}"))
        open_ = tree.select("a", "b").join(name("a"), "a").join(name("b"), "b").where((F.col("ma") != F.col("mb")) & (F.col("sa") + F.col("sb") <= cutoff))
        open_ = open_.select(F.struct((F.col("sa") + F.col("sb")).alias("sum"), F.xxhash64(F.least("ma", "mb"), F.greatest("ma", "mb")).alias("h"), F.least("ma", "mb").alias("x"), F.greatest("ma", "mb").alias("y")).alias("e")).distinct()
        best = open_.select("e", F.explode(F.array("e.x", "e.y")).alias("m")).groupBy("m").agg(F.min("e").alias("e"))
        chosen = best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.x", "e.y", "e.sum")
        chosen = materialize(chosen, "contract-chosen")
        if chosen.isEmpty():
            return state
        moved = chosen.select(F.inline(F.array(*(F.struct(F.col(c).alias("merged"), F.col("x").alias("into"), F.col("sum").alias("total")) for c in "xy"))))
        state = state.join(moved, "merged", "left").select("node", F.coalesce("into", "merged").alias("merged"), F.coalesce("total", "size").alias("size"))
        state = materialize(state, "contract")
