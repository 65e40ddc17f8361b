"""Directed graphs with any number of edges in and out: strongly connected components and the breaking of cycles.

Edges are (src, dst) of comparable node ids; loops are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, materialize_count, supersede
from . import groups
from .graph import WHOLE, connected_components
from .paths import with_rank


def _spread(edges: DataFrame, state: DataFrame, better) -> DataFrame:
    """(node, value) when values no longer change by going along edges (src, dst); ``better(new, old)`` says which one stays.

    Only nodes that changed last are looked at, so all rounds together read each
    edge as often as its source changes.
    """
    state = state.withColumn("new", F.lit(True))
    while True:
        front = state.where("new").select(F.col("node").alias("src"), F.col("value").alias("more"))
        came = edges.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.max("more").alias("more"))
        wins = F.coalesce(better(F.col("more"), F.col("value")), F.lit(False))
        moved = state.join(came, "node", "left").select("node", F.when(wins, F.col("more")).otherwise(F.col("value")).alias("value"), wins.alias("new"))
        moved, changed = materialize_count(moved, "spread", F.count_if("new"))
        state = supersede(state, moved)
        if not changed:
            return state.select("node", "value")


def strong_components(edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(node, component) of the nodes on cycles: the strongly connected components of two or more nodes, by their greatest one.

    Parts of at most ``whole`` edges are worked on inside tasks, many a task
    (:func:`.groups.strong_labels`); larger ones by passes over them all.
    In every pass the nodes without an edge in or without one out go, then each
    node takes the greatest node that reaches it; within one such colour, what
    reaches the node of that number is its component.  Edges between colours and
    at components found are done with.  Passes are few, rounds in a pass follow
    the longest of the shortest ways inside a colour, and all components advance
    at once.
    """
    kind = edges.schema["src"].dataType.simpleString()
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    parts = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "scc-parts")
    done, left = groups.label_edges(edges, parts, "src", groups.strong_labels, kind, whole, "scc-done")
    small = done.where("label is not null").select(F.col("src").alias("node"), F.col("label").alias("component")).distinct()
    return small.union(_strong_rounds(done.where(F.col("m") > whole).select("src", "dst"))) if left else small


def _strong_rounds(edges: DataFrame) -> DataFrame:
    live, left = materialize_count(edges, "scc-edges")
    found = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while left:
        for _ in range(2):
            into = live.select(F.col("dst").alias("src")).distinct()
            out = live.select(F.col("src").alias("dst")).distinct()
            live = live.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")
        live, left = materialize_count(live, "scc-edges")
        if not left:
            break
        nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = materialize(_spread(live, nodes.withColumn("value", F.col("node")), lambda new, old: new > old), "scc-colours")
        a, b = (colours.select(F.col("node").alias(x), F.col("value").alias(f"{x}_colour")) for x in ("src", "dst"))
        inside = materialize(live.join(a, "src").join(b, "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")), "scc-inside")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = colours.select("node", (F.col("node") == F.col("value")).cast("int").alias("value"))
        reach = _spread(back, start, lambda new, old: new > old).where("value = 1").select("node")
        part = materialize(colours.join(reach, "node").select("node", F.col("value").alias("component")), "scc-found")
        sizes = part.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        found = found.union(part.join(sizes, "component", "left_semi").select("node", "component"))
        done = part.select("node")
        live = inside.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        live, left = materialize_count(live, "scc-edges")
    return found


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """``edges`` that lie on a cycle, with their ``component``."""
    edges = materialize(edges, "scc-all")
    found = materialize(strong_components(edges), "scc")
    a, b = (found.select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("src", "component"), ("dst", "other")))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").where("component = other").select(*edges.columns, "component")


def break_components(edges: DataFrame) -> DataFrame:
    """``edges`` without those that leave a node on a cycle."""
    edges = materialize(edges, "scc-all")
    return edges.join(strong_components(edges).select(F.col("node").alias("src")), "src", "left_anti").select(edges.columns)


def lightest_of_cycles(edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(src, dst, weight) of the edges (src, dst, weight) that go if the lightest one on a cycle goes until there are no cycles; of equals the smallest (src, dst).

    An edge goes if it is the lightest of some cycle: lighter ones that stay are
    on none.  So with edges added from the heaviest on, it goes if its ends are
    in one strongly connected component as soon as it is there.  In components
    of at most ``whole`` edges, edges are added one by one inside tasks, many
    components a task (:func:`.groups.lightest_labels`).  In larger ones, when ends come
    together is found for all edges at once by halving: those together halfway
    look in the first half, the others in the second, with the components of the
    first as nodes.  That takes one search for components for every bit of the
    number of edges on cycles, however many have to go.
    """
    on = materialize(cyclic_edges(edges.select("src", "dst", "weight").where("src <> dst")), "cycle-edges")
    found = on.select(F.col("src").alias("node"), F.col("component").alias("root")).distinct()
    done, left = groups.label_edges(on.select("src", "dst", "weight"), found, "src", groups.lightest_labels, "int", whole, "cycle-done")
    small = done.where("label = 1").select("src", "dst", "weight")
    return small.union(_lightest_rounds(done.where(F.col("m") > whole).select("src", "dst", "weight"))) if left else small


def _lightest_rounds(on: DataFrame) -> DataFrame:
    kind = on.schema["src"].dataType
    ranked = with_rank(on.withColumns({"w": -F.col("weight"), "s": -F.col("src"), "d": -F.col("dst")}), ["w", "s", "d"])
    text = lambda c: F.col(c).cast("string")
    at, n = materialize_count(ranked.select("src", "dst", "weight", F.col("rank").alias("t"), F.lit(0).cast("long").alias("half"), text("src").alias("a"), text("dst").alias("b")), "cycle-halves")
    for k in reversed(range(max(n - 1, 0).bit_length())):
        size = 1 << k
        key = lambda c: F.concat(text("half"), F.lit("/"), F.col(c))
        first = at.where(F.col("t") < F.col("half") + size).select(key("a").alias("src"), key("b").alias("dst"))
        found = materialize(strong_components(first), "cycle-components")
        a, b = (found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("ka", "kb"))
        met = at.withColumns({"ka": key("a"), "kb": key("b")}).join(a, "ka", "left").join(b, "kb", "left")
        later = ~F.coalesce(F.col("cka") == F.col("ckb"), F.lit(False))
        name = lambda c: F.when(later, F.regexp_replace(F.coalesce(f"ck{c}", f"k{c}"), "^[0-9]+/", "")).otherwise(F.col(c)).alias(c)
        at = materialize(met.select("src", "dst", "weight", "t", (F.col("half") + F.when(later, size).otherwise(0)).alias("half"), name("a"), name("b")), "cycle-halves")
    return at.where("half <= t").select(F.col("src").cast(kind), F.col("dst").cast(kind), "weight")


def break_lightest(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst, weight) without loops and without those of :func:`lightest_of_cycles`: no cycle is left."""
    return edges.where("src <> dst").join(lightest_of_cycles(edges).select("src", "dst"), ["src", "dst"], "left_anti").select(edges.columns)
