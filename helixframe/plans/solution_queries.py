"""Registered queries over solutions by rule: directions, gaps, orientations, checks, partial solutions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as X
from ..operators import decompose as D
from ..operators import graph as G
from ..operators import links as L
from ..operators import paths as H
from ..operators import scaffolds as S
from ..operators import scores as C
from ..operators import solve as P
from .fixtures import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _gaps(spark, sf_dir):
    return L.mean_gaps(view(spark, sf_dir, "links"), view(spark, sf_dir, "contigs"), view(spark, sf_dir, "bundles2"))


def _nodes(spark, sf_dir):
    return view(spark, sf_dir, "contigs").select(F.col("node_idx").alias("node"))


@_query
def overhanging_links(spark, sf_dir):
    """Reads that hang over their contig, here those of every fifth order moved on by 150."""
    moved = F.when(F.col("order_key") % 5 == 0, F.col("read_a_right_pos") + 150).otherwise(F.col("read_a_right_pos"))
    links = view(spark, sf_dir, "links").withColumn("read_a_right_pos", moved)
    return L.overhanging(links, view(spark, sf_dir, "contigs")).select("ctg_a_idx", "ctg_b_idx", "order_key", "d1", "d2")


@_query
def mark_used(spark, sf_dir):
    """Valid links marked with the number of a round."""
    return L.mark_used(view(spark, sf_dir, "links"), 7).select("ctg_a_idx", "ctg_b_idx", "order_key", "invalid", "used")


@_query
def name_lookup(spark, sf_dir):
    """Last contig of each name; 64 names in turn."""
    names = view(spark, sf_dir, "contigs").withColumn("ctg_name", F.concat(F.lit("name_"), F.col("node_idx") % 64))
    return L.name_lookup(names)


@_query
def last_links(spark, sf_dir):
    """Last link of each pair, by order, then its ends and reads."""
    order = ["order_key", "ctg_a_idx", "read_a_left_pos", "read_b_left_pos", "insert_size", "implied_state", "invalid"]
    return L.last_links(view(spark, sf_dir, "links"), order).select("lo", "hi", "ctg_a_idx", "order_key", "read_a_left_pos", "read_b_left_pos", "implied_state", "invalid")


@_query
def constant_insert_gaps(spark, sf_dir):
    """Mean gaps of bundles under an insert size of 2000, from links of orders that are multiples of 3; 500 without any."""
    links = view(spark, sf_dir, "links").where("order_key % 3 = 0")
    return L.constant_insert_gaps(links, view(spark, sf_dir, "contigs"), view(spark, sf_dir, "bundles2"))


@_query
def prune_negative(spark, sf_dir):
    """Bundles without very negative gaps; gaps are spread to reach them."""
    return H.prune_negative(_gaps(spark, sf_dir).withColumn("gap", (F.col("gap") - 300) * 8))


@_query
def sane_gaps(spark, sf_dir):
    """Bundles without gaps beyond reason; gaps are spread to reach them."""
    return H.sane_gaps(_gaps(spark, sf_dir).withColumn("gap", (F.col("gap") - 300) * 8000))


@_query
def edge_direction(spark, sf_dir):
    """Direction of every bundle's state under all four pairs of orientations."""
    each = view(spark, sf_dir, "solved").withColumn("seen", F.explode(F.sequence(F.lit(0), F.lit(3))))
    a, b = F.floor(F.col("seen") / 2), F.col("seen") % 2
    return each.select("u", "v", "seen", X.direction("state", a, b).alias("way"))


@_query
def directed_pairs(spark, sf_dir):
    """Directed edges of solved bundles."""
    return H.directed_pairs(view(spark, sf_dir, "solved"))


@_query
def weighted_pairs(spark, sf_dir):
    """Directed edges with the weight of their state; contigs that are multiples of 50 are special."""
    special = _nodes(spark, sf_dir).where("node % 50 = 0")
    return H.weighted_pairs(view(spark, sf_dir, "solved"), view(spark, sf_dir, "bundles2"), special)


@_query
def flipped_solution(spark, sf_dir):
    """Solved bundles seen from the other strand."""
    return view(spark, sf_dir, "solved").withColumns(X.flipped())


@_query
def induced_digraph(spark, sf_dir):
    """Directed edges out of the active contigs."""
    return L.induced_digraph(H.directed_pairs(view(spark, sf_dir, "solved")), view(spark, sf_dir, "contigs").where("node_idx % 10 < 5"))


@_query
def assign_gaps(spark, sf_dir):
    """Directed edges with the mean gap of their pair; pairs that sum to a multiple of 4 have none."""
    return H.assign_gaps(H.directed_pairs(view(spark, sf_dir, "solved")), _gaps(spark, sf_dir).where("(lo + hi) % 4 <> 0"))


@_query
def assign_orientations(spark, sf_dir):
    """Orientation of every contig in the solution; none for a contig without a bundle."""
    return H.assign_orientations(_nodes(spark, sf_dir), view(spark, sf_dir, "solved"))


@_query
def path_degrees(spark, sf_dir):
    """Contigs whose directed bundles are no path."""
    return H.path_degrees(view(spark, sf_dir, "solved"))


def _region_edges(spark, sf_dir):
    s = view(spark, sf_dir, "region_solved")
    gaps = s.where("(u + v) % 5 <> 0").select(F.col("u").alias("lo"), F.col("v").alias("hi"), (F.col("u") % 100).cast("double").alias("gap"))
    return H.assign_gaps(H.directed_pairs(s), gaps)


@_query
def path_checks(spark, sf_dir):
    """What keeps the region graph from being paths; contigs that are multiples of 9 have no orientation, pairs that sum to a multiple of 5 no gap."""
    ends = view(spark, sf_dir, "region_solved").select(F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = ends.withColumn("orien", F.when(F.col("node") % 9 != 0, F.col("node") % 2))
    return H.path_violations(nodes, _region_edges(spark, sf_dir))


@_query
def completeness(spark, sf_dir):
    """What a solution leaves open; states of weightless pairs are taken away."""
    solved = view(spark, sf_dir, "solved")
    nodes = H.assign_orientations(_nodes(spark, sf_dir), solved)
    return H.incomplete(nodes, solved.withColumn("state", F.when((F.col("u") + F.col("v")) % 6 != 0, F.col("state"))))


@_query
def solved_active(spark, sf_dir):
    """Solved contigs in the active set."""
    nodes = _nodes(spark, sf_dir)
    return H.solved_and_active(H.assign_orientations(nodes, view(spark, sf_dir, "solved")), nodes.where("node % 10 < 5"))


def _orientations(spark, sf_dir):
    return H.assign_orientations(_nodes(spark, sf_dir), view(spark, sf_dir, "solved")).where("orien is not null")


@_query
def apply_partial(spark, sf_dir):
    """Orientations with those of a partial solution over them: every third contig, 1 where it is a multiple of 2."""
    partial = _nodes(spark, sf_dir).where("node % 3 = 0").withColumn("orien", 1 - F.col("node") % 2)
    return P.apply_partial(_orientations(spark, sf_dir), partial)[0]


@_query
def partial_conflicts(spark, sf_dir):
    """Contigs on which the partial solution differs."""
    partial = _nodes(spark, sf_dir).where("node % 3 = 0").withColumn("orien", 1 - F.col("node") % 2)
    return P.apply_partial(_orientations(spark, sf_dir), partial)[1]


def _parts(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).where("node % 100 < 40")
    part = F.floor(F.col("node") / 100)
    # Parts with an odd number are the other way round, and multiples of 17 are plainly wrong.
    orien = (F.floor(F.col("node") % 4 / 2) + part + (F.col("node") % 17 == 0).cast("long")) % 2
    return nodes.select(part.alias("part"), "node", orien.alias("orien"))


@_query
def flip_retry(spark, sf_dir):
    """Partial solutions by hundreds of contigs, turned around where they disagree."""
    return P.apply_with_flip(_orientations(spark, sf_dir), _parts(spark, sf_dir))[1]


@_query
def flip_applied(spark, sf_dir):
    """Orientations after the partial solutions."""
    return P.apply_with_flip(_orientations(spark, sf_dir), _parts(spark, sf_dir))[0]


@_query
def partial_bundles(spark, sf_dir):
    """States and directions with those of a partial solution over them: of even second contigs, with bundles of first contigs that are multiples of 3, turned."""
    s = view(spark, sf_dir, "solved").select("u", "v", "state", "X", "Y")
    partial = s.where("u % 3 = 0").select("u", "v", "state", F.col("Y").alias("X"), F.col("X").alias("Y"))
    return P.apply_partial_bundles(s.where("v % 2 = 0"), partial)


@_query
def flip_bundles(spark, sf_dir):
    """States and directions after the partial solutions by hundreds of contigs; bundles that sum to a multiple of 5 have no direction there."""
    s = view(spark, sf_dir, "solved").select("u", "v", "state", "X", "Y")
    inside = s.where("floor(u / 100) = floor(v / 100) and u % 100 < 40 and v % 100 < 40")
    none = (F.col("u") + F.col("v")) % 5 == 0
    partial = inside.select(F.floor(F.col("u") / 100).alias("part"), "u", "v", "state", *(F.when(none, 0).otherwise(F.col(c)).alias(c) for c in "XY"))
    return P.apply_bundles_with_flip(s, partial, P.apply_with_flip(_orientations(spark, sf_dir), _parts(spark, sf_dir))[1])


@_query
def merge_partial(spark, sf_dir):
    """Solved bundles of both of two partial solutions: one has the bundles of active first contigs, the other those of second ones, turned."""
    s = view(spark, sf_dir, "solved").select("u", "v", "state", "X", "Y")
    other = s.where("v % 10 < 5").select("u", "v", (3 - F.col("state")).alias("state"), F.col("Y").alias("X"), F.col("X").alias("Y"))
    return P.merge_partial(s.where("u % 10 < 5"), other)


@_query
def order_by_support(spark, sf_dir):
    """Solved pairs ranked by the weight of their state; pairs whose first contig is a multiple of 11 have no bundle."""
    return H.order_by_support(view(spark, sf_dir, "solved"), view(spark, sf_dir, "bundles2").where("ctg_a_idx % 11 <> 0"))


@_query
def score_identities(spark, sf_dir):
    """Identities that the confusion counts must keep."""
    ref, test = (S.scaffold_rows(view(spark, sf_dir, n)) for n in ("path_ref", "path_test"))
    truth, contigs = S.adjacencies(ref), ref.where("comp_type = 'W'")
    return C.identities(C.confusion(truth, S.adjacencies(test), contigs), truth, contigs)


@_query
def solution_rows(spark, sf_dir):
    """Rows of a solution file for the pairs of the final edges, here directed edges between contigs of one half."""
    s = view(spark, sf_dir, "solved")
    return P.previous_solution(s, H.directed_pairs(s).where("src % 2 = dst % 2"))


@_query
def large_components(spark, sf_dir):
    """Components of the region graph that a cutoff of 3, which counts as 5, lets through."""
    edges = view(spark, sf_dir, "regions").select(F.col("ctg_a_idx").alias("u"), F.col("ctg_b_idx").alias("v"))
    return D.large_components(G.connected_components(edges), 3)
