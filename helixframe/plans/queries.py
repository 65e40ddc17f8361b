"""The registered queries: one per operator, over the views of :mod:`fixtures`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as X
from ..operators import assembly as A
from ..operators import decompose as D
from ..operators import graph as G
from ..operators import links as L
from ..operators import paths as H
from ..operators import scaffolds as S
from ..operators import scores as C
from ..operators import solve as P
from ..sources import text as T
from ..tables import scratch_folder
from . import exact_queries, format_queries, region_queries, solution_queries
from .fixtures import both_paths, keyed_paths, link_tasks, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Every other contig, as the active set of the set queries.
ACTIVE = "node_idx % 10 < 5"


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _edges(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.col("ctg_a_idx").alias("u"), F.col("ctg_b_idx").alias("v"))


def _agp(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.scaffold_rows(keyed_paths(spark, sf_dir, name))


@_query
def pair_class(spark, sf_dir):
    """Links per pair and orientation class."""
    links = view(spark, sf_dir, "links").withColumn("class", X.orientation_class())
    pairs = L.dealt_by_pair(links.select("ctg_a_idx", "ctg_b_idx", "class"), link_tasks(spark, sf_dir))
    return pairs.groupBy("lo", "hi", "class").agg(F.count("*").alias("n"))


@_query
def implied_dist(spark, sf_dir):
    """Distance that each link's state implies."""
    d = L.with_implied_distance(view(spark, sf_dir, "links"), view(spark, sf_dir, "contigs"))
    return d.select("ctg_a_idx", "ctg_b_idx", "order_key", "implied_state", "d1", "d2", "implied_dist")


@_query
def link_gap(spark, sf_dir):
    """Gap estimate of each link, as intended and as in older results."""
    w = L.with_widths(view(spark, sf_dir, "links"), view(spark, sf_dir, "contigs"))
    return w.select("ctg_a_idx", "ctg_b_idx", "order_key", X.link_gap().alias("gap"), X.link_gap(compat=True).alias("gap_compat"))


@_query
def bundle_links(spark, sf_dir):
    """Bundles of at least two links."""
    return L.bundle_links(view(spark, sf_dir, "links"), 2)


@_query
def gap_avg(spark, sf_dir):
    """Mean gap of each bundle."""
    return L.mean_gaps(view(spark, sf_dir, "links"), view(spark, sf_dir, "contigs"), view(spark, sf_dir, "bundles2"))


@_query
def gap_avg_fallback(spark, sf_dir):
    """Mean gap of each bundle from links of odd orders only; without any, the known gap, here 10 times the smaller id plus the larger."""
    known = view(spark, sf_dir, "bundles2").select(F.col("ctg_b_idx").alias("comp_a"), F.col("ctg_a_idx").alias("comp_b"), (10 * F.col("ctg_a_idx") + F.col("ctg_b_idx")).alias("gap"))
    odd = view(spark, sf_dir, "links").where("order_key % 2 = 1")
    return L.mean_gaps(odd, view(spark, sf_dir, "contigs"), view(spark, sf_dir, "bundles2"), known)


@_query
def links_per_pair(spark, sf_dir):
    """Links of each pair."""
    return L.links_per_pair(view(spark, sf_dir, "links"), link_tasks(spark, sf_dir))


@_query
def tp_fp_hist(spark, sf_dir):
    """Pairs by number of links, split by whether they are bundles."""
    truth = L.with_pair(view(spark, sf_dir, "bundles2")).select("lo", "hi")
    return L.bundle_size_histogram(view(spark, sf_dir, "links"), truth, link_tasks(spark, sf_dir))


@_query
def cluster_filter(spark, sf_dir):
    """Bundles that are in a list of pairs (those of three or more links), in either order."""
    pairs = view(spark, sf_dir, "bundles3").select(F.col("ctg_a_idx").alias("lo"), F.col("ctg_b_idx").alias("hi"))
    return L.in_clusters(view(spark, sf_dir, "bundles2"), pairs)


@_query
def induced_edges(spark, sf_dir):
    """Bundles with both ends in the active set."""
    return L.induced(view(spark, sf_dir, "bundles2"), view(spark, sf_dir, "contigs").where(ACTIVE))


@_query
def incident_edges(spark, sf_dir):
    """Bundles with an end in the active set."""
    return L.incident(view(spark, sf_dir, "bundles2"), view(spark, sf_dir, "contigs").where(ACTIVE))


@_query
def induced_cut_edges(spark, sf_dir):
    """Bundles inside the active set and the cuts (multiples of 7), none between two cuts."""
    contigs = view(spark, sf_dir, "contigs")
    return L.induced_with_cuts(view(spark, sf_dir, "bundles2"), contigs.where(ACTIVE), contigs.where("node_idx % 7 = 0"))


@_query
def triangles(spark, sf_dir):
    """Triangles of bundles."""
    return L.triangles(view(spark, sf_dir, "bundles2"))


@_query
def triangles_ordered(spark, sf_dir):
    """Triangles in all six orders."""
    return L.ordered_triangles(view(spark, sf_dir, "bundles2"))


def _one_link_per_pair(spark, sf_dir):
    d = L.with_pair(L.with_implied_distance(view(spark, sf_dir, "links"), view(spark, sf_dir, "contigs")))
    one = d.join(L.unique_edges(view(spark, sf_dir, "bundles2")), ["lo", "hi"], "left_semi")
    least = F.min(F.struct("order_key", "ctg_a_idx", "implied_state", "implied_dist", "read_a_left_pos", "read_b_left_pos"))
    return one.groupBy("lo", "hi").agg(least.alias("l")).select("lo", "hi", "l.implied_state", "l.implied_dist")


@_query
def transitive_small(spark, sf_dir):
    """Small contigs inside triangles that the opposite link can span."""
    return L.spanned_small_contigs(_one_link_per_pair(spark, sf_dir), view(spark, sf_dir, "contigs"))


@_query
def mask_overlap(spark, sf_dir):
    """Unmasked part of the reads of each link; the masks of a contig are 30 bases around each multiple of 60 and of 75."""
    tasks = link_tasks(spark, sf_dir)
    contigs = view(spark, sf_dir, "contigs").select("node_idx", "ctg_width").repartition(tasks, "node_idx")
    step = lambda n: F.sequence(F.lit(0).cast("long"), "ctg_width", F.lit(n).cast("long"))
    masks = contigs.select("node_idx", F.explode(F.concat(step(60), step(75))).alias("start")).withColumn("end", F.col("start") + 30 + F.col("node_idx") % 7)
    key = ["ctg_a_idx", "ctg_b_idx", "order_key", "read_a_left_pos", "read_b_left_pos"]
    links = view(spark, sf_dir, "links").select(*key, "read_a_right_pos", "read_b_right_pos").distinct()
    weights = L.read_weights(links, masks, bin_width=64, key=key, tasks=tasks)
    return weights.select(F.concat_ws("_", *key).alias("link_id"), F.round("a_overlap", 6).alias("a_overlap"), F.round("b_overlap", 6).alias("b_overlap"), "a_coverage", "b_coverage")


@_query
def scaffold_coords(spark, sf_dir):
    """Scaffold rows of the reference paths."""
    return _agp(spark, sf_dir, "path_ref").drop("scaf_key")


@_query
def agp_adjacency(spark, sf_dir):
    """Neighbours over gap rows."""
    return S.adjacencies(_agp(spark, sf_dir, "path_ref"))


@_query
def agp_digraph(spark, sf_dir):
    """Directed neighbours with the length of the gap row."""
    return S.scaffold_digraph(_agp(spark, sf_dir, "path_test"))


@_query
def agp_gaps(spark, sf_dir):
    """Gaps between neighbours from scaffold coordinates."""
    return S.coordinate_gaps(_agp(spark, sf_dir, "path_test"))


def _shared(spark, sf_dir):
    ref, test = (S.adjacencies(_agp(spark, sf_dir, n), tasks=link_tasks(spark, sf_dir)) for n in ("path_ref", "path_test"))
    return ref.join(test, ["lo", "hi"], "left_semi")


@_query
def break_scaffolds(spark, sf_dir):
    """Test scaffolds broken at neighbours that the reference doesn't have."""
    return S.break_scaffolds(_agp(spark, sf_dir, "path_test"), _shared(spark, sf_dir), tasks=link_tasks(spark, sf_dir)).select("scaf_name", "scaf_idx", "comp_name", "comp_type", "piece")


@_query
def confusion(spark, sf_dir):
    """A, B, C, D of the test scaffolds."""
    ref = _agp(spark, sf_dir, "path_ref")
    return C.confusion(S.adjacencies(ref), S.adjacencies(_agp(spark, sf_dir, "path_test")), ref.where("comp_type = 'W'"))


@_query
def scores(spark, sf_dir):
    """Sensitivity, positive predictive value and correlation."""
    return C.derived_scores(confusion(spark, sf_dir)).select(*(F.round(c, 9).alias(c) for c in ("sensitivity", "ppv", "mcc")))


@_query
def gap_deviation(spark, sf_dir):
    """Mean relative deviation of gap lengths."""
    return C.gap_deviation(_agp(spark, sf_dir, "path_ref"), _agp(spark, sf_dir, "path_test")).select(F.round("gap_dev", 9).alias("gap_dev"))


@_query
def n50(spark, sf_dir):
    """N50 of the test scaffolds, one later as in older results, and the usual one."""
    sizes = S.scaffold_sizes(_agp(spark, sf_dir, "path_test"))
    return S.n50(sizes, True).withColumnRenamed("n50", "n50_compat").join(F.broadcast(S.n50(sizes)))


@_query
def tp50(spark, sf_dir):
    """N50 of the broken test scaffolds."""
    pieces = S.break_scaffolds(_agp(spark, sf_dir, "path_test"), _shared(spark, sf_dir), tasks=link_tasks(spark, sf_dir))
    return S.n50(S.scaffold_sizes(pieces, ("scaf_name", "piece")), True).withColumnRenamed("n50", "tp50")


@_query
def evaluate(spark, sf_dir):
    """The whole score row."""
    row = C.evaluate(*(S.scaffold_rows(p) for p in both_paths(spark, sf_dir)), "orders", "shipdate", tasks=link_tasks(spark, sf_dir))
    return row.withColumns({c: F.round(c, 9) for c in ("gap_dev", "sensitivity", "ppv", "mcc")})


@_query
def components(spark, sf_dir):
    """Connected component of every contig."""
    nodes = view(spark, sf_dir, "contigs").select(F.col("node_idx").alias("node"))
    return G.components(nodes, _edges(view(spark, sf_dir, "bundles3")))


@_query
def component_sizes(spark, sf_dir):
    """Components by size."""
    return components(spark, sf_dir).groupBy("root").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@_query
def bucket_small(spark, sf_dir):
    """Components by size, whether they are batched (fewer than 5 contigs) and whether their bucket holds fewer than twice as many contigs."""
    buckets = G.bucket_small(components(spark, sf_dir), 5)
    filled = buckets.groupBy(F.col("bucket").alias("b")).agg(F.sum("size").alias("held"))
    fits = F.coalesce((F.col("held") < 10).cast("int"), F.lit(1))
    return buckets.join(filled, F.col("bucket") == F.col("b"), "left").groupBy("size", F.col("bucket").isNull().cast("int").alias("alone"), fits.alias("fits")).agg(F.count("*").alias("n"))


@_query
def degrees(spark, sf_dir):
    """In- and out-degree, smaller id to larger."""
    return G.degrees(view(spark, sf_dir, "bundles2").select(F.col("ctg_a_idx").alias("src"), F.col("ctg_b_idx").alias("dst")))


@_query
def linear_violations(spark, sf_dir):
    """Contigs with more than one edge in or out."""
    return G.nonlinear_nodes(view(spark, sf_dir, "bundles2").select(F.col("ctg_a_idx").alias("src"), F.col("ctg_b_idx").alias("dst")))


@_query
def break_nonlinear(spark, sf_dir):
    """Edges between contigs that have one edge in and out at most."""
    return G.break_nonlinear(view(spark, sf_dir, "bundles2").select(F.col("ctg_a_idx").alias("src"), F.col("ctg_b_idx").alias("dst")))


@_query
def max_incoming(spark, sf_dir):
    """Heaviest edge into each contig."""
    weight = (F.col("WT_A") + F.col("WT_B") + F.col("WT_C") + F.col("WT_D")).alias("weight")
    return G.best_incoming(view(spark, sf_dir, "bundles2").select(F.col("ctg_a_idx").alias("src"), F.col("ctg_b_idx").alias("dst"), weight))


def _named_blocks(spark, sf_dir):
    return D.named_blocks(G.blocks(_edges(view(spark, sf_dir, "bundles3"))))


@_query
def block_members(spark, sf_dir):
    """Contigs of each biconnected component, by its smallest edge."""
    return G.block_members(_named_blocks(spark, sf_dir))


@_query
def articulation(spark, sf_dir):
    """Contigs whose removal parts their component."""
    return G.articulation_points(G.blocks(_edges(view(spark, sf_dir, "bundles3"))))


@_query
def block_cut_tree(spark, sf_dir):
    """Blocks and the contigs that join them."""
    return G.block_cut_tree(_named_blocks(spark, sf_dir))


@_query
def shared_members(spark, sf_dir):
    """Blocks that share contigs."""
    found = G.shared_members(G.block_members(_named_blocks(spark, sf_dir)).withColumnRenamed("block", "set"))
    return found.select("i", "j", F.array_join("shared", ",").alias("shared"))


@_query
def shortest_paths(spark, sf_dir):
    """Lightest paths from contig 1 over bundles from smaller to larger id."""
    weight = (F.col("WT_A") + F.col("WT_B") + F.col("WT_C") + F.col("WT_D")).alias("weight")
    return G.shortest_paths(view(spark, sf_dir, "bundles2").select(F.col("ctg_a_idx").alias("src"), F.col("ctg_b_idx").alias("dst"), weight), 1).select("node", "distance")


@_query
def solve_objective(spark, sf_dir):
    """Greatest total weight of the solved bundles."""
    return P.solve(view(spark, sf_dir, "bundles3")).agg(F.sum("weight").alias("objective"), F.count("*").alias("n_bundles"))


@_query
def solution(spark, sf_dir):
    """Weight of the solved bundles of each component."""
    solved = P.materialize(P.solve(view(spark, sf_dir, "bundles3")), "solution")
    found = G.connected_components(solved.select("u", "v")).withColumnRenamed("node", "u")
    return solved.join(found, "u").groupBy("root").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_bundles"))


@_query
def constraint_checks(spark, sf_dir):
    """How many bundles break each constraint: none; and of how many bundles with which links."""
    bundles = view(spark, sf_dir, "bundles3")
    solved = P.materialize(P.solve(bundles), "solution")
    total = solved.agg(F.count("*").alias("n"), F.sum(F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3")).cast("long").alias("links"))
    told = total.select(F.lit("bundles").alias("rule"), "n").union(total.select(F.lit("links"), "links"))
    return P.violations(solved, L.triangles(bundles)).union(told)


@_query
def matching(spark, sf_dir):
    """Edges and weight of the greatest matching among edges that compete with one another, and how many such groups have them."""
    edges = region_queries._directed(spark, sf_dir)
    side = lambda x: F.concat(F.lit(x[0]), F.col(x).cast("string"))
    groups = G.connected_components(edges.select(side("src").alias("u"), side("dst").alias("v")))
    matched = H.match_maximum(edges).withColumn("node", side("src")).join(groups, "node")
    per = matched.groupBy("root").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))
    return per.groupBy("n_edges", "weight").agg(F.count("*").alias("n_groups"))


@_query
def paths(spark, sf_dir):
    """Contigs of each test scaffold in order, from its directed edges."""
    # A name may come twice in a scaffold, a name with its place doesn't.
    at = lambda name, step: F.concat(name, F.lit("#"), F.col("scaf_idx") + step)
    gaps = S.neighbours(_agp(spark, sf_dir, "path_test")).where("comp_type = 'N' and prev is not null and next is not null")
    name = lambda c: F.substring_index(c, "#", 1).alias(c)
    return G.order_paths(gaps.select(at("prev", -1).alias("src"), at("next", 1).alias("dst"))).select(name("node"), name("path"), "pos")


@_query
def agp_out(spark, sf_dir):
    """What a file of the scaffolds of all region contigs holds, written and read: contigs, bases in contigs; and what is wrong with it: nothing."""
    links, regions = view(spark, sf_dir, "region_links"), P.materialize(view(spark, sf_dir, "regions"), "regions")
    nodes = links.select(F.explode(F.array("ctg_a_idx", "ctg_b_idx")).alias("node_idx")).distinct()
    contigs = P.materialize(nodes.select("node_idx", F.concat(F.lit("ctg_"), "node_idx").alias("ctg_name"), (200 + F.col("node_idx") % 51).alias("ctg_width")), "contigs")
    path = f"{scratch_folder(spark)}/agp-{uuid.uuid4().hex}"
    made = H.with_rank(A.assemble(regions, links, contigs), ["scaf_name", "scaf_idx"])
    T.write_agp(made.withColumnRenamed("rank", "line_no"), path)
    rows = T.read_agp(spark, path)
    w = F.col("comp_type") == "W"
    told = rows.agg(
        F.count_if(w).alias("contigs"), F.sum(F.when(w, F.col("comp_stop"))).alias("bases"), (F.count_if(w) - F.count_distinct(F.when(w, F.col("comp_name")))).alias("contigs twice"),
        (F.count_if(~w) + F.count_distinct("scaf_name") - F.count_if(w)).alias("joins missing"), (F.sum("scaf_stop") < F.sum("comp_stop")).cast("long").alias("too short"),
    )
    broken = T.agp_violations(rows).agg(F.count("*").alias("n")).select(F.lit("rules").alias("measure"), "n")
    return told.unpivot([], told.columns, "measure", "n").union(broken)


for _more in (format_queries, solution_queries, region_queries, exact_queries):
    QUERIES |= _more.QUERIES
