"""Registered graph and solver queries over regions, whose graphs keep their shape at every size of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose as D
from ..operators import graph as G
from ..operators import links as L
from ..operators import paths as H
from ..operators import solve as P
from ..tables import materialize
from .fixtures import solved, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _edges(spark, sf_dir, name="regions"):
    return view(spark, sf_dir, name).select(F.col("ctg_a_idx").alias("u"), F.col("ctg_b_idx").alias("v"))


def _nodes(edges):
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _blocks(spark, sf_dir):
    return D.named_blocks(G.blocks(_edges(spark, sf_dir)))


def _by_text(blocks):
    """Contigs as text, like the names of blocks, for tables that list both."""
    return blocks.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "block")


def _directed(spark, sf_dir):
    # Links are joined and counted once, for the solution and its support.
    regions = materialize(view(spark, sf_dir, "regions"), "regions")
    return materialize(H.weighted_pairs(solved(spark, regions), regions), "directed")


@_query
def region_components(spark, sf_dir):
    """Connected components of the dense regions."""
    edges = _edges(spark, sf_dir, "dense")
    return G.components(_nodes(edges), edges)


@_query
def bucket_sizes(spark, sf_dir):
    """Components of the regions by whether they are batched (fewer than 4 contigs) or alone."""
    edges = _edges(spark, sf_dir)
    buckets = G.bucket_small(G.components(_nodes(edges), edges), 4)
    return buckets.groupBy("size", F.col("bucket").isNull().cast("int").alias("alone")).agg(F.count("*").alias("n"))


@_query
def bucket_limits(spark, sf_dir):
    """Of the buckets of small components: how many contigs they hold in all, and how many buckets hold twice the cutoff or more (none)."""
    edges = _edges(spark, sf_dir)
    filled = G.bucket_small(G.components(_nodes(edges), edges), 4).where("bucket is not null").groupBy("bucket").agg(F.sum("size").alias("size"))
    return filled.agg(F.sum("size").alias("n_contigs"), F.count_if(F.col("size") >= 8).alias("n_overfull"))


@_query
def region_triangles(spark, sf_dir):
    """Triangles of the dense regions."""
    return L.triangles(view(spark, sf_dir, "dense"))


@_query
def region_block_members(spark, sf_dir):
    """Contigs of each block, blocks by their smallest edge."""
    return G.block_members(_blocks(spark, sf_dir))


@_query
def region_articulation(spark, sf_dir):
    """Contigs whose removal parts their component."""
    return G.articulation_points(G.blocks(_edges(spark, sf_dir)))


@_query
def region_block_cuts(spark, sf_dir):
    """Blocks and the contigs that join them."""
    return G.block_cut_tree(_blocks(spark, sf_dir))


@_query
def block_cut_forest(spark, sf_dir):
    """Blocks with their cuts, blocks without one, and single contigs; the contigs are those of bundles of one link or more."""
    blocks = G.blocks(_edges(spark, sf_dir))
    linked = view(spark, sf_dir, "region_links").select(F.explode(F.array("ctg_a_idx", "ctg_b_idx")).alias("node")).distinct()
    return G.block_cut_forest(blocks, linked).select(F.col("cut").isNull().cast("int").alias("alone")).groupBy("alone").agg(F.count("*").alias("n"))


@_query
def block_cut_nodes(spark, sf_dir):
    """Nodes of the block-cut tree with their degrees."""
    return G.block_cut_nodes(_by_text(_blocks(spark, sf_dir)))


@_query
def block_tree_node(spark, sf_dir):
    """Where each contig is in the block-cut tree."""
    return G.block_tree_node(_by_text(_blocks(spark, sf_dir)))


@_query
def common_block(spark, sf_dir):
    """Pairs of cuts that lie in one block, smaller first."""
    blocks = _blocks(spark, sf_dir)
    cut = G.articulation_points(blocks)
    edges = blocks.select(F.col("u").alias("s"), F.col("v").alias("t"))
    pairs = edges.join(cut.withColumnRenamed("node", "s"), "s").join(cut.withColumnRenamed("node", "t"), "t").select("s", "t")
    return G.common_block(blocks, pairs)


@_query
def biconnected(spark, sf_dir):
    """Whether each component stays connected without any one contig."""
    edges = _edges(spark, sf_dir)
    found = G.biconnected_components(G.blocks(edges), G.components(_nodes(edges), edges))
    return found.select("root", F.col("biconnected").cast("int").alias("biconnected"))


@_query
def set_connectivity(spark, sf_dir):
    """Parts into which bundles join the even and the odd contigs of each region."""
    edges = _edges(spark, sf_dir)
    sets = _nodes(edges).select((F.col("node") - F.col("node") % 64 + F.col("node") % 64 % 2).alias("set"), "node")
    return G.set_connectivity(sets, edges)


@_query
def region_shared_members(spark, sf_dir):
    """Blocks that share contigs."""
    found = G.shared_members(G.block_members(_blocks(spark, sf_dir)).withColumnRenamed("block", "set"))
    return found.select("i", "j", F.array_join("shared", ",").alias("shared"))


@_query
def union_check(spark, sf_dir):
    """Contigs of each block that an earlier block has too."""
    return G.overlap_with_earlier(G.block_members(_blocks(spark, sf_dir)).withColumnRenamed("block", "set"))


@_query
def first_component(spark, sf_dir):
    """First component of the dense regions with more than 9 and fewer than 20 contigs."""
    edges = _edges(spark, sf_dir, "dense")
    return G.first_component_of_size(G.components(_nodes(edges), edges), 9, 20)


def _heaviest(spark, sf_dir):
    weight = (F.col("WT_A") + F.col("WT_B") + F.col("WT_C") + F.col("WT_D")).alias("weight")
    return G.best_incoming(view(spark, sf_dir, "regions").select(F.col("ctg_a_idx").alias("src"), F.col("ctg_b_idx").alias("dst"), weight))


@_query
def tree_orders(spark, sf_dir):
    """Preorder and postorder of the trees of heaviest edges from smaller contigs."""
    return G.tree_orders(_heaviest(spark, sf_dir).select("src", "dst"))


@_query
def long_paths(spark, sf_dir):
    """Edges of the longest paths in the trees of heaviest edges."""
    return G.long_paths(_heaviest(spark, sf_dir).select("src", "dst"))


@_query
def contracted_tree(spark, sf_dir):
    """Pieces into which the trees of heaviest edges are put together, of at most 6 contigs: contigs in all, and pieces beyond that size (none)."""
    tree = _heaviest(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    sizes = tree.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("size", F.lit(1))
    merged = G.contract_tree(tree, sizes, 6).groupBy("merged").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return merged.agg(F.sum("n").alias("n_contigs"), F.count_if((F.col("size") > 6) | (F.col("size") != F.col("n"))).alias("n_wrong"))


@_query
def cycle_edges(spark, sf_dir):
    """Edges that are left when rings of 7 contigs in a row lose their lightest edge; weights by the contig."""
    ring = _nodes(_edges(spark, sf_dir)).select((F.col("node") - F.col("node") % 7).alias("base")).distinct()
    edges = ring.select(F.explode(F.expr("sequence(0, 6)")).alias("k"), "base").select(
        (F.col("base") + F.col("k")).alias("src"), (F.col("base") + (F.col("k") + 1) % 7).alias("dst"), ((F.col("base") + F.col("k")) * 31 % 11).alias("weight")
    )
    return G.break_cycles_lightest(edges)


@_query
def cycle_ends(spark, sf_dir):
    """Edges that are left when each ring loses the one that leads back to its smallest contig."""
    ring = _nodes(_edges(spark, sf_dir)).select((F.col("node") - F.col("node") % 7).alias("base")).distinct()
    edges = ring.select(F.explode(F.expr("sequence(0, 6)")).alias("k"), "base").select((F.col("base") + F.col("k")).alias("src"), (F.col("base") + (F.col("k") + 1) % 7).alias("dst"))
    return G.break_cycles_last(edges)


@_query
def matching_objective(spark, sf_dir):
    """Edges and weight of the greatest matching of directed region edges, in all."""
    return H.match_maximum(_directed(spark, sf_dir)).agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


@_query
def matching_degrees(spark, sf_dir):
    """Contigs of the matching with more than one edge in or out: none, of as many contigs as take part."""
    matched = H.match_maximum(_directed(spark, sf_dir))
    return G.degrees(matched).agg(F.count_if((F.col("in_degree") > 1) | (F.col("out_degree") > 1)).alias("n_wrong"), F.sum("in_degree").alias("n_edges"))


@_query
def region_branching(spark, sf_dir):
    """Weight of the greatest branching of the directed edges of each region component."""
    edges = _directed(spark, sf_dir)
    found = G.connected_components(_edges(spark, sf_dir)).withColumnRenamed("node", "src")
    return H.branching(edges).join(found, "src").groupBy("root").agg(F.sum("weight").alias("weight"))


@_query
def region_objective(spark, sf_dir):
    """Greatest total weight of the solved region bundles, with the rule on circles of three."""
    return P.solve(view(spark, sf_dir, "regions")).agg(F.sum("weight").alias("objective"), F.count("*").alias("n_bundles"), F.count_if(F.col("status") == "exact").alias("n_exact"))


@_query
def region_checks(spark, sf_dir):
    """How many bundles of the dense regions break each constraint: none; and of how many bundles and triangles."""
    bundles = view(spark, sf_dir, "dense")
    tris = L.triangles(bundles)
    solution = P.materialize(P.solve(bundles), "solution")
    sizes = {"bundles": solution, "triangles": tris}
    return P.violations(solution, tris).union(H.counted(sizes))


@_query
def dense_gap(spark, sf_dir):
    """The most that the dense regions could weigh, by status; and how many components weigh more than that or less than three quarters of it (none)."""
    solution = P.materialize(P.solve(view(spark, sf_dir, "dense")), "solution")
    found = G.connected_components(solution.select("u", "v")).withColumnRenamed("node", "u")
    per = solution.join(found, "u").groupBy("status", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("most").alias("most"))
    off = (F.col("weight") > F.col("most")) | (F.col("weight") < 0.75 * F.col("most"))
    return per.groupBy("status").agg(F.sum("n").alias("n_bundles"), F.sum("most").alias("most"), F.count_if(off).alias("n_off"))


@_query
def forced_solution(spark, sf_dir):
    """Orientations of the contigs that a previous solution forces; every contig that is a multiple of 3 is forced."""
    s = view(spark, sf_dir, "region_solved")
    wanted = H.assign_orientations(_nodes(s), s).where("node % 3 = 0")
    directions = s.where("u % 3 = 0 and v % 3 = 0").select(F.col("u").alias("idxa"), F.col("v").alias("idxb"), F.col("X").alias("patha"), F.col("Y").alias("pathb"))
    solution = P.solve(view(spark, sf_dir, "regions"), orientations=wanted, directions=directions)
    return H.assign_orientations(wanted, solution)


@_query
def forced_directions(spark, sf_dir):
    """Directions of the bundles between two forced contigs."""
    s = view(spark, sf_dir, "region_solved")
    wanted = H.assign_orientations(_nodes(s), s).where("node % 3 = 0")
    directions = s.where("u % 3 = 0 and v % 3 = 0").select(F.col("v").alias("idxa"), F.col("u").alias("idxb"), F.col("Y").alias("patha"), F.col("X").alias("pathb"))
    solution = P.solve(view(spark, sf_dir, "regions"), orientations=wanted, directions=directions)
    return solution.where("u % 3 = 0 and v % 3 = 0").select("u", "v", "X", "Y")
