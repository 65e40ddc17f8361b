"""The decomposition of a bundle graph: components, then the blocks of the large ones, with the tree that joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from . import graph as G

#: Fixed value: the least size that a component is decomposed from, whatever is asked for.
LEAST_CUTOFF = 5


def large_components(members: DataFrame, cutoff: int) -> DataFrame:
    """(root, size): components of ``members`` (node, root) with at least ``cutoff`` nodes, and never fewer than five."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    return sizes.where(F.col("size") >= max(cutoff, LEAST_CUTOFF))


def named_blocks(edge_blocks: DataFrame) -> DataFrame:
    """(u, v, block): blocks named by their smallest edge, as "u-v", whatever tree they were found by."""
    name = F.min(F.struct("u", "v")).alias("e")
    names = edge_blocks.groupBy("block").agg(name).select("block", F.concat_ws("-", "e.u", "e.v").alias("name"))
    return edge_blocks.join(names, "block").select("u", "v", F.col("name").alias("block"))


def decompose(nodes: DataFrame, edges: DataFrame, cutoff: int = LEAST_CUTOFF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pieces (stage, path, node), links (stage, a, b, cut) and roots (stage, path) of ``nodes`` (node) and ``edges`` (u, v).

    Stage 0 has every component, numbered by its smallest node; stage 1 the
    blocks of components of at least ``cutoff`` nodes, numbered as in
    :func:`.graph.blocks`.  ``path`` is the numbers of the
    pieces that a piece lies in and its own.  At every cut the smallest block is
    linked with all others that share it, so links form a tree over the blocks
    of a component; its root is the smallest block.  Pieces are one row per
    member, so none is ever gathered.
    """
    members = materialize(G.components(nodes, edges), "decompose-components")
    stage0 = members.select(F.lit(0).alias("stage"), F.array("root").alias("path"), "node")
    inside = edges.select("u", "v").join(members.withColumnRenamed("node", "u"), "u").join(large_components(members, cutoff).select("root"), "root", "left_semi")
    found = G.blocks(inside.select("u", "v"))
    named = materialize(found.join(members.withColumnRenamed("node", "u"), "u").select("root", "block", "u", "v"), "decompose-blocks")
    in_block = named.select("root", "block", F.explode(F.array("u", "v")).alias("node")).distinct()
    stage1 = in_block.select(F.lit(1).alias("stage"), F.array("root", "block").alias("path"), "node")
    shared = in_block.join(G.articulation_points(found), "node", "left_semi")
    hub = shared.groupBy("node").agg(F.min("block").alias("hub"))
    met = shared.join(hub, "node").where("block <> hub")
    links = met.select(F.lit(1).alias("stage"), F.array("root", "hub").alias("a"), F.array("root", "block").alias("b"), F.array("node").alias("cut"))
    roots = named.groupBy("root").agg(F.min("block").alias("block")).select(F.lit(1).alias("stage"), F.array("root", "block").alias("path"))
    return stage0.union(stage1), links, roots


def listed(pieces: DataFrame) -> DataFrame:
    """(stage, path, members): pieces as the lists that decomposition files have; a line is a whole piece, so memory follows the largest."""
    return pieces.groupBy("stage", "path").agg(F.sort_array(F.collect_list("node")).alias("members"))
