"""From bundles to scaffold rows: solve, match, break cycles, order, estimate gaps, place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import links as X
from ..tables import materialize
from . import graph as G
from .links import mean_gaps
from .paths import assign_orientations, match_maximum
from .scaffolds import scaffold_rows
from .solve import directed_edges, solve, solve_paths


def assemble(bundles: DataFrame, links: DataFrame, contigs: DataFrame, by_paths: bool = False) -> DataFrame:
    """Scaffold rows of all ``contigs``, each on one scaffold; one that joins nothing is a scaffold of its own.

    Bundles get orientations and directions (:func:`.solve.solve`), a matching
    leaves each contig one edge in and one out at most, and cycles of it go.  With
    ``by_paths`` the program itself leaves paths (:func:`.solve.solve_paths`).
    Scaffolds are named by their first contig, gaps are means over links.
    """
    solved = materialize(solve_paths(bundles) if by_paths else solve(bundles), "assembly-solved")
    edges = directed_edges(solved)
    edges = materialize(G.break_cycles(edges if by_paths else match_maximum(edges)), "assembly-edges")
    nodes = contigs.select(F.col("node_idx").alias("node"), "ctg_name", F.col("ctg_width").alias("size"))
    placed = nodes.join(G.order_paths(edges), "node", "left").withColumns({"path": F.coalesce("path", "node"), "pos": F.coalesce("pos", F.lit(0)) + 1})
    oriented = assign_orientations(contigs.select(F.col("node_idx").alias("node")), solved).withColumn("orien", F.coalesce("orien", F.lit(0)))
    into = edges.select(F.col("dst").alias("node"), X.smaller("src", "dst").alias("lo"), X.larger("src", "dst").alias("hi"))
    into = into.join(mean_gaps(links, contigs, bundles), ["lo", "hi"]).select("node", "gap")
    rows = placed.join(oriented, "node").join(into, "node", "left")
    return scaffold_rows(rows.select(F.concat(F.lit("scaf_"), F.col("path")).alias("scaf_name"), "pos", F.col("ctg_name").alias("comp_name"), "size", "gap", "orien"))
