"""Registered queries of exact solutions, of the path model and of scaffolds end to end, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose as D
from ..operators import digraph as R
from ..operators import graph as G
from ..operators import paths as H
from ..operators import solve as P
from . import more_oracles
from .fixtures import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Named subqueries, besides the views and those of the other modules.
PARTS: dict[str, str] = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _sized(solution: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Solved bundles with their component's ``root`` and ``nodes`` and ``bundles`` in it."""
    found = G.connected_components(solution.select("u", "v"), "solution-components")
    sizes = found.groupBy("root").agg(F.count("*").alias("nodes"))
    named = solution.join(found.withColumnRenamed("node", "u"), "u")
    return named.join(sizes, "root").join(named.groupBy("root").agg(F.count("*").alias("bundles")), "root")


@_query
def dense_objective(spark, sf_dir):
    """Weight of the solved dense regions in components of at most 14 bits, and how many bundles, of those and of all, are solved exactly."""
    bundles = view(spark, sf_dir, "dense")
    solved = P.materialize(P.solve(bundles), "solution")
    tris = P.triangles(bundles)
    sides = P.triangle_edges(tris).withColumn("side", F.lit(1))
    named = _sized(solved).join(sides, ["u", "v"], "left")
    bits = named.groupBy("root").agg((F.first("nodes") - 1 + F.count("side")).alias("bits"))
    small = named.join(bits, "root").withColumn("small", F.col("bits") <= 14)
    return small.agg(
        F.sum(F.when(F.col("small"), F.col("weight"))).alias("objective"), F.count_if("small").alias("n_small"), F.count("*").alias("n_bundles"),
        F.count_if(F.col("status") == "exact").alias("n_exact"),
    )


PARTS |= {
    "both_d": "SELECT ctg_a_idx AS u, ctg_b_idx AS v FROM dense UNION SELECT ctg_b_idx, ctg_a_idx FROM dense",
    "reached_d": "SELECT DISTINCT u AS node, u AS r FROM both_d UNION SELECT b.v, reached_d.r FROM reached_d JOIN both_d b ON b.u = reached_d.node",
    "comp_d": "SELECT node, min(r) AS root FROM reached_d GROUP BY node",
    "pair_d": "SELECT DISTINCT ctg_a_idx AS u, ctg_b_idx AS v FROM dense",
    "wedge_d": "SELECT x.u AS a, x.v AS b, y.v AS c FROM pair_d x JOIN pair_d y ON x.v = y.u",
    "tri_d": "SELECT a, b, c FROM wedge_d JOIN pair_d z ON z.u = a AND z.v = c",
    "tri_side_d": "SELECT DISTINCT u, v FROM (SELECT a AS u, b AS v FROM tri_d UNION ALL SELECT b, c FROM tri_d UNION ALL SELECT a, c FROM tri_d)",
    "place_d": "SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY node) - 2 AS bit_at, count(*) OVER (PARTITION BY root) AS size FROM comp_d",
    "side_d": """SELECT pu.root, ctg_a_idx AS u, ctg_b_idx AS v, pu.bit_at AS iu, pv.bit_at AS iv, pu.size AS size, t.u IS NOT NULL AS tri, WT_A, WT_B, WT_C, WT_D, count(t.u) OVER (PARTITION BY pu.root) AS n_tri, count(t.u) OVER (PARTITION BY pu.root ORDER BY ctg_a_idx, ctg_b_idx) - 1 AS it
        FROM dense JOIN place_d pu ON pu.node = ctg_a_idx JOIN place_d pv ON pv.node = ctg_b_idx LEFT JOIN tri_side_d t ON t.u = ctg_a_idx AND t.v = ctg_b_idx""",
    "worth_d": "SELECT root, mask, u, v, tri, way, CASE WHEN tri THEN [WT_A, WT_B, WT_C, WT_D][CAST(CASE WHEN way = 1 THEN 2 * su + sv ELSE 3 - 2 * su - sv END + 1 AS INTEGER)] WHEN su = sv THEN greatest(WT_A, WT_D) ELSE greatest(WT_B, WT_C) END AS w FROM (SELECT *, CASE WHEN iu < 0 THEN 0 ELSE (mask >> CAST(iu AS INTEGER)) % 2 END AS su, CASE WHEN iv < 0 THEN 0 ELSE (mask >> CAST(iv AS INTEGER)) % 2 END AS sv, CASE WHEN tri AND (mask >> CAST(size - 1 + it AS INTEGER)) % 2 = 1 THEN -1 ELSE 1 END AS way FROM (SELECT *, unnest(range(0, CAST(1 AS BIGINT) << CAST(size - 1 + n_tri AS INTEGER))) AS mask FROM side_d WHERE size - 1 + n_tri <= 14))",
    "circle_d": "SELECT DISTINCT x.root, x.mask FROM (SELECT * FROM worth_d WHERE tri) x JOIN (SELECT * FROM worth_d WHERE tri) y ON y.root = x.root AND y.mask = x.mask AND y.u = x.v JOIN (SELECT * FROM worth_d WHERE tri) z ON z.root = x.root AND z.mask = x.mask AND z.u = x.u AND z.v = y.v WHERE x.way = y.way AND z.way = -x.way",
    "value_d": "SELECT root, mask, sum(w) AS value FROM worth_d GROUP BY root, mask",
    "best_d": "SELECT v.root, max(value) AS value FROM value_d v LEFT JOIN circle_d c ON c.root = v.root AND c.mask = v.mask WHERE c.root IS NULL GROUP BY v.root",
}
SQL["dense_objective"] = """SELECT (SELECT sum(value) FROM best_d) AS objective, (SELECT count(*) FROM side_d WHERE size - 1 + n_tri <= 14) AS n_small,
    (SELECT count(*) FROM dense) AS n_bundles, (SELECT count(*) FROM dense) AS n_exact"""


@_query
def path_objective(spark, sf_dir):
    """Weight of the paths through the regions in components of at most 12 bits, one for each contig but the first and two for each bundle; and of all how many are solved exactly."""
    solved = P.materialize(P.solve_paths(view(spark, sf_dir, "regions")), "solution")
    small = _sized(solved).withColumn("small", F.col("nodes") - 1 + 2 * F.col("bundles") <= 12)
    return small.agg(F.sum(F.when(F.col("small"), F.col("weight"))).alias("objective"), F.count_if("small").alias("n_small"), F.count_if(F.col("status") == "exact").alias("n_exact"))


PARTS |= {
    "road_r": """SELECT a.root, ctg_a_idx AS u, ctg_b_idx AS v, a.i AS iu, b.i AS iv, a.size AS size, WT_A, WT_B, WT_C, WT_D, row_number() OVER (PARTITION BY a.root ORDER BY ctg_a_idx, ctg_b_idx) - 1 AS ie, count(*) OVER (PARTITION BY a.root) AS m
        FROM regions JOIN spot_r a ON a.node = ctg_a_idx JOIN spot_r b ON b.node = ctg_b_idx""",
    "spot_r": "SELECT c.root AS root, node, size, row_number() OVER (PARTITION BY c.root ORDER BY node) - 2 AS i FROM comp_r c JOIN size_r s ON s.root = c.root",
    "drive_r": """SELECT root, mask, u, v, used, back, CASE WHEN used = 0 THEN 0 ELSE [WT_A, WT_B, WT_C, WT_D][CAST(CASE WHEN back = 0 THEN 2 * su + sv ELSE 3 - 2 * su - sv END + 1 AS INTEGER)] END AS w
        FROM (SELECT *, CASE WHEN iu < 0 THEN 0 ELSE (mask >> CAST(iu AS INTEGER)) % 2 END AS su, CASE WHEN iv < 0 THEN 0 ELSE (mask >> CAST(iv AS INTEGER)) % 2 END AS sv, (mask >> CAST(size - 1 + 2 * ie AS INTEGER)) % 2 AS used, (mask >> CAST(size + 2 * ie AS INTEGER)) % 2 AS back
              FROM (SELECT *, unnest(range(0, CAST(1 AS BIGINT) << CAST(size - 1 + 2 * m AS INTEGER))) AS mask FROM road_r WHERE size - 1 + 2 * m <= 12))""",
    "jam_r": """SELECT root, mask FROM drive_r WHERE used = 0 AND back = 1
        UNION SELECT root, mask FROM (SELECT root, mask, CASE WHEN back = 0 THEN v ELSE u END AS into_, CASE WHEN back = 0 THEN u ELSE v END AS out_ FROM drive_r WHERE used = 1) GROUP BY root, mask HAVING count(*) > count(DISTINCT into_) OR count(*) > count(DISTINCT out_)
        UNION SELECT x.root, x.mask FROM drive_r x JOIN drive_r y ON y.root = x.root AND y.mask = x.mask AND y.u = x.v JOIN drive_r z ON z.root = x.root AND z.mask = x.mask AND z.u = x.u AND z.v = y.v WHERE x.used + y.used + z.used = 3 AND x.back = y.back AND z.back <> x.back""",
    "trip_r": "SELECT t.root, max(value) AS value FROM (SELECT root, mask, sum(w) AS value FROM drive_r GROUP BY root, mask) t LEFT JOIN jam_r j ON j.root = t.root AND j.mask = t.mask WHERE j.root IS NULL GROUP BY t.root",
}
SQL["path_objective"] = "SELECT (SELECT sum(value) FROM trip_r) AS objective, (SELECT count(*) FROM road_r WHERE size - 1 + 2 * m <= 12) AS n_small, (SELECT count(*) FROM regions) AS n_exact"


@_query
def path_model_checks(spark, sf_dir):
    """Contigs with more than one used bundle in or out, and constraints broken by used bundles: none, of as many bundles as there are."""
    bundles = view(spark, sf_dir, "regions")
    solved = P.materialize(P.solve_paths(bundles), "solution")
    used = solved.where("state is not null")
    wrong = P.violations(used, P.triangles(bundles)).agg(F.sum("n").alias("n")).select(F.lit("rules").alias("rule"), "n")
    turns = G.degrees(P.directed_ways(used)).where("in_degree > 1 or out_degree > 1").agg(F.count("*").alias("n")).select(F.lit("degrees").alias("rule"), "n")
    return wrong.union(turns).union(solved.agg(F.count("*").alias("n")).select(F.lit("bundles").alias("rule"), "n"))


SQL["path_model_checks"] = "SELECT 'rules' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'degrees', CAST(0 AS BIGINT) UNION ALL SELECT 'bundles', count(*) FROM regions"


def _ways(spark, sf_dir):
    """Directed edges of the dense regions, where contigs have several in and out; weights by the ends."""
    return H.directed_pairs(view(spark, sf_dir, "dense_solved")).withColumn("weight", (F.col("src") * 7 + F.col("dst") * 13) % 31)


@_query
def scc(spark, sf_dir):
    """Strongly connected components of two or more contigs."""
    return R.strong_components(_ways(spark, sf_dir))


@_query
def break_scc(spark, sf_dir):
    """Edges that leave no contig on a cycle."""
    return R.break_components(_ways(spark, sf_dir)).select("src", "dst")


@_query
def break_scc_lightest(spark, sf_dir):
    """Edges on cycles that go if the lightest one on a cycle goes, again and again, and how many contigs are on a cycle then: none."""
    edges = P.materialize(_ways(spark, sf_dir), "ways")
    gone = P.materialize(R.lightest_of_cycles(edges), "gone").select("src", "dst")
    left = R.strong_components(edges.join(gone, ["src", "dst"], "left_anti"))
    none = F.lit(None).cast("long")
    return gone.withColumn("n_left", none).union(left.agg(F.count("*").alias("n")).select(none, none, "n"))


PARTS |= {
    "way_d": "SELECT src, dst, (src * 7 + dst * 13) % 31 AS weight FROM (SELECT CASE WHEN X = 1 THEN u ELSE v END AS src, CASE WHEN X = 1 THEN v ELSE u END AS dst FROM dense_solved WHERE X + Y = 1)",
    "flow_d": "SELECT src, dst FROM way_d UNION SELECT f.src, w.dst FROM flow_d f JOIN way_d w ON w.src = f.dst",
    "strong_d": "SELECT src AS node, max(dst) AS component FROM flow_d f WHERE EXISTS (SELECT 1 FROM flow_d b WHERE b.src = f.dst AND b.dst = f.src) GROUP BY src",
    "on_d": "SELECT w.*, a.component AS component FROM way_d w JOIN strong_d a ON a.node = src JOIN strong_d b ON b.node = dst AND b.component = a.component",
    "rank_d": "SELECT *, row_number() OVER (ORDER BY weight DESC, src DESC, dst DESC) AS t FROM on_d",
    "back_d": "SELECT src, dst, t, dst AS at FROM rank_d UNION SELECT b.src, b.dst, b.t, r.dst FROM back_d b JOIN rank_d r ON r.src = b.at AND r.t < b.t",
}
SQL |= {
    "scc": "SELECT node, component FROM strong_d",
    "break_scc": "SELECT src, dst FROM way_d WHERE src NOT IN (SELECT node FROM strong_d)",
    # An edge goes if heavier ones lead from its end back to its start.
    "break_scc_lightest": "SELECT DISTINCT e.src AS src, e.dst AS dst, CAST(NULL AS BIGINT) AS n_left FROM back_d e WHERE e.at = e.src UNION ALL SELECT NULL, NULL, CAST(0 AS BIGINT)",
}

#: The parts over regions, over bundles3: for queries of the small graph.
_SMALL = ("both_r", "reached_r", "comp_r", "without_r", "label_r", "sign_r", "block_r", "member_r", "cut_r")
PARTS |= {re.sub("_r$", "_t", n): re.sub(r"\bregions\b", "bundles3", re.sub(r"_r\b", "_t", more_oracles.PARTS[n])) for n in _SMALL}
_RULES = "SELECT rule, CAST(0 AS BIGINT) AS n FROM (VALUES ('xor'), ('one direction'), ('direction'), ('no circle of three')) t(rule)"
SQL |= {
    "block_members": "SELECT block, node FROM member_t",
    "block_cut_tree": "SELECT block, node AS cut FROM member_t WHERE node IN (SELECT node FROM cut_t)",
    "shared_members": "SELECT a.block AS i, b.block AS j, string_agg(CAST(a.node AS VARCHAR), ',' ORDER BY a.node) AS shared FROM member_t a JOIN member_t b ON a.node = b.node AND a.block < b.block GROUP BY 1, 2",
    "bucket_small": "SELECT size, CAST(size >= 5 AS INTEGER) AS alone, 1 AS fits, count(*) AS n FROM (SELECT root, count(*) AS size FROM comp GROUP BY root) GROUP BY size",
    "solution": """SELECT s.root AS root, max(value) AS weight, any_value(n) AS n_bundles FROM (SELECT root, mask, CAST(sum(CASE WHEN (mask >> iu) % 2 = (mask >> iv) % 2 THEN greatest(WT_A, WT_D) ELSE greatest(WT_B, WT_C) END) AS DOUBLE) AS value FROM masks3 GROUP BY root, mask) s
        JOIN (SELECT root, count(*) AS n FROM bundles3 JOIN comp ON node = ctg_a_idx GROUP BY root) c ON c.root = s.root GROUP BY s.root""",
    "constraint_checks": _RULES + " UNION ALL SELECT 'bundles', count(*) FROM bundles3 UNION ALL SELECT 'links', CAST(sum(WT_A + WT_B + WT_C + WT_D) AS BIGINT) FROM bundles3",
    "matching": "SELECT CAST(n AS BIGINT) AS n_edges, CAST(w AS BIGINT) AS weight, count(*) AS n_groups FROM matched_r GROUP BY 1, 2",
    "paths": """SELECT comp_name AS node, first_value(comp_name) OVER (PARTITION BY scaf_name ORDER BY pos) AS path, pos - 1 AS pos FROM path_test
        WHERE scaf_name IN (SELECT scaf_name FROM path_test GROUP BY scaf_name HAVING count(*) > 1)""",
    "agp_out": """SELECT 'contigs' AS measure, count(*) AS n FROM linked_r UNION ALL SELECT 'bases', CAST(sum(200 + node % 51) AS BIGINT) FROM linked_r
        UNION ALL SELECT measure, CAST(0 AS BIGINT) FROM (VALUES ('contigs twice'), ('joins missing'), ('too short'), ('rules')) t(measure)""",
    "dense_gap": "SELECT 'exact' AS status, count(*) AS n_bundles, sum(greatest(WT_A, WT_B, WT_C, WT_D)) AS most, CAST(0 AS BIGINT) AS n_off FROM dense",
}
PARTS["linked_r"] = "SELECT DISTINCT node FROM (SELECT ctg_a_idx AS node FROM region_links UNION ALL SELECT ctg_b_idx FROM region_links)"


@_query
def block_cut_orders(spark, sf_dir):
    """Blocks and cuts of each component of the regions as a tree from its smallest block on: kind, name, and ranks in preorder and postorder."""
    edges = view(spark, sf_dir, "regions").select(F.col("ctg_a_idx").alias("u"), F.col("ctg_b_idx").alias("v"))
    return G.block_cut_orders(D.named_blocks(G.blocks(edges)))


PARTS |= {
    "twig_r": "SELECT concat('B ', block) AS a, concat('C ', CAST(node AS VARCHAR)) AS b FROM member_r WHERE node IN (SELECT node FROM cut_r)",
    "branch_r": "SELECT a AS x, b AS y FROM twig_r UNION ALL SELECT b, a FROM twig_r",
    "top_r": "SELECT min(concat('B ', block)) AS top FROM block_r GROUP BY root",
    "climb_r": "SELECT top AS node, CAST(NULL AS VARCHAR) AS up, top, [top] AS path FROM top_r UNION ALL SELECT y, x, top, list_append(path, y) FROM climb_r JOIN branch_r ON x = node WHERE up IS NULL OR y <> up",
}
#: Every path ends in the greatest text, so that by these texts a node comes after all below it.
SQL["block_cut_orders"] = """SELECT node[1:1] AS kind, node[3:] AS name, top[3:] AS root, row_number() OVER (PARTITION BY top ORDER BY path) - 1 AS pre, row_number() OVER (PARTITION BY top ORDER BY list_append(path, '~')) - 1 AS post FROM climb_r"""


@_query
def separation_pairs(spark, sf_dir):
    """Pairs of contigs without which a block of the regions falls apart."""
    edges = view(spark, sf_dir, "regions").select(F.col("ctg_a_idx").alias("u"), F.col("ctg_b_idx").alias("v"))
    return G.separation_pairs(D.named_blocks(G.blocks(edges)))


PARTS |= {
    "gone_r": "SELECT x.block AS block, x.node AS a, y.node AS b FROM member_r x JOIN member_r y ON x.block = y.block AND x.node < y.node WHERE x.block IN (SELECT block FROM member_r GROUP BY block HAVING count(*) > 3)",
    "side2_r": "SELECT block, u, v FROM block_r UNION ALL SELECT block, v, u FROM block_r",
    "stay_r": "SELECT g.block AS block, a, b, min(node) AS node FROM gone_r g JOIN member_r m ON m.block = g.block AND node <> a AND node <> b GROUP BY 1, 2, 3",
    "seen_r": "SELECT block, a, b, node FROM stay_r UNION SELECT s.block, s.a, s.b, e.v FROM seen_r s JOIN side2_r e ON e.block = s.block AND e.u = s.node AND e.v <> s.a AND e.v <> s.b",
}
SQL["separation_pairs"] = """SELECT s.block AS block, a, b FROM (SELECT block, a, b, count(*) AS n FROM seen_r GROUP BY 1, 2, 3) s JOIN (SELECT block, count(*) AS size FROM member_r GROUP BY block) m ON m.block = s.block WHERE n < size - 2"""

SQL |= {
    "partial_bundles": "SELECT u, v, state, CASE WHEN u % 3 = 0 THEN Y ELSE X END AS X, CASE WHEN u % 3 = 0 THEN X ELSE Y END AS Y FROM solved WHERE u % 3 = 0 OR v % 2 = 0",
    "flip_bundles": """SELECT u, v, state, CASE WHEN part IS NULL THEN X WHEN (u + v) % 5 = 0 THEN 0 WHEN turned THEN 1 - X ELSE X END AS X, CASE WHEN part IS NULL THEN Y WHEN (u + v) % 5 = 0 THEN 0 WHEN turned THEN 1 - Y ELSE Y END AS Y
        FROM solved LEFT JOIN part_turn ON part = floor(u / 100) AND part = floor(v / 100) AND u % 100 < 40 AND v % 100 < 40""",
}

#: Every set of edges of a component with one edge into a contig at most, less those that close a ring.
PARTS |= {
    "arc_c": "SELECT root, src, dst, weight, row_number() OVER (PARTITION BY root ORDER BY src, dst) - 1 AS bit_at, count(*) OVER (PARTITION BY root) AS m FROM arc_r JOIN comp_r ON node = src",
    "pick_c": "SELECT root, mask, src, dst, weight FROM (SELECT *, unnest(range(1, CAST(1 AS BIGINT) << CAST(m AS INTEGER))) AS mask FROM arc_c) WHERE (mask >> CAST(bit_at AS INTEGER)) % 2 = 1",
    "tree_c": "SELECT root, mask, sum(weight) AS w FROM pick_c GROUP BY root, mask HAVING count(*) = count(DISTINCT dst)",
    "ring_c": "SELECT p.root AS root, p.mask AS mask, p.dst AS start, p.src AS at FROM pick_c p JOIN tree_c t ON t.root = p.root AND t.mask = p.mask UNION SELECT r.root, r.mask, r.start, p.src FROM ring_c r JOIN pick_c p ON p.root = r.root AND p.mask = r.mask AND p.dst = r.at WHERE r.at <> r.start",
}
SQL["region_branching"] = "SELECT root, CAST(max(w) AS BIGINT) AS weight FROM tree_c t WHERE NOT EXISTS (SELECT 1 FROM ring_c r WHERE r.root = t.root AND r.mask = t.mask AND r.at = r.start) GROUP BY root"
