"""The queries of :mod:`queries` in SQL, where SQL can express them."""

from __future__ import annotations

import re

from . import exact_queries, more_oracles
from .fixtures import views

#: Named subqueries that the statements build on, besides the views.
PARTS = {
    "wide": "SELECT l.*, a.ctg_width AS width_a, b.ctg_width AS width_b FROM links l JOIN contigs a ON l.ctg_a_idx = a.node_idx JOIN contigs b ON l.ctg_b_idx = b.node_idx",
    "dist": """SELECT *, CASE WHEN d1 >= 0 AND d2 >= 0 THEN insert_size - d1 - d2 END AS implied_dist FROM (SELECT *,
        CASE WHEN (ctg_a_idx < ctg_b_idx AND implied_state IN (0, 1)) OR (ctg_a_idx >= ctg_b_idx AND implied_state IN (1, 3)) THEN width_a - read_a_right_pos ELSE read_a_left_pos END AS d1,
        CASE WHEN (ctg_a_idx < ctg_b_idx AND implied_state IN (1, 3)) OR (ctg_a_idx >= ctg_b_idx AND implied_state IN (0, 1)) THEN width_b - read_b_right_pos ELSE read_b_left_pos END AS d2 FROM wide)""",
    "gaps": """SELECT *, CAST(insert_size - CASE WHEN read_a_orien = 0 THEN width_a - read_a_right_pos ELSE read_a_left_pos END
        - CASE WHEN read_b_orien = 1 THEN width_b - read_b_right_pos ELSE read_b_left_pos END AS DOUBLE) AS gap FROM wide""",
    "pairs2": "SELECT DISTINCT ctg_a_idx AS lo, ctg_b_idx AS hi FROM bundles2",
    "tri": "SELECT x.lo AS a, x.hi AS b, y.hi AS c FROM pairs2 x JOIN pairs2 y ON x.hi = y.lo JOIN pairs2 z ON z.lo = x.lo AND z.hi = y.hi",
    "active": "SELECT node_idx FROM contigs WHERE node_idx % 10 < 5",
    "one_link": """SELECT lo, hi, s.implied_state AS implied_state, s.implied_dist AS implied_dist FROM (
        SELECT least(ctg_a_idx, ctg_b_idx) AS lo, greatest(ctg_a_idx, ctg_b_idx) AS hi, min({'o': order_key, 'a': ctg_a_idx, 'implied_state': implied_state, 'implied_dist': implied_dist, 'x': read_a_left_pos, 'y': read_b_left_pos}) AS s
        FROM dist GROUP BY 1, 2) WHERE (lo, hi) IN (SELECT lo, hi FROM pairs2)""",
    "turns": "SELECT a, b, c, 0 AS turn, c AS i, a AS j, b AS k FROM tri UNION ALL SELECT a, b, c, 1, a, b, c FROM tri UNION ALL SELECT a, b, c, 2, b, c, a FROM tri",
    "side_ij": "SELECT t.*, l.implied_state AS s_ij FROM turns t JOIN one_link l ON l.lo = least(t.i, t.j) AND l.hi = greatest(t.i, t.j)",
    "side_jk": "SELECT t.*, l.implied_state AS s_jk FROM side_ij t JOIN one_link l ON l.lo = least(t.j, t.k) AND l.hi = greatest(t.j, t.k)",
    "sided": "SELECT t.*, l.implied_state AS s_ik, l.implied_dist AS d_ik, w.ctg_width FROM side_jk t JOIN one_link l ON l.lo = least(t.i, t.k) AND l.hi = greatest(t.i, t.k) JOIN contigs w ON w.node_idx = t.j",
    "adj_ref": "SELECT DISTINCT least(p, comp_name) AS lo, greatest(p, comp_name) AS hi FROM (SELECT comp_name, lag(comp_name) OVER (PARTITION BY scaf_name ORDER BY pos) AS p FROM path_ref) WHERE p IS NOT NULL",
    "adj_test": "SELECT DISTINCT least(p, comp_name) AS lo, greatest(p, comp_name) AS hi FROM (SELECT comp_name, lag(comp_name) OVER (PARTITION BY scaf_name ORDER BY pos) AS p FROM path_test) WHERE p IS NOT NULL",
    "counts": """SELECT a AS A, s - a AS B, t - a AS C, n * (n - 1) - t - (s - a) AS D FROM (SELECT
        (SELECT count(*) FROM adj_ref JOIN adj_test USING (lo, hi)) AS a, (SELECT count(*) FROM adj_test) AS s, (SELECT count(*) FROM adj_ref) AS t, (SELECT count(*) FROM path_ref) AS n)""",
    "rates": """SELECT A / CAST(A + C AS DOUBLE) AS sensitivity, A / CAST(A + B AS DOUBLE) AS ppv,
        (CAST(A AS DOUBLE) * D - CAST(B AS DOUBLE) * C) / sqrt(CAST(A + B AS DOUBLE) * (A + C) * (D + B) * (D + C)) AS mcc FROM counts""",
    "deviation": """SELECT avg(abs(r - t) / CAST(r AS DOUBLE)) AS gap_dev FROM (SELECT least(p, comp_name) AS lo, greatest(p, comp_name) AS hi,
          CASE WHEN g - 1 = 0 THEN 1 ELSE g - 1 END AS r FROM (SELECT *, lag(comp_name) OVER (PARTITION BY scaf_name ORDER BY pos) AS p, CASE WHEN gap < 0 THEN 7 ELSE gap END AS g FROM path_ref) WHERE p IS NOT NULL)
        JOIN (SELECT least(p, comp_name) AS lo, greatest(p, comp_name) AS hi, g - 1 AS t FROM (SELECT *, lag(comp_name) OVER (PARTITION BY scaf_name ORDER BY pos) AS p, CASE WHEN gap < 0 THEN 7 ELSE gap END AS g FROM path_test) WHERE p IS NOT NULL) USING (lo, hi)""",
    "coords_ref": "SELECT *, sum(CASE WHEN pos = 1 THEN size ELSE g + size + 2 END) OVER (PARTITION BY scaf_name ORDER BY pos) AS stop FROM (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN gap < 0 THEN 7 ELSE gap END AS g FROM path_ref)",
    "coords_test": "SELECT *, sum(CASE WHEN pos = 1 THEN size ELSE g + size + 2 END) OVER (PARTITION BY scaf_name ORDER BY pos) AS stop FROM (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN gap < 0 THEN 7 ELSE gap END AS g FROM path_test)",
    "spans_test": "SELECT *, CASE WHEN pos = 1 THEN size - 1 ELSE size END AS span, lag(comp_name) OVER (PARTITION BY scaf_name ORDER BY pos) AS p FROM coords_test",
    "pieces": """SELECT *, CAST(sum(bad) OVER (PARTITION BY scaf_name ORDER BY pos) AS BIGINT) AS piece FROM (SELECT s.*, CASE WHEN p IS NOT NULL AND r.lo IS NULL THEN 1 ELSE 0 END AS bad
        FROM spans_test s LEFT JOIN adj_ref r ON r.lo = least(p, comp_name) AND r.hi = greatest(p, comp_name))""",
    "sizes": "SELECT sum(span) - 1 AS size FROM spans_test GROUP BY scaf_name",
    "piece_sizes": "SELECT sum(span) - 1 AS size FROM pieces GROUP BY scaf_name, piece",
    "ranked": "SELECT size, coalesce(sum(size) OVER (ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size) OVER () AS t FROM sizes",
    "piece_ranked": "SELECT size, coalesce(sum(size) OVER (ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size) OVER () AS t FROM piece_sizes",
    "n50s": "SELECT CAST(max(CASE WHEN t - b <= t // 2 THEN size END) AS BIGINT) AS n50_compat, CAST(max(CASE WHEN 2 * (b + size) >= t THEN size END) AS BIGINT) AS n50 FROM ranked",
    "tp50s": "SELECT CAST(max(CASE WHEN t - b <= t // 2 THEN size END) AS BIGINT) AS tp50 FROM piece_ranked",
    "both3": "SELECT ctg_a_idx AS u, ctg_b_idx AS v FROM bundles3 UNION SELECT ctg_b_idx, ctg_a_idx FROM bundles3",
    "reached": "SELECT node_idx AS node, node_idx AS r FROM contigs UNION SELECT b.v, reached.r FROM reached JOIN both3 b ON b.u = reached.node",
    "comp": "SELECT node, min(r) AS root FROM reached GROUP BY node",
    "weights2": "SELECT ctg_a_idx AS src, ctg_b_idx AS dst, WT_A + WT_B + WT_C + WT_D AS weight FROM bundles2",
    "ends2": "SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT ctg_a_idx AS node, 0 AS i, 1 AS o FROM bundles2 UNION ALL SELECT ctg_b_idx, 1, 0 FROM bundles2) GROUP BY node",
    "masks": """SELECT node_idx, start, start + 30 + node_idx % 7 AS "end" FROM (SELECT node_idx, unnest(range(0, ctg_width + 1, 60)) AS start FROM contigs UNION ALL SELECT node_idx, unnest(range(0, ctg_width + 1, 75)) FROM contigs)""",
    "masked": "SELECT DISTINCT node_idx, unnest(range(start, \"end\")) AS pt FROM masks",
    "reads": """SELECT DISTINCT concat_ws('_', ctg_a_idx, ctg_b_idx, order_key, read_a_left_pos, read_b_left_pos) AS link_id, ctg_a_idx, ctg_b_idx, read_a_left_pos, read_a_right_pos, read_b_left_pos, read_b_right_pos FROM links""",
    "far": "SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS d WHERE EXISTS (SELECT 1 FROM contigs) UNION SELECT w.dst, far.d + w.weight FROM far JOIN weights2 w ON w.src = far.node",
    "without": "SELECT a.u AS x, b.u AS n, b.u AS m FROM (SELECT DISTINCT u FROM both3) a JOIN (SELECT DISTINCT u FROM both3) b ON a.u <> b.u WHERE b.u IN (SELECT node FROM comp WHERE root = (SELECT root FROM comp WHERE node = a.u)) UNION SELECT w.x, e.v, w.m FROM without w JOIN both3 e ON e.u = w.n AND e.v <> w.x",
    "numbered3": "SELECT node, root, row_number() OVER (PARTITION BY root ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY root) AS size FROM comp",
    "masks3": "SELECT u.root AS root, u.i AS iu, v.i AS iv, unnest(range(0, CAST(1 AS BIGINT) << (u.size - 1))) AS mask, b.* FROM bundles3 b JOIN numbered3 u ON u.node = ctg_a_idx JOIN numbered3 v ON v.node = ctg_b_idx",
}

SQL = {
    "pair_class": "SELECT least(ctg_a_idx, ctg_b_idx) AS lo, greatest(ctg_a_idx, ctg_b_idx) AS hi, implied_state AS class, count(*) AS n FROM links GROUP BY 1, 2, 3",
    "implied_dist": "SELECT ctg_a_idx, ctg_b_idx, order_key, implied_state, d1, d2, implied_dist FROM dist",
    "link_gap": """SELECT ctg_a_idx, ctg_b_idx, order_key, gap, CAST(insert_size - CASE WHEN ctg_a_idx < ctg_b_idx AND read_a_orien = 0 AND read_b_orien = 1 THEN width_a
        WHEN read_a_orien = 0 THEN CASE WHEN ctg_a_idx < ctg_b_idx THEN width_a ELSE width_b END - read_a_right_pos ELSE read_a_left_pos END
        - CASE WHEN read_b_orien = 1 THEN CASE WHEN ctg_a_idx < ctg_b_idx THEN width_b ELSE width_a END - read_b_right_pos ELSE read_b_left_pos END AS DOUBLE) AS gap_compat FROM gaps""",
    "bundle_links": "SELECT * FROM bundles2",
    "gap_avg": "SELECT lo, hi, avg(gap) AS gap FROM pairs2 LEFT JOIN (SELECT * FROM gaps WHERE invalid <> 1) ON least(ctg_a_idx, ctg_b_idx) = lo AND greatest(ctg_a_idx, ctg_b_idx) = hi GROUP BY 1, 2",
    "gap_avg_fallback": "SELECT lo, hi, coalesce(avg(gap), CAST(10 * lo + hi AS DOUBLE)) AS gap FROM pairs2 LEFT JOIN (SELECT * FROM gaps WHERE invalid <> 1 AND order_key % 2 = 1) ON least(ctg_a_idx, ctg_b_idx) = lo AND greatest(ctg_a_idx, ctg_b_idx) = hi GROUP BY 1, 2",
    "links_per_pair": "SELECT least(ctg_a_idx, ctg_b_idx) AS lo, greatest(ctg_a_idx, ctg_b_idx) AS hi, count(*) AS n_links FROM links GROUP BY 1, 2",
    "tp_fp_hist": """SELECT n_links, count(CASE WHEN tp THEN 1 END) AS tp, count(CASE WHEN NOT tp THEN 1 END) AS fp FROM (SELECT unnest(range(0, (SELECT max(c) FROM (SELECT count(*) AS c FROM links GROUP BY least(ctg_a_idx, ctg_b_idx), greatest(ctg_a_idx, ctg_b_idx))) + 1)) AS n_links)
        LEFT JOIN (SELECT c, p.lo IS NOT NULL AS tp FROM (SELECT least(ctg_a_idx, ctg_b_idx) AS l, greatest(ctg_a_idx, ctg_b_idx) AS h, count(*) AS c FROM links GROUP BY 1, 2) LEFT JOIN pairs2 p ON p.lo = l AND p.hi = h) ON c = n_links GROUP BY n_links""",
    "cluster_filter": "SELECT * FROM bundles2 WHERE (ctg_a_idx, ctg_b_idx) IN (SELECT ctg_a_idx, ctg_b_idx FROM bundles3)",
    "induced_edges": "SELECT * FROM bundles2 WHERE ctg_a_idx IN (SELECT node_idx FROM active) AND ctg_b_idx IN (SELECT node_idx FROM active)",
    "incident_edges": "SELECT * FROM bundles2 WHERE ctg_a_idx IN (SELECT node_idx FROM active) OR ctg_b_idx IN (SELECT node_idx FROM active)",
    "induced_cut_edges": "SELECT * FROM bundles2 WHERE (ctg_a_idx % 10 < 5 OR ctg_a_idx % 7 = 0) AND (ctg_b_idx % 10 < 5 OR ctg_b_idx % 7 = 0) AND NOT (ctg_a_idx % 7 = 0 AND ctg_b_idx % 7 = 0)",
    "triangles": "SELECT a, b, c FROM tri",
    "triangles_ordered": "SELECT a AS p, b AS x, c AS y FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT b, a, c FROM tri UNION ALL SELECT b, c, a FROM tri UNION ALL SELECT c, a, b FROM tri UNION ALL SELECT c, b, a FROM tri",
    "transitive_small": """SELECT i, j, k FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY turn) AS n FROM sided
        WHERE ctg_width < 2145 AND d_ik + 750 > ctg_width AND (s_ij >= 2) = (s_jk >= 2) AND (s_jk >= 2) = (s_ik >= 2)) WHERE n = 1""",
    "mask_overlap": """SELECT link_id, round(1 - (SELECT count(*) FROM masked WHERE node_idx = ctg_a_idx AND pt >= read_a_left_pos AND pt < read_a_right_pos) / CAST(read_a_right_pos - read_a_left_pos AS DOUBLE), 6) AS a_overlap,
        round(1 - (SELECT count(*) FROM masked WHERE node_idx = ctg_b_idx AND pt >= read_b_left_pos AND pt < read_b_right_pos) / CAST(read_b_right_pos - read_b_left_pos AS DOUBLE), 6) AS b_overlap, CAST(1 AS DOUBLE) AS a_coverage, CAST(1 AS DOUBLE) AS b_coverage FROM reads""",
    "scaffold_coords": """SELECT scaf_name, CAST(CASE WHEN pos = 1 THEN 1 ELSE stop - size END AS BIGINT) AS scaf_start, CAST(stop AS BIGINT) AS scaf_stop, CAST(2 * pos - 1 AS BIGINT) AS scaf_idx, 'W' AS comp_type, comp_name,
          CAST(1 AS BIGINT) AS comp_start, size AS comp_stop, orien AS comp_orien, CAST(NULL AS BIGINT) AS comp_linkage FROM coords_ref
        UNION ALL SELECT scaf_name, CAST(stop - size - g - 1 AS BIGINT), CAST(stop - size - 1 AS BIGINT), CAST(2 * pos - 2 AS BIGINT), 'N', 'fragment', CAST(1 AS BIGINT), CAST(g AS BIGINT), NULL, CAST(0 AS BIGINT) FROM coords_ref WHERE pos > 1""",
    "agp_adjacency": "SELECT lo, hi FROM adj_ref",
    "agp_digraph": "SELECT p AS src, comp_name AS dst, CAST(g AS BIGINT) AS weight FROM spans_test WHERE p IS NOT NULL",
    "agp_gaps": "SELECT p AS comp_a, comp_name AS comp_b, CAST(g + 2 AS BIGINT) AS gap FROM spans_test WHERE p IS NOT NULL",
    "break_scaffolds": "SELECT scaf_name, CAST(2 * pos - 1 AS BIGINT) AS scaf_idx, comp_name, 'W' AS comp_type, piece FROM pieces UNION ALL SELECT scaf_name, CAST(2 * pos - 2 AS BIGINT), 'fragment', 'N', piece FROM pieces WHERE pos > 1 AND bad = 0",
    "confusion": "SELECT A, B, C, D FROM counts",
    "scores": "SELECT round(sensitivity, 9) AS sensitivity, round(ppv, 9) AS ppv, round(mcc, 9) AS mcc FROM rates",
    "gap_deviation": "SELECT round(gap_dev, 9) AS gap_dev FROM deviation",
    "n50": "SELECT n50_compat, n50 FROM n50s",
    "tp50": "SELECT tp50 FROM tp50s",
    "evaluate": """SELECT 'orders' AS name, 'shipdate' AS method, A, B, C, D, round(gap_dev, 9) AS gap_dev, CAST(-1 AS DOUBLE) AS runtime, round(sensitivity, 9) AS sensitivity, round(ppv, 9) AS ppv, round(mcc, 9) AS mcc, n50_compat AS n50, tp50
        FROM counts, rates, deviation, n50s, tp50s""",
    "components": "SELECT node, root FROM comp",
    "component_sizes": "SELECT size, count(*) AS n FROM (SELECT root, count(*) AS size FROM comp GROUP BY root) GROUP BY size",
    "degrees": "SELECT node, in_degree, out_degree FROM ends2",
    "linear_violations": "SELECT node, in_degree, out_degree FROM ends2 WHERE in_degree > 1 OR out_degree > 1",
    "break_nonlinear": "SELECT ctg_a_idx AS src, ctg_b_idx AS dst FROM bundles2 WHERE ctg_a_idx NOT IN (SELECT node FROM ends2 WHERE in_degree > 1 OR out_degree > 1) AND ctg_b_idx NOT IN (SELECT node FROM ends2 WHERE in_degree > 1 OR out_degree > 1)",
    "max_incoming": "SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS n FROM weights2) WHERE n = 1",
    "shortest_paths": """SELECT node, distance FROM (SELECT node, CAST(min(d) AS DOUBLE) AS distance FROM far GROUP BY node)""",
    "articulation": """SELECT x AS node FROM (SELECT x, count(DISTINCT least_end) AS parts FROM (SELECT x, n, min(m) AS least_end FROM without GROUP BY x, n) WHERE n IN (SELECT v FROM both3 WHERE u = x) GROUP BY x) WHERE parts > 1""",
    "solve_objective": """SELECT sum(best) AS objective, (SELECT count(*) FROM bundles3) AS n_bundles FROM (SELECT root, max(value) AS best FROM (SELECT root, mask, CAST(sum(CASE WHEN (mask >> iu) % 2 = (mask >> iv) % 2 THEN greatest(WT_A, WT_D) ELSE greatest(WT_B, WT_C) END) AS DOUBLE) AS value FROM masks3 GROUP BY root, mask) GROUP BY root)""",
    "constraint_checks": "SELECT rule, CAST(0 AS BIGINT) AS n FROM (VALUES ('xor'), ('one direction'), ('direction'), ('no circle of three')) t(rule)",
}


def oracle_sql() -> dict[str, str]:
    """Whole statements: each with the subqueries that it needs, in order."""
    known = views("part", "lineitem") | PARTS | more_oracles.PARTS | exact_queries.PARTS

    def needed(sql: str, found: dict[str, None], inside: tuple[str, ...] = ()) -> None:
        for name in re.findall(r"\w+", sql):
            if name in known and name not in found and name not in inside:
                needed(known[name], found, (*inside, name))
                found[name] = None

    out = {}
    for query, sql in (SQL | more_oracles.SQL | exact_queries.SQL).items():
        found: dict[str, None] = {}
        needed(sql, found)
        kind = {name: "" if re.search(rf"FROM {name}\b", known[name]) else "MATERIALIZED " for name in found}
        out[query] = "WITH RECURSIVE " + ", ".join(f"{name} AS {kind[name]}({known[name].strip()})" for name in found) + " " + sql if found else sql
    return out
