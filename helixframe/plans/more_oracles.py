"""SQL of the format, solution and region queries."""

from __future__ import annotations

#: Named subqueries, besides the views and those of :mod:`oracles`.
PARTS = {
    "long_wide": "SELECT ctg_a_idx, ctg_b_idx, order_key, implied_state, read_a_left_pos, CASE WHEN order_key % 5 = 0 THEN read_a_right_pos + 150 ELSE read_a_right_pos END AS read_a_right_pos, read_b_left_pos, read_b_right_pos, width_a, width_b FROM wide",
    "long_dist": """SELECT *, CASE WHEN (ctg_a_idx < ctg_b_idx AND implied_state IN (0, 1)) OR (ctg_a_idx >= ctg_b_idx AND implied_state IN (1, 3)) THEN width_a - read_a_right_pos ELSE read_a_left_pos END AS d1,
        CASE WHEN (ctg_a_idx < ctg_b_idx AND implied_state IN (1, 3)) OR (ctg_a_idx >= ctg_b_idx AND implied_state IN (0, 1)) THEN width_b - read_b_right_pos ELSE read_b_left_pos END AS d2 FROM long_wide""",
    "bundle_gaps": "SELECT lo, hi, avg(gap) AS gap FROM pairs2 JOIN (SELECT * FROM gaps WHERE invalid <> 1) ON least(ctg_a_idx, ctg_b_idx) = lo AND greatest(ctg_a_idx, ctg_b_idx) = hi GROUP BY 1, 2",
    "pairs_out": "SELECT CASE WHEN X = 1 THEN u ELSE v END AS src, CASE WHEN X = 1 THEN v ELSE u END AS dst, u, v, state FROM solved WHERE X + Y = 1",
    "orient_of": "SELECT node, max(o) AS orien FROM (SELECT u AS node, orien_a AS o FROM solved UNION ALL SELECT v, orien_b FROM solved) GROUP BY node",
    "agp_rows": """SELECT scaf_name, CAST(CASE WHEN pos = 1 THEN 1 ELSE stop - size END AS BIGINT) AS scaf_start, CAST(stop AS BIGINT) AS scaf_stop, CAST(2 * pos - 1 AS BIGINT) AS scaf_idx, 'W' AS comp_type, comp_name,
          CAST(1 AS BIGINT) AS comp_start, size AS comp_stop, orien AS comp_orien, CAST(NULL AS BIGINT) AS comp_linkage FROM coords_ref
        UNION ALL SELECT scaf_name, CAST(stop - size - g - 1 AS BIGINT), CAST(stop - size - 1 AS BIGINT), CAST(2 * pos - 2 AS BIGINT), 'N', 'fragment', CAST(1 AS BIGINT), CAST(g - 1 AS BIGINT), NULL, CAST(0 AS BIGINT) FROM coords_ref WHERE pos > 1""",
    "agp_left": "SELECT *, lag(scaf_idx) OVER w AS before, lag(comp_type) OVER w AS kind FROM agp_rows WHERE scaf_idx % 7 <> 2 AND NOT (scaf_idx = 1 AND scaf_name LIKE '%3') WINDOW w AS (PARTITION BY scaf_name ORDER BY scaf_idx)",
    "small_reads": "SELECT DISTINCT ctg_a_idx, ctg_b_idx, read_a_left_pos, read_a_right_pos, read_b_left_pos, read_b_right_pos FROM links",
    # Graphs of regions, both ways round.
    "both_r": "SELECT ctg_a_idx AS u, ctg_b_idx AS v FROM regions UNION SELECT ctg_b_idx, ctg_a_idx FROM regions",
    "reached_r": "SELECT DISTINCT u AS node, u AS r FROM both_r UNION SELECT b.v, reached_r.r FROM reached_r JOIN both_r b ON b.u = reached_r.node",
    "comp_r": "SELECT node, min(r) AS root FROM reached_r GROUP BY node",
    "size_r": "SELECT root, count(*) AS size FROM comp_r GROUP BY root",
    "both_d": "SELECT ctg_a_idx AS u, ctg_b_idx AS v FROM dense UNION SELECT ctg_b_idx, ctg_a_idx FROM dense",
    "reached_d": "SELECT DISTINCT u AS node, u AS r FROM both_d UNION SELECT b.v, reached_d.r FROM reached_d JOIN both_d b ON b.u = reached_d.node",
    "comp_d": "SELECT node, min(r) AS root FROM reached_d GROUP BY node",
    # Without contig x, n still reaches m.
    "without_r": "SELECT x.node AS x, n.node AS n, n.node AS m FROM comp_r x JOIN comp_r n ON x.root = n.root AND x.node <> n.node UNION SELECT w.x, e.v, w.m FROM without_r w JOIN both_r e ON e.u = w.n AND e.v <> w.x",
    "label_r": "SELECT x, n, min(m) AS m FROM without_r GROUP BY x, n",
    # Two edges are in one block if no contig of the component parts them.
    "sign_r": "SELECT ctg_a_idx AS u, ctg_b_idx AS v, c.root AS root, string_agg(CAST(l.m AS VARCHAR), ',' ORDER BY x.node) AS sign FROM regions JOIN comp_r c ON c.node = ctg_a_idx JOIN comp_r x ON x.root = c.root JOIN label_r l ON l.x = x.node AND l.n = CASE WHEN x.node <> ctg_a_idx THEN ctg_a_idx ELSE ctg_b_idx END GROUP BY 1, 2, 3",
    "block_r": "SELECT u, v, root, concat(CAST(first_value(u) OVER w AS VARCHAR), '-', CAST(first_value(v) OVER w AS VARCHAR)) AS block FROM sign_r WINDOW w AS (PARTITION BY root, sign ORDER BY u, v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "member_r": "SELECT DISTINCT root, block, node FROM (SELECT root, block, u AS node FROM block_r UNION ALL SELECT root, block, v FROM block_r)",
    "cut_r": "SELECT node FROM member_r GROUP BY node HAVING count(*) > 1",
    "list_r": "SELECT root, block, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM member_r WHERE root IN (SELECT root FROM size_r WHERE size >= 5) GROUP BY root, block",
    # Every assignment of every block: a bit for each contig but the first, and one for each side of a triangle.
    "tri_r": "SELECT x.u AS a, x.v AS b, y.v AS c, x.block AS block FROM block_r x JOIN block_r y ON x.v = y.u JOIN block_r z ON z.u = x.u AND z.v = y.v",
    "tri_side_r": "SELECT DISTINCT u, v FROM (SELECT a AS u, b AS v FROM tri_r UNION ALL SELECT b, c FROM tri_r UNION ALL SELECT a, c FROM tri_r)",
    "place_r": "SELECT block, node, row_number() OVER (PARTITION BY block ORDER BY node) - 2 AS bit_at, count(*) OVER (PARTITION BY block) AS size FROM member_r",
    "side_r": """SELECT e.block, e.u, e.v, pu.bit_at AS iu, pv.bit_at AS iv, pu.size AS size, t.u IS NOT NULL AS tri, WT_A, WT_B, WT_C, WT_D, count(t.u) OVER (PARTITION BY e.block) AS n_tri, count(t.u) OVER (PARTITION BY e.block ORDER BY e.u, e.v) - 1 AS it
        FROM block_r e JOIN place_r pu ON pu.block = e.block AND pu.node = e.u JOIN place_r pv ON pv.block = e.block AND pv.node = e.v LEFT JOIN tri_side_r t ON t.u = e.u AND t.v = e.v JOIN regions ON ctg_a_idx = e.u AND ctg_b_idx = e.v""",
    "worth_r": "SELECT block, mask, u, v, tri, way, CASE WHEN tri THEN [WT_A, WT_B, WT_C, WT_D][CAST(CASE WHEN way = 1 THEN 2 * su + sv ELSE 3 - 2 * su - sv END + 1 AS INTEGER)] WHEN su = sv THEN greatest(WT_A, WT_D) ELSE greatest(WT_B, WT_C) END AS w FROM (SELECT *, CASE WHEN iu < 0 THEN 0 ELSE (mask >> CAST(iu AS INTEGER)) % 2 END AS su, CASE WHEN iv < 0 THEN 0 ELSE (mask >> CAST(iv AS INTEGER)) % 2 END AS sv, CASE WHEN tri AND (mask >> CAST(size - 1 + it AS INTEGER)) % 2 = 1 THEN -1 ELSE 1 END AS way FROM (SELECT side_r.*, mask FROM side_r JOIN (SELECT unnest(range(0, 65536)) AS mask) ON mask < CAST(1 AS BIGINT) << CAST(size - 1 + n_tri AS INTEGER)))",
    "circle_r": "SELECT DISTINCT x.block, x.mask FROM worth_r x JOIN worth_r y ON y.block = x.block AND y.mask = x.mask AND y.u = x.v JOIN worth_r z ON z.block = x.block AND z.mask = x.mask AND z.u = x.u AND z.v = y.v WHERE x.way = y.way AND z.way = -x.way",
    "value_r": "SELECT block, mask, sum(w) AS value FROM worth_r GROUP BY block, mask",
    "best_r": "SELECT v.block, max(value) AS value FROM value_r v LEFT JOIN circle_r c ON c.block = v.block AND c.mask = v.mask WHERE c.block IS NULL GROUP BY v.block",
    # Directed region edges that compete for a source or a target.
    "arc_r": "SELECT row_number() OVER (ORDER BY src, dst) AS i, * FROM (SELECT CASE WHEN X = 1 THEN u ELSE v END AS src, CASE WHEN X = 1 THEN v ELSE u END AS dst, CAST([WT_A, WT_B, WT_C, WT_D][CAST(state + 1 AS INTEGER)] AS BIGINT) AS weight FROM region_solved JOIN regions ON u = ctg_a_idx AND v = ctg_b_idx WHERE X + Y = 1) WHERE weight <> 0",
    "compete_r": "SELECT a.i AS i, b.i AS j FROM arc_r a JOIN arc_r b ON a.src = b.src UNION SELECT a.i, b.i FROM arc_r a JOIN arc_r b ON a.dst = b.dst",
    "rival_r": "SELECT i, j FROM compete_r UNION SELECT r.i, c.j FROM rival_r r JOIN compete_r c ON c.i = r.j",
    "group_r": "SELECT i, min(j) AS g FROM rival_r GROUP BY i",
    "placed_r": "SELECT a.*, g, row_number() OVER (PARTITION BY g ORDER BY a.i) - 1 AS bit_at, count(*) OVER (PARTITION BY g) AS m FROM arc_r a JOIN group_r USING (i)",
    "chosen_r": "SELECT g, mask, src, dst, weight FROM (SELECT *, unnest(range(1, CAST(1 AS BIGINT) << CAST(m AS INTEGER))) AS mask FROM placed_r) WHERE (mask >> CAST(bit_at AS INTEGER)) % 2 = 1",
    "valid_r": "SELECT g, mask, count(*) AS n, sum(weight) AS w FROM chosen_r GROUP BY g, mask HAVING count(*) = count(DISTINCT src) AND count(*) = count(DISTINCT dst)",
    "matched_r": "SELECT g, n, w FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, w DESC) AS k FROM valid_r) WHERE k = 1",
    # Trees of heaviest edges from smaller contigs.
    "weights_r": "SELECT ctg_a_idx AS src, ctg_b_idx AS dst, WT_A + WT_B + WT_C + WT_D AS weight FROM regions",
    "heavy_r": "SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS n FROM weights_r) WHERE n = 1",
    "walk_r": "SELECT DISTINCT src AS node, CAST(NULL AS BIGINT) AS parent, src AS root, [src] AS path FROM heavy_r WHERE src NOT IN (SELECT dst FROM heavy_r) UNION ALL SELECT h.dst, h.src, w.root, list_append(w.path, h.dst) FROM walk_r w JOIN heavy_r h ON h.src = w.node",
    "below_r": "SELECT a.node AS node, max(len(b.path)) AS deepest, count(*) AS size FROM walk_r a JOIN walk_r b ON a.root = b.root AND list_slice(b.path, 1, len(a.path)) = a.path GROUP BY a.node",
    "ring_base": "SELECT DISTINCT u - u % 7 AS base FROM both_r",
    "ring": "SELECT base, base + k AS src, base + (k + 1) % 7 AS dst, (base + k) * 31 % 11 AS weight FROM ring_base, (SELECT unnest(range(0, 7)) AS k)",
    "region_dirs": "SELECT CASE WHEN X = 1 THEN u ELSE v END AS src, CASE WHEN X = 1 THEN v ELSE u END AS dst, u, v FROM region_solved WHERE X + Y = 1",
    "region_ends": "SELECT node, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM (SELECT src AS node, 0 AS i, 1 AS o FROM region_dirs UNION ALL SELECT dst, 1, 0 FROM region_dirs) GROUP BY node",
    "orient_r": "SELECT node, max(o) AS orien FROM (SELECT u AS node, orien_a AS o FROM region_solved UNION ALL SELECT v, orien_b FROM region_solved) GROUP BY node",
    "set_of": "SELECT DISTINCT u - u % 64 + u % 64 % 2 AS s, u AS node FROM both_r",
    "set_edge": "SELECT e.u, e.v FROM both_r e JOIN set_of a ON a.node = e.u JOIN set_of b ON b.node = e.v AND b.s = a.s",
    "set_reach": "SELECT node, node AS r FROM set_of UNION SELECT e.v, set_reach.r FROM set_reach JOIN set_edge e ON e.u = set_reach.node",
    "set_part": "SELECT node, min(r) AS part FROM set_reach GROUP BY node",
    "partial_in": "SELECT node_idx AS node, 1 - node_idx % 2 AS orien FROM contigs WHERE node_idx % 3 = 0",
    "part_in": "SELECT node_idx // 100 AS part, node_idx AS node, CAST((node_idx % 4 // 2 + node_idx // 100 + CASE WHEN node_idx % 17 = 0 THEN 1 ELSE 0 END) % 2 AS BIGINT) AS orien FROM contigs WHERE node_idx % 100 < 40",
    "part_turn": "SELECT part, count(CASE WHEN o.orien <> p.orien THEN 1 END) > 0 AS turned, CASE WHEN count(CASE WHEN o.orien <> p.orien THEN 1 END) > 0 THEN count(CASE WHEN o.orien = p.orien THEN 1 END) ELSE 0 END AS conflicts FROM part_in p LEFT JOIN orient_of o USING (node) GROUP BY part",
    "merge_in": "SELECT u, v, state, X, Y, 0 AS k FROM solved WHERE u % 10 < 5 UNION ALL SELECT u, v, 3 - state, Y, X, 1 FROM solved WHERE v % 10 < 5",
}

SQL = {
    "contig_file": "SELECT * FROM contigs",
    "link_file": "SELECT ctg_a_idx, ctg_b_idx, read_a_left_pos, read_a_right_pos, read_b_left_pos, read_b_right_pos, read_a_orien, read_b_orien, insert_size, implied_state, implied_dist, std_dev, invalid, used FROM dist",
    "bundle_file": "SELECT * FROM bundles2",
    "weight_table": """SELECT ctg_a_idx AS a_idx, ctg_b_idx AS b_idx, CAST(1 AS DOUBLE) AS a_coverage, CAST(1 AS DOUBLE) AS b_coverage,
        round(1 - greatest(0, least(read_a_right_pos, 70 + ctg_a_idx % 10) - greatest(read_a_left_pos, 20)) / CAST(read_a_right_pos - read_a_left_pos AS DOUBLE), 6) AS a_overlap,
        round(1 - greatest(0, least(read_b_right_pos, 70 + ctg_b_idx % 10) - greatest(read_b_left_pos, 20)) / CAST(read_b_right_pos - read_b_left_pos AS DOUBLE), 6) AS b_overlap FROM small_reads""",
    "agp_sorted": "SELECT row_number() OVER (ORDER BY scaf_name, scaf_idx) - 1 AS line_no, scaf_name, scaf_idx FROM agp_rows",
    "agp_file": "SELECT * FROM agp_rows",
    "agp_checks": """SELECT rule, count(*) AS n FROM (SELECT 'first row' AS rule FROM agp_left WHERE before IS NULL AND (scaf_idx <> 1 OR comp_type <> 'W') UNION ALL SELECT 'index' FROM agp_left WHERE scaf_idx <> before + 1
        UNION ALL SELECT 'start and stop' FROM agp_left WHERE scaf_start >= scaf_stop UNION ALL SELECT 'missing gap' FROM agp_left WHERE kind = 'W' AND comp_type = 'W') GROUP BY rule""",
    "runtime_trailer": "SELECT count(*) / CAST(4 AS DOUBLE) AS runtime FROM contigs",
    "alignment_ids": "SELECT concat('q', l_orderkey, '_', l_linenumber) AS read_id, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS several FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_linenumber",
    "mask_file": "SELECT ctg_name, node_idx % 90 AS start, node_idx % 90 + ctg_width % 17 AS stop FROM contigs WHERE node_idx % 3 <> 0",
    "cluster_list": "SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT CAST(ctg_a_idx AS VARCHAR) AS a, CAST(ctg_b_idx AS VARCHAR) AS b FROM bundles3)",
    "cluster_lines": "SELECT concat_ws(chr(9), ctg_a_idx, ctg_b_idx, WT_A, WT_B, WT_C, WT_D) AS line FROM bundles2 WHERE (ctg_a_idx, ctg_b_idx) IN (SELECT ctg_a_idx, ctg_b_idx FROM bundles3)",
    "previous_orientations": "SELECT node AS node_idx, orien FROM orient_r",
    "previous_directions": "SELECT u AS idxa, v AS idxb, X AS patha, Y AS pathb FROM region_solved",
    "score_record": """SELECT 'orders' AS name, 'shipdate' AS method, A, B, C, D, round(gap_dev, 6) AS gap_dev, CAST(-1 AS DOUBLE) AS runtime, round(sensitivity, 6) AS sensitivity, round(ppv, 6) AS ppv, round(mcc, 6) AS mcc, n50_compat AS n50, tp50
        FROM counts, rates, deviation, n50s, tp50s""",
    "decomposition_file": "SELECT 0 AS stage, root, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM comp_r GROUP BY root UNION ALL SELECT 1, root, members FROM list_r",
    "decomposition_sets": "SELECT least(a.members, b.members) AS one, greatest(a.members, b.members) AS other, CAST(x.node AS VARCHAR) AS cut FROM member_r x JOIN member_r y ON x.node = y.node AND x.block < y.block JOIN list_r a ON a.block = x.block AND a.root = x.root JOIN list_r b ON b.block = y.block AND b.root = y.root",
    "decomposition_tree": "SELECT root, count(*) AS n_blocks, count(*) - 1 AS n_links, CAST(1 AS BIGINT) AS n_roots FROM list_r GROUP BY root",
    "overhanging_links": "SELECT ctg_a_idx, ctg_b_idx, order_key, d1, d2 FROM long_dist WHERE d1 < 0 OR d2 < 0",
    "mark_used": "SELECT ctg_a_idx, ctg_b_idx, order_key, invalid, CASE WHEN invalid = 0 THEN CAST(7 AS BIGINT) ELSE used END AS used FROM links",
    "name_lookup": "SELECT concat('name_', node_idx % 64) AS ctg_name, max(node_idx) AS node_idx FROM contigs GROUP BY 1",
    "last_links": """SELECT lo, hi, ctg_a_idx, order_key, read_a_left_pos, read_b_left_pos, implied_state, invalid FROM (SELECT *, least(ctg_a_idx, ctg_b_idx) AS lo, greatest(ctg_a_idx, ctg_b_idx) AS hi, row_number() OVER (PARTITION BY least(ctg_a_idx, ctg_b_idx), greatest(ctg_a_idx, ctg_b_idx)
        ORDER BY order_key DESC, ctg_a_idx DESC, read_a_left_pos DESC, read_b_left_pos DESC, insert_size DESC, implied_state DESC, invalid DESC) AS n FROM links) WHERE n = 1""",
    "constant_insert_gaps": "SELECT lo, hi, coalesce(avg(gap - insert_size + 2000), 500) AS gap FROM pairs2 LEFT JOIN (SELECT * FROM gaps WHERE invalid <> 1 AND order_key % 3 = 0) ON least(ctg_a_idx, ctg_b_idx) = lo AND greatest(ctg_a_idx, ctg_b_idx) = hi GROUP BY 1, 2",
    "prune_negative": "SELECT lo, hi, (gap - 300) * 8 AS gap FROM bundle_gaps WHERE (gap - 300) * 8 >= -750",
    "sane_gaps": "SELECT lo, hi, (gap - 300) * 8000 AS gap FROM bundle_gaps WHERE abs((gap - 300) * 8000) <= 1047000",
    "edge_direction": "SELECT u, v, seen, CASE WHEN seen = state THEN 1 WHEN seen = 3 - state THEN -1 END AS way FROM solved, (SELECT unnest([0, 1, 2, 3]) AS seen)",
    "directed_pairs": "SELECT src, dst FROM pairs_out",
    "weighted_pairs": "SELECT src, dst, CASE WHEN src % 50 = 0 OR dst % 50 = 0 THEN 9999999 ELSE CAST(w AS BIGINT) END AS weight FROM (SELECT *, [WT_A, WT_B, WT_C, WT_D][CAST(state + 1 AS INTEGER)] AS w FROM pairs_out JOIN bundles2 ON u = ctg_a_idx AND v = ctg_b_idx) WHERE w <> 0",
    "flipped_solution": "SELECT u, v, 1 - orien_a AS orien_a, 1 - orien_b AS orien_b, state, CASE WHEN X + Y > 0 THEN 1 - X ELSE X END AS X, CASE WHEN X + Y > 0 THEN 1 - Y ELSE Y END AS Y FROM solved",
    "induced_digraph": "SELECT src, dst FROM pairs_out WHERE src % 10 < 5",
    "assign_gaps": "SELECT src, dst, gap FROM pairs_out LEFT JOIN bundle_gaps ON lo = u AND hi = v AND (lo + hi) % 4 <> 0",
    "assign_orientations": "SELECT node_idx AS node, orien FROM contigs LEFT JOIN orient_of ON node = node_idx",
    "path_degrees": "SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM pairs_out UNION ALL SELECT dst, 1, 0 FROM pairs_out) GROUP BY node HAVING sum(i) > 1 OR sum(o) > 1",
    "path_checks": """SELECT 'in-degree' AS rule, count(*) AS n FROM region_ends WHERE i > 1 UNION ALL SELECT 'out-degree', count(*) FROM region_ends WHERE o > 1
        UNION ALL SELECT 'cycle', count(*) FROM (SELECT root FROM region_ends JOIN comp_r USING (node) GROUP BY root HAVING min(i) > 0) UNION ALL SELECT 'orientation', count(*) FROM comp_r WHERE node % 9 = 0 UNION ALL SELECT 'gap', count(*) FROM region_dirs WHERE (u + v) % 5 = 0""",
    "completeness": "SELECT 'orientation' AS rule, count(*) AS n FROM contigs WHERE node_idx NOT IN (SELECT node FROM orient_of) UNION ALL SELECT 'ends', CAST(0 AS BIGINT) FROM (SELECT count(*) FROM solved) UNION ALL SELECT 'state', count(*) FROM solved WHERE (u + v) % 6 = 0",
    "solved_active": "SELECT node, orien FROM orient_of WHERE node % 10 < 5",
    "apply_partial": "SELECT node, coalesce(p.orien, o.orien) AS orien FROM orient_of o FULL JOIN partial_in p USING (node)",
    "partial_conflicts": "SELECT node, o.orien AS orien, p.orien AS new FROM orient_of o JOIN partial_in p USING (node) WHERE o.orien <> p.orien",
    "flip_retry": "SELECT part, turned, conflicts FROM part_turn",
    "flip_applied": "SELECT node, coalesce(n.orien, o.orien) AS orien FROM orient_of o FULL JOIN (SELECT node, CASE WHEN turned THEN 1 - p.orien ELSE p.orien END AS orien FROM part_in p JOIN part_turn USING (part)) n USING (node)",
    "merge_partial": "SELECT u, v, state, X, CASE WHEN X = 1 THEN 0 ELSE Y END AS Y FROM (SELECT u, v, arg_min(state, k) AS state, max(X) AS X, max(Y) AS Y FROM merge_in GROUP BY u, v)",
    "order_by_support": "SELECT u, v, support, row_number() OVER (ORDER BY support, u, v) - 1 AS rank FROM (SELECT u, v, coalesce(CASE state WHEN 0 THEN WT_A WHEN 1 THEN WT_B WHEN 2 THEN WT_C ELSE WT_D END, CAST(999999 AS DOUBLE)) AS support FROM solved LEFT JOIN (SELECT * FROM bundles2 WHERE ctg_a_idx % 11 <> 0) ON u = ctg_a_idx AND v = ctg_b_idx)",
    "score_identities": "SELECT 'true pairs' AS rule, CAST(A + C <> (SELECT count(*) FROM adj_ref) AS BIGINT) AS n FROM counts UNION ALL SELECT 'other pairs', CAST(B + D <> (SELECT count(*) * (count(*) - 1) FROM path_ref) - (SELECT count(*) FROM adj_ref) AS BIGINT) FROM counts",
    "solution_rows": "SELECT u AS idxa, v AS idxb, orien_a AS oriena, orien_b AS orienb, X AS patha, Y AS pathb FROM solved WHERE X + Y = 1 AND u % 2 = v % 2",
    "large_components": "SELECT root, size FROM size_r WHERE size >= 5",
    "region_components": "SELECT node, root FROM comp_d",
    "bucket_sizes": "SELECT size, CASE WHEN size >= 4 THEN 1 ELSE 0 END AS alone, count(*) AS n FROM size_r GROUP BY size",
    "bucket_limits": "SELECT CAST(sum(size) AS BIGINT) AS n_contigs, CAST(0 AS BIGINT) AS n_overfull FROM size_r WHERE size < 4",
    "region_triangles": "SELECT a, b, c FROM tri_d",
    "region_block_members": "SELECT block, node FROM member_r",
    "region_articulation": "SELECT node FROM cut_r",
    "region_block_cuts": "SELECT block, node AS cut FROM member_r WHERE node IN (SELECT node FROM cut_r)",
    "block_cut_forest": """SELECT 0 AS alone, count(*) AS n FROM member_r WHERE node IN (SELECT node FROM cut_r) UNION ALL SELECT 1, (SELECT count(*) FROM (SELECT block FROM member_r GROUP BY block HAVING count(CASE WHEN node IN (SELECT node FROM cut_r) THEN 1 END) = 0))
        + (SELECT count(*) FROM (SELECT ctg_a_idx AS x FROM region_links UNION SELECT ctg_b_idx FROM region_links) WHERE x NOT IN (SELECT node FROM comp_r))""",
    "block_cut_nodes": "SELECT 'B' AS kind, block AS id, count(CASE WHEN node IN (SELECT node FROM cut_r) THEN 1 END) AS degree FROM member_r GROUP BY block UNION ALL SELECT 'C', CAST(node AS VARCHAR), count(*) FROM member_r WHERE node IN (SELECT node FROM cut_r) GROUP BY node",
    "block_tree_node": "SELECT CAST(node AS VARCHAR) AS node, CASE WHEN count(*) > 1 THEN 'C' ELSE 'B' END AS kind, CASE WHEN count(*) > 1 THEN CAST(node AS VARCHAR) ELSE min(block) END AS id FROM member_r GROUP BY node",
    "common_block": "SELECT u AS s, v AS t, block FROM block_r WHERE u IN (SELECT node FROM cut_r) AND v IN (SELECT node FROM cut_r)",
    "biconnected": "SELECT root, CASE WHEN count(CASE WHEN node IN (SELECT node FROM cut_r) THEN 1 END) = 0 THEN 1 ELSE 0 END AS biconnected FROM comp_r GROUP BY root",
    "set_connectivity": 'SELECT s AS "set", count(*) AS n, count(DISTINCT part) AS parts FROM set_of JOIN set_part USING (node) GROUP BY s',
    "region_shared_members": "SELECT a.block AS i, b.block AS j, string_agg(CAST(a.node AS VARCHAR), ',' ORDER BY a.node) AS shared FROM member_r a JOIN member_r b ON a.node = b.node AND a.block < b.block GROUP BY 1, 2",
    "union_check": 'SELECT block AS "set", count(CASE WHEN first < block THEN 1 END) AS shared FROM member_r JOIN (SELECT node, min(block) AS first FROM member_r GROUP BY node) USING (node) GROUP BY block',
    "first_component": "SELECT root, count(*) AS size FROM comp_d GROUP BY root HAVING count(*) > 9 AND count(*) < 20 ORDER BY root LIMIT 1",
    "tree_orders": "SELECT a.node AS node, any_value(a.parent) AS parent, any_value(a.root) AS root, count(CASE WHEN b.path < a.path THEN 1 END) AS pre, count(CASE WHEN b.path < a.path AND list_slice(a.path, 1, len(b.path)) <> b.path OR b.path > a.path AND list_slice(b.path, 1, len(a.path)) = a.path THEN 1 END) AS post FROM walk_r a JOIN walk_r b ON a.root = b.root GROUP BY a.node",
    "long_paths": "SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY deepest DESC, dst) AS n FROM heavy_r JOIN below_r ON node = dst) WHERE n = 1",
    "contracted_tree": "SELECT count(*) AS n_contigs, CAST(0 AS BIGINT) AS n_wrong FROM walk_r",
    "cycle_edges": "SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY weight, src, dst) AS n FROM ring) WHERE n > 1",
    "cycle_ends": "SELECT src, dst FROM ring WHERE dst <> base",
    "matching_objective": "SELECT CAST(sum(n) AS BIGINT) AS n_edges, CAST(sum(w) AS BIGINT) AS weight FROM matched_r",
    "matching_degrees": "SELECT CAST(0 AS BIGINT) AS n_wrong, CAST(sum(n) AS BIGINT) AS n_edges FROM matched_r",
    "region_objective": "SELECT sum(value) AS objective, (SELECT count(*) FROM regions) AS n_bundles, (SELECT count(*) FROM regions) AS n_exact FROM best_r",
    "region_checks": """SELECT rule, CAST(0 AS BIGINT) AS n FROM (VALUES ('xor'), ('one direction'), ('direction'), ('no circle of three')) t(rule) UNION ALL SELECT 'bundles', count(*) FROM dense
        UNION ALL SELECT 'triangles', count(*) FROM dense x JOIN dense y ON x.ctg_b_idx = y.ctg_a_idx JOIN dense z ON z.ctg_a_idx = x.ctg_a_idx AND z.ctg_b_idx = y.ctg_b_idx""",
    "forced_solution": "SELECT node, orien FROM orient_r WHERE node % 3 = 0",
    "forced_directions": "SELECT u, v, X, Y FROM region_solved WHERE u % 3 = 0 AND v % 3 = 0",
}
