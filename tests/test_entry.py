"""The registry, and its library queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from helixframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that take many rounds; tests of their operators are in test_library.
SLOW = {
    "solve_objective", "constraint_checks", "articulation", "shortest_paths", "region_objective", "region_checks", "forced_solution", "forced_directions", "matching_objective", "matching_degrees",
    "region_components", "region_articulation", "region_block_cuts", "block_cut_forest", "block_cut_nodes", "block_tree_node", "biconnected", "region_shared_members", "union_check", "decomposition_sets",
    "decomposition_tree", "bucket_sizes", "bucket_limits", "contracted_tree", "long_paths", "common_block", "decomposition_file", "tree_orders", "path_checks", "component_sizes",
    "dense_objective", "path_objective", "path_model_checks", "scc", "break_scc", "break_scc_lightest", "block_cut_orders", "separation_pairs", "agp_out", "solution", "matching", "dense_gap",
    "block_members", "block_cut_tree", "shared_members", "bucket_small", "region_branching",
}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row.name == "orders" and row.A > 0


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted((set(QUERIES) & set(entry.oracle_sql())) - SLOW))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    with duckdb.connect() as con:
        con.execute("SET temp_directory = ''; SET memory_limit = '4GB'")
        for table in ("part", "lineitem"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cursor = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        wanted = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in cursor.fetchall())
    assert sorted(names) == columns
    assert sorted(repr([plain(v) for v in row]) for row in df.select(columns).collect()) == wanted
