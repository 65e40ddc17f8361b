"""Tasks of the links of a large table."""

from __future__ import annotations

from helixframe.operators import links as L
from helixframe.plans import fixtures


def test_links_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """More line items make more tasks of links, and the links are the same."""
    rows = spark.range(400).selectExpr(
        "id div 4 AS l_orderkey", "id * 7 % 50 AS l_partkey", "CAST(id % 50 AS DOUBLE) AS l_quantity", "if(id % 3 = 0, 'O', 'F') AS l_linestatus", "if(id % 5 = 0, 'R', 'N') AS l_returnflag"
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    few = fixtures.view(spark, str(tmp_path), "links")
    monkeypatch.setattr(fixtures, "_TASK_BYTES", 200)
    many = fixtures.view(spark, str(tmp_path), "links")
    assert fixtures.link_tasks(spark, str(tmp_path)) > 8 and many.rdd.getNumPartitions() > max(8, few.rdd.getNumPartitions())
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    dealt = L.links_per_pair(many, 9)
    assert dealt.rdd.getNumPartitions() == 9 and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, L.links_per_pair(few).collect()))
