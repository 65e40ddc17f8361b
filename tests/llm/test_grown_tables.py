"""Tables that grow on their way to a join (anchors of prints, keys of nodes) are never sent to all tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helixframe import tables
from helixframe.llm import nearcopies, simhash


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_anchors_are_not_broadcast(spark):
    # Of a stored table Spark knows the size.
    prints = tables.materialize(spark.createDataFrame([(0,), (1,), (3,), (7,), (1 << 40,)], "print long"), "prints")
    links = simhash.near_links(prints, 2)
    assert "Broadcast" not in plan(links)
    assert {tuple(r) for r in links.collect()} == {(0, 1), (0, 3), (1, 3), (1, 7), (3, 7), (0, 1 << 40), (1, 1 << 40)}


@pytest.mark.parametrize("copies", [1, 6])
def test_buckets_are_not_broadcast(spark, monkeypatch, copies):
    plans = []

    def noted(df, label, kept=nearcopies.materialize):
        plans.append(plan(df))
        return kept(df, label)

    monkeypatch.setattr(nearcopies, "materialize", noted)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[: 59 - i % 3] + ["x" * (i % 5)]) for i in range(12)] + ["all other words here " * 9, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * copies)], "row long, text string").repartition(3)
    found = nearcopies.near_copies(docs, "row")
    plans.append(plan(found))
    assert len(plans) > 9 and not [p for p in plans if "Broadcast" in p]
    leaders = {r.leader for r in found.where(F.col("row") < 12).collect()}
    assert leaders == {0} and found.count() == len(texts) * copies
