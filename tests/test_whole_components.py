"""Components that are worked on whole inside tasks, against the rounds that larger ones go through."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from helixframe.operators import decompose as D
from helixframe.operators import digraph as R
from helixframe.operators import graph as G
from helixframe.operators import groups
from helixframe.operators import paths as H


@pytest.fixture
def pairs():
    """Edges in clusters of ten nodes, and a long chain."""
    rng = random.Random(5)
    found = {(c * 10 + rng.randrange(10), c * 10 + rng.randrange(10)) for c in range(25) for _ in range(rng.randrange(1, 26))}
    return sorted({e for e in found if e[0] != e[1]} | {(i, i + 1) for i in range(1000, 1040)})


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_components_meet_across_chunks(spark, pairs, monkeypatch):
    """Chunks of edges have roots of their own, which meet afterwards."""
    edges = spark.createDataFrame(pairs, "u long, v long")
    wanted = rows(G.star_components(edges))
    assert rows(G.connected_components(edges)) == wanted
    assert rows(G.connected_components(edges.repartition(7)).select("node", "root")) == wanted
    text = edges.selectExpr("concat('n', u) AS u", "concat('n', v) AS v")
    assert rows(G.connected_components(text)) == rows(G.star_components(text))
    assert rows(G.connected_components(edges.limit(0))) == []
    monkeypatch.setattr(G, "_CHUNK", 10)
    frame = pd.DataFrame(pairs, columns=["u", "v"])
    batches = [frame.iloc[i : i + 4] for i in range(0, len(frame), 4)]
    stars = list(G._stars(iter(batches)))
    assert len(stars) > 5 and all((s["root"] <= s["node"]).all() for s in stars)
    assert set(pd.concat(stars)["node"]) == {x for e in pairs for x in e}


def test_few_scratch_tables(spark, pairs, monkeypatch):
    """Components of neighbouring ids take a fixed number of tables, not one for every round of a long chain."""
    written = []
    real = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: written.append(label) or real(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)], "u long, v long").repartition(3)
    assert G.connected_components(edges).where("root <> 0").count() == 0 and len(written) < 10


def test_blocks(spark, pairs):
    edges = spark.createDataFrame(pairs, "u long, v long")
    wanted = rows(D.named_blocks(G.blocks(edges, whole=0)))
    assert rows(D.named_blocks(G.blocks(edges))) == wanted
    assert rows(D.named_blocks(G.blocks(edges, whole=12))) == wanted  # some whole, some by rounds
    numbered = G.blocks(edges)
    assert numbered.select("block").distinct().count() == D.named_blocks(numbered).select("block").distinct().count()


def test_strong_components_and_lightest_edges(spark, pairs):
    edges = spark.createDataFrame([(a, b, (a * 7 + b * 13) % 5) for a, b in pairs], "src long, dst long, weight long")
    assert rows(R.strong_components(edges)) == rows(R.strong_components(edges, whole=0)) == rows(R.strong_components(edges, whole=9)) != []
    gone = rows(R.lightest_of_cycles(edges))
    assert gone == rows(R.lightest_of_cycles(edges, whole=0)) == rows(R.lightest_of_cycles(edges, whole=15)) != []


def test_tree_orders(spark):
    rng = random.Random(3)
    tree = [(c * 100 + rng.randrange(i), c * 100 + i) for c in range(4) for i in range(1, 5 + 8 * c)]
    df = spark.createDataFrame(tree, "src long, dst long")
    wanted = rows(G.tree_orders(df, whole=0).selectExpr("node", "coalesce(parent, -1)", "root", "pre", "post"))
    for whole in (2000, 14):
        assert rows(G.tree_orders(df, whole=whole).selectExpr("node", "coalesce(parent, -1)", "root", "pre", "post")) == wanted


def test_matching_deals_many_components_to_a_task(spark, pairs):
    """Components share tasks: batches of rows hold several, and none is cut in two."""
    edges = spark.createDataFrame([(a, b, (a * 7 + b * 13) % 5) for a, b in pairs], "src long, dst long, weight long")
    matched = H.match_maximum(edges)
    assert matched.groupBy("src").count().where("count > 1").isEmpty() and matched.groupBy("dst").count().where("count > 1").isEmpty()
    got = matched.agg({"weight": "sum", "src": "count"}).first()
    whole = H.best_matching([tuple(r) for r in edges.collect()])
    listed = [tuple(r) for r in edges.collect()]
    assert sorted(got) == sorted((len(whole), sum(listed[i][2] for i in whole)))
    done, left = groups.label_edges(edges, G.connected_components(edges.selectExpr("src AS u", "dst AS v")), "src", lambda part: list(range(len(part))), "int", 12, "t")
    assert left == done.where("label is null").count() == done.where("m > 12").count() > 0
