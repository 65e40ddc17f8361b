"""The score row takes two passes over line items, and the sizes of whole and broken scaffolds come from one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helixframe.operators import scaffolds as S
from helixframe.plans import fixtures
from helixframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shuffled(spark, after: int = -1) -> tuple[int, int]:
    """The last stage, and the rows that stages after one wrote to shuffles."""
    context, jvm = spark._jsc.sc(), spark._jvm
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    told = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())]
    return max((s for s, _ in told), default=-1), sum(n for s, n in told if s > after)


@pytest.mark.parametrize("name", ["score_record", "evaluate"])
def test_line_items_are_shuffled_twice(spark, name):
    """Once for the pairs of both sides, once for the sizes; the rest are pairs, the places of shared ones and the buckets of sizes."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    pairs = sum(S.joints(S.scaffold_rows(p)).count() for p in fixtures.both_paths(spark, SF))
    last, _ = shuffled(spark)
    row = QUERIES[name](spark, SF).first()
    rows = shuffled(spark, last)[1]
    assert 2 * items + pairs + row.A <= rows < 3 * items + pairs + row.A


def test_both_paths_are_keyed_paths(spark):
    """Both sides are what they are alone, and meet with one shuffle of line items."""
    ref, test = fixtures.both_paths(spark, SF)
    for one, name in ((ref, "path_ref"), (test, "path_test")):
        other = fixtures.keyed_paths(spark, SF, name)
        assert one.schema == other.schema and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_whole_and_broken_sizes(spark):
    """Scaffolds of gaps only, of one contig, without good gaps and with only good ones, by name and by key."""
    contig = lambda key, idx, length: (key, f"s{key}", idx, "W", f"c{key}_{idx}", 1, 1 + length)
    gap = lambda key, idx: (key, f"s{key}", idx, "N", "fragment", 1, 8)
    rows = [gap(1, 1), gap(1, 2), contig(2, 1, 50)]
    rows += [r for key in (3, 4, 5) for r in (contig(key, 1, 10), gap(key, 2), contig(key, 3, 20), gap(key, 4), contig(key, 5, 30))]
    rows += [gap(6, 1), contig(6, 2, 40), gap(6, 3)]
    agp = spark.createDataFrame(rows, "scaf_key long, scaf_name string, scaf_idx long, comp_type string, comp_name string, scaf_start long, scaf_stop long")
    places = spark.createDataFrame([(4, 2), (4, 4), (5, 4)], "scaf_key long, scaf_idx long")
    named = places.select(F.concat(F.lit("s"), "scaf_key").alias("scaf_name"), "scaf_idx")
    for a, fits, by in ((agp, places, "scaf_key"), (agp.drop("scaf_key"), named, "scaf_name")):
        got = S.whole_and_broken_sizes(a, fits, tasks=3).collect()
        assert sorted((r.size, sorted(r.pieces)) for r in got) == [(-1, []), (39, [39]), (49, [49]), (59, [9, 19, 29]), (59, [9, 49]), (59, [59])]
        values = lambda df: sorted(r.size for r in df.collect())
        assert sorted(r.size for r in got) == values(S.scaffold_sizes(a, (by,)))
        assert sorted(x for r in got for x in r.pieces) == values(S.scaffold_sizes(S.keep_gaps(a, fits), (by, "piece")))
