"""Scores of test scaffolds against reference scaffolds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import materialize
from . import scaffolds as S

PAIR = ["lo", "hi"]


def confusion(true_pairs: DataFrame, test_pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(A, B, C, D) of adjacencies: shared, only in the test, only in the truth, neither, of the n (n - 1) ordered pairs of contigs.

    One outer join and one aggregate.
    """
    both = true_pairs.select(*PAIR, F.lit(1).alias("t")).join(test_pairs.select(*PAIR, F.lit(1).alias("s")), PAIR, "full_outer")
    counts = both.agg(
        F.count_if(F.col("t").isNotNull() & F.col("s").isNotNull()).alias("A"), F.count_if(F.col("t").isNull()).alias("B"), F.count_if(F.col("s").isNull()).alias("C")
    )
    n = contigs.agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(n)).select("A", "B", "C", (F.col("n") * (F.col("n") - 1) - F.col("A") - F.col("C") - F.col("B")).alias("D"))


def derived_scores(counts: DataFrame) -> DataFrame:
    """``counts`` with sensitivity, ppv and mcc; null where a denominator is 0."""
    a, b, c, d = (F.col(x).cast("double") for x in "ABCD")
    return counts.withColumns(
        {
            "sensitivity": F.try_divide(a, a + c),
            "ppv": F.try_divide(a, a + b),
            "mcc": F.try_divide(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c))),
        }
    )


def gap_deviation(ref: DataFrame, test: DataFrame) -> DataFrame:
    """(gap_dev): mean relative deviation of gap lengths over adjacencies of both; a reference length of 0 counts as 1."""
    pair = lambda agp, n: S.gap_lengths(agp).select(F.least("comp_a", "comp_b").alias("lo"), F.greatest("comp_a", "comp_b").alias("hi"), F.col("length").alias(n))
    truth = pair(ref, "r").withColumn("r", F.when(F.col("r") == 0, 1).otherwise(F.col("r")))
    return truth.join(pair(test, "t"), PAIR).agg(F.avg(F.abs(F.col("r") - F.col("t")) / F.col("r")).alias("gap_dev"))


def evaluate(ref: DataFrame, test: DataFrame, name: str, method: str, runtime: float = -1.0, compat: bool = True, tasks: int | None = None) -> DataFrame:
    """The 13-field score row of ``test`` against ``ref``; N50 and TP50 in the one-later form unless not ``compat``.

    The pairs of both meet once, in one outer join, with their gap lengths and
    the places of their gap rows in the test; what it gives is written without
    their names and read by every part.  One more pass over ``test`` writes the
    sizes of its scaffolds and of their pieces.  Shuffles take so many ``tasks``
    if given.
    """
    by = S.by_column(test)
    seen = Observation()
    contigs = ref.observe(seen, F.count_if(F.col("comp_type") == "W").alias("n"))
    lengths = lambda: F.collect_list(F.when(F.col("after_contig"), F.col("length")))
    truth = S.dealt(S.joints(contigs), tasks, *PAIR).groupBy(PAIR).agg(lengths().alias("r"))
    found = S.dealt(S.joints(test), tasks, *PAIR).groupBy(PAIR).agg(lengths().alias("t"), F.collect_list(F.struct(by, "scaf_idx")).alias("places"))
    both = F.col("r").isNotNull() & F.col("t").isNotNull()
    # A reference length of 0 counts as 1.
    least = lambda r: F.when(r == 0, 1).otherwise(r)
    off = lambda r, t: F.abs(least(r) - t) / least(r)
    against = lambda r: lambda total, t: total + off(r, t)
    deviation = F.aggregate("r", F.lit(0.0), lambda total, r: F.aggregate("t", total, against(r)))
    pairs = truth.join(found, PAIR, "full_outer").select(
        F.col("r").isNotNull().alias("in_ref"), F.col("t").isNotNull().alias("in_test"), F.when(both, deviation).alias("deviation"),
        F.when(both, F.size("r").cast("long") * F.size("t")).alias("n"), F.when(both, F.col("places")).alias("places"),
    )
    pairs = materialize(pairs, "score-pairs")
    n = seen.get["n"]
    a, b, c = (F.count_if(x) for x in (F.col("in_ref") & F.col("in_test"), ~F.col("in_ref"), ~F.col("in_test")))
    counts = pairs.agg(a.alias("A"), b.alias("B"), c.alias("C"), F.try_divide(F.sum("deviation"), F.sum("n")).alias("gap_dev"))
    counts = counts.select("A", "B", "C", (F.lit(n * (n - 1)).cast("long") - F.col("A") - F.col("C") - F.col("B")).alias("D"), "gap_dev")
    fits = pairs.where("places is not null").select(F.inline("places"))
    sizes = materialize(S.whole_and_broken_sizes(test, fits, tasks), "score-sizes")
    whole, pieces = sizes.select("size").where("size is not null"), sizes.select(F.explode("pieces").alias("size"))
    parts = [derived_scores(counts), S.n50_of_kept(whole, compat), S.n50_of_kept(pieces, compat).withColumnRenamed("n50", "tp50")]
    row = parts[0]
    for one in parts[1:]:
        row = row.join(F.broadcast(one))  # one row each
    return row.select(
        F.lit(name).alias("name"), F.lit(method).alias("method"), "A", "B", "C", "D", "gap_dev", F.lit(runtime).alias("runtime"), "sensitivity", "ppv", "mcc", "n50", "tp50"
    )


def identities(counts: DataFrame, true_pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(rule, n): which identities A, B, C, D of ``counts`` break: A + C are the true pairs, B + D the ordered pairs of contigs that are not."""
    m = true_pairs.agg(F.count("*").alias("m"))
    n = contigs.agg((F.count("*") * (F.count("*") - 1)).alias("pairs"))
    row = counts.join(F.broadcast(m)).join(F.broadcast(n))  # one row each
    broken = {"true pairs": F.col("A") + F.col("C") != F.col("m"), "other pairs": F.col("B") + F.col("D") != F.col("pairs") - F.col("m")}
    return row.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), c.cast("long").alias("n")) for name, c in broken.items()))))


#: Fields of a score row in the order of its line.
FIELDS = ("name", "method", "A", "B", "C", "D", "gap_dev", "runtime", "sensitivity", "ppv", "mcc", "n50", "tp50")


def score_line(row: DataFrame) -> DataFrame:
    """(value): score rows as tab-separated lines; a missing field is None, as in older lines."""
    return row.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in FIELDS)).alias("value"))
