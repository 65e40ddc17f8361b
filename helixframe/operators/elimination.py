"""Exact optimisation over bits by elimination of variables.

A problem is a sum of factors.  A factor is a table over a few variables: one
row per allowed assignment, with its value; what has no row is forbidden.
Variables are names, assignments are masks with bit i for the i-th variable of
the scope, scopes are sorted.  The variables of a tree of small cuts fall in
rounds: leaves and chains first, in every part of every problem at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize, materialize_count, supersede


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value.cast("long"), by.cast("int"))


def _bit(mask: Column, at: Column) -> Column:
    return F.call_function("shiftright", mask, at.cast("int")).bitwiseAND(F.lit(1).cast("long"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def project(mask: Column, positions: Column) -> Column:
    """The mask of the bits of ``mask`` at ``positions``."""
    return _sum(F.transform(positions, lambda p, i: _left(_bit(mask, p), i)))


def factor(name: Column, pairs: Column, value: Column) -> list[Column]:
    """Columns (factor, scope, mask, value) of one row, of ``pairs`` (var, bit)."""
    ordered = F.array_sort(pairs)
    mask = _sum(F.transform(ordered, lambda p, i: _left(p["bit"], i)))
    return [name.alias("factor"), F.transform(ordered, lambda p: p["var"]).alias("scope"), mask.alias("mask"), value.cast("double").alias("value")]


def condition(factors: DataFrame, fixed: DataFrame) -> DataFrame:
    """``factors`` without the variables of ``fixed`` (var, bit), which have these bits."""
    scopes = factors.select("factor", "scope").distinct().select("factor", F.posexplode("scope").alias("pos", "var"))
    known = scopes.join(fixed.select("var", "bit"), "var").groupBy("factor").agg(F.sum(_left(F.lit(1), F.col("pos"))).alias("drop"), F.sum(_left(F.col("bit"), F.col("pos"))).alias("want"))
    met = factors.join(known, "factor", "left").where("drop is null or (mask & drop) = want").withColumn("drop", F.coalesce("drop", F.lit(0).cast("long")))
    kept = F.filter(F.transform("scope", lambda s, i: i), lambda i: _bit(F.col("drop"), i) == 0)
    return met.select("factor", F.transform(kept, lambda i: F.element_at("scope", i + 1)).alias("scope"), project(F.col("mask"), kept).alias("mask"), "value")


@dataclass(frozen=True)
class Eliminated:
    """What a round needs to be undone, and the variables that no round could take."""

    #: Of each round, (x, scope) and (x, mask, bit): the best bit of x under every assignment of its scope.
    rounds: list[tuple[DataFrame, DataFrame]]
    #: (var): those with more than ``max_width`` neighbours each.
    core: DataFrame

    def assign(self, core: DataFrame | None = None) -> DataFrame:
        """(var, bit) of all variables, from those of the ``core``."""
        known = core.select("var", F.col("bit").cast("long").alias("bit")) if core is not None else None
        for chosen, choices in reversed(self.rounds):
            asked = chosen.select("x", F.lit(0).cast("long").alias("mask"))
            if known is not None:
                at = chosen.select("x", F.posexplode("scope").alias("pos", "var")).join(known, "var").groupBy("x").agg(F.sum(_left(F.col("bit"), F.col("pos"))).alias("seen"))
                asked = chosen.select("x").join(at, "x", "left").select("x", F.coalesce("seen", F.lit(0)).alias("mask"))
            got = asked.join(choices, ["x", "mask"], "left").select(F.col("x").alias("var"), F.coalesce("bit", F.lit(0)).alias("bit"))
            got = materialize(got, "eliminate-assigned")
            known = got if known is None else known.union(got)
        return known if known is not None else self.core.select("var", F.lit(0).cast("long").alias("bit"))


def eliminate(factors: DataFrame, max_width: int = 14) -> Eliminated:
    """Maximise a sum of factors (factor, scope, mask, value) over all variables with few neighbours, in rounds.

    Two variables are neighbours if a factor has both.  In every round the
    variables with at most ``max_width`` neighbours that have fewer than all of
    these (of equals, by a hash) go at once: the factors of each are added up
    over all assignments of its neighbours, at most 2**max_width, and leave one
    factor with the best that the variable can do.  So the limit is the width of
    a problem, not its size, and no problem is gathered anywhere: a round is
    joins and grouped sums over all of them.  A variable with many neighbours
    waits until they are gone.
    """
    live = materialize(factors, "eliminate-factors")
    rounds = []
    while True:
        scopes = live.select("factor", "scope").distinct()
        near = scopes.select(F.explode("scope").alias("a"), "scope").select("a", F.explode("scope").alias("b")).distinct()
        rank = near.groupBy("a").agg((F.count("*") - 1).alias("n")).where(F.col("n") <= max_width).select("a", F.struct("n", F.xxhash64("a", F.lit(len(rounds))).alias("h"), "a").alias("rank"))
        met = near.join(rank, "a").join(rank.select(F.col("a").alias("b"), F.col("rank").alias("other")), "b", "left")
        first = met.groupBy("a").agg(F.min("other").alias("least"), F.first("rank").alias("rank"), F.collect_list("b").alias("all")).where("least = rank")
        chosen = first.select(F.col("a").alias("x"), F.array_sort(F.array_remove("all", F.col("a"))).alias("around"))
        # The variable itself has bit 0, its neighbours those after it.
        places = F.transform("scope", lambda s: F.array_position(F.concat(F.array("x"), F.col("around")), s) - 1)
        bucket = scopes.select("factor", "scope", F.explode("scope").alias("x")).join(chosen, "x").select("x", "around", "factor", places.alias("positions"))
        bucket, found = materialize_count(bucket, "eliminate-buckets")
        chosen = bucket.groupBy("x").agg(F.first("around").alias("scope"), F.count("*").alias("n"))
        if not found:
            return Eliminated(rounds, scopes.select(F.explode("scope").alias("var")).distinct())
        looked = bucket.withColumn("m", F.explode(F.expr("sequence(0L, shiftleft(1L, size(around) + 1) - 1)")))
        looked = looked.select("x", "m", "factor", project(F.col("m"), F.col("positions")).alias("mask"))
        added = looked.join(live.select("factor", "mask", "value"), ["factor", "mask"]).groupBy("x", "m").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        allowed = added.join(chosen, ["x", "n"])
        own = F.col("m").bitwiseAND(F.lit(1).cast("long"))
        best = allowed.groupBy("x", F.shiftright("m", 1).alias("mask")).agg(F.max_by(own, F.struct("value", -own)).alias("bit"), F.max("value").alias("value"), F.first("scope").alias("scope"))
        best = materialize(best, "eliminate-best")
        rounds.append((chosen.select("x", "scope"), best.select("x", "mask", "bit")))
        left = best.where(F.size("scope") > 0).select(F.concat(F.lit(f"{len(rounds)}:"), "x").alias("factor"), "scope", "mask", "value")
        live = supersede(live, materialize(live.join(bucket.select("factor"), "factor", "left_anti").unionByName(left), "eliminate-factors"))
