"""Mix sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: A word is a run of characters other than these six (space, tab to carriage return).
SPACE = r"\x20\x09-\x0D"

#: Bits of a document's hash, and of each histogram level.
HASH_BITS, LEVEL_BITS = 36, 12


def word_count(text: Column) -> Column:
    """Words of a text; a null one has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{SPACE}]+"))).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 36 bits of the MD5 of id and text, so that rows with one id still differ."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def target_sizes(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources by code point, null last, take the weights in turn and share the
    whole; a target stops at ``most`` times its size, and the excess goes to the
    others by weight until none is above: all get weight times one level, or
    their limit.  The rows are sources, one each, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stopped, used = F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - stopped) / (F.sum("weight").over(every) - used))
    return rows.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.max("level").over(every)).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each row: doc_id, source, size, source_size, target, copies, taken, and the columns ``keep``.

    A row's size is its words.  A source with a target of q whole times its size
    and a rest takes every row q times, and once more the rows whose hash lies
    below a threshold.  The threshold comes from histograms of words by source
    and hash bucket: the bucket where the budget runs out is found from running
    sums, and only its rows are counted again by the next bits, twice.  The last
    bucket is taken or left, whichever is nearer.  No rows are sorted, reruns
    agree, and a source with a third of all rows is summed before any shuffle.

    A null text has size 0 and is never taken; null sources are one source;
    null or repeated ids are kept row by row (rows equal in id and text are
    taken alike); an empty table gives no rows.  A text of any length counts
    with all its words.
    """
    text, doc_id = docs[text_col], docs[id_col].cast("long")
    kept = [docs[c].alias(f"kept_{c}") for c in keep]
    columns = [doc_id.alias("doc_id"), docs[source_col].alias("source"), word_count(text).alias("size"), document_hash(doc_id, text).alias("hash")]
    sized = materialize(docs.select(columns), "mix-sizes")
    sources = target_sizes(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("copies", copies).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    plan = materialize(plan.withColumn("path", F.lit(0).cast("long")).withColumn("spent", F.lit(0).cast("long")), "mix-plan")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        low = HASH_BITS - level * LEVEL_BITS
        own = plan.select(F.col("source").alias("of"), "path", "spent", "budget")
        inside = sized.join(own, sized.source.eqNullSafe(F.col("of")) & (F.shiftright("hash", low + LEVEL_BITS) == F.col("path")))
        buckets = inside.groupBy("of", "spent", "budget", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.col("spent") + F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
        reached = buckets.withColumn("upto", upto).where(F.col("upto") >= F.col("budget"))
        edge = reached.groupBy("of").agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("edge"))
        plan = plan.drop("last").join(edge, plan.source.eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "copies", "budget",
            F.col("edge.bucket").alias("path"), (F.col("edge.upto") - F.col("edge.words")).alias("spent"), F.col("edge.words").alias("last"),
        )
        plan = materialize(plan, "mix-plan")
    # The edge bucket itself is taken if that ends nearer to the budget; there is none only for a source without words.
    threshold = F.col("path") + (F.col("spent") + F.col("last") - F.col("budget") < F.col("budget") - F.col("spent")).cast("long")
    rules = materialize(plan.select(F.col("source").alias("of"), "source_size", "target", "copies", F.coalesce(threshold, F.lit(0)).alias("threshold")), "mix-rules")
    times = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")
    rows = docs.select(*columns, *kept) if keep else sized  # texts are read again rather than written twice
    return rows.join(rules, rows.source.eqNullSafe(rules.of)).select(
        "doc_id", "source", "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"), *(F.col(f"kept_{c}").alias(c) for c in keep)
    )
