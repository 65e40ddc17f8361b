"""Scaffold rows: coordinates, neighbours, gaps, breaking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as X
from ..tables import materialize

#: Fixed value: what a negative gap becomes.
LEAST_GAP = 7


def by_column(rows: DataFrame) -> str:
    """What tells scaffolds apart: ``scaf_key`` where rows have it, and then they are dealt by it already, else their name."""
    return "scaf_key" if "scaf_key" in rows.columns else "scaf_name"


def scaffold_rows(paths: DataFrame) -> DataFrame:
    """Scaffold rows of paths (scaf_name, pos, comp_name, size, gap, orien).

    With a ``scaf_key``, which must be as many values as there are names, rows
    keep it, and all windows here go by it, so that rows dealt by it stay where
    they are.

    pos counts from 1 and gap is that before the contig, ignored for the first.
    The first contig spans 1 to its size; each further one ends at the running
    sum of gap, size and 2, and starts its size earlier; the gap row before it
    starts one after the last contig.  Sums are doubles and are cut to whole
    numbers.  Windows lie inside a scaffold.
    """
    by = by_column(paths)
    order = Window.partitionBy(by).orderBy("pos")
    gap = F.when(F.col("gap") < 0, LEAST_GAP).otherwise(F.col("gap")).cast("double")
    p = paths.withColumn("k", F.row_number().over(order) - 1).withColumn("g", F.when(F.col("k") == 0, 0.0).otherwise(gap))
    step = F.when(F.col("k") == 0, F.col("size")).otherwise(F.col("g") + F.col("size") + 2)
    p = p.withColumn("stop", F.sum(step).over(order))
    p = p.withColumn("start", F.when(F.col("k") == 0, 1.0).otherwise(F.col("stop") - F.col("size")))
    p = p.withColumn("gap_start", F.lag("stop").over(order) + 1)
    long = lambda c: c.cast("long")  # noqa: E731  cuts toward zero
    null = F.lit(None).cast("long")
    contig = F.struct(
        long(F.col("start")).alias("scaf_start"), long(F.col("stop")).alias("scaf_stop"), long(2 * F.col("k") + 1).alias("scaf_idx"), F.lit("W").alias("comp_type"),
        F.col("comp_name"), F.lit(1).cast("long").alias("comp_start"), long(F.col("size")).alias("comp_stop"), long(F.col("orien")).alias("comp_orien"), null.alias("comp_linkage"),
    )
    before = F.struct(
        long(F.col("gap_start")).alias("scaf_start"), long(F.col("gap_start") + F.col("g")).alias("scaf_stop"), long(2 * F.col("k")).alias("scaf_idx"), F.lit("N").alias("comp_type"),
        F.lit("fragment").alias("comp_name"), F.lit(1).cast("long").alias("comp_start"), long(F.col("g")).alias("comp_stop"), null.alias("comp_orien"), F.lit(0).cast("long").alias("comp_linkage"),
    )
    rows = F.when(F.col("k") == 0, F.array(contig)).otherwise(F.array(before, contig))
    return p.select(*dict.fromkeys([by, "scaf_name"]), F.inline(rows))


def neighbours(agp: DataFrame, by_line: bool = False) -> DataFrame:
    """Rows with the rows before and after: within the scaffold by index, or by line number wherever the scaffold ends.

    Line numbers meet in equi joins, not in a window over the whole file.
    """
    if not by_line:
        order = Window.partitionBy(by_column(agp)).orderBy("scaf_idx")
        return agp.withColumns({"prev": F.lag("comp_name").over(order), "next": F.lead("comp_name").over(order), "prev_type": F.lag("comp_type").over(order), "next_type": F.lead("comp_type").over(order)})
    named = lambda step, n: agp.select((F.col("line_no") + step).alias("line_no"), F.col("comp_name").alias(n), F.col("comp_type").alias(f"{n}_type"))
    return agp.join(named(1, "prev"), "line_no", "left").join(named(-1, "next"), "line_no", "left")


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``df`` in so many ``tasks`` by some columns, if a number is given."""
    return df.repartition(tasks, *by) if tasks else df


def adjacencies(agp: DataFrame, by_line: bool = False, tasks: int | None = None) -> DataFrame:
    """(lo, hi): different pairs of components on both sides of a gap row, in so many ``tasks`` if given; a gap at either end of the file joins nothing."""
    gaps = neighbours(agp, by_line).where("comp_type = 'N' and prev is not null and next is not null")
    return dealt(gaps.select(F.least("prev", "next").alias("lo"), F.greatest("prev", "next").alias("hi")), tasks, "lo", "hi").distinct()


def scaffold_digraph(agp: DataFrame, by_line: bool = False) -> DataFrame:
    """(src, dst, weight): directed neighbours over each gap row with its length on the scaffold."""
    gaps = neighbours(agp, by_line).where("comp_type = 'N' and prev is not null and next is not null")
    return gaps.select(F.col("prev").alias("src"), F.col("next").alias("dst"), (F.col("scaf_stop") - F.col("scaf_start")).alias("weight"))


def coordinate_gaps(agp: DataFrame) -> DataFrame:
    """(comp_a, comp_b, gap): from the end of each contig to the start of the next on its scaffold."""
    order = Window.partitionBy(by_column(agp)).orderBy("scaf_idx")
    contigs = agp.where("comp_type = 'W'")
    pairs = contigs.select(
        F.col("comp_name").alias("comp_a"), F.lead("comp_name").over(order).alias("comp_b"), (F.lead("scaf_start").over(order) - F.col("scaf_stop")).alias("gap")
    )
    return pairs.where("comp_b is not null")


def gap_lengths(agp: DataFrame) -> DataFrame:
    """(comp_a, comp_b, length): length of the gap row between a contig and the next one of its scaffold, two rows on."""
    order = Window.partitionBy(by_column(agp)).orderBy("scaf_idx")
    rows = agp.select(
        "comp_type", F.col("comp_name").alias("comp_a"), F.lead("comp_name", 2).over(order).alias("comp_b"), F.lead("comp_type").over(order).alias("between"),
        (F.lead("comp_stop").over(order) - F.lead("comp_start").over(order)).alias("length"),
    )
    return rows.where("comp_type = 'W' and comp_b is not null and between = 'N'").select("comp_a", "comp_b", "length")


def joints(agp: DataFrame) -> DataFrame:
    """Gap rows between two components: what tells the scaffold, scaf_idx, lo, hi, length, and ``after_contig``, whether a contig row comes before."""
    between = neighbours(agp, False).where("comp_type = 'N' and prev is not null and next is not null")
    return between.select(
        by_column(agp), "scaf_idx", F.least("prev", "next").alias("lo"), F.greatest("prev", "next").alias("hi"), (F.col("comp_stop") - F.col("comp_start")).alias("length"),
        (F.col("prev_type") == "W").alias("after_contig"),
    )


def break_scaffolds(agp: DataFrame, good: DataFrame, compat: bool = False, tasks: int | None = None) -> DataFrame:
    """Scaffold rows without gap rows whose adjacency is not in ``good`` (lo, hi); such a row starts a new piece.

    Adds ``piece``, the number of the piece in its scaffold from 0.  ``compat``:
    the rows of the last piece of the last scaffold by name have no scaffold.
    Shuffles take so many ``tasks`` if given.
    """
    # Only the pairs of gap rows are looked up, and only where the good ones are comes back.
    fits = dealt(joints(agp), tasks, "lo", "hi").join(good.select("lo", "hi"), ["lo", "hi"], "left_semi").select(by_column(agp), "scaf_idx")
    return keep_gaps(agp, fits, compat, tasks)


def keep_gaps(agp: DataFrame, fits: DataFrame, compat: bool = False, tasks: int | None = None) -> DataFrame:
    """As :func:`break_scaffolds`, with the places of the gap rows that stay: ``fits`` (scaf_name, or scaf_key where ``agp`` has it, scaf_idx)."""
    cut = _pieces(agp, fits, tasks).where("bad = 0").drop("bad")
    if not compat:
        return cut
    last = cut.agg(F.max(F.struct("scaf_name", "piece")).alias("last"))
    gone = F.struct("scaf_name", "piece") == F.col("last")
    return cut.join(F.broadcast(last)).withColumn("lost", gone).drop("last")


def _pieces(agp: DataFrame, fits: DataFrame, tasks: int | None) -> DataFrame:
    """All scaffold rows with ``piece``, and ``bad``, 1 for gap rows that are not in ``fits``."""
    by = by_column(agp)
    null = {f.name: F.lit(None).cast(f.dataType) for f in agp.schema}
    told = fits.select(*(F.col(c) if c in (by, "scaf_idx") else null[c].alias(c) for c in agp.columns), F.lit(True).alias("told"))
    order = Window.partitionBy(by).orderBy("scaf_idx", F.desc("told"))
    gap = F.col("comp_type") == "N"
    # What is told of a gap row comes just before it.
    marked = agp.withColumn("told", F.lit(False)).unionByName(dealt(told, tasks, by)).withColumn("fits", F.lag("told").over(order))
    marked = marked.withColumn("bad", F.when(F.col("told"), 0).otherwise((gap & ~F.coalesce("fits", F.lit(False))).cast("int")))
    return marked.withColumn("piece", F.sum("bad").over(order)).where("not told").drop("told", "fits")


def _contig_length() -> Column:
    """Stop less start of a contig row, 0 for a gap row."""
    return F.when(F.col("comp_type") == "W", F.col("scaf_stop") - F.col("scaf_start")).otherwise(0)


def scaffold_sizes(agp: DataFrame, by: tuple[str, ...] = ("scaf_name",)) -> DataFrame:
    """(by, size): sum of stop less start over the contig rows, less 1."""
    return agp.groupBy(*by).agg((F.sum(_contig_length()) - 1).alias("size"))


def whole_and_broken_sizes(agp: DataFrame, fits: DataFrame, tasks: int | None = None) -> DataFrame:
    """(size, pieces): per scaffold its :func:`scaffold_sizes`, and those of what :func:`keep_gaps` leaves of it, from one pass over the rows."""
    by = by_column(agp)
    parts = _pieces(agp, fits, tasks).groupBy(by, "piece").agg(F.sum(_contig_length()).alias("length"), F.count_if(F.col("bad") == 0).alias("kept"))
    # A piece of which only bad gap rows are left is none.
    piece = F.when(F.col("kept") > 0, F.col("length") - 1).cast("long")
    return parts.groupBy(by).agg((F.sum("length") - 1).cast("long").alias("size"), F.collect_list(piece).alias("pieces")).select("size", "pieces")


#: Bits of a size that one histogram of :func:`n50` takes.
_SIZE_BITS = 12


def n50(sizes: DataFrame, compat: bool = False) -> DataFrame:
    """(n50) of ``sizes`` (size): the size at which half of the total is reached, from the largest down.

    ``compat``: the first size, before which the total less what came before
    itself is at most the whole half; it comes one later, and null if there is
    no such size.

    Sizes are summed by their highest 12 bits, the bucket where the sum is
    reached by its next 12 bits, and so on: no sort, and no window over more
    than 4096 rows.
    """
    return n50_of_kept(materialize(sizes.select(F.col("size").cast("long").alias("size")).where("size is not null"), "n50-sizes"), compat)


def n50_of_kept(sizes: DataFrame, compat: bool = False) -> DataFrame:
    """As :func:`n50`, of ``sizes`` (size long, not null) that a scratch table holds; they are read several times."""
    spark = sizes.sparkSession
    total, most = sizes.agg(F.sum("size"), F.max("size")).first()
    answer = lambda x: spark.createDataFrame([(x,)], "n50 long")
    if total is None:
        return answer(None)
    need = total - int(total / 2) if compat else -(-total // 2)
    # The sum from the largest size down to one, less one of it in the late form, only grows with every smaller size.
    levels = max(1, -(-int(max(most, 0)).bit_length() // _SIZE_BITS))
    path, before, inside = 0, 0, sizes.where("size > 0")
    for low in reversed(range(0, levels * _SIZE_BITS, _SIZE_BITS)):
        cells = inside.where(F.shiftright("size", low + _SIZE_BITS) == path).groupBy(F.shiftright("size", low).alias("bucket")).agg(F.sum("size").alias("part"), F.min("size").alias("least"))
        down = Window.orderBy(F.desc("bucket"))  # at most 4096 rows
        upto = before + F.sum("part").over(down)
        edge = cells.withColumn("upto", upto).where(F.col("upto") - (F.col("least") if compat else 0) >= need).agg(F.max(F.struct("bucket", "part", "upto")).alias("e")).first().e
        if edge is None:
            break
        path, before = edge.bucket, edge.upto - edge.part
    else:
        return answer(path)
    upto = inside.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    for row in sizes.where("size <= 0").groupBy("size").agg(F.sum("size").alias("part")).orderBy(F.desc("size")).collect():  # 0 and -1
        if upto + (0 if compat else row.part) >= need:
            return answer(row.size)
        upto += row.part
    return answer(None)
