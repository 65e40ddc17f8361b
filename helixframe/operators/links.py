"""Links, bundles, gaps, masks and triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as X

PAIR = ["lo", "hi"]


def with_pair(df: DataFrame, a: str = "ctg_a_idx", b: str = "ctg_b_idx") -> DataFrame:
    """``df`` with the canonical pair key (lo, hi)."""
    return df.withColumns({"lo": X.smaller(a, b), "hi": X.larger(a, b)})


def valid(links: DataFrame) -> DataFrame:
    """Links that are not marked invalid; only the value 1 marks."""
    return links.where("invalid <> 1 or invalid is null")


def with_widths(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links with the widths of both contigs."""
    width = contigs.select("node_idx", "ctg_width")
    a = width.select(F.col("node_idx").alias("ctg_a_idx"), F.col("ctg_width").alias("width_a"))
    b = width.select(F.col("node_idx").alias("ctg_b_idx"), F.col("ctg_width").alias("width_b"))
    return links.join(a, "ctg_a_idx").join(b, "ctg_b_idx")


def with_implied_distance(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links with d1, d2 and the distance that their state implies; null where a read hangs over its contig."""
    d = with_widths(links, contigs).withColumn("d", X.read_end_distances())
    return d.withColumn("implied_dist", X.implied_distance("d")).select("*", "d.d1", "d.d2").drop("d")


def overhanging(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links with d1 and d2 of which one is negative: a read that hangs over its contig, so that no distance is implied."""
    return with_implied_distance(links, contigs).where("d1 < 0 or d2 < 0").drop("implied_dist")


def mark_used(links: DataFrame, round_: int) -> DataFrame:
    """Links with ``used`` set to the number of a round where they are valid."""
    return links.withColumn("used", F.when(F.col("invalid") == 0, F.lit(round_).cast("long")).otherwise(F.col("used")))


def name_lookup(contigs: DataFrame, order: str = "node_idx") -> DataFrame:
    """(ctg_name, node_idx): the number of each name; of several the last in ``order``."""
    return contigs.groupBy("ctg_name").agg(F.max_by("node_idx", order).alias("node_idx"))


def last_links(links: DataFrame, order: list[str]) -> DataFrame:
    """(lo, hi, ...): of the links of each pair the last in ``order``, with all its columns, as an edge of a simple graph."""
    rest = F.struct(*links.columns)
    return with_pair(links).groupBy(PAIR).agg(F.max_by(rest, F.struct(*order)).alias("l")).select(*PAIR, "l.*")


def constant_insert_gaps(links: DataFrame, contigs: DataFrame, bundles: DataFrame, insert_size: int = 2000, without: float = 500.0) -> DataFrame:
    """(lo, hi, gap): mean gap estimate of the valid links of each bundle under one insert size; ``without`` for a bundle that has none."""
    each = with_pair(with_widths(valid(links), contigs)).withColumn("gap", X.insert_gap(insert_size))
    means = each.groupBy(PAIR).agg(F.avg("gap").alias("gap"))
    return with_pair(bundles).select(PAIR).distinct().join(means, PAIR, "left").select(*PAIR, F.coalesce("gap", F.lit(without)).alias("gap"))


def induced_digraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges (src, dst) out of ``nodes`` (node_idx), wherever they lead."""
    return edges.join(nodes.select(F.col("node_idx").alias("src")).distinct(), "src", "left_semi").select(edges.columns)


def dealt_by_pair(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """``links`` with (lo, hi), all of a pair in one of so many ``tasks``, so that counts by pair need no table in front of the shuffle."""
    return with_pair(links).repartition(tasks, *PAIR) if tasks else with_pair(links)


def links_per_pair(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(lo, hi, n_links), in so many ``tasks`` if given: most pairs have one link, so a task's table of pairs is as long as its links."""
    pairs = dealt_by_pair(links.select("ctg_a_idx", "ctg_b_idx"), tasks)
    return pairs.groupBy(PAIR).agg(F.count("*").alias("n_links"))


def bundle_links(links: DataFrame, min_links: int) -> DataFrame:
    """Bundles: valid links per pair and state, of pairs with at least ``min_links`` of them."""
    support = [F.count_if(F.col("implied_state") == s).cast("double").alias(f"WT_{c}") for s, c in enumerate("ABCD")]
    grouped = with_pair(valid(links)).groupBy(PAIR).agg(F.count("*").alias("n"), *support).where(F.col("n") >= min_links)
    return grouped.select(F.col("lo").alias("ctg_a_idx"), F.col("hi").alias("ctg_b_idx"), *(f"WT_{c}" for c in "ABCD"))


def mean_gaps(links: DataFrame, contigs: DataFrame, bundles: DataFrame, agp_gaps: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """(lo, hi, gap): mean gap estimate of the valid links of each bundle.

    A bundle without links takes the gap of ``agp_gaps`` (comp_a, comp_b, gap)
    in either order; without that, gap is null, and the caller decides.
    """
    wanted = with_pair(bundles).select(PAIR).distinct()
    # Most links are of no bundle; only the others need widths.
    held = with_pair(valid(links)).join(wanted, PAIR, "left_semi")
    each = with_widths(held, contigs).withColumn("gap", X.link_gap(compat=compat))
    means = each.groupBy(PAIR).agg(F.avg("gap").alias("mean"))
    out = wanted.join(means, PAIR, "left")
    if agp_gaps is None:
        return out.withColumnRenamed("mean", "gap")
    known = agp_gaps.select(X.smaller("comp_a", "comp_b").alias("lo"), X.larger("comp_a", "comp_b").alias("hi"), (F.col("comp_a") > F.col("comp_b")).alias("turned"), "gap")
    known = known.groupBy(PAIR).agg(F.min_by("gap", "turned").alias("known"))
    return out.join(known, PAIR, "left").select(*PAIR, F.coalesce("mean", "known").cast("double").alias("gap"))


def bundle_size_histogram(links: DataFrame, truth: DataFrame, tasks: int | None = None) -> DataFrame:
    """(n_links, tp, fp): pairs by number of links, split by whether ``truth`` (lo, hi) has them; dense from 0 to the largest."""
    sizes = links_per_pair(links, tasks).join(truth.select(*PAIR, F.lit(True).alias("true")).distinct(), PAIR, "left")
    counted = sizes.groupBy("n_links").agg(F.count_if("true").alias("tp"), F.count_if(F.col("true").isNull()).alias("fp"))
    dense = sizes.agg(F.max("n_links").alias("most")).select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("n_links"))
    return dense.join(counted, "n_links", "left").select("n_links", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"))


def in_clusters(bundles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bundles whose pair is in ``pairs`` (lo, hi), in either order."""
    return bundles.join(pairs, (X.smaller() == F.col("lo")) & (X.larger() == F.col("hi")), "left_semi")


def induced(bundles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bundles with both ends in ``nodes`` (node_idx)."""
    a, b = (nodes.select(F.col("node_idx").alias(f"ctg_{x}_idx")) for x in "ab")
    return bundles.join(a, "ctg_a_idx", "left_semi").join(b, "ctg_b_idx", "left_semi").select(bundles.columns)


def incident(bundles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bundles with either end in ``nodes`` (node_idx): two equi joins, not one join with OR."""
    a, b = (nodes.select(F.col("node_idx").alias(f"ctg_{x}_idx")) for x in "ab")
    at_a = bundles.join(a, "ctg_a_idx", "left_semi").select(bundles.columns)
    only_b = bundles.join(b, "ctg_b_idx", "left_semi").join(a, "ctg_a_idx", "left_anti").select(bundles.columns)
    return at_a.unionAll(only_b)


def induced_with_cuts(bundles: DataFrame, nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Bundles inside ``nodes`` and ``cuts`` (node_idx) together, but none between two cuts."""
    inside = induced(bundles, nodes.select("node_idx").union(cuts.select("node_idx")).distinct())
    a, b = (cuts.select(F.col("node_idx").alias(f"cut_{x}"), F.lit(True).alias(f"is_{x}")) for x in "ab")
    marked = inside.join(a, inside.ctg_a_idx == a.cut_a, "left").join(b, inside.ctg_b_idx == b.cut_b, "left")
    return marked.where("is_a is null or is_b is null").select(bundles.columns)


def unique_edges(bundles: DataFrame) -> DataFrame:
    """(lo, hi): different pairs, without loops."""
    return with_pair(bundles).where("lo <> hi").select(PAIR).distinct()


def triangles(bundles: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c: each triangle once.

    Edges point from the end with fewer neighbours to the one with more (then to
    the larger id), so a hub's neighbours are not paired with one another: an
    end has at most sqrt(2 * edges) edges out.
    """
    edges = unique_edges(bundles)
    degree = edges.select(F.explode(F.array("lo", "hi")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    lo, hi = (degree.select(F.col("n").alias(x), F.struct("d", "n").alias(f"r_{x}")) for x in PAIR)
    ranked = edges.join(lo, "lo").join(hi, "hi")
    forward = F.col("r_lo") < F.col("r_hi")
    out = ranked.select(F.when(forward, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(forward, F.col("hi")).otherwise(F.col("lo")).alias("v"))
    wedges = out.select("u", F.col("v").alias("x")).join(out.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedges.join(edges, (F.col("x") == F.col("lo")) & (F.col("y") == F.col("hi")))
    corners = F.array_sort(F.array("u", "x", "y"))
    return closed.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def ordered_triangles(bundles: DataFrame) -> DataFrame:
    """(p, x, y): every triangle in all six orders."""
    t = triangles(bundles)
    orders = F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(o, "pxy"))) for o in ("abc", "acb", "bac", "bca", "cab", "cba")))
    return t.select(F.inline(orders))


def spanned_small_contigs(links: DataFrame, contigs: DataFrame, compat: bool = False) -> DataFrame:
    """(i, j, k): triangles whose corner j is a small contig that the link from i to k can span, one per triangle.

    ``links`` has one row per pair (lo, hi) with implied_state and implied_dist.
    The first corner that is narrower than insert size plus three deviations,
    is narrower than the distance between the others plus three deviations, and
    whose three links are all of states 0, 1 or all of states 2, 3, counts.
    ``compat``: the width to span is that of the contig numbered 0, 1 or 2 like
    the corner.
    """
    slack = 3 * X.DEVIATION
    t = triangles(links.select(F.col("lo").alias("ctg_a_idx"), F.col("hi").alias("ctg_b_idx")))
    corner = ["a", "b", "c"]
    turns = F.array(*(F.struct(F.lit(r).alias("turn"), *(F.col(corner[(r + o) % 3]).alias(n) for o, n in ((-1, "i"), (0, "j"), (1, "k")))) for r in range(3)))
    rotated = t.select("a", "b", "c", F.inline(turns))
    width = contigs.select("node_idx", "ctg_width")
    rotated = rotated.join(width.select(F.col("node_idx").alias("j"), F.col("ctg_width").alias("width")), "j").where(F.col("width") < X.INSERT + slack)
    if compat:
        rotated = rotated.drop("width").join(width.select(F.col("node_idx").cast("int").alias("turn"), F.col("ctg_width").alias("width")), "turn")
    for x, y in ("ij", "jk", "ik"):
        side = links.select(F.col("lo").alias("l"), F.col("hi").alias("h"), (F.col("implied_state") >= 2).alias(f"s_{x}{y}"), F.col("implied_dist").alias(f"d_{x}{y}"))
        rotated = rotated.join(side, (X.smaller(x, y) == F.col("l")) & (X.larger(x, y) == F.col("h"))).drop("l", "h")
    good = rotated.where((F.col("d_ik") + slack > F.col("width")) & (F.col("s_ij") == F.col("s_jk")) & (F.col("s_jk") == F.col("s_ik")))
    first = good.groupBy("a", "b", "c").agg(F.min_by(F.struct("i", "j", "k"), "turn").alias("t"))
    return first.select("t.*")


def merge_islands(masks: DataFrame, key: str = "node_idx") -> DataFrame:
    """Masks (key, start, end) as intervals that neither overlap nor touch."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = masks.where("start < end").withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    return opened.withColumn("island", F.sum("opens").over(order)).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def read_weights(links: DataFrame, masks: DataFrame, bin_width: int = 1000, key: tuple[str, ...] = ("link_id",), tasks: int | None = None) -> DataFrame:
    """(link_id, a_coverage, b_coverage, a_overlap, b_overlap): the unmasked part of each link's reads; null for a read without bases, no row if both are.

    ``links`` has a link_id, or other columns as ``key``; ``masks``: (node_idx,
    start, end).  A range join: islands lie in bins at least as wide as the
    longest read, each bin with those of the next one as well, so that a read
    looks up one bin only and a link stays one row.  Both joins take so many
    ``tasks`` if given.  Coverage is always 1.
    """
    length = F.greatest(*(F.col(f"read_{x}_right_pos") - F.col(f"read_{x}_left_pos") for x in "ab"))
    width = max(bin_width, links.agg(F.max(length)).first()[0] or 0)
    bin_ = lambda c: F.floor(c / width)
    islands = merge_islands(masks).select("node_idx", F.struct(F.col("start").alias("m_start"), F.col("end").alias("m_end")).alias("island"))
    islands = islands.withColumn("bin", F.explode(F.sequence(bin_(F.col("island.m_start")) - 1, bin_(F.col("island.m_end") - 1))))
    marks = islands.groupBy("node_idx", "bin").agg(F.collect_list("island").alias("islands"))
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    out = links
    for x in "ab":
        node, start, end = (F.col(c) for c in (f"ctg_{x}_idx", f"read_{x}_left_pos", f"read_{x}_right_pos"))
        inside = lambda total, i: total + F.greatest(F.least(end, i["m_end"]) - F.greatest(start, i["m_start"]), F.lit(0).cast("long"))  # noqa: B023, E731
        masked = F.coalesce(F.aggregate("islands", F.lit(0).cast("long"), inside), F.lit(0))
        met = dealt(out.withColumn("bin", bin_(start)), f"ctg_{x}_idx", "bin").join(dealt(marks.withColumnRenamed("node_idx", f"ctg_{x}_idx"), f"ctg_{x}_idx", "bin"), [f"ctg_{x}_idx", "bin"], "left")
        out = met.withColumn(f"{x}_overlap", F.when(start < end, 1.0 - masked / (end - start))).drop("bin", "islands")
    out = out.where("a_overlap is not null or b_overlap is not null")
    return out.select(*key, F.lit(1.0).alias("a_coverage"), F.lit(1.0).alias("b_coverage"), "a_overlap", "b_overlap")
