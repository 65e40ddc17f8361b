"""Expressions over one link, bundle or solved bundle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean insert size and its standard deviation in the probes for small contigs and for mad gaps.
INSERT, DEVIATION = 1395, 250


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def smaller(a: Column | str = "ctg_a_idx", b: Column | str = "ctg_b_idx") -> Column:
    """First part of the canonical pair key."""
    return F.least(_col(a), _col(b))


def larger(a: Column | str = "ctg_a_idx", b: Column | str = "ctg_b_idx") -> Column:
    """Second part of the canonical pair key."""
    return F.greatest(_col(a), _col(b))


def orientation_class(a="ctg_a_idx", b="ctg_b_idx", ao="read_a_orien", bo="read_b_orien") -> Column:
    """State 0..3 of a link: the two orientation bits, which turn around and flip where the ends are swapped."""
    a, b, ao, bo = map(_col, (a, b, ao, bo))
    return F.when(a < b, 2 * ao + bo).otherwise(2 * (1 - bo) + 1 - ao)


def insert_gap(insert_size, a="ctg_a_idx", b="ctg_b_idx", width_a="width_a", width_b="width_b") -> Column:
    """Gap estimate of one link as a double under an insert size that is given, not the link's own."""
    return link_gap(a, b, width_a, width_b) - _col("insert_size") + F.lit(float(insert_size))


def read_end_distances(state="implied_state", a="ctg_a_idx", b="ctg_b_idx", width_a="width_a", width_b="width_b") -> Column:
    """struct<d1, d2>: how far each read is from the contig end that faces the other contig.

    Each end is the contig's tail (width less the read's right end) or its head
    (the read's left end), by one bit of the state; for swapped ends the bits
    change places and meaning.
    """
    state, a, b, width_a, width_b = map(_col, (state, a, b, width_a, width_b))
    forward = a < b
    tail_a, tail_b = width_a - _col("read_a_right_pos"), width_b - _col("read_b_right_pos")
    high, low = state >= 2, state % 2 == 1
    first = F.when(F.when(forward, ~high).otherwise(low), tail_a).otherwise(_col("read_a_left_pos"))
    second = F.when(F.when(forward, low).otherwise(~high), tail_b).otherwise(_col("read_b_left_pos"))
    return F.struct(first.alias("d1"), second.alias("d2"))


def implied_distance(distances: Column | str) -> Column:
    """Insert size less both read-end distances; null where one of them is negative, which no valid link has."""
    d = _col(distances)
    return F.when((d["d1"] >= 0) & (d["d2"] >= 0), _col("insert_size") - d["d1"] - d["d2"])


def link_gap(a="ctg_a_idx", b="ctg_b_idx", width_a="width_a", width_b="width_b", compat: bool = False) -> Column:
    """Gap estimate of one link as a double, from the orientations of its reads.

    ``compat``: as in older results, widths change places where the ends are
    swapped, and a forward link with orientations (0, 1) uses the whole width of
    its first contig.
    """
    a, b, width_a, width_b = map(_col, (a, b, width_a, width_b))
    ao, bo = _col("read_a_orien"), _col("read_b_orien")
    if compat:
        width_a, width_b = F.when(a < b, width_a).otherwise(width_b), F.when(a < b, width_b).otherwise(width_a)
    da = F.when(ao == 0, width_a - _col("read_a_right_pos")).otherwise(_col("read_a_left_pos"))
    if compat:
        da = F.when((a < b) & (ao == 0) & (bo == 1), width_a).otherwise(da)
    db = F.when(bo == 1, width_b - _col("read_b_right_pos")).otherwise(_col("read_b_left_pos"))
    return (_col("insert_size") - da - db).cast("double")


def direction(state, orien_a, orien_b) -> Column:
    """1 for a to b, -1 for b to a, null for none: the direction that a state has under two orientations.

    A state's two bits are the orientations under which its edge runs forward;
    under their complements it runs backward.
    """
    state, orien_a, orien_b = map(_col, (state, orien_a, orien_b))
    seen = 2 * orien_a + orien_b
    return F.when(seen == state, 1).when(seen == 3 - state, -1)


def flipped() -> dict[str, Column]:
    """A solved bundle seen from the other strand: orientations and direction turn, the state stays."""
    turned = F.col("X") + F.col("Y") > 0
    return {
        "orien_a": 1 - F.col("orien_a"), "orien_b": 1 - F.col("orien_b"),
        "X": F.when(turned, 1 - F.col("X")).otherwise(F.col("X")), "Y": F.when(turned, 1 - F.col("Y")).otherwise(F.col("Y")),
    }
