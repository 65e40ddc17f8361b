"""Row types of the input tables.  Numbers are 64-bit integers or doubles; null means not set."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


CONTIG = StructType(
    [*_longs("node_idx"), StructField("ctg_name", StringType()), *_longs("ctg_width", "ctg_orien", "ctg_order", "invalid")]
)
LINK = StructType(
    _longs(
        "ctg_a_idx", "ctg_b_idx", "read_a_left_pos", "read_a_right_pos", "read_b_left_pos", "read_b_right_pos",
        "read_a_orien", "read_b_orien", "insert_size", "implied_state", "implied_dist", "std_dev", "invalid", "used",
    )
)
STATES = ("WT_A", "WT_B", "WT_C", "WT_D")
BUNDLE = StructType([*_longs("ctg_a_idx", "ctg_b_idx"), *(StructField(n, DoubleType()) for n in STATES)])
WEIGHT = StructType(
    [*_longs("a_idx", "b_idx"), *(StructField(n, DoubleType()) for n in ("a_coverage", "b_coverage", "a_overlap", "b_overlap"))]
)
SOLUTION = StructType(_longs("idxa", "idxb", "oriena", "orienb", "patha", "pathb"))
#: A scaffold row.  comp_linkage is set for gaps, comp_orien for contigs.
AGP = StructType(
    [
        *_longs("line_no"), StructField("scaf_name", StringType()), *_longs("scaf_start", "scaf_stop", "scaf_idx"),
        StructField("comp_type", StringType()), StructField("comp_name", StringType()), *_longs("comp_start", "comp_stop", "comp_orien", "comp_linkage"),
    ]
)
