"""SimHash near-dedup down to a similarity: candidates by anchors and by bands of minima, each verified on its shingle sets.

Fingerprints of texts that share 0.8 of their shingles differ in some 10 of 64
bits, where no covering code of useful size reaches.  So anchors find what is
nearly equal, and bands of minima the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components
from ..tables import materialize
from .simhash import fold, near_links, shingle_hashes

#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 1 - 5e-6 at 0.8, and more above.
BANDS, ROWS = 40, 6
#: Bits of each minimum that a sketch keeps.
SKETCH_BITS = 4


@cache
def _factors() -> np.ndarray:
    """Odd multipliers, each of which orders the hashes anew."""
    return (np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and a sketch of all minima in 64-bit words; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, (_factors()[:, None] * shingles[None, lo : lo + 1024]).min(1), out=least)
    keys = np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)
    marks = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SKETCH_BITS)).reshape(-1, 64 // SKETCH_BITS)
    words = (marks << np.arange(0, 64, SKETCH_BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return keys.view(np.int64), words.view(np.int64)


def sketch_limit(percent: int) -> int:
    """Bits in which the sketches of two sets of that similarity differ at most, but for one pair in three million.

    A minimum is the same with the probability of the similarity, else each of
    its bits agrees by chance; five standard deviations are left above the mean.
    """
    same, n = percent / 100, BANDS * ROWS
    agree = SKETCH_BITS * (1 + same) / 2
    variance = same * SKETCH_BITS**2 + (1 - same) * (SKETCH_BITS**2 + SKETCH_BITS) / 4 - agree**2
    return int(n * (SKETCH_BITS - agree) + 5 * (n * variance) ** 0.5) + 1


def _measured(docs: DataFrame, words_in_shingle: int, whole: bool) -> DataFrame:
    """Of (row, text): node (digest of the shingle set), and the set itself if ``whole``, else row, n, fingerprint, band keys and sketch."""
    schema = "node binary, shingles array<bigint>" if whole else f"row {docs.schema['row'].dataType.simpleString()}, node binary, n bigint, print bigint, keys array<bigint>, sketch array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                hashes = [shingle_hashes(t.as_py() or "", words_in_shingle) for t in part.column(1)]
                sets = [np.unique(h) for h in hashes]
                nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                if whole:
                    yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in sets], lists)], ["node", "shingles"])
                else:
                    prints = np.array([fold(h) for h in hashes], np.uint64).view(np.int64)
                    keys, sketches = (pa.array(c, lists) for c in zip(*map(band_keys, sets)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), nodes, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), keys, sketches], ["row", "node", "n", "print", "keys", "sketch"]
                    )

    return docs.select("row", "text").mapInArrow(run, schema)


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by the keys of both sides, of which none is sent to all tasks.

    Nodes and pairs repeat in buckets, so their Parquet files are a small part of
    the rows, and exploded keys count as if they had not been: Spark would take
    tables for small that no driver holds.
    """
    return left.join(right.hint("merge"), on, how)


def _measured_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with ``both``, the number of shingles that their sets share, and ``near``, whether their Jaccard similarity is at least ``percent`` percent."""
    u, v = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    met = _met(_met(pairs, u, "u"), v, "v").select("u", "v", F.size("of_u").alias("n_u"), F.size("of_v").alias("n_v"), F.size(F.array_intersect("of_u", "of_v")).alias("both"))
    return met.select("u", "v", "both", _alike(F.col("both"), F.col("n_u"), F.col("n_v"), percent).alias("near"))


def _alike(both: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of a and b elements with so many in common have a Jaccard similarity of at least ``percent`` percent."""
    return 100 * both >= percent * (a + b - both)


def near_copies(docs: DataFrame, row_col: str, text_col: str = "text", words_in_shingle: int = 5, percent: int = 80, threshold: int = 2) -> DataFrame:
    """(row, leader) for every row: the smallest row key of its group.

    Two texts link if the Jaccard similarity of their sets of word shingles (as
    in :func:`.simhash.fingerprint`) is at least ``percent`` percent; a group is
    what links reach.  Equal sets are one node from the start.  Nodes whose
    fingerprints meet at an anchor and differ in at most ``threshold`` bits are
    candidates (:func:`.simhash.near_links`), and so are nodes with a band key
    in common.  In every bucket all nodes are compared with the one that has the
    most company; after that only nodes that are still in different groups are,
    and only if what each shares with that one and what it has besides allow the
    similarity and their sketches are near (:func:`sketch_limit`), so a large
    group of near copies is not compared pair by pair.
    Every link is verified on the sets, so candidates decide nothing by
    themselves.

    A null text is empty; texts without words are one group.  ``row_col`` is any
    orderable key without nulls; an empty table gives no rows.  A text of any
    length is shingled whole in one task.
    """
    texts = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    each = materialize(_measured(texts, words_in_shingle, False), "near-each")
    nodes = materialize(each.groupBy("node").agg(F.min("row").alias("least"), F.first("n").alias("n"), F.min("print").alias("print"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "near-nodes")
    # A fingerprint with copies is one more bucket; of nodes with neighbouring ones, the smallest of each are compared.
    by_print = nodes.where("n > 0").groupBy("print").agg(F.min("node").alias("node"))
    met = materialize(near_links(by_print, threshold), "near-prints")
    u, v = (by_print.select(F.col("print").alias(x), F.col("node").alias(f"node_{x}")) for x in "uv")
    anchored = materialize(_met(_met(met, u, "u"), v, "v").select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")), "near-anchored")
    banded = nodes.where("n > 0").select("node", "n", F.explode(F.concat("keys", F.array("print"))).alias("key"))
    company = banded.groupBy("key").agg(F.count("*").alias("company")).where("company > 1")
    members = materialize(_met(banded, company, "key"), "near-members")
    alone = anchored.select(F.explode(F.array("u", "v")).alias("node"), F.lit(0).cast("long").alias("company"))
    central = materialize(members.select("node", "company").union(alone).groupBy("node").agg(F.sum("company").alias("company")), "near-central")
    wanted = _met(nodes, central, "node", "left_semi").select(F.col("least").alias("row")).distinct()
    sets = _measured(_met(texts, wanted, "row", "left_semi"), words_in_shingle, True)
    sets = materialize(_met(sets, central, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")

    ranked = _met(members.drop("company"), central, "node")
    first = ranked.groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("f"))
    near_first = _met(members, first, "key").select("key", "node", "n", "f", F.least("node", "f").alias("u"), F.greatest("node", "f").alias("v"))
    star = near_first.where("u <> v").select("u", "v").union(anchored).distinct()
    compared = materialize(_measured_pairs(star, sets, percent), "near-compared")
    links = compared.where("near").select("u", "v")
    placed = _met(near_first, compared.select("u", "v", "both"), ["u", "v"], "left").select("key", "node", "n", F.coalesce("both", "n").alias("shared"))
    grouped = _met(placed, star_components(links, "near-star").withColumnRenamed("root", "r"), "node", "left")
    grouped = materialize(grouped.select("key", "node", "n", "shared", F.coalesce("r", "node").alias("root")), "near-grouped")
    split = grouped.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ = _met(_met(grouped, split, "key", "left_semi"), nodes.select("node", F.concat("keys", F.array("print")).alias("keys"), "sketch"), "node")
    open_ = materialize(open_.withColumn("band", F.array_position("keys", F.col("key"))), "near-open")
    a, b = open_.alias("a"), open_.hint("merge").alias("b")
    # No more can two sets share than the lesser of their parts inside the first node's set and the lesser of those outside it.
    most = F.least("a.shared", "b.shared") + F.least(F.col("a.n") - F.col("a.shared"), F.col("b.n") - F.col("b.shared"))
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _alike(most, F.col("a.n"), F.col("b.n"), percent)
    # A pair is met once, in the first bucket that it shares, and only if its sketches leave a chance of a link.
    apart = apart & F.expr("array_position(zip_with(a.keys, b.keys, (x, y) -> x = y), true) = a.band")
    apart = apart & (F.expr("aggregate(zip_with(a.sketch, b.sketch, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)") <= sketch_limit(percent))
    rest = a.join(b, apart).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    rest = _met(rest, star, ["u", "v"], "left_anti")
    measured = materialize(_measured_pairs(materialize(rest, "near-rest"), sets, percent), "near-measured")
    links = links.union(measured.where("near").select("u", "v"))

    roots = star_components(links, "near-components")
    named = _met(nodes.select("node", "least"), roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    leaders = named.groupBy("root").agg(F.min("least").alias("leader"))
    return _met(each.select("row", "node"), _met(named, leaders, "root").select("node", "leader"), "node").select("row", "leader")
