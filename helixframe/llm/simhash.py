"""SimHash fingerprints and near-duplicate groups by anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import star_components
from ..tables import materialize

#: The binary Golay code: length 23, 12 information bits, every word within 3 bits of exactly one code word.
_LENGTH, _CHECKS, _GENERATOR = 23, 11, 0b110001110101
#: Different fingerprints that one task takes to their anchors.
PRINTS_PER_TASK = 20_000


def shingle_hashes(text: str, words_in_shingle: int) -> np.ndarray:
    """A 64-bit hash of each word shingle of a text, ASCII letters in lower case.

    A shingle is so many words joined by single spaces, counted as often as it
    occurs; a shorter text is one shingle; a text without words has none.
    """
    import xxhash

    words = text.encode().lower().split()  # of bytes: ASCII letters and the six white-space characters only
    n = max(1, len(words) - words_in_shingle + 1) if words else 0
    if not n:
        return np.zeros(0, "<u8")
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)), "<u8", n)


def fold(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes: a bit is set if it is set in over half of them; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = hashes[lo : lo + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words_in_shingle: int) -> int:
    """64-bit SimHash of the word shingles of a text (:func:`shingle_hashes`); a text without words has 0."""
    return fold(shingle_hashes(text, words_in_shingle))


class CoveringCode:
    """Anchors: pairs of Golay code words over the lowest 46 bits of a fingerprint."""

    def __init__(self):
        remainder = np.arange(1 << _LENGTH, dtype=np.uint32)
        for bit in range(_LENGTH - 1, _CHECKS - 1, -1):
            remainder ^= np.where(remainder >> bit & 1, np.uint32(_GENERATOR << (bit - _CHECKS)), np.uint32(0))
        leader = np.zeros(1 << _CHECKS, np.uint32)
        for weight in (3, 2, 1, 0):
            for bits in combinations(range(_LENGTH), weight):
                error = sum(1 << b for b in bits)
                leader[remainder[error]] = error
        #: The number (its information bits) of the code word nearest to each 23-bit word.
        self.nearest = ((np.arange(1 << _LENGTH, dtype=np.uint32) ^ leader[remainder]) >> _CHECKS).astype(np.uint16)
        self.flips = [np.array([sum(1 << b for b in c) for c in combinations(range(_LENGTH), w)], np.uint32) for w in range(3)]

    def home(self, prints: np.ndarray) -> np.ndarray:
        """The nearest anchor."""
        mask = np.uint64((1 << _LENGTH) - 1)
        low, high = (prints & mask).astype(np.uint32), (prints >> np.uint64(_LENGTH) & mask).astype(np.uint32)
        return self.nearest[low].astype(np.int64) << 12 | self.nearest[high]

    def reach(self, prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Every anchor that is nearest to some word within ``threshold`` bits, as (position in ``prints``, anchor).

        These are the anchors within covering radius plus threshold, less those
        that no such word has for its own.
        """
        mask = np.uint64((1 << _LENGTH) - 1)
        low, high = (prints & mask).astype(np.uint32), (prints >> np.uint64(_LENGTH) & mask).astype(np.uint32)
        by_low = [self.nearest[low[:, None] ^ f].astype(np.int64) for f in self.flips[: threshold + 1]]
        by_high = [self.nearest[high[:, None] ^ f].astype(np.int64) for f in self.flips[: threshold + 1]]
        found = []
        for a in range(threshold + 1):
            for b in range(threshold + 1 - a):
                pairs = by_low[a][:, :, None] << 12 | by_high[b][:, None, :]
                found.append(pairs.reshape(len(prints), -1))
        anchors = np.sort(np.concatenate(found, axis=1), axis=1)
        fresh = np.ones(anchors.shape, bool)
        fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
        return np.nonzero(fresh)[0], anchors[fresh]


@cache
def _code() -> CoveringCode:
    """One per Python worker."""
    return CoveringCode()


def _anchored(prints: DataFrame, threshold: int | None) -> DataFrame:
    """(anchor, print): each print at its nearest anchor, or with a threshold at every anchor in reach."""
    out = pa.schema([("anchor", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code()
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(every), 1024):
                own = every[lo : lo + 1024]
                if threshold is None:
                    at, anchors = np.arange(len(own)), code.home(own.view(np.uint64))
                else:
                    at, anchors = code.reach(own.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(own[at], pa.int64())], schema=out)

    return prints.select("print").mapInArrow(run, "anchor bigint, print bigint")


def near_links(prints: DataFrame, threshold: int) -> DataFrame:
    """Pairs u < v of different fingerprints in ``prints`` (print) that differ in at most ``threshold`` bits, each once.

    Two such prints meet at the nearest anchor of the smaller one: it lies
    within the covering radius of that one and so within radius plus threshold
    of the other.  The comparison is part of the join, so only links leave it.
    ``threshold`` is at most 2.  Prints grow about 61-fold on their way to the
    anchors, so they are dealt to tasks by their number before that, not by
    their bytes; Spark, which sizes both sides as if they had not grown, must
    not send one of them to all tasks.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2")
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, prints.count() // PRINTS_PER_TASK + 1)
    prints = prints.select("print").repartition(tasks, "print")
    home = _anchored(prints, None).withColumnRenamed("print", "u")
    reach = _anchored(prints, threshold).withColumnRenamed("print", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    return home.join(reach.hint("merge"), (home.anchor == reach.anchor) & (F.col("u") < F.col("v")) & near).select("u", "v")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """(doc_id, print) of every row; the 64 bits as a signed long."""
    out = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or "", words_in_shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], schema=out)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, print bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, threshold: int = 2
) -> DataFrame:
    """One row per document: doc_id, print, component_id.

    Documents link if their fingerprints differ in at most ``threshold`` bits;
    ``component_id`` is the smallest id reachable over links, their own
    included.  Equal fingerprints are one node with the smallest id of its
    documents, so copies are never compared; only different ones are, per
    anchor.  Nothing but counts reaches the driver.

    A null text is empty; fingerprint 0 links like any other.  Rows with a null
    id are kept; they take the component's smallest id, which is null where all
    ids in it are.  Repeated rows are kept; other columns are ignored; an empty
    table gives no rows.  A text of any length is hashed whole in one task.
    """
    each = materialize(fingerprints(docs, id_col, text_col, words_in_shingle), "simhash")
    nodes = materialize(each.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = star_components(near_links(nodes, threshold), "simhash-links")
    grouped = nodes.join(roots, nodes.print == roots.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    best = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(best, "root").select("print", "component_id")
    return each.join(named, "print").select("doc_id", "print", "component_id")
