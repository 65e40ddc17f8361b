"""Deduplication of repeated passages by content-defined chunks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

_CHUNKS = "doc_id bigint, version bigint, start bigint, end bigint, high bigint, low bigint"
_WINDOW = 32


def gear_table(seed: int = 1) -> np.ndarray:
    """256 random 32-bit words, by a fixed rule."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The gear rolling hash after each byte: h = 2 h + table[byte] modulo 2**32, which the last 32 bytes decide."""
    h = table[data]
    span = 1
    while span < _WINDOW:
        shifted = h.copy()
        shifted[span:] += h[:-span] << np.uint32(span)
        h, span = shifted, 2 * span
    return h


def boundaries(data: np.ndarray, table: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a text in UTF-8: after the first byte, at least ``least`` and at most ``most`` on, where the
    ``bits`` highest hash bits are 0; only between characters, so a forced cut comes up to three bytes earlier."""
    n = len(data)
    open_ = np.ones(n + 1, bool)
    open_[:n] = (data & 0xC0) != 0x80
    marked = np.flatnonzero(((gear_hashes(data, table) >> np.uint32(32 - bits)) == 0) & open_[1:]) + 1
    marked = marked.tolist()
    ends, last, i = [], 0, 0
    while n - last > least:
        i = bisect_left(marked, last + least, i)
        end = marked[i] if i < len(marked) else n
        if end > last + most:
            end = last + most
            while not open_[end]:
                end -= 1
        end = min(end, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunk(docs: DataFrame, id_col: str, text_col: str, bits: int, least: int, most: int) -> DataFrame:
    """(doc_id, version, start, end, high, low): the chunks of at least ``least`` bytes of every text.

    ``start`` and ``end`` are code points; ``version`` tells texts with one id apart.
    """
    out = pa.schema([(c.split()[0], pa.int64()) for c in _CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = gear_table()
        for batch in batches:
            counts, starts_in, ends_in = [], [], []
            digests = []
            for value in batch.column(2):
                text = (value.as_py() or "").encode()
                if len(text) < least:
                    counts.append(0)
                    continue
                data = np.frombuffer(text, np.uint8)
                ends = boundaries(data, table, bits, least, most)
                starts = [0, *ends[:-1]]
                if ends[-1] - starts[-1] < least:
                    ends.pop(), starts.pop()
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                counts.append(len(ends))
                starts_in.append(points[starts])
                ends_in.append(points[ends])
                digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(starts, ends)]
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            spans = [np.concatenate([np.zeros(0, np.int64), *s]) for s in (starts_in, ends_in)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), *map(pa.array, spans), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=out
            )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text")).mapInArrow(run, _CHUNKS)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 5, least: int = 16, most: int = 128, min_span: int = 96
) -> DataFrame:
    """Passages that earlier documents have as well: doc_id, start, end, n_chunks, n_docs, kept_doc_ids.

    Texts are cut where a gear hash of the last 32 bytes says so, so an
    insertion moves the cuts near it only.  Chunks with one 128-bit digest are
    equal; the document with the smallest id keeps them.  Neighbouring chunks of
    a document that others keep are one passage; those of at least ``min_span``
    code points are returned, with the ids that keep at least as much of it
    (``kept_doc_ids``; if none does, the one that keeps most) and the most rows
    that hold one of its chunks (``n_docs``).  ``start`` and ``end`` are code
    points, so a writer can cut the passage out.

    Digests are counted before the shuffle, so a passage that is everywhere is a
    few rows there.  A null text has no chunks; repetition within a document is
    left alone; rows with one id are one document, which keeps what any of them
    has, but passages never reach from one of its texts into another; rows with
    a null id are one document that comes last; other columns are ignored; an
    empty table gives no rows.  A text of any length is cut whole in one task,
    which holds about 20 bytes for each of its bytes.
    """
    chunks = materialize(chunk(docs, id_col, text_col, bits, least, most), "chunks")
    # A null id is none of the ids: it keeps a chunk from nobody, and any id keeps one from it.
    grouped = chunks.groupBy("high", "low").agg(
        F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last_id"), F.count("doc_id").alias("named"), F.count("*").alias("n_docs")
    )
    repeated = grouped.where("kept_doc_id <> last_id or (named > 0 and named < n_docs)").drop("last_id", "named")
    later = chunks.join(repeated, ["high", "low"]).where("doc_id is null or doc_id <> kept_doc_id")
    # From here on everything is bounded by one text.
    order = Window.partitionBy("doc_id", "version").orderBy("start", "end")
    fresh = F.coalesce(F.lag("end").over(order) < F.col("start"), F.lit(True)).cast("int")
    again = F.coalesce((F.lag("start").over(order) == F.col("start")) & (F.lag("end").over(order) == F.col("end")), F.lit(False))
    numbered = later.withColumns({"fresh": fresh, "again": again}).withColumn("passage", F.sum("fresh").over(order)).where("not again")
    each = numbered.groupBy("doc_id", "version", "passage", "kept_doc_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("n_docs").alias("n_docs"), F.sum(F.col("end") - F.col("start")).alias("held")
    )
    keepers = F.collect_list(F.struct("held", F.bitwise_not("kept_doc_id").alias("last")))
    spans = each.groupBy("doc_id", "version", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_chunks"), F.max("n_docs").alias("n_docs"), keepers.alias("keepers")
    )
    long = F.filter("keepers", lambda k: k.held >= min_span)
    named = F.transform(F.when(F.size(long) > 0, long).otherwise(F.array(F.array_max("keepers"))), lambda k: F.bitwise_not(k.last))
    return spans.where(F.col("end") - F.col("start") >= min_span).select(
        "doc_id", "start", "end", "n_chunks", "n_docs", F.array_sort(named).alias("kept_doc_ids")
    )
