"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import RankTokenizer

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, sequence_length bigint, sequence_cost double"
)


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Spread documents of the given lengths over ``sum // capacity`` sequences that all get full.

    Pieces are (document, start, length).  A piece costs ``linear * n +
    quadratic * n * n``.  In descending cost, each goes to the sequence of
    lowest cost among those with room for it; what fits nowhere is cut to fill
    the remaining room, again at the lowest cost first.  Returns the sequences
    and the pieces left over, fewer than ``capacity`` ids.
    """
    cost = lambda n: linear * n + quadratic * n * n
    pieces = [(d, at, min(capacity, n - at)) for d, n in enumerate(lengths) for at in range(0, n, capacity)]
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    count = sum(lengths) // capacity
    room = np.full(count, capacity, np.int64)
    costs = np.zeros(count)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    rest = []
    for piece in pieces:
        n = piece[2]
        at = int(np.where(room >= n, costs, np.inf).argmin()) if count else -1
        if at < 0 or room[at] < n:
            rest.append(piece)
            continue
        sequences[at].append(piece)
        room[at] -= n
        costs[at] += cost(n)
    holes = [(costs[i], i) for i in range(count) if room[i]]
    heapq.heapify(holes)
    left = []
    for d, start, n in rest:
        while n and holes:
            _, at = heapq.heappop(holes)
            take = min(n, int(room[at]))
            sequences[at].append((d, start, take))
            room[at] -= take
            costs[at] += cost(take)
            if room[at]:
                heapq.heappush(holes, (costs[at], at))
            start, n = start + take, n - take
        if n:
            left.append((d, start, n))
    return sequences, left


def pack(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    group_tokens: int = 1 << 20,
) -> DataFrame:
    """Tokenise documents and pack them; one row per piece (``PIECES``).

    Each task packs what it reads, in groups of about ``group_tokens`` ids, so
    nothing is shuffled and memory holds one group and one document.  A group
    fills ``ids // capacity`` sequences to the last position by
    :func:`balance`; the ids left over join the next group.  The last ones of a
    task, fewer than ``capacity``, go into sequences whose lengths are powers of
    two, which need no padding either.  ``ids`` is the piece as little-endian
    unsigned 32-bit ids; ``sequence_id`` is unique and the same on every attempt
    of a task.

    A null text is empty and a document is at least its ``end_id``; null or
    repeated ids are kept, row by row; other columns are ignored; an empty table
    gives no rows.
    """
    out_schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("sequence_cost", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = RankTokenizer(rank_path, pattern)
        next_id = TaskContext.get().partitionId() << 33
        pending: list[tuple] = []  # doc_id, ids before these, ids, ids of the document
        held = 0

        def emit(sequences: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal next_id
            rows = []
            for pieces in sequences:
                offset, total = 0, sum(n for *_, n in pieces)
                cost = sum(linear * n + quadratic * n * n for *_, n in pieces)
                for d, start, n in pieces:
                    doc_id, before, ids, doc_tokens = pending[d]
                    rows.append((doc_id, before + start, n, ids[start : start + n].tobytes(), doc_tokens, next_id, offset, total, cost))
                    offset += n
                next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out_schema)], schema=out_schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokenizer.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                pending.append((doc_id, 0, ids, len(ids)))
                held += len(ids)
                if held >= group_tokens:
                    sequences, left = balance([len(p[2]) for p in pending], capacity, linear, quadratic)
                    yield emit(sequences)
                    pending = [(pending[d][0], pending[d][1] + s, pending[d][2][s : s + n], pending[d][3]) for d, s, n in left]
                    held = sum(n for *_, n in left)
        sequences, left = balance([len(p[2]) for p in pending], capacity, linear, quadratic)
        held = sum(n for *_, n in left)
        for bit in reversed(range(held.bit_length())):
            if held >> bit & 1:
                short: list[tuple[int, int, int]] = []
                need = 1 << bit
                while need:
                    d, start, n = left[0]
                    take = min(n, need)
                    short.append((d, start, take))
                    need -= take
                    left[0] = (d, start + take, n - take)
                    if n == take:
                        left.pop(0)
                sequences.append(short)
        if sequences:
            yield emit(sequences)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PIECES)
