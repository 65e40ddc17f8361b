"""Token counts per field and section of documents that are encoded once as a whole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import RankTokenizer

COUNTS = "doc_id bigint, field string, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint"


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens (ends, tiling from 0) and sections (starts, tiling from 0).

    Returns each token's section under ``rule`` and whether it crosses a
    boundary.  ``start``: the section of its first byte; ``majority``: the one
    with most of its bytes, the earlier one of equals.
    """
    token_starts = np.concatenate([[0], token_ends])[:-1]
    first = np.searchsorted(section_starts, token_starts, "right") - 1
    last = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    crossing = first != last
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            edges = np.concatenate([[token_starts[t]], section_starts[first[t] + 1 : last[t] + 1], [token_ends[t]]])
            first[t] += int(np.diff(edges).argmax())
    elif rule != "start":
        raise ValueError(f"rule must be 'start' or 'majority', not {rule!r}")
    return first, crossing


def count_tokens(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    fields: Sequence[str],
    sectioned: str | None = None,
    separator: str = " ",
    rule: str = "majority",
    id_col: str = "doc_id",
) -> DataFrame:
    """Tokens of each field, and of each line of the field ``sectioned`` (``COUNTS``).

    A document is its ``fields`` in order, joined by ``separator``, encoded
    once.  Its sections tile it: each field is one, but every line of
    ``sectioned`` is one of its own; a separator or line feed belongs to the
    section before it.  Token spans come from the byte lengths of the ids, so
    no text is encoded twice.  Every token counts in exactly one section by
    ``rule`` (see :func:`attribute`); ``n_crossing`` of those also reach into
    another section.  ``start`` and ``end`` are code points in the document,
    without the separator.

    A null field is empty (a section without characters of its own); null or
    repeated ids are kept row by row; other columns are ignored; an empty table
    gives no rows.  A token that two sections share equally belongs to the
    earlier one.  A document of any length is encoded whole in one task.
    """
    out = pa.schema([("doc_id", pa.int64()), ("field", pa.string())] + [(c, pa.int64()) for c in ("section", "start", "end", "n_tokens", "n_crossing")])
    fields = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = RankTokenizer(rank_path, pattern)
        for batch in batches:
            found: list[list] = [[] for _ in out]
            for r, doc_id in enumerate(batch.column(0).to_pylist()):
                values = [batch.column(1 + i)[r].as_py() or "" for i in range(len(fields))]
                parts = [(f, n, line) for f, v in zip(fields, values) for n, line in enumerate(v.split("\n") if f == sectioned else [v])]
                ids = tokenizer.encode(separator.join(values))
                tails = [1 if f == sectioned and parts[i + 1][0] == f else len(separator) for i, (f, _, _) in enumerate(parts[:-1])] + [0]
                tail_bytes = [1 if f == sectioned and parts[i + 1][0] == f else len(separator.encode()) for i, (f, _, _) in enumerate(parts[:-1])] + [0]
                sizes = np.array([len(p.encode()) for _, _, p in parts]) + tail_bytes
                points = np.array([len(p) for _, _, p in parts])
                starts = np.concatenate([[0], np.cumsum(points + tails)[:-1]])
                owner, crossing = attribute(np.cumsum(tokenizer.byte_lengths[ids]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), rule)
                columns = (
                    [doc_id] * len(parts), [f for f, _, _ in parts], [n for _, n, _ in parts], starts.tolist(), (starts + points).tolist(),
                    np.bincount(owner, minlength=len(parts)).tolist(), np.bincount(owner[crossing], minlength=len(parts)).tolist(),
                )
                for to, values in zip(found, columns):
                    to.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(found, out)], schema=out)

    chosen = [docs[id_col].cast("long").alias("doc_id")] + [docs[f].cast("string").alias(f"field_{i}") for i, f in enumerate(fields)]
    return docs.select(*chosen).mapInArrow(run, COUNTS)
