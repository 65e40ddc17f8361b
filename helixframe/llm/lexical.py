"""Exact ranked lexical search with hashed max-sketches as upper bounds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappushpop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Fixed value.  Characters outside ASCII, digits and letters.
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_INDEX = "doc_id bigint, n bigint, places binary, maxima binary, terms array<string>, counts array<int>"
_HITS = "item_id bigint, doc_id bigint, score bigint"
#: A coordinate that has reached this stands for any number of occurrences.
_FULL = 255
#: Impacts stay below this.
_LIMIT = 1_000_000
#: Documents in a batch that leaves a task, so that few are held as Python objects.
_BATCH = 256


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.encode().lower().decode())


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs ``tf`` times adds to the score, before its weight; it grows with ``tf``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4096) -> DataFrame:
    """(doc_id, n, places, maxima, terms, counts): every document that has a term.

    ``n`` counts its terms, ``counts`` each different one.  Term hashes share
    ``width`` coordinates, at most 65,536; each holds the greatest count of the
    terms that fall on it, one byte, of which 255 means that many or more.
    ``places`` and ``maxima`` are the coordinates other than 0 of this sketch.  For one document the
    impact of a term grows with its count, so the coordinate bounds the impact of
    every such term, whatever the collection around the document.  A text is
    read whole in one task.
    """
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()))
    schema = pa.schema([(c.split()[0], t) for c, t in zip(_INDEX.split(", "), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns):
                found = Counter(terms_of(text.as_py()))
                counts = np.fromiter(found.values(), np.int64, len(found))
                places = np.fromiter((crc32(t.encode()) % width for t in found), np.int64, len(found))
                sketch = np.zeros(width, np.uint8)
                np.maximum.at(sketch, places, np.minimum(counts, _FULL).astype(np.uint8))
                if found:
                    used = np.flatnonzero(sketch)
                    rows.append((doc_id.as_py(), int(counts.sum()), used.astype("<u2").tobytes(), sketch[used].tobytes(), list(found), counts.astype(np.int32)))
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, _INDEX)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the different terms of every item; rows with one id are one item."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i.as_py(), t) for i, text in zip(*batch.columns) for t in dict.fromkeys(terms_of(text.as_py()))]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*pairs), schema)], schema=schema)

    texts = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "item_id bigint, term string").distinct()


class Block:
    """Some items: their terms, weights and the best hits of one task."""

    def __init__(self, rows: list[tuple[int | None, str, int]], width: int, k: int):
        self.items = sorted({r[0] for r in rows}, key=lambda i: (i is None, i))
        place = {item: at for at, item in enumerate(self.items)}
        terms = dict.fromkeys(r[1] for r in rows)
        self.vocabulary = pa.array(list(terms), pa.string())
        numbers = dict(zip(terms, range(len(terms))))
        own: list[list[tuple[int, int]]] = [[] for _ in self.items]
        #: Summed over the terms of an item that share a coordinate.
        self.matrix = np.zeros((width, len(self.items)))
        for item, term, weight in rows:
            own[place[item]].append((numbers[term], weight))
            self.matrix[crc32(term.encode()) % width, place[item]] += weight
        self.terms = [np.array([t for t, _ in x]) for x in own]
        self.weights = [np.array([w for _, w in x], np.int64) for x in own]
        self.width, self.k = width, k
        #: Of each item, (score, order of the id backwards, id), the worst first.
        self.best: list[list[tuple]] = [[] for _ in self.items]
        self.floors = np.zeros(len(self.items), np.int64)

    def scan(self, batch: pa.RecordBatch, rows: int, n_docs: int, all_terms: int) -> None:
        for at in range(0, batch.num_rows, rows):
            self._scan(batch.slice(at, rows), n_docs, all_terms)

    def _scan(self, batch: pa.RecordBatch, n_docs: int, all_terms: int) -> None:
        ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        m = np.array([10 + 90 * n * n_docs // all_terms for n in lengths], np.int64)
        places, maxima = (batch.column(c).to_pylist() for c in (2, 3))
        owner = np.repeat(np.arange(batch.num_rows), list(map(len, maxima)))
        held = np.frombuffer(b"".join(maxima), np.uint8).astype(np.int64)
        folded = np.zeros((batch.num_rows, self.width))
        folded[owner, np.frombuffer(b"".join(places), "<u2")] = np.where(held == _FULL, _LIMIT, impact(held, m[owner]))
        # Sums stay far below 2**53 for items of up to 300,000 terms; the factor covers larger ones.
        bounds = np.ceil((folded @ self.matrix) * (1 + 1e-9)).astype(np.int64).T.copy()
        impacts = None
        for q in np.flatnonzero(bounds.max(1) >= np.maximum(self.floors, 1)).tolist():
            likely = np.flatnonzero(bounds[q] >= max(1, self.floors[q]))
            likely = likely[np.argsort(-bounds[q, likely], kind="stable")]
            if impacts is None:
                impacts = self._impacts(batch, m)
            done, step = 0, self.k
            while done < len(likely) and bounds[q, likely[done]] >= self.floors[q]:
                some = likely[done : done + step]
                scores = impacts[np.ix_(some, self.terms[q])] @ self.weights[q]
                for d, score in zip(some.tolist(), scores.tolist()):
                    if score >= max(1, self.floors[q]):
                        self._offer(q, score, ids[d])
                done, step = done + step, 2 * step

    def _impacts(self, batch: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        """Exactly what every term of the items adds to the score of every document of the batch, before its weight."""
        lists = batch.column(4)
        offsets = lists.offsets.to_numpy()
        number = pc.index_in(lists.flatten(), value_set=self.vocabulary)
        known = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[known]
        counts = batch.column(5).flatten().cast(pa.int64()).to_numpy()[known]
        out = np.zeros((batch.num_rows, len(self.vocabulary)), np.int64)
        out[owner, number.drop_null().to_numpy()] = impact(counts, m[owner])
        return out

    def _offer(self, q: int, score: int, doc_id: int | None) -> None:
        hit = (score, doc_id is not None, -(doc_id or 0), doc_id)
        best = self.best[q]
        if len(best) < self.k:
            heappush(best, hit)
        elif hit[:3] > best[0][:3]:
            heappushpop(best, hit)
        if len(best) == self.k:
            self.floors[q] = best[0][0]

    def hits(self) -> Iterator[tuple]:
        for item, best in zip(self.items, self.best):
            for score, _, _, doc_id in best:
                yield item, doc_id, score


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", width: int = 4096, block_items: int = 256, block_rows: int = 256) -> DataFrame:
    """The ``k`` documents of highest score above 0 for every item: item_id, rank, doc_id, score.

    A term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``, of N documents with
    a term and df with this one; of L terms in all, a document with n has ``m =
    10 + 90nN div L``; its score for an item sums ``weight * impact(tf, m)``.

    The items go over the whole index in blocks of about ``block_items``, a
    stated set of queries against all rows.  One pass counts df; in the next one
    each task multiplies the sketches of ``block_rows`` documents with the
    block's weights, which bounds all scores at once, and scores documents
    exactly in the order of their bounds until those fall below its ``k``-th
    score.  The best ``k`` of each task meet in a window; it only gets so many.

    Rows with one item id (null is one) are one item with the terms of all;
    equal scores go by ascending doc_id, those without one last; rows of
    documents count one by one, repeated or not.  An item without a term that a
    document has gives no row, and neither does an empty table.
    """
    terms = materialize(query_terms(items, id_col, text_col), "query-terms")
    n_docs, all_terms = index.agg(F.count("*"), F.sum("n")).first()
    blocks = terms.select("item_id").distinct().count() // block_items + 1
    if not n_docs:
        return _ranked(terms.sparkSession.createDataFrame([], _HITS), k)
    found = [_search_block(index, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), n_docs, all_terms, k, width, block_rows) for b in range(blocks)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    return _ranked(hits, k)


def _search_block(index: DataFrame, terms: DataFrame, n_docs: int, all_terms: int, k: int, width: int, block_rows: int) -> DataFrame:
    vocabulary = pa.array([r.term for r in terms.select("term").distinct().collect()], pa.string())
    schema = pa.schema([("term", pa.string()), ("df", pa.int64())])
    hits_schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            places = pc.drop_null(pc.index_in(batch.column(0).flatten(), value_set=vocabulary))
            total += np.bincount(places.to_numpy(), minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(seen)), pa.array(total[seen])], schema=schema)

    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.sum("df") + 1))).cast("long")
    weights = index.select("terms").mapInArrow(count, "term string, df bigint").groupBy("term").agg(weight.alias("weight"))
    rows = [tuple(r) for r in terms.join(weights, "term").select("item_id", "term", "weight").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(rows, width, k)
        for batch in batches:
            block.scan(batch, block_rows, n_docs, all_terms)
        found = list(block.hits())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), hits_schema)], schema=hits_schema)

    return index.mapInArrow(run, _HITS) if rows else index.sparkSession.createDataFrame([], _HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
