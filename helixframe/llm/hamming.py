"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize, materialize_count

BITS = 64
#: Codes in the index of a task at most, about; queries that a task has at least, if there are more; look-ups at a time.
PART, BLOCK, _AT_ONCE = 1 << 21, 256, 1 << 20


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): bit i of the code is set where component i is positive.

    A vector of more than 64 components is folded first: component i of the
    fold is the sum of components i, i + 64, and so on.  Components that are
    missing or null count as 0.  Rows with a null id or vector have no code.
    """
    part = f"slice(vector, i * {BITS} + 1, {BITS})"
    folded = f"if(size(vector) <= {BITS}, vector, aggregate(transform(sequence(0, (size(vector) - 1) div {BITS}), i -> {part}), array_repeat(0D, {BITS}), (a, b) -> zip_with(a, b, (x, y) -> x + coalesce(y, 0))))"
    code = F.expr(f"aggregate(transform({folded}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    named = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"))
    return named.select("id", code.alias("code")).where("id is not null and code is not null")


def _widths(classes: int) -> list[int]:
    """About log2(classes) bits a segment, so that a segment value has about one code."""
    m = max(3, round(BITS / max(4.0, log2(max(2, classes)))))
    return [BITS // m + (i < BITS % m) for i in range(m)]


def _flips(width: int, n: int) -> np.ndarray:
    """All words of ``width`` bits with n bits set."""
    return np.fromiter((sum(1 << b for b in c) for c in combinations(range(width), n)), np.int64)


class CodeIndex:
    """Different codes by the values of their segments, for searches by incremental multi-index hashing."""

    def __init__(self, codes: np.ndarray, least: np.ndarray, copies: np.ndarray):
        """``codes`` as unsigned words, with the smallest id and the number of the rows that have each."""
        order = np.lexsort((codes, least))
        # By id, so that of equally far ones the earlier place is the nearer one.
        self.codes, self.copies = codes[order], copies[order]
        self.widths = _widths(len(codes))
        self.segments, at = [], 0
        for w in self.widths:
            value = self._value(self.codes, at, w)
            starts = np.zeros((1 << w) + 1, np.int32)
            np.cumsum(np.bincount(value, minlength=1 << w), out=starts[1:])
            self.segments.append((at, w, starts, np.argsort(value, kind="stable").astype(np.int32)))
            at += w

    @staticmethod
    def _value(codes: np.ndarray, at: int, width: int) -> np.ndarray:
        return (codes >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``queries``, code, distance) of the classes that hold the k nearest rows of each query.

        Round s looks up every segment with exactly s bits flipped, as far as the
        kth distance known so far needs it: with j segments at this radius, all
        within m s + j - 1 bits is met.
        """
        m = len(self.widths)
        bound, live = np.full(len(queries), BITS), np.arange(len(queries))
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for s in range(max(self.widths) + 1):
            for j, (at, w, starts, places) in enumerate(self.segments):
                live = live[bound[live] >= m * s + j]
                if s > w or not len(live):
                    continue
                flips = _flips(w, s)
                for own in np.array_split(live, -(-len(live) * len(flips) // _AT_ONCE)):
                    found = self._look_up(queries, own, flips, at, w, starts, places, bound)
                    best = self._nearest(best, found, bound, k)
        return best[0], self.codes[best[1]], best[2]

    def _look_up(self, queries, own, flips, at, width, starts, places, bound):
        """Pairs (query, place of a code, distance) that meet in one segment and lie within the query's bound, a bounded number at a time."""
        value = (self._value(queries[own], at, width)[:, None] ^ flips[None, :]).ravel()
        first = starts[value].astype(np.int64)
        count = starts[value + 1] - first
        hit = np.flatnonzero(count)
        ends = np.cumsum(count[hit])
        q, first, count, done = own[hit // len(flips)], first[hit], count[hit], 0
        while done < len(hit):
            # One value with more codes than that goes by itself.
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _AT_ONCE, "right")))
            n = count[done:upto]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, code = np.repeat(q[done:upto], n), places[np.repeat(first[done:upto], n) + inside].astype(np.int64)
            far = np.bitwise_count(queries[who] ^ self.codes[code]).astype(np.int64)
            near = far <= bound[who]
            yield who[near], code[near], far[near]
            done = upto

    def _nearest(self, best, found, bound, k):
        """``best`` with what is ``found``: of each query the k nearest classes at most, none farther than the kth row; ``bound`` gets the kth distances.

        At one distance, classes come by their smallest ids: copies in an
        earlier class may come after a later one, so they don't end the list.
        """
        for more in found:
            who, code, far = (np.concatenate(c) for c in zip(best, more))
            order = np.lexsort((code, far, who))
            who, code, far = who[order], code[order], far[order]
            fresh = np.ones(len(who), bool)
            fresh[1:] = (who[1:] != who[:-1]) | (code[1:] != code[:-1])  # one class has one distance, so its repeats lie together
            who, code, far = who[fresh], code[fresh], far[fresh]
            upto = np.cumsum(self.copies[code])
            start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(who)))
            rows = upto - np.repeat((upto - self.copies[code])[start], size)
            full = (rows >= k) & (rows - self.copies[code] < k)
            bound[who[full]] = far[full]
            kept = (np.arange(len(who)) - np.repeat(start, size) < k) & (far <= bound[who])
            best = who[kept], code[kept], far[kept]
        return best


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of ``codes`` (id, code) nearest to each row of ``queries`` (id, code), exactly: query_id, rank, id, distance.

    Nearest by Hamming distance, then by id; a query that is a row of ``codes``
    finds itself.  Rows with one code form a class with its k smallest ids, and
    queries with one code are searched once, so copies cost nothing.  Classes
    are dealt by a hash into parts of about :data:`PART`, and a task indexes one
    part by segments of its codes and searches it for a block of queries
    (:class:`CodeIndex`): bits are flipped and values looked up inside the task,
    so that neither flipped values nor candidates are rows, and what leaves it
    is k classes a query at most.  The nearest of all parts are the result.

    Fewer than k rows are returned only if there are fewer.  Repeated rows are
    rows of their own; null ids or codes must be left out before; empty tables
    give no rows.
    """
    spark = codes.sparkSession
    first = Window.partitionBy("code").orderBy("id")
    ranked = codes.select("id", "code").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    members, classes = materialize_count(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    wanted, n = materialize_count(queries.select(F.col("code").alias("q")).distinct(), "search-queries")
    parts = -(-max(1, classes) // PART)
    blocks = max(1, min(-(-4 * spark.sparkContext.defaultParallelism // parts), n // BLOCK))
    dealt = lambda c, i: F.pmod(F.xxhash64(c), F.lit(i)).cast("int")
    every = lambda i: F.explode(F.sequence(F.lit(0), F.lit(i - 1)))
    stored = members.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("copies"), dealt("code", parts).alias("part"))
    stored = stored.withColumn("block", every(blocks)).repartition(parts * blocks, "part", "block")
    asked = wanted.withColumn("block", dealt("q", blocks)).withColumn("part", every(parts)).repartition(parts * blocks, "part", "block")

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        q = asking["q"].to_numpy(np.int64)
        if not len(own) or not len(q):
            return pd.DataFrame({"q": q[:0], "code": q[:0], "distance": q[:0]})
        index = CodeIndex(own["code"].to_numpy(np.int64).view(np.uint64), own["least"].to_numpy(np.int64), own["copies"].to_numpy(np.int64))
        who, code, distance = index.search(q.view(np.uint64), k)
        return pd.DataFrame({"q": q[who], "code": code.view(np.int64), "distance": distance})

    met = stored.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(search, "q long, code long, distance int")
    near = materialize(met, "search-met")
    # Neither side is sent to all tasks: Parquet sizes say little about rows with arrays.
    rows = near.hint("merge").join(members, "code").select("q", F.posexplode("ids").alias("copy", "id"), "distance")
    order = Window.partitionBy("q").orderBy("distance", "id", "copy")
    ranks = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "id", "distance", "rank")
    return queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(ranks.hint("merge"), "q").select("query_id", "rank", "id", "distance")
