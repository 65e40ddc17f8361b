"""Incremental, reversible deduplication of lines across documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .cuckoo import CuckooFilter
from ..tables import materialize

_REFERENCES = "doc_id bigint, version bigint, high bigint, low bigint"
#: Of the ``n`` references of a key, ``named`` are of documents with an id; without any, ``first_id`` and ``last_id`` are 0.
_COUNTS = ["shard", "high", "low", "n", "named", "first_id", "last_id"]
_PROBED = "shard int, high bigint, low bigint, n bigint, named bigint, first_id bigint, last_id bigint, seen boolean, filter binary"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit digest of a line without white space at its ends and with ASCII letters in lower case; None if too short."""
    line = line.strip(" \t\n\v\f\r")
    return blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= min_chars else None


def line_references(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, version, high, low): each row's different line keys; ``version`` tells texts with one id apart."""
    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "version", "high", "low")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys = [], []
            for text in batch.column(2):
                own = {k for line in (text.as_py() or "").split("\n") if (k := line_key(line, min_chars))}
                counts.append(len(own))
                keys += own
            both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=out)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text")).mapInArrow(run, _REFERENCES)


@dataclass(frozen=True)
class LineIndex:
    """Which documents hold which lines, as three tables in shared storage.

    ``references``: (doc_id, version, high, low), one row per text and line key.
    ``counts``: the exact reference counts per key, with the smallest and the
    largest id.  ``filters``: one cuckoo filter per shard of the keys, of all
    keys with a reference.  A new batch asks the filters first: a key that they
    don't know is new for certain and is appended; only the others meet the
    exact table.  Keys whose last reference goes leave their filter, so that
    deletions undo insertions.
    """

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def empty(spark, shards: int = 64) -> LineIndex:
        return LineIndex(
            spark.createDataFrame([], _REFERENCES),
            spark.createDataFrame([], "shard int, high bigint, low bigint, n bigint, named bigint, first_id bigint, last_id bigint"),
            spark.createDataFrame([], "shard int, filter binary"),
            shards,
        )

    def _grouped(self, references: DataFrame) -> DataFrame:
        """Counts of some references; combined before the shuffle, so a line that is everywhere is a few rows."""
        ends = [F.coalesce(f("doc_id"), F.lit(0)).alias(c) for f, c in ((F.min, "first_id"), (F.max, "last_id"))]
        grouped = references.groupBy("high", "low").agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), *ends)
        return grouped.select(F.pmod(F.xxhash64("high", "low"), F.lit(self.shards)).cast("int").alias("shard"), *_COUNTS[1:])

    def insert(self, references: DataFrame) -> LineIndex:
        """The index with the references of more documents (see :func:`line_references`)."""

        def probe(new: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            known = CuckooFilter.load(stored["filter"].iloc[0]) if len(stored) else CuckooFilter()
            high, low = new["high"].to_numpy(np.int64), new["low"].to_numpy(np.int64)
            seen = known.contains(high, low)
            # A false positive goes in as well: what is deleted later must have been inserted.
            known.insert(high[~seen], low[~seen])
            shard = (new if len(new) else stored)["shard"].iloc[0]
            kinds = {c: "Int64" for c in _COUNTS[1:]} | {"seen": "boolean"}
            last = pd.DataFrame({"shard": [shard], "filter": [known.dump()]}).reindex(columns=[*_COUNTS, "seen", "filter"]).astype(kinds)
            return pd.concat([new[_COUNTS].assign(seen=seen, filter=None).astype(kinds), last])

        grouped = self._grouped(references)
        probed = materialize(grouped.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, _PROBED), "line-probe")
        seen = probed.where("filter is null and seen").select(*_COUNTS)
        old, more = self.counts.alias("o"), seen.alias("s")
        merged = old.join(more, ["shard", "high", "low"], "full_outer").select(
            "shard", "high", "low",
            (F.coalesce("o.n", F.lit(0)) + F.coalesce("s.n", F.lit(0))).alias("n"),
            (F.coalesce("o.named", F.lit(0)) + F.coalesce("s.named", F.lit(0))).alias("named"),
            *(F.coalesce(f(*(F.when(F.col(f"{side}.named") > 0, F.col(f"{side}.{c}")) for side in "os")), F.lit(0)).alias(c) for f, c in ((F.least, "first_id"), (F.greatest, "last_id"))),
        )
        counts = merged.union(probed.where("filter is null and not seen").select(*_COUNTS))
        return LineIndex(
            self.references.union(references), materialize(counts, "line-counts"), probed.where("filter is not null").select("shard", "filter"), self.shards
        )

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents in ``doc_ids`` (doc_id; null: that of the rows without an id), as if they had never come."""
        gone = F.col("doc_id").eqNullSafe(F.col("gone_id"))
        doc_ids = doc_ids.select(F.col("doc_id").cast("long").alias("gone_id"))
        kept = materialize(self.references.join(doc_ids, gone, "left_anti"), "line-references")
        touched = self.references.join(doc_ids, gone, "left_semi").select("high", "low").distinct()
        left = self._grouped(kept.join(touched, ["high", "low"], "left_semi"))
        counts = materialize(self.counts.join(touched, ["high", "low"], "left_anti").select(*_COUNTS).union(left), "line-counts")
        unheld = touched.join(left, ["high", "low"], "left_anti").select(F.pmod(F.xxhash64("high", "low"), F.lit(self.shards)).cast("int").alias("shard"), "high", "low")

        def remove(old: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            known = CuckooFilter.load(stored["filter"].iloc[0])
            known.delete(old["high"].to_numpy(np.int64), old["low"].to_numpy(np.int64))
            return pd.DataFrame({"shard": stored["shard"].iloc[:1], "filter": [known.dump()]})

        filters = unheld.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(remove, "shard int, filter binary")
        return LineIndex(kept, counts, materialize(filters, "line-filters"), self.shards)

    def surplus(self) -> DataFrame:
        """(doc_id, version, high, low): references of keys that a smaller id holds as well; to a null id all others are smaller."""
        repeated = self.counts.where("first_id <> last_id or (named > 0 and named < n)").select("high", "low", "first_id")
        return self.references.join(repeated, ["high", "low"]).where("doc_id is null or doc_id <> first_id").select("doc_id", "version", "high", "low")

    def reshard(self, shards: int) -> LineIndex:
        """The same index with another number of shards, for when it has outgrown them; filters are built from the counts."""
        counts = self.counts.withColumn("shard", F.pmod(F.xxhash64("high", "low"), F.lit(shards)).cast("int"))

        def build(keys: pd.DataFrame) -> pd.DataFrame:
            known = CuckooFilter()
            known.insert(keys["high"].to_numpy(np.int64), keys["low"].to_numpy(np.int64))
            return pd.DataFrame({"shard": keys["shard"].iloc[:1], "filter": [known.dump()]})

        counts = materialize(counts, "line-counts")
        filters = counts.select("shard", "high", "low").groupBy("shard").applyInPandas(build, "shard int, filter binary")
        return LineIndex(self.references, counts, materialize(filters, "line-filters"), shards)


def drop_lines(docs: DataFrame, surplus: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """All columns of ``docs`` with the surplus lines cut out of the text, and ``n_lines`` and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped", "__of", "__version", "__keys")
    # Bounded by one text, whatever number of rows has its id.
    per_text = surplus.groupBy(F.col("doc_id").alias("__of"), F.col("version").alias("__version")).agg(F.collect_set(F.struct("high", "low")).alias("__keys"))
    own = docs[id_col].cast("long").eqNullSafe(per_text["__of"]) & (F.xxhash64(docs[text_col]) == per_text["__version"])
    rows = docs.join(per_text, own, "left").drop("__of", "__version")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names = batch.schema.get_field_index(text_col), batch.schema.names
            texts, totals, dropped = [], [], []
            for text, keys in zip(batch.column(at), batch.column("__keys")):
                lines = (text.as_py() or "").split("\n")
                totals.append(len(lines))
                if keys.is_valid:
                    cut = {np.array([k["high"], k["low"]], "<i8").tobytes() for k in keys.as_py()}
                    kept = [line for line in lines if line_key(line, min_chars) not in cut]
                    texts.append("\n".join(kept))
                    dropped.append(len(lines) - len(kept))
                else:
                    texts.append(text.as_py())
                    dropped.append(0)
            arrays = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i, c in enumerate(names) if c != "__keys"]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], [*(c for c in names if c != "__keys"), "n_lines", "n_dropped"]
            )

    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return rows.mapInArrow(run, schema)


def deduplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 2, shard_keys: int = 500_000
) -> DataFrame:
    """Every document with its repeated lines cut out, ``n_lines`` before that and ``n_dropped``; all other columns kept.

    Lines are split at line feeds.  A line's key is the line without white space
    at its ends and with ASCII letters in lower case.  Keys of at least
    ``min_chars`` code points that two or more documents hold stay only in the
    one with the smallest id; all else stays in place.  The documents go into a
    :class:`LineIndex` in ``batches`` batches by a hash of the id, with a shard
    for every ``shard_keys`` references at most, so that a shard stays small at
    any size; the result does not depend on either.

    A null or empty text is one empty line and stays as it is.  Rows with one id
    are one document; rows with a null id are one that comes last.  Columns
    named n_lines, n_dropped, __of, __version or __keys are replaced.  An empty table gives
    no rows.  A text of any length is split whole in one task.
    """
    references = materialize(line_references(docs, id_col, text_col, min_chars), "line-references")
    index = LineIndex.empty(docs.sparkSession, max(64, references.count() // shard_keys + 1))
    for b in range(batches):
        index = index.insert(references.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    return drop_lines(docs, index.surplus(), id_col, text_col, min_chars)
