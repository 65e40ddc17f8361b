"""Credentials in texts: single findings, and parts that only count where complementary ones stand near."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_JOIN = r"""["']?\x20*[:=]\x20*["']?"""

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _JOIN

#: Fixed values.  Kinds in order: name, pattern, pattern that a finding must match as a whole, role, and strings of which a
#: text must have one for any finding.  Findings of the first three count by themselves; of the others only where linked.
KINDS = (
    ("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", "^" + _ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}$", "secret", (":", "=")),
    ("access", r"AKIA[A-Z0-9]+", r"^.{20,}$", "identifier", ("AKIA",)),
    ("hex", r"[0-9a-f]{24,}", r"^.", "secret", ()),
    ("login", r"(?i:user(?:name)?|login|account|client_?id|access_?key_?id)" + _JOIN + r"[A-Za-z0-9+/_.=@-]+", r"^.", "identifier", (":", "=")),
    ("endpoint", r"(?i:https?|ftp|jdbc:[a-z]+|mongodb|redis|amqp)://[A-Za-z0-9._:@-]+", r"^.", "endpoint", ("://",)),
    ("blob", r"[A-Za-z0-9+/_-]{20,}", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", "secret", ()),
)
BASE = 3
#: Two parts are in one scope if they start at most so many code points apart.
SCOPE = 200
_MARK, _OTHER = "\u0001", "\u0002"


def _pieces(text: Column, number: int) -> Column:
    """The text cut at the findings of one kind: array<struct<kind, at, length, found>>, one piece without a finding."""
    _, pattern, whole, _, needs = KINDS[number]
    marked = F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}")
    if needs:
        marked = F.when(reduce(or_, (text.contains(n) for n in needs)), marked).otherwise(text)
    kind = F.lit(number)
    return F.transform(
        F.split(marked, _MARK, -1), lambda p, i: F.struct(kind.alias("kind"), i.alias("at"), F.char_length(p).alias("length"), ((i % 2 == 1) & p.rlike(whole)).alias("found"))
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans) of every row; spans: array<struct<start, kind, end>> in this order, in code points, end exclusive.

    ``kind`` is a number of ``KINDS``.  Findings of each kind are leftmost and
    do not overlap; a finding of the first three kinds always counts.  The
    others are weak: logins, endpoints and blobs.  They are joined to the parts
    that start within ``scope`` code points and are reported only if a
    complementary one is there: a secret for a login or an endpoint, an
    identifier or an endpoint for a blob.  A login or blob inside a finding of
    the first kinds is not another one.  Only spans move, never texts, and a
    window over a document's spans stands for the interval join, so no pairs
    are formed.

    A null text is empty and gives an empty array.  Null or repeated ids are
    kept row by row; rows that are equal in id and text are found once and
    returned as often as they come; other columns are ignored; an empty table
    gives no rows.  Spans with one start stand in the order of kinds.  A text of
    any length is searched whole in one task.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    row = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("length"), F.lit(False).alias("found"))
    # The mark is no part of any pattern, and the one that stands in for it is as long.
    keyed = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.char_length(text).alias("chars"), F.when(text.contains(_MARK), F.translate(text, _MARK, _OTHER)).otherwise(text).alias("text"),
    )
    pieces = keyed.select("doc_id", "version", "chars", F.inline(F.concat(F.array(row), *(_pieces(F.col("text"), n) for n in range(len(KINDS))))))
    pieces = pieces.where("kind < 0 or at > 0 or length < chars")  # a kind without a finding leaves the whole text as one piece
    once = pieces.groupBy("doc_id", "version", "kind", "at", "length", "found").agg(F.count("*").alias("copies")).repartition("doc_id", "version")

    placed = once.withColumn("end", F.sum("length").over(Window.partitionBy("doc_id", "version", "kind").orderBy("at")))
    placed = placed.withColumn("start", F.col("end") - F.col("length")).where("found or kind < 0")
    role = lambda r: F.col("kind").isin([n for n, k in enumerate(KINDS) if k[3] == r]).cast("int")
    document = Window.partitionBy("doc_id", "version").orderBy("start")
    near = document.rangeBetween(-scope, scope)
    covered = F.max(F.when(F.col("kind").between(0, BASE - 1), F.col("end"))).over(document.rangeBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("free", ~F.col("kind").isin(3, 5) | F.coalesce(covered <= F.col("start"), F.lit(True)))
    part = lambda r: F.max(role(r) * F.col("free").cast("int")).over(near) == 1
    linked = placed.withColumns({"secret": part("secret"), "identifier": part("identifier"), "endpoint": part("endpoint")})
    reported = F.col("kind").between(0, BASE - 1) | (
        F.col("free") & F.when(F.col("kind").isin(3, 4), F.col("secret")).when(F.col("kind") == 5, F.col("identifier") | F.col("endpoint")).otherwise(False)
    )
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    each = linked.groupBy("doc_id", "version").agg(
        F.max(F.when(F.col("kind") < 0, F.col("copies"))).alias("copies"), F.sort_array(F.collect_list(F.when(reported, span))).alias("spans")
    )
    return each.select("doc_id", "spans", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), s.kind + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start.cast("string"), s.end.cast("string"))), ",")
