"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Hash digits by id and text; sixteen more part rows equal in both.
KEY_DIGITS = 10
#: Bits that a round of the directory adds: two hexadecimal digits.
STEP = 8


def shard_key(doc_id: Column, text: Column) -> Column:
    """The first 40 bits of the MD5 of id and text, as hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))), 1, KEY_DIGITS)


def shard(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard: doc_id, bytes, shard, depth, shard_bytes, shard_rows.

    A shard is a prefix of the row's hash: ``shard`` has its bits, ``depth``
    their number.  The directory starts with one bucket; a bucket of more than
    ``max_bytes`` bytes of text splits on the next bit, all others stay, until
    every one fits or holds a single row.  The directory is built a few bits at
    a time from byte sums per prefix: each round reads only the rows in buckets
    that are still too large, and its tables are as long as the directory.  Rows
    equal in id and text part on 64 further bits, a scrambled row number that is
    drawn once and written down with them; no two rows have the same, so every
    bucket gets to one row if it must.

    A null text has 0 bytes; null or repeated ids are kept row by row; a single
    row over the limit is a shard of its own; other columns are ignored; an
    empty table gives no rows.
    """
    doc_id, text = docs[id_col].cast("long"), docs[text_col]
    # XXH64 of one long maps different numbers to different ones.
    own = F.lower(F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0"))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.concat(shard_key(doc_id, text), own).alias("key"))
    rows = materialize(rows, "shard-rows")
    bits = lambda digits: F.concat_ws("", F.transform(F.split(digits, "(?<=.)(?=.)"), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")))
    parts, still_open, depth = [], None, 0
    while True:
        digits = depth // 4
        inside = rows.withColumns({"root": F.substring("key", 1, digits), "cell": F.conv(F.substring("key", digits + 1, STEP // 4), 16, 10).cast("int")})
        if still_open is not None:
            inside = inside.join(still_open, ["root"], "left_semi")
        cells = inside.groupBy("root", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).repartition("root")
        chosen = F.lit(None).cast("struct<depth int, bytes bigint, rows bigint>")
        for extra in reversed(range(STEP + 1)):
            cells = cells.withColumn(f"at_{extra}", F.shiftright("cell", STEP - extra))
            same = Window.partitionBy("root", f"at_{extra}")
            total, count = F.sum("bytes").over(same), F.sum("rows").over(same)
            chosen = F.when((total <= max_bytes) | (count == 1), F.struct(F.lit(depth + extra).alias("depth"), total.alias("bytes"), count.alias("rows"))).otherwise(chosen)
        cells = materialize(cells.withColumn("leaf", chosen).select("root", "cell", "leaf"), "shard-cells")
        found = inside.join(cells.where("leaf is not null"), ["root", "cell"])
        found = found.withColumn("bits", bits(F.substring("key", 1, digits + STEP // 4)))
        parts.append(
            found.select(
                "doc_id", "bytes", F.expr("left(bits, leaf.depth)").alias("shard"), F.col("leaf.depth").alias("depth"),
                F.col("leaf.bytes").alias("shard_bytes"), F.col("leaf.rows").alias("shard_rows"),
            )
        )
        still_open = cells.where("leaf is null").select(F.concat("root", F.lower(F.lpad(F.hex("cell"), STEP // 4, "0"))).alias("root"))
        if still_open.isEmpty():
            break
        depth += STEP
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
