"""A training corpus from ``documents``: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read back as the next one's docs.  All but the last return the
columns of ``documents``; other columns of its input are left out.  An empty
table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import linededup, mixing, nearcopies, packing, quality
from helixframe.llm.tokens import vocabulary
from helixframe.tables import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    A null or empty text has no words and goes; with a null language the script
    decides; null or repeated ids are judged row by row.
    """
    import public_tokenizers

    return quality.filter_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses lines and keeps only white space goes.

    Rows with one id are one document and share its lines; rows with a null id
    are one that comes last.  A null or blank text that loses nothing stays.
    ``n_chars`` counts the text that is left, and is null for a null text.
    """
    kept = linededup.deduplicate_lines(docs)
    text = F.col("text")
    blank = F.btrim(text, F.lit(" \t\n\v\f\r")) == ""
    return kept.where((F.col("n_dropped") == 0) | ~blank).withColumn("n_chars", F.char_length(text).cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are alike to 0.8 or more: that with the smallest id.

    SimHash anchors find candidates, and bands of minima those that lie out of
    their reach; shingle sets decide.  Rows with one id but different texts are
    rows of their own (of equal ids the smaller hash of the text comes first);
    rows without an id come last; rows equal in id and text are one.  Texts
    without words are one group.
    """
    keyed = docs.withColumn("row", F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("digest")))
    leaders = nearcopies.near_copies(keyed, "row").select(F.col("leader").alias("row")).distinct()
    return keyed.join(leaders, "row", "left_semi").dropDuplicates(["row"]).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy a row.

    Texts without words are never taken; a null source is a source; null or
    repeated ids are taken row by row.
    """
    taken = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return taken.where("copies > 0 and size > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; every row is packed, a null text as an empty one."""
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: fingerprints, components and tokenisation are beyond it; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
