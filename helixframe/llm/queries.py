"""The registered ``opN_*`` queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, chunks, hamming, katz, lexical, linededup, mixing, packing, quality, repair, secrets, sharding, simhash
from .tokens import vocabulary
from ..tables import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fertility() -> tuple[str, tuple[str, str]]:
    """The two vocabularies that measure fertility."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of ``embeddings``, by sign codes, to every row whose id is divisible by 100."""
    codes = hamming.sign_codes(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.top_k(codes, codes.where("id % 100 = 0"), k=10).withColumnRenamed("id", "vec_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in sequences of at most 2048 ids."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), *vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "sequence_cost"
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``, single and linked."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("spans", lambda s: s.kind == n)).cast("long")
    base = F.filter("spans", lambda s: s.kind < secrets.BASE)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of source, language and every line of the text of ``documents``, each encoded whole."""
    return attribution.count_tokens(_table(spark, sf_dir, "documents"), *vocabulary(), fields=("source", "lang", "text"), sectioned="text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and tokeniser fertility of every row of ``documents``."""
    return quality.apply_rules(_table(spark, sf_dir, "documents"), *_fertility())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` mixed by source with weights 5, 2, 1."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in shards of at most 256 KiB of text."""
    return sharding.shard(_table(spark, sf_dir, "documents"), max_bytes=256 << 10)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that a document with a smaller id has."""
    kept = linededup.deduplicate_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that a document with a smaller id has."""
    return chunks.repeated_passages(_table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with about a quarter of the rows damaged by a fixed rule; ``copies`` is 0 for a dropped row and 2 for a repeated one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged ``conversations``, what is wrong with each and its cheapest repair."""
    pieces = materialize(repair.repair(damaged(_table(spark, sf_dir, "conversations")), copies_col="copies"), "repaired")
    report = pieces.where("piece = 0").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    digests = repair.digests(pieces).withColumnRenamed("conv_id", "of")
    return report.join(digests, report.conv_id.eqNullSafe(digests.of)).drop("of")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of ``documents`` for every item of ``benchmark``."""
    index = materialize(lexical.build_index(_table(spark, sf_dir, "documents")), "lexical-index")
    return lexical.search(index, _table(spark, sf_dir, "benchmark"), k=10)


def op13_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` under a bigram model of nine tenths of them; a null id is the empty text here."""
    documents = _table(spark, sf_dir, "documents")
    return katz.score(documents, F.crc32(F.coalesce(documents.doc_id.cast("string"), F.lit(""))) % 10 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_topk_search, op2_packing, op3_secrets, op4_token_counts, op5_quality_rules, op6_mixing, op7_sharding, op8_simhash,
        op9_line_dedup, op10_substring_dedup, op11_structure_repair, op12_lexical_search, op13_katz_scores, pipeline,
    )
    return {f.__name__: f for f in named}
