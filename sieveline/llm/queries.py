"""The registered queries of this package: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import filter_audit, sharding, spelling, url_rules
from sieveline.llm.common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    from sieveline.llm.piece_codec import encode_documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode_documents(docs, tokenizer("piece_bpe_32k.model")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to earlier documents."""
    from sieveline.llm.suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), result="digest")


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed along the curve."""
    from sieveline.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out rows are not learned from."""
    from sieveline.llm.toxicity import score_toxicity

    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the weakly supervised rules for every document."""
    from sieveline.llm.quality import judge_quality

    return judge_quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    from sieveline.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from sieveline.llm.language import predict_language

    return predict_language(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    from sieveline.llm.url_rules import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates that each document holds."""
    from sieveline.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    from sieveline.llm.edit_prints import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with their near words, forms and roots."""
    return spelling.group_variants(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove by source, under each order of them."""
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard with one more."""
    return sharding.shard_documents(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_suffix_dedup, op3_hilbert_packing, op4_toxicity, op5_quality_rules, op6_minhash_near_dup, op7_language_id, op8_url_filter, op9_license_scan, op10_edit_fingerprints, op11_spelling_variants, op12_filter_audit, op13_jump_sharding)}
ORACLE_SQL: dict[str, str] = {"op8_url_filter": url_rules.SQL, "op11_spelling_variants": spelling.SQL, "op12_filter_audit": filter_audit.SQL, "op13_jump_sharding": sharding.SQL}
