"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's
documents. All stages but the last return the columns of documents.

What holds for every stage: an empty table gives an empty table; other columns pass through whatever they are called; texts count
whole; decisions hold for rows, so rows with a null doc_id take part like others; ties are decided by the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import documents, staged
from sieveline.llm.language import UNKNOWN, predict_language
from sieveline.llm.near_dup import near_duplicates
from sieveline.llm.packing import pack_documents
from sieveline.llm.quality import judge_quality
from sieveline.llm.queries import tokenizer
from sieveline.llm.suffix_dedup import remove_repeats
from sieveline.operators.blooms import anti_join, semi_join


def _named(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with names for its other columns that clash with nothing, and the columns that give the names back."""
    back = {c: c if c in ("doc_id", "text") else f"own column {i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in back.items())), [F.col(f"`{n}`").alias(c) for c, n in back.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, with the predicted language as their `lang`, by which the last stage packs them.

    Labels may be missing or wrong, so the prediction from the whole text replaces them; where nothing can be learned they stay. Null texts
    and texts without a letter have no language and go, whether or not a language can be learned.
    """
    plain, back = _named(docs)
    lang = f"own column {docs.columns.index('lang')}" if "lang" in docs.columns else "own column none"
    if "lang" not in docs.columns:
        plain = plain.withColumn(lang, F.lit(None).cast("string"))
    found = predict_language(plain, lang=lang, carry=True).where(F.col("text").rlike(r"\p{L}"))
    return found.withColumn(lang, F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred")).otherwise(F.col(lang))).select(*back)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail. Repeated rows are judged alike."""
    plain, back = _named(docs)
    return judge_quality(plain, carry=True).where("kept").select(*back)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, in one row: of rows that repeat its doc_id the one with the smallest text.

    Texts without words are in no group; rows without a doc_id have no place in a group and stay.
    """
    plain, back = _named(docs)
    gone = near_duplicates(plain.select("doc_id", "text")).where("not kept and doc_id is not null").select("doc_id")
    left = anti_join(plain, gone, ["doc_id"])  # the texts of most rows that stay are not shuffled
    again = staged(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    rows = semi_join(left, again, ["doc_id"])
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in plain.columns)), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return anti_join(left, again, ["doc_id"]).select(*plain.columns).unionByName(one).select(*back)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; characters cut in part go, and documents left empty go."""
    plain, back = _named(docs)
    left = remove_repeats(plain, result="text").where("kept <> ''").withColumn("text", F.col("kept"))
    out = left.select(*back)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences for training, with the language of their documents; every row is packed, null texts as empty.

    Sequences are filled with one language after the other, so few hold more than one.
    """
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), group="lang" if "lang" in docs.columns else None)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SQL cannot express the language model, the expectation-maximisation or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
