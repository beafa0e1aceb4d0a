"""The pipeline's stages on small tables, and its registration."""

import pytest

from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, brute_repeats, edge_rows, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = edge_rows()[:-1] + [(100 + i, prose(i + 50, 60) + ". And so on.", "en", "s", 5) for i in range(30)] + [(200, prose(50, 60) + ". And so on.", "en", "s", 5)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {3, 4, 5} & seen["language"] == set() and 100 in seen["repeated_passages"]
    assert 9 not in seen["quality"] and 200 in seen["quality"] and 200 not in seen["near_duplicate"]
    assert docs.where("length(text) <> n_chars or text = ''").count() == 0
    tokens = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in tokens.select("doc_id").distinct().collect()} == seen["repeated_passages"]


def test_stages_with_extra_columns_and_empty(spark, folder):
    import corpus_pipeline
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("n_bytes", F.lit("b"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        assert docs.columns[-2:] == ["kept", "n_bytes"] and docs.count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    rows = [(0, "some words", None, None, None), (1, "漢字", None, None, None), (2, "12 !", None, None, None), (3, None, None, None, None), (None, "über", None, None, None)]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r.doc_id for r in kept.collect()} == {0, 1, None}


def test_rows_without_or_with_repeated_ids(spark):
    import corpus_pipeline

    clean = [prose(i + 70, 60) + ". And so on." for i in range(40)]
    rows = [(i, t, "en", "s", 5) for i, t in enumerate(clean)] + [(3, clean[3], "en", "s", 5)] * 3 + [(None, prose(7, 60) + ". So.", "en", "s", 5), (None, None, "en", "s", 5), (50, clean[9], "de", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("own column 2", F.lit("c"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, ""), name)
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted(str(i) for i, _ in got) == sorted([*map(str, range(40)), "None"]) and docs.columns[-1] == "own column 2"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.where("start = 0").count() == 41


def test_stages_equal_a_walk_over_documents(spark, folder):
    """The verdicts of each stage, by the functions that test_operators holds against brute force."""
    import corpus_pipeline
    from sieveline.llm import near_dup, quality

    docs = corpus_pipeline.staged(corpus_pipeline.language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), "l")
    assert {r.doc_id for r in docs.collect()} == {i for i, t, *_ in edge_rows()[:-1] if t and any(c.isalpha() for c in t)} | set(range(100, 130)) | {200}
    kept = {r.doc_id for r in quality.judge_quality(docs).where("kept").collect()}
    docs = corpus_pipeline.staged(corpus_pipeline.quality(spark, docs, folder), "q")
    assert {r.doc_id for r in docs.collect()} == kept
    first = {r.doc_id for r in near_dup.near_duplicates(docs).where("kept").collect()}
    docs = corpus_pipeline.staged(corpus_pipeline.near_duplicate(spark, docs, folder), "n")
    assert sorted(r.doc_id for r in docs.collect()) == sorted(first)
    want = {i: left.decode("utf-8", "ignore") for i, (_, _, _, left) in brute_repeats([(r.doc_id, r.text) for r in docs.collect()]).items()}
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, folder).collect()}
    assert left == {i: t for i, t in want.items() if t}


def test_the_predicted_language_reaches_the_sequences(spark, tmp_path):
    import random

    import corpus_pipeline

    words = {"en": "the cat and the dog with that house", "de": "der hund und die katze mit dem haus"}
    true = {i: "en" if i % 2 else "de" for i in range(240)}
    texts = {i: " ".join(random.Random(i).choices(words[v].split(), k=60)) + str(i) + "." for i, v in true.items()}
    label = {i: None if i % 3 == 0 else "de" if i == 121 else v for i, v in true.items()}
    docs = spark.createDataFrame([(i, texts[i], label[i], "s", 1) for i in true], SCHEMA)
    told = corpus_pipeline.language(spark, docs, "")
    assert {r.doc_id: r.lang for r in told.collect()} == true
    got = corpus_pipeline.packing(spark, told, "").collect()
    assert {(r.doc_id, r.lang) for r in got} == set(true.items())
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, set()).add(r.lang)
    mixed = sum(len(v) > 1 for v in held.values())
    assert mixed <= len({s >> 40 for s in held}) < len(held) / 2  # one change of language in each stretch at most
    again = corpus_pipeline.packing(spark, docs.drop("lang"), "")
    assert "lang" not in again.columns and again.select("doc_id").distinct().count() == 240


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14))
