"""The two learned models against direct evaluation, and every operator on a text of ten megabytes."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from sieveline.llm import edit_prints, filter_audit, language, licenses, near_dup, packing, piece_codec, quality, sharding, spelling, suffix_dedup, toxicity
from tests.llm.test_operators import BYTES, PIECES, SCHEMA, prose


def laid_out(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def grams(text):
    """The buckets of a text's n-grams, one after the other."""
    raw, out, mask = text.encode().lower(), set(), (1 << 32) - 1
    for n in language.SIZES:
        for i in range(len(raw) - n + 1):
            g = int.from_bytes(raw[i : i + n], "big")
            x = ((g ^ (g >> 15)) * 0x9E3779B1 + (n * 0x85EBCA6B & mask)) & mask
            x = ((x ^ (x >> 13)) * 0xC2B2AE35) & mask
            out.add(x >> (32 - language.BITS))
    return out


def kernel(a, b):
    return len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))


TEXTS = ["the cat sat on the mat and looked at the moon", "der Hund läuft über die große Straße", "le chat est sur la table", "", "a", "ab", "The CAT", "ÀÉ 漢字"]


def test_presence_and_kernel_are_those_of_gram_sets():
    sets, found = [grams(t) for t in TEXTS], language.presence(*laid_out(TEXTS))
    assert [set(np.flatnonzero(r)) for r in found] == sets
    scaled = found / np.sqrt(np.maximum(found.sum(1, keepdims=True, dtype=np.float32), 1))
    want = [[kernel(a, b) for b in sets] for a in sets]
    assert np.allclose(language._kernel(found, scaled), want, atol=1e-5)


def sentences(lang, n, seed):
    own = {"en": "the of and to in is that it was for on are with his they", "de": "der die und in den von zu das mit sich des auf für ist im", "fr": "le de un être et à il avoir ne je son que se qui ce"}[lang].split()
    rng = random.Random(f"{lang}{seed}")
    return [" ".join(rng.choices(own, k=rng.randint(3, 14))) for _ in range(n)]


def test_language_scores_are_those_of_a_direct_solve(spark):
    """Kernel by set intersection, Nyström features by the landmarks' kernel matrix, ridge as one augmented least-squares problem."""
    rows = [(i, t, lang, "s", 1) for i, (lang, t) in enumerate((lang, t) for lang in ("en", "de", "fr") for t in sentences(lang, 40, 1))]
    docs = spark.createDataFrame(rows, SCHEMA)
    x, langs = language._sample(docs, "doc_id", "text", "lang")
    names, marks, _ = language.fit(x, langs)
    sample, landmarks = ([set(np.flatnonzero(r)) for r in m] for m in (x, marks))
    values, vectors = np.linalg.eigh([[kernel(a, b) for b in landmarks] for a in landmarks])
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = lambda sets: np.hstack([np.array([[kernel(s, m) for m in landmarks] for s in sets]) @ root, np.ones((len(sets), 1))])
    phi, label = features(sample), np.array([names.index(v) for v in langs])
    weight = np.sqrt(1 / np.bincount(label)[label])[:, None]
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    left = np.vstack([phi * weight, math.sqrt(language.RIDGE) * np.eye(phi.shape[1])])
    right = np.vstack([target * weight, np.zeros((phi.shape[1], len(names)))])
    solved = np.linalg.lstsq(left, right, rcond=None)[0]
    want = features([grams(r[1]) for r in rows]) @ solved
    got = {r.doc_id: r for r in language.predict_language(docs).collect()}
    for (i, *_), own in zip(rows, want):
        order = np.sort(own)
        assert abs(got[i].score - np.clip((order[-1] + 1) / 2, 0, 1)) < 2e-3
        assert got[i].lang_pred == names[int(own.argmax())] or order[-1] - order[-2] < 4e-3
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows]) > 0.97


def test_toxicity_scores_are_those_of_explicit_pairs(spark):
    """Terms word by word, and a sum over all pairs of terms."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        words, toxic = [rng.choice(("apple", "river", "Stone", "cloudy", "garden2", "ein", "über")) for _ in range(rng.randint(0, 12))], rng.random() < 0.4
        words += ["idiotically", "grouplings"] if toxic else rng.choice((["idiotically"], ["grouplings"], []))
        rng.shuffle(words)
        rows.append((i, rng.choice((" ", "-", ". ")).join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    terms, sizes, y = toxicity._sample(docs, known, "doc_id", "text", "toxic")
    model = toxicity.FactorizationMachine()
    model.fit(terms, sizes, y)
    of_word = lambda w: set(toxicity._terms(*laid_out([w]))[0].tolist())
    used = 0
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    for i, text, *_ in rows:
        own = sorted(set().union(*(of_word(w) for w in re.findall(r"[A-Za-z0-9\u0080-\U0010FFFF]+", text))))
        pairs = sum(float(model.v[a].astype(float) @ model.v[b].astype(float)) for a, b in itertools.combinations(own, 2))
        used += abs(pairs) > 1e-3
        logit = model.bias + sum(float(model.w[t]) for t in own) + pairs
        want = 1 / (1 + math.exp(-(model.scale * (logit - model.middle) + math.log(0.7 / 0.3))))
        assert abs(got[i].score - want) < 1e-4 and got[i].predicted == int(got[i].score >= 0.7)
    assert used > 50


BIG = None


def big():
    global BIG
    if BIG is None:
        BIG = (prose(77, 4000) + " Größe\n") * (10_000_000 // len((prose(77, 4000) + " Größe\n")) + 1)
    return BIG


@pytest.mark.parametrize("name", ["codec", "dedup", "pack", "toxic", "quality", "near", "language", "license", "print", "variants", "audit", "shards"])
def test_ten_megabytes(spark, name):
    """Two equal long texts and a short one: whole texts count."""
    text = big()
    docs = spark.createDataFrame([(0, text, "en", "a", 1), (1, text, "en", "a", 1), (2, "short", "de", "b", 1)], SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    n = len(text.encode())
    if name == "codec":
        import sentencepiece

        ids = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
        rows = {r.doc_id: r for r in piece_codec.encode_documents(docs.where("doc_id > 0"), PIECES).collect()}
        assert rows[1].ids == ids
    elif name == "dedup":
        rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, result="digest").collect()}
        assert (rows[0].n_bytes, rows[0].n_removed, rows[1].n_removed) == (n, 0, n)
    elif name == "pack":
        rows = packing.pack_documents(docs.where("doc_id <> 1"), BYTES).where("doc_id = 0").collect()
        assert sum(r.length for r in rows) == rows[0].doc_tokens > n / 8
    elif name == "toxic":
        assert len({r.score for r in toxicity.score_toxicity(docs, labels).where("doc_id < 2").collect()}) == 1
    elif name == "quality":
        assert quality.judge_quality(docs).where("doc_id = 0").head()["n_words"] == len(text.split())
    elif name == "near":
        rows = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
        words = text.lower().split()
        assert rows[0].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and rows[1].component_id == 0
    elif name == "language":
        assert language.predict_language(docs).count() == 3
    elif name == "license":
        assert licenses.scan_licenses(docs).count() == 0
    elif name == "print":
        rows = {r.doc_id: r for r in edit_prints.plain_fingerprints(docs).collect()}
        assert rows[0].fingerprint == rows[1].fingerprint != rows[2].fingerprint
    elif name == "variants":
        assert spelling.group_variants(docs).where("n >= 100").count() > 0
    elif name == "audit":
        assert filter_audit.audit_filters(docs, labels).where("filter_order = 'ABCDE' and part = 'a'").count() == 5
    else:
        assert {r.size for r in sharding.shard_documents(docs).where("doc_id < 2").collect()} == {n + 1}
