"""The operators on small tables: brute-force results, and the cases that each docstring defines."""

import collections
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from sieveline.llm import edit_prints, graph, language, licenses, linking, near_dup, packing, piece_codec, quality, suffix_dedup, toxicity, url_rules

PIECES, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def edge_rows():
    base = prose(1, 80)
    near = base.split()
    near[40] = "changed"
    return [
        (0, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, " ".join(near), None, None, None),
        (3, None, "en", "b", 0),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 3),
        (6, "A", "en", "b", 1),
        (7, "über Größe 漢字 😀 " * 3, "de", "c", 40),
        (8, "x" * 9000 + " " + prose(2, 3000), "en", "c", None),
        (9, "same line\n" * 30, "en", "c", 300),
        (9, "same line\n" * 30, "en", "c", 300),
        (10, prose(3, 30) + " " + base[:300], "en", "d", 9),
        (None, base, None, None, None),
    ]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def clash(edge):
    names = ("kept", "score", "n_bytes", "ids", "component_id", "fingerprint", "part", "k", "h", "id", "c0", "rest")
    return edge.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(11)] + [(0, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def every(docs, labels):
    return {
        "codec": piece_codec.encode_documents(docs, PIECES),
        "dedup": suffix_dedup.remove_repeats(docs),
        "pack": packing.pack_documents(docs, BYTES),
        "toxic": toxicity.score_toxicity(docs, labels),
        "quality": quality.judge_quality(docs),
        "near": near_dup.near_duplicates(docs),
        "language": language.predict_language(docs),
        "carried": language.predict_language(docs, carry=True),
        "license": licenses.scan_licenses(docs),
        "print": edit_prints.fingerprint_documents(docs),
        "plain": edit_prints.plain_fingerprints(docs),
    }


def test_empty_tables(none, labels):
    for name, df in every(none, labels).items():
        assert df.count() == 0, name


def test_clashing_columns_and_nulls(edge, clash, labels):
    n = len(edge_rows())
    for name, df in every(clash, labels).items():
        rows = df.collect()
        assert len(rows) == n or name in ("pack", "license"), name
    assert every(edge, labels)["dedup"].count() == n


def test_codec_equals_library(spark):
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.codec(PIECES)
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab the ▁\n\t09éß漢😀<>=.", k=rng.randint(0, 70))) for _ in range(1500)] + ["a" * 500, " " * 70, "<s></s>", "<0x0A>"]
    for text, ids in zip(texts, model.encode(texts)):
        assert own.encode(text) == ids
        assert own.decode(ids) == model.decode(ids) == own.round_trip(text)[1]
    df = piece_codec.encode_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:50])], "doc_id long, text string"), PIECES, decoded=None)
    back = {r.doc_id: r.decoded for r in piece_codec.decode_documents(df, PIECES).collect()}
    assert all(back[i] == model.decode(model.encode(t)) for i, t in enumerate(texts[:50]))


def brute_repeats(rows):
    first, out = {}, {}
    for i, text in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        raw = text.encode()
        for s in range(len(raw) - 49):
            first.setdefault(raw[s : s + 50], i)
    for i, text in [(r[0], r[1] or "") for r in rows]:
        raw, gone = text.encode(), set()
        for s in range(len(raw) - 49):
            if first.get(raw[s : s + 50], i if i is not None else -1) < (i if i is not None else 1 << 62):
                gone.update(range(s, s + 50))
        left = bytes(b for k, b in enumerate(raw) if k not in gone)
        out[i] = (len(raw), len(gone), sum(k - 1 not in gone for k in gone), left)
    return out


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_suffix_dedup_equals_brute_force(spark, block):
    rng = random.Random(8)
    shared = [prose(s, 12) for s in range(4)] + ["ab" * 60, "z" * 130]
    rows = edge_rows() + [(i, prose(i, rng.randint(0, 20)) + rng.choice(shared)[rng.randint(0, 9) :] + prose(-i, 3) + rng.choice(shared), "en", "s", 1) for i in range(20, 60)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
    want = brute_repeats(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert {(r.lang, r.source) for r in got if r.doc_id == 2} == {(None, None)}


def test_anchors_are_even_over_shards():
    data = np.frombuffer(prose(5, 20_000).encode(), np.uint8)
    h = suffix_dedup.anchors(data, np.array([0, len(data)]))[3]
    shares = np.bincount((h >> np.uint64(61)).astype(int), minlength=8) / len(h)
    assert 0.1 < shares.min() and shares.max() < 0.15


def test_a_large_anchor_is_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    n, mark = 3000, np.frombuffer(b"the the the the the the ", np.uint8)
    slices = rng.integers(97, 123, (n, 76)).astype(np.uint8)
    slices[:, 26:50] = mark
    slices[1::3, :40] = slices[0, :40]
    slices[2::7] = slices[2]
    doc = rng.integers(0, n // 2, n)
    sizes, sort = [], suffix_dedup._sort_bucket

    def seen(text, begin, count, *rest):
        sizes.append(int((count + suffix_dedup.WIDTH - 1 + suffix_dedup.V).sum()))
        return sort(text, begin, count, *rest)

    monkeypatch.setattr(suffix_dedup, "_sort_bucket", seen)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 40_000)
    got = suffix_dedup.repeated_windows(slices.ravel(), np.arange(n) * 76, np.full(n, 27), np.full(n, 26), np.full(n, 9, np.uint64), doc)
    strings = [slices[i, k : k + 50].tobytes() for i in range(n) for k in range(27)]
    least = {}
    for s, d in zip(strings, np.repeat(doc, 27)):
        least[s] = min(d, least.get(s, d))
    assert got.tolist() == [least[s] < d for s, d in zip(strings, np.repeat(doc, 27))] and got.any()
    assert len(sizes) > 1 and max(sizes) <= 80_000


def test_anchors_of_many_strings_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 60)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    rng = random.Random(4)
    passages = [prose(s, 6) for s in range(3)] + ["the " * 40]
    rows = [(i, prose(i, rng.randint(0, 3)) + rng.choice(passages) + prose(-i, 2) + rng.choice(passages), "en", "s", 1) for i in range(60)] + [(None, passages[0], None, None, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), block=700).collect()
    want = brute_repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_the_greatest_key_is_no_null(spark):
    passage, top = prose(3, 12), (1 << 63) - 1
    rows = [(top, passage), (top - 1, prose(1, 3) + passage), (-5, prose(2, 3)), (None, passage), (None, prose(4, 9))]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = {i: len(t.encode()) for i, t in rows[:3]}
    n = len(passage)
    assert got == {(top, n): n, (top - 1, size[top - 1]): 0, (-5, size[-5]): 0, (None, n): n, (None, len(rows[4][1])): 0}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([(top, "a"), (-top - 1, "b")], "doc_id long, text string"))


def test_shards_follow_stored_bytes_and_wide_anchors_are_dealt_out(spark, monkeypatch):
    rng = random.Random(9)
    shared = [prose(s, 9) for s in range(3)]
    rows = [(i, prose(i, rng.randint(0, 4)) + rng.choice(shared), "en", "s", 1) for i in range(40)]
    want = brute_repeats(rows)
    monkeypatch.setattr(suffix_dedup, "SHARD", 100)
    monkeypatch.setattr(suffix_dedup, "WIDE", 2)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), block=500).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_difference_cover():
    cover = suffix_dedup.COVER.tolist()
    assert {(a - b) % suffix_dedup.V for a in cover for b in cover} == set(range(suffix_dedup.V))
    assert suffix_dedup.AHEAD.max() <= 8  # one word reaches the next sample position


def test_ranges_are_even_in_bytes(spark):
    rng = np.random.default_rng(4)
    k = rng.integers(0, 1 << 40, 20_000)
    size = np.where(k < 1 << 37, 4000, 40) + rng.integers(0, 400, len(k))
    df = spark.createDataFrame(list(zip(k.tolist(), size.tolist())), "k long, size long").repartition(5)
    for n in (2, 51):
        cuts = packing.even_cuts(df, n)
        sums = np.bincount(np.searchsorted(cuts, k, "left"), size, n)
        assert len(cuts) == n - 1 and sums.max() < 1.25 * np.median(sums)
    assert len(packing.even_cuts(df, 1)) == 0 and len(packing.even_cuts(df.limit(0), 4)) == 0
    assert len(packing.even_cuts(df.where(f"k = {k[0]}"), 4)) <= 1


def test_packing_is_whole(edge):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTES)
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack_documents(edge.where("doc_id is not null and doc_id <> 9"), BYTES, with_ids=True).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text, *_ in edge_rows():
        if i is None or i == 9:
            continue
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(pieces[i], key=lambda r: r.start)
        assert list(itertools.chain(*(p.ids for p in parts))) == ids
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in parts)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_ids_equal_library():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(BYTES), packing.ByteTokenizer(BYTES)
    rng, parts = random.Random(9), ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "a", "don't", "12", "é", "漢", "😀", ".", "\u00a0", "the "]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert own.encode(text) == plain.encode(text, add_special_tokens=False).ids, text
    assert 50256 in own.encode("a<|endoftext|>b")
    for text in ("a" * 300_000, " " * 300_000 + "x", "ab \n" * 100_000, "^" * 100_000):
        assert own.encode(text) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_packing_uses_the_library_for_other_files(tmp_path, change):
    import json

    from tokenizers import Tokenizer

    path = tmp_path / "other.json"
    path.write_text(json.dumps(json.load(open(BYTES)) | change))
    assert packing.ByteTokenizer(str(path)).encode("Some TEXT") == Tokenizer.from_file(str(path)).encode("Some TEXT", add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert(points, 3)
    walk = points[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_toxicity_learns_pairs_and_ignores_held_out():
    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        sets.append(np.unique(np.concatenate([rng.integers(100, 400, 6), [1] * a, [2] * b]).astype(np.int64)))
        y.append(int(a and b))
    model = toxicity.FactorizationMachine()
    sizes, y = np.array([len(s) for s in sets]), np.array(y)
    model.fit(np.concatenate(sets), sizes, y)
    right = ((model.scores(np.concatenate(sets), sizes) >= 0.7) == y).mean()
    assert right > 0.97


def fits(train, test):
    model = toxicity.FactorizationMachine()
    rows = [(np.concatenate(sets), np.array([len(s) for s in sets]), np.array(y)) for sets, y in (train, test)]
    model.fit(*rows[0])
    said = model.scores(*rows[1][:2]) >= 0.7
    return said[rows[1][2] == 1].mean(), 1 - said[rows[1][2] == 0].mean()


def test_toxicity_pairs_of_terms_with_equal_rates():
    def table(seed):
        rng, sets, y = np.random.default_rng(seed), [], []
        for _ in range(3000):
            a, b = rng.integers(0, 2, 2)
            sets.append(np.unique(np.concatenate([rng.integers(100, 400, 40), [1] * a, [2] * b]).astype(np.int64)))
            y.append(int(a == b))
        return sets, y

    caught, spared = fits(table(1), table(2))
    assert caught > 0.97 and spared > 0.97


@pytest.mark.parametrize("named", [0.3, 0.5, 0.7])
def test_toxicity_insult_with_rare_groups(named):
    """Toxic is an insult with one of 60 groups; clean texts have an insult or, as often as not, a group."""

    def table(seed):
        rng, sets, y = np.random.default_rng(seed), [], []
        zipf = 1 / np.arange(1, 4001)
        for _ in range(6000):
            toxic, own = rng.random() < 0.11, list(1000 + rng.choice(4000, 60, p=zipf / zipf.sum()))
            if toxic or rng.random() < named:
                own.append(10 + rng.integers(60))
                own += [1] * toxic
            elif rng.random() < 0.2 / (1 - named):
                own.append(1)
            sets.append(np.unique(own))
            y.append(int(toxic))
        return sets, y

    caught, spared = fits(table(1), table(2))
    assert caught > 0.8 and spared > 0.97


def test_pair_sums_equal_brute_force():
    rng, model = np.random.default_rng(2), toxicity.FactorizationMachine()
    model.bias, model.w = 0.3, rng.normal(size=model.w.shape).astype(np.float32)
    model.v = rng.normal(size=model.v.shape).astype(np.float32)
    sets = [np.unique(rng.integers(0, 5000, n)) for n in (0, 1, 2, 40)]
    got = model.logits(np.concatenate(sets).astype(np.int64), np.array([len(s) for s in sets]))
    for s, x in zip(sets, got):
        pairs = sum(float(model.v[a].astype(float) @ model.v[b].astype(float)) for a, b in itertools.combinations(s.astype(int), 2))
        assert abs(x - (0.3 + model.w[s.astype(int)].sum(dtype=float) + pairs)) < 1e-3


def test_toxicity_needs_its_pairs():
    """Without the factors held-out quality falls: an insult or a group alone is clean, together they are toxic."""

    def table(seed):
        rng, sets, y = np.random.default_rng(seed), [], []
        for _ in range(3000):
            a, b = rng.integers(0, 2, 2)
            sets.append(np.unique(np.concatenate([rng.integers(100, 400, 20), [1] * a, [2] * b]).astype(np.int64)))
            y.append(int(a != b))
        return np.concatenate(sets), np.array([len(s) for s in sets]), np.array(y)

    model, (terms, sizes, y) = toxicity.FactorizationMachine(), table(2)
    model.fit(*table(1))
    with_pairs = ((model.scores(terms, sizes) >= 0.7) == y).mean()
    model.v[:] = 0
    without = max(((model.logits(terms, sizes) > cut) == y).mean() for cut in np.unique(model.logits(terms, sizes)))
    assert with_pairs > 0.95 and without < 0.8


def test_term_sets_are_packed_whole():
    for n in (0, 5, (1 << 13) - 1, 1 << 13, 100_000):
        terms = np.sort(np.random.default_rng(n).permutation(1 << toxicity.BITS)[:n]).astype(np.int32)
        raw = toxicity._packed(terms)
        assert len(raw) <= 1 << (toxicity.BITS - 3) and (toxicity._unpacked(raw) == terms).all()


@pytest.mark.parametrize("counts", [[10**10, 30], [10**10] * 2000, [3, 10**12, 10**7]])
def test_every_class_keeps_its_share_at_any_size(counts):
    from sieveline.llm.common import share_bound

    each = max(1, language.SAMPLE // len(counts))
    for n in counts:
        expected = share_bound(each, n) / (1 << 63) * n
        assert 0.99 * min(each, n) <= expected <= 1.01 * each or n <= each


def test_staged_tables_are_released(spark):
    from sieveline.llm import common

    before = spark.catalog.listTables()
    path = common.staged(spark.range(3), "some").inputFiles()[0].rsplit("/", 1)[0]
    suffix_dedup.remove_repeats(spark.createDataFrame(edge_rows(), SCHEMA)).count()
    common.release(spark)
    assert not common._made and [t.name for t in spark.catalog.listTables()] == [t.name for t in before if not t.name.startswith("sieveline_")]
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, edit_prints.fingerprint_documents])
def test_other_keys_are_refused(spark, run):
    with pytest.raises(ValueError, match="long or int"):
        run(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_toxicity_on_words(spark):
    rows = [(i, prose(i, 60) + (" you utter fool" if i % 3 == 0 else ""), None, None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.99
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, labels.where("toxic = 1")).collect())


def test_quality_counts_equal_brute_force(spark):
    texts = [r[1] for r in edge_rows()] + ["## # | $$$$ a!! a!! 漢。 字？ <>", "a ##", "# b | | |", "a b c d e a b c d e f", "x x x x x x", "#$ & ok\n\nok\nok \n", "one two\none two\n \n \n"]
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        words = raw.split()
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in raw.split(b"\n") if x.split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        bare = sum(not any(c.isalnum() or ord(c) > 127 for c in w.decode()) for w in words)
        runs = sum(all(c in "#*$%&|<>" for c in (text or "")[k : k + 3]) for k in range(len(text or "") - 2))
        assert (r.n_bare, r.n_symbol_runs, r.n_stutters) == (bare, runs, sum(a == b for a, b in zip(words, words[1:])))
        assert (r.n_exclaims, r.n_ends) == (raw.count(b"!"), sum((text or "").count(c) for c in ".!?。！？؟।።…"))
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_accuracies_equal_brute_force():
    """Expectation-maximisation written out document by document, from the same start."""
    rng = np.random.default_rng(5)
    docs = []
    for _ in range(400):
        bad = rng.random() < 0.2
        docs.append(tuple(int(v) for v in np.where(rng.random(5) < (0.6 if bad else 0.02), -1, rng.integers(0, 2, 5))))
    share, good, bad = quality.fit_accuracies(sorted(collections.Counter(docs).items()), 5, rounds=60)
    p = [[0.95, 0.5, 0.1][min(2, d.count(-1))] for d in docs]
    for _ in range(60):
        q = (sum(p) + 1) / (len(docs) + 2)
        rate = {}
        for r in range(5):
            for v in (-1, 0, 1):
                rate[r, v] = ((sum(x for x, d in zip(p, docs) if d[r] == v) + 1) / (sum(p) + 3), (sum(1 - x for x, d in zip(p, docs) if d[r] == v) + 1) / (len(docs) - sum(p) + 3))
        p = []
        for d in docs:
            a, b = q, 1 - q
            for r, v in enumerate(d):
                a, b = a * rate[r, v][0], b * rate[r, v][1]
            p.append(a / (a + b))
    assert abs(share - q) < 1e-6
    for r in range(5):
        for v in (-1, 0, 1):
            assert abs(good[r, v + 1] - rate[r, v][0]) < 1e-6 and abs(bad[r, v + 1] - rate[r, v][1]) < 1e-6
    assert abs(share - 0.8) < 0.07 and (good[:, 0] < 0.06).all() and (bad[:, 0] > 0.4).all()


def posterior(share, good, bad, votes):
    a = share * np.prod([good[r, v + 1] for r, v in enumerate(votes)])
    return a / (a + (1 - share) * np.prod([bad[r, v + 1] for r, v in enumerate(votes)]))


def test_posterior_is_not_all_must_pass():
    """A rule that objects at random does not reject; rules that agree do, and the silence of good votes counts."""
    rng = np.random.default_rng(6)
    docs = []
    for _ in range(5000):
        bad = rng.random() < 0.1
        sound = [-1 if rng.random() < (0.8 if bad else 0.005) else int(rng.random() < (0.1 if bad else 0.9)) for _ in range(4)]
        docs.append((-1 if rng.random() < 0.3 else 0, *sound))
    fitted = quality.fit_accuracies(sorted(collections.Counter(docs).items()), 5)
    assert posterior(*fitted, (-1, 1, 1, 1, 1)) > 0.99  # kept despite an objection
    assert posterior(*fitted, (0, -1, -1, 0, 0)) < 0.01
    assert posterior(*fitted, (0, 0, 0, 0, 0)) < 0.5  # dropped without one
    clean = [((0, 1, 1, 1, 1), 900), ((0, 1, 0, 1, 1), 100)]
    assert all(posterior(*quality.fit_accuracies(clean, 5), v) > 0.5 for v, _ in clean)


def test_quality_keeps_unspaced_scripts(spark):
    rows = [(i, prose(i, 60) + ". So be it.") for i in range(200)] + [(300, "漢字仮名交じり文である。" * 3 + " 今日は良い天気です。" * 12)] + [(400 + i, " ".join(prose(i, 40).replace(" ", " $$$ | ").split()) + ".") for i in range(30)]
    got = {r.doc_id: r.kept for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[400 + i] for i in range(30))
    lone = {r.vote_word_length for r in quality.judge_quality(spark.createDataFrame([(1, "漢字仮名交じり文であるのでとても長い。" * 9)], "doc_id long, text string")).collect()}
    assert lone == {0}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    rows = edge_rows()[:-1]
    for g in range(6):
        words = prose(100 + g, 120).split()
        for k in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 9)}"
            rows.append((1000 + 12 * g + k, " ".join(copy), None, None, None))
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {}
    for i, text, *_ in rows:
        w = [x.lower() for x in (text or "").encode().split()]
        sets[i] = set(zip(*(w[k:] for k in range(5)))) if len(w) > 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), find(i), find(i) == i)


def test_verification_bounds():
    least = near_dup.least_matches(0.75)
    assert least == sorted(least) and 0 < least[0] < 24 and least[-1] < 96


def brute_groups(prints):
    """The smallest id of each document's group, by likeness alone."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    own = np.stack([prints[i] for i in ids])
    for k, a in enumerate(ids[:-1]):
        for m in np.flatnonzero(edit_prints.likeness(own[k][None], own[k + 1 :]) >= edit_prints.LIKE):
            x, y = sorted((find(a), find(ids[k + 1 + m])))
            parent[y] = x
    return {i: find(i) for i in ids}


def together(groups):
    by = collections.defaultdict(list)
    for i, g in groups.items():
        by[g].append(i)
    return {p for members in by.values() for p in itertools.combinations(sorted(members), 2)}


def check_near_groups(docs):
    """Groups join only what likeness joins, and at least 0.9 of it."""
    got = edit_prints.fingerprint_documents(docs).collect()
    prints = {r.doc_id: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for r in got if r.doc_id is not None}
    found, want = together({r.doc_id: r.near_id for r in got if r.doc_id is not None}), together(brute_groups(prints))
    assert found <= want and len(found) >= 0.9 * len(want) > 0, (len(found), len(want))
    return got


def test_near_groups_against_brute_force(spark):
    rng, rows = random.Random(21), edge_rows()[:-1]
    for g in range(25):
        text = prose(500 + g, 150)
        rows += [(100 + 10 * g + k, edited(text, rng.choice((0, 1, 4, 15, 40, 120)), rng), None, None, None) for k in range(10)]
    docs = spark.createDataFrame(rows + [(None, "x", None, None, None)], SCHEMA)
    got = check_near_groups(docs.repartition(3))
    assert [r.near_id for r in got if r.doc_id is None] == [None]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_near_groups_of_the_tables(spark):
    check_near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_near_groups_recall_by_edit_distance(spark):
    """Pairs of long texts a few edits apart are found; texts that have nothing to do with each other are not."""
    rng, rows = random.Random(22), []
    for g in range(100):
        text = prose(2000 + g, 200)
        rows += [(2 * g, text), (2 * g + 1, edited(text, 5, rng))]
    got = {r.doc_id: r.near_id for r in edit_prints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(100)) >= 90 and all(got[2 * g] == 2 * g for g in range(100))


def test_long_texts_are_walked_whole():
    import time

    rng = np.random.default_rng(3)
    text = rng.integers(1, 256, 10_000_000).astype(np.uint8)
    began = time.time()
    out, base, length = edit_prints.embed([text, text[:50], np.zeros(0, np.uint8)])
    assert time.time() - began < 60
    for t, b, n in zip((text, text[:50]), base, length):
        pos = 0
        for j in range(int(n)):
            if j < 2000 or n - j < 2000 or len(t) < 100:
                assert out[b + j] == (t[pos] if pos < len(t) else 0)
            pos += int(edit_prints.MOVES[j & (edit_prints.PERIOD - 1), t[pos] if pos < len(t) else 0])
        assert pos >= len(t)
    assert length[2] == 0


def test_forest_keeps_components():
    from sieveline.llm.linking import Forest

    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(2000)] + [(i, 1000) for i in range(300)]
    for span in (10, 10**6):
        forest = Forest()
        forest.SPAN = span
        mask = forest.joins([a for a, _ in links], [b for _, b in links]).to_pylist()
        kept = [x for x, m in zip(links, mask) if m]
        assert components_of(kept, {x for p in links for x in p}) == components_of(links, {x for p in links for x in p})
    assert len(kept) == 300


def test_heavy_keys_are_handled_apart(spark, monkeypatch):
    from sieveline.llm import common, linking

    monkeypatch.setattr(common, "HEAVY", 5)
    monkeypatch.setattr(linking, "BLOCK", 16)
    rows = [(b, i) for i in range(300) for b in {7, i % 50 + 100}] + [(9, 1000)]
    members = spark.createDataFrame(rows, "bucket long, id long")
    got = {(r.bucket, r.id): (r.head, r.n) for r in linking.headed(members).collect()}
    assert got == {(b, i): ((0, 300) if b == 7 else (b - 100, 6)) for b, i in rows if b != 9}
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    joined = common.heavy_join(members, sizes, "bucket")
    assert sorted((r.bucket, r.id, r.n) for r in joined.collect()) == sorted((b, i, collections.Counter(x for x, _ in rows)[b]) for b, i in rows)

    def compare(table, i, j, found):
        ids = table.column("id").to_numpy()
        for x, y in zip(i.tolist(), j.tolist()):
            if ids[x] % 10 == ids[y] % 10 and not found.same(x, y):
                found.put(x, y)

    none = spark.createDataFrame([], "a long, b long")
    links = linking.across(linking.headed(members.where("bucket = 7")), none, members.select("id").distinct(), compare).collect()
    assert components_of([(r.a, r.b) for r in links], range(1, 300)) == {i: (i % 10 or 10) for i in range(1, 300)}


def test_large_bucket_is_split(spark):
    words = prose(77, 60).split()
    rows = []
    for i in range(700):  # one group, more than two blocks
        copy = list(words)
        copy[i % 60] = f"v{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[3][1]) for i in range(400)] + [(2000 + i, None) for i in range(400)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 2000} == {0} and all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id >= 2000)


def test_sets_travel_for_likely_pairs_alone(spark, monkeypatch):
    """Members of one bucket that are unlike by their signatures are sifted out before sets are dealt; like ones are linked as before."""
    rng = np.random.default_rng(12)
    base = [rng.integers(1, 1 << 60, 60, dtype=np.uint64) for _ in range(500)]
    rows = [(i, np.sort(s)) for i, s in enumerate(base)] + [(1000 + i, np.sort(np.append(base[i][:56], rng.integers(1, 1 << 60, 4, dtype=np.uint64)))) for i in range(0, 500, 50)]
    sigs = spark.createDataFrame([(i, bytearray(near_dup.signature(s).tobytes())) for i, s in rows], "id long, sig binary")
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in rows], "id long, shingles binary")
    members = spark.createDataFrame([(7, i, -1, len(rows)) for i, _ in rows], "bucket long, id long, head long, n long")
    least, seen, real = near_dup.least_matches(0.75), {}, linking.staged
    monkeypatch.setattr(linking, "staged", lambda df, name: seen.setdefault(name, real(df, name)))

    def sift(group, i, j):
        sig = np.stack(linking.binary_rows(group.column("sig"), np.uint32))
        return near_dup.survivors(sig, sig, i, j, least)

    def compare(group, i, j, found):
        own = linking.binary_rows(group.column("shingles"), np.uint64)
        for x, y in zip(*(k.tolist() for k in sift(group, i, j))):
            if near_dup.linked(own[x], own[y], 75):
                found.put(x, y)

    none = spark.createDataFrame([], "a long, b long")
    links = linking.across(members, none, sets, compare, heads_done=False, sift=sift, light=sigs).collect()
    assert {(r.a, r.b) for r in links} == {(i, 1000 + i) for i in range(0, 500, 50)}
    assert seen["sifted"].count() < 60 < len(rows) * 3


def test_language(spark):
    en, de = "the cat and the dog with that", "der hund und die katze mit dem"
    rows = [(i, " ".join(random.Random(i).choices((en if i % 2 else de).split(), k=20)), "en" if i % 2 else "de", None, None) for i in range(300)]
    rows += [(900, None, "en", None, None), (901, "123 !!", "en", None, None), (902, "漢字", None, None, None)]
    got = {r.doc_id: r for r in language.predict_language(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert np.mean([got[i].lang_pred == ("en" if i % 2 else "de") for i in range(300)]) == 1
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred != "und" and got[900].score == 0


def test_every_language_takes_part(spark):
    rows = [(i, f"{hashlib.sha256(str(i % 600).encode()).hexdigest()} abc", f"l{i % 600}", None, None) for i in range(6000)]
    got = language.predict_language(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.lang_pred for r in got}) > 590


def test_samples_hold_the_most_frequent_value(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 2)
    monkeypatch.setattr(toxicity, "SAMPLE", 2)
    rare = F.col("id") < 50
    docs = spark.range(2_000_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(rare, "de").otherwise("en").alias("lang"), rare.cast("int").alias("toxic"))
    assert set(language._sample(docs, "doc_id", "text", "lang")[1]) == {"de", "en"}
    assert set(toxicity._sample(docs, docs.select("doc_id", "toxic"), "doc_id", "text", "toxic")[2].tolist()) == {0, 1}


def test_url_rules(spark):
    link = '<html><LINK href="https://x.org/real" rel=canonical></html>'
    rows = [
        (0, "http://a.example.com/en/1", None), (1, "http://www.example.com/en/1", ""), (2, "HTTP://EXAMPLE.COM/de", ""), (3, "https://y.net/es/1?q#f", ""), (4, "no url", ""), (5, None, ""), (6, "http://x.org", ""),
        (7, "http://z.org/1", '<meta http-equiv="refresh" content="0; url=http://q.net/fr/2">'), (8, "http://z.org/2", '<link rel="canonical" href="/1">'), (9, "http://q.com/x", '<link rel="canonical" href="http://z.org/1">'), (10, "http://x.org/alias", link), (11, "http://notexample.com/en/1", ""),
    ]
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2] == ("example.com", "/de", "com/", "allow")
    assert got[3] == ("y.net", "/es/1", "net/es/", "block") and got[4] == got[5] == ("", "", None, "allow") and got[6] == ("x.org", "", None, "allow")
    assert got[7][2:] == (None, "block") and got[8][3] == "block" and got[9][2:] == ("com/", "allow") and got[10][3] == "allow" and got[11][2] == "com/"


HREFS = (
    ("http://h.org/a/b", "c", "h.org/a/c"), ("http://h.org/a/b", "../c", "h.org/c"), ("http://h.org/a/b", "../../../c", "h.org/c"), ("http://h.org/a/b/", "./c/.", "h.org/a/b/c/"), ("http://h.org", "c", "h.org/c"),
    ("http://h.org/a/b?x=1", "?y=2", "h.org/a/b?y=2"), ("http://h.org/a/b", "#top", None), ("http://h.org/a/b", "//Q.net/x", "q.net/x"), ("http://h.org/a/b", "/c/../d?z#f", "h.org/d?z"), ("http://h.org/a", "mailto:x@y", None),
    ("http://h.org/a", "HTTPS://X.org/q?a=1&amp;b=2", "x.org/q?a=1&b=2"), ("no url", "/c", None), ("http://h.org/a/b", "..", "h.org/"), ("http://h.org/.a/b", "c.d", "h.org/.a/c.d"),
)


def test_hrefs_are_resolved(spark):
    for quote in ('"', "'", ""):
        rows = [(i, u, f"<p><link data-rel=x rel={quote}canonical{quote} href={quote}{h}{quote} />") for i, (u, h, _) in enumerate(HREFS)]
        got = {(r.a, r.b) for r in url_rules.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {(u.split("://")[1], w) for u, _, w in HREFS if w}
    one = [(1, "http://h.org/a", "<meta content=\"5; URL='it&#39;s>x'\" http-equiv=Refresh><link rel='nofollow canonical' href=\"it's\"><link href='x' rel='canonicals'>")]
    assert {r.b for r in url_rules.alias_edges(spark.createDataFrame(one, "page_id long, url string, html string")).collect()} == {"h.org/it", "h.org/it's"}


def alias_pages():
    rows = [(i, f"http://h{i}.org/p", f'<link rel="canonical" href="http://h{i + 1}.org/p">' if i % 5 else "") for i in range(30)] + [(99, "http://b.net/fr/1", '<link rel=canonical href="http://h7.org/p">')]
    rows += [(100 + i, u, f'<link href="{h}" rel="canonical">') for i, (u, h, _) in enumerate(HREFS)] + [(200, "http://x.net/es/", '<meta http-equiv="refresh" content="0; url=//h.org/a/x/../c">'), (201, None, None), (202, "http://h7.org/p", None)]
    rows += [(300 + i, "http://q.org/hub" if i % 2 else f"http://q.org/{i}", '<link rel="canonical" href="/hub">') for i in range(60)] + [(400, "http://y.net/fr/x", "<meta http-equiv='refresh' content='0;url=http://q.org/hub'>")]
    return rows


def brute_verdicts(rows):
    """A walk over the edges, with urllib for the hrefs."""
    import html
    import re
    from urllib.parse import urljoin

    node = lambda u: None if "://" not in u else u.split("://", 1)[1].split("#")[0]

    def low(u):
        host, rest = re.match(r"([^/?#]*)(.*)", u).groups()
        return host.lower() + rest

    def action(n):
        host, path = re.match(r"([^/?]*)([^?]*)", n).groups()
        fits = [(len(h + p), what) for what, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    near = collections.defaultdict(set)
    for _, url, body in rows:
        m = re.search(r"""href="([^"]*)"|href=(\S+)>|url=([^"']*)""", body or "")
        if m and node(url or ""):
            href = html.unescape(next(g for g in m.groups() if g is not None))
            target = urljoin(url, href)
            if "://" in target and href and not href.startswith("#"):
                a, b = low(node(url)), low(node(target))
                near[a].add(b)
                near[b].add(a)
    out = {}
    for i, url, _ in rows:
        n = low(node(url)) if url and node(url) else None
        seen, todo = set(), [n] if n else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        own = action(n) if n else None
        out[i] = own or ("block" if any(action(x) == "block" for x in seen) else "allow")
    return out


def test_url_query_equals_sql_and_a_walk(spark, tmp_path, monkeypatch):
    import duckdb

    from sieveline.llm import common, queries

    monkeypatch.setattr(common, "HEAVY", 8)
    rows = alias_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.withColumns({"verdict": F.lit("x"), "node": F.lit(1), "n": F.lit(2)}).coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op8_url_filter(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert sorted(con.sql(url_rules.SQL).fetchall(), key=str) == sorted(got, key=str)
    assert {r[0]: r[4] for r in got} == brute_verdicts(rows)
    assert {r[4] for r in got if r[0] >= 300} == {"block"} and url_rules.judge_urls(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3), (200, 200)]
    got = dict(tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def test_licenses(spark):
    rows = [(i, prose(i, 40) + "\n" + t + "\n" + prose(-i, 200)) for i, t in enumerate(licenses.TEMPLATES.values())] + [(90, prose(5, 900)), (91, None), (92, "")]
    rows.append((93, licenses.TEMPLATES["mit-grant"].replace("copy of this", "copy of that")))
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert all(name in got[i] for i, name in enumerate(licenses.TEMPLATES)) and "mit-grant" in got[93] and not {90, 91, 92} & set(got)


def test_license_windows_equal_brute_force():
    """Every template against every window of its level, by containment alone."""
    rng, texts = random.Random(31), ["", "a b c", "one two three four five"]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            parts += [prose(rng.randint(0, 999), rng.randint(0, 60)), " ".join(own[rng.choice((0, 0, 2)) :])]
        texts.append("\n".join(parts))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    sequence, sizes = licenses.shingle_sequence(data, at)
    index = licenses.Index(licenses.TEMPLATES)
    want, ends = [], np.cumsum(sizes)
    for d, (e, n) in enumerate(zip(ends, sizes)):
        own = sequence[e - n : e].tolist()
        for k, template in enumerate(index.sets):
            step = 1
            while step < len(template):
                step *= 2
            held = {b: len(set(template.tolist()) & set(own[b : b + 2 * step])) for b in range(0, n, step)}
            good = [b for b, h in held.items() if 100 * h >= 75 * len(template)]
            if good:
                want.append((d, k, good[0], max(held[b] for b in good), len(good)))
    assert licenses.scan_chunk(sequence, sizes, index) == want and len(want) > 200


def test_fingerprints(spark):
    rows = [(i, prose(i, 5 + 9 * i)) for i in range(30)] + [(40, prose(3, 32)), (41, None), (42, "a")]
    got = {r.doc_id: r for r in edit_prints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(text) // 2
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()
    assert got[40].fingerprint == got[3].fingerprint
    long = [got[i] for i in range(10, 30)]
    assert all(r.near_edited > r.near_next for r in long)


def test_near_links_finds_edits(spark):
    rng, rows = random.Random(2), []
    for i in range(60):
        text = prose(i, 100)
        k = rng.randrange(len(text))
        rows += [(2 * i, text), (2 * i + 1, text[:k] + "q" + text[k + 1 :])]
    found = {(r.a, r.b) for r in edit_prints.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found & {(2 * i, 2 * i + 1) for i in range(60)}) >= 57 and all(a // 2 == b // 2 for a, b in found)


def brute_components(rows, distance=20):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        if abs(len(s) - len(t)) <= distance and find(a) != find(b) and edit_prints.within(s, t, distance) >= 0:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in parent}


def edited(text: str, edits: int, rng: random.Random) -> str:
    for _ in range(edits):
        k = rng.randrange(len(text) + 1)
        text = text[:k] + rng.choice(["", "q", "z"]) + text[k + rng.randint(0, 1) :]
    return text


def components_of(links, ids):
    found = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            found[a] = found[b] = min(found[a], found[b])
    return found


def test_near_links_chain(spark):
    rows = []
    for g in range(8):  # A-B and B-C are near, A-C is not, and A heads the buckets that B and C share
        a = prose(300 + g, 150)
        places = sorted(random.Random(g).sample(range(len(a)), 30))
        b = "".join("#" if k in places[:15] else c for k, c in enumerate(a))
        c = "".join("#" if k in places else c for k, c in enumerate(a))
        rows += [(3 * g, a), (3 * g + 1, b), (3 * g + 2, c)]
    got = edit_prints.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert all(edit_prints.within(texts[r.a], texts[r.b], 20) == r.distance for r in got)
    assert components_of([(r.a, r.b) for r in got], texts) == {i: i - i % 3 for i in texts}


def test_near_links_equal_brute_force_on_short_texts(spark):
    rng, rows = random.Random(12), [(0, ""), (1, "a"), (2, "b" * 60), (3, "b" * 85), (4, "漢字" * 30), (5, "漢字" * 29 + "x")]
    for g in range(60):
        text = prose(900 + g, 400)[: rng.choice((30, 60, 120, 240, 330, 600))]
        rows += [(10 + 3 * g, text), (11 + 3 * g, edited(text, 20, rng)), (12 + 3 * g, edited(text, 5, rng))]
    got = edit_prints.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert components_of([(r.a, r.b) for r in got], dict(rows)) == brute_components(rows)


def test_within_equals_levenshtein(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        a = "".join(rng.choices("abc漢", k=rng.randint(0, 40)))
        rows.append((i, a, edited(a, rng.randint(0, 12), rng)))
    want = {r.i: r.d for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", F.levenshtein("a", "b", 8).alias("d")).collect()}
    assert all(edit_prints.within(a, b, 8) == want[i] for i, a, b in rows)
