"""Spelling variants, the filter audit and sharding: brute-force results, and the cases that each docstring defines."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.llm import filter_audit, queries, sharding, spelling
from tests.llm.test_operators import SCHEMA, edge_rows, prose

LONG = "Répétition élevée under_score; " * 200_000
FOLDER = "/root/testdata/sf0.001"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in ("word", "n", "form", "part", "failed", "digest", "first", "shard", "slot", "size", "law", "key", "count", "jump", "good", "toxic")))


# --- spelling variants


def brute_variants(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, n, len(found))
    result = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.append((w, form, root, n, k, words[form] if form else None))
    return sorted(result)


def variants(df, **more):
    return sorted(tuple(r) for r in spelling.group_variants(df, **more).collect())


def variant_rows():
    rng = random.Random(11)
    base = ["receive", "séparer", "können", "abcdef", "aaaaaa", "aaaaaaa", "ÀÀÀÀÀÀ", "çava×÷é", "mississippi", "abcabc", "abcxabc"]
    words = list(base)
    for w in base:
        for _ in range(12):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcxéß")
            words.append(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    rows = []
    for i in range(60):
        picked = rng.choices(base, k=60) + rng.choices(words, k=25) + ["prefix" + x + y for x, y in [rng.choice(list(itertools.product("abc", "xyz")))]]
        rows.append((i, rng.choice([" ", "-", "_1_"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in picked), "en", "s", 1))
    return rows + edge_rows() + [(500 + i, "steps " * 5**i + "ab" + "steps"[: i + 3] + "xyz " * 1 + " chainaa" * 5 + " chainab" * 30 + " chainbb" * 200, None, None, None) for i in range(3)]


@pytest.mark.parametrize("more", [{}, {"hot": 1, "shard": 20}, {"hot": 4, "shard": 9}])
def test_variants_equal_brute_force(spark, more):
    rows = variant_rows()
    want = brute_variants(rows)
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[4] > 3 for r in want)
    assert variants(make(spark, rows).repartition(5), **more) == want


def test_an_index_of_rests_gives_what_comparing_gives(spark, monkeypatch):
    rows = variant_rows()
    half = spelling._Half(True, 7, 3)
    words = ["abc" + "".join(x) for x in itertools.product("abx", repeat=4)]
    half.words = [(w, 9) for w in words]
    for w in ["abcabab", "abcaba", "abcababx", "abcxxxx", "abcaaa", "abcaaaaa"]:
        assert sorted(half.near(w)) == sorted((x, 9) for x in words if spelling.one_edit(w, x))
    monkeypatch.setattr(spelling, "LISTED", 0)
    assert list(spelling._scan(iter([]))) == [] and brute_variants(rows)


def test_variants_of_edges(spark):
    assert variants(make(spark, [])) == []
    assert variants(make(spark, [(1, None, None, None, None), (None, "", None, None, None), (2, "short word s", None, None, None)])) == []
    rows = [(1, LONG, "fr", "a", 1), (2, "élevéex élevéex élevéex élevéex élevéex " * 3, "fr", "a", 1), (None, "élevée " * 5, None, None, None)]
    assert variants(clashing(make(spark, rows))) == brute_variants(rows)


# --- filter audit


def brute_audit(rows, labels):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    own = []
    for i, text, _, source, _ in rows:
        t = text or ""
        w = word.findall(t.encode())
        failed = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(set(t) & set("#$%&*|")), i is not None and least[t] < i]
        own.append((source or "", {f for f, x in zip("ABCDE", failed) if x}, i in good, i in toxic))
    out = []
    for part in {o[0] for o in own}:
        mine = [o for o in own if o[0] == part]
        rows_of, shapley = [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [o for o in left if f in o[1]]
                left = [o for o in left if f not in o[1]]
                fails = sum(f in o[1] for o in mine)
                shapley[f] += len(gone)
                rows_of.append([part, order, step, len(left), len(gone), fails - len(gone), sum(o[1] == {f} for o in mine), sum(o[2] for o in gone), sum(o[3] for o in gone)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_of]
    return sorted(out)


def audit(docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit_filters(docs, labels).collect())


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(0, 1, None), (1, None, 1), (None, 1, 1), (999, 1, 1)]


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [prose(i, rng.choice([50, 250])) for i in range(6)] + ["Word " * 250, "AB # cd" * 60, "", None]
    rows = edge_rows() + [(20 + i, rng.choice(texts), None, rng.choice(["a", "b", "", None]), None) for i in range(60)] + [(20, texts[0], None, "a", None)]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, LABELS)
    assert audit(clashing(make(spark, rows)).repartition(4), labels) == want
    monkeypatch.setattr(filter_audit, "heavy_keys", lambda *a, **k: [])
    assert audit(make(spark, rows).repartition(3), labels) == want


def test_audit_of_edges(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audit(make(spark, []), labels) == []
    rows = [(1, LONG, None, "a", None), (0, LONG, None, "b", None), (None, LONG, None, "a", None), (2, "x" * 9_000_000, None, "a", None)]
    assert audit(make(spark, rows), labels.limit(0)) == brute_audit(rows, [])


def test_words_of_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(filter_audit, "_PIECE", 7)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("abc é\n\t\x0b漢", k=rng.randint(0, 60)))
        found = text.encode().split()
        assert filter_audit._words(np.frombuffer(text.encode(), np.uint8)) == (len(found), len(set(found)))


def test_table_of_first_failures():
    assert filter_audit.TABLE.shape == (32, 120) and (filter_audit.TABLE[0] == 0).all()
    assert filter_audit.TABLE[0b10001, filter_audit.ORDERS.index("BEDCA")] == 2


# --- sharding


def jump(key, shards):
    k, last, at = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16), -1, 0
    while at < shards:
        last = at
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        at = int((last + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return last


def test_shards_equal_the_published_loop(spark, monkeypatch):
    keys = [None, *range(-3, 400), 1 << 62, -(1 << 63)]
    df = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    for shards in (1, 2, 8, 40, 5000):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.with_shards(df, shards=shards).collect()}
        assert got == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}
        assert all(a == b or b == shards for a, b in got.values())
    monkeypatch.setattr(sharding, "UNROLLED", 2)
    assert {r.doc_id: r.shard for r in sharding.with_shards(df, shards=64).collect()} == {k: jump(k, 64) for k in keys}
    with pytest.raises(ValueError):
        sharding.with_shards(df, shards=0)


def test_documents_have_slots_without_gaps(spark):
    rows = edge_rows() + [(77, "hot " * (i % 3), None, None, None) for i in range(300)] + [(i, "t", None, None, None) for i in range(100, 400)] + [(5, LONG, None, None, None)]
    got = sharding.shard_documents(clashing(make(spark, rows)).repartition(5)).collect()
    want = sorted((jump(r[0], 8), r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows)
    assert sorted((r.shard, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in got) == want
    slots = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        slots[r.shard].append((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
        assert r.slot == len(slots[r.shard]) - 1
    assert all(s == sorted(s) for s in slots.values())
    assert sharding.shard_documents(make(spark, [])).collect() == []


def test_shards_are_even_and_plans_native(spark):
    df = sharding.with_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"))
    counts = [r["count"] for r in df.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.08 * min(counts)
    plan = sharding.shard_documents(make(spark, edge_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards_hold_the_rows(spark, tmp_path):
    rows = edge_rows()
    sharding.write_shards(clashing(make(spark, rows)), str(tmp_path / "out"), 3, file_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    assert all(r.shard == jump(r.doc_id, 3) for r in back.collect())
    assert len(list((tmp_path / "out").glob("shard=*/*.parquet"))) > 3


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_filter_audit", "op13_jump_sharding"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
