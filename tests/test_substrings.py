"""The gram index against a loop over all names and texts."""

import random

import pytest

from sieveline.operators import substrings

LETTERS = "abé_"


def texts_and_names(n=400):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choices(LETTERS, k=k))
    texts = ["get" + word(rng.randint(0, 30)) for _ in range(n)] + [word(rng.randint(0, 9)) for _ in range(60)] + [word(1500), "", None, "x" * 2000]
    names = {"get" + word(rng.randint(0, 7)) for _ in range(150)} | {word(rng.randint(1, 18)) for _ in range(150)} | {t[5:30] for t in texts[:30]} | {t for t in texts[:10]} | {texts[-4][700:740], "x" * 40, "x" * 2001, "g", "qq"}
    return texts, sorted(names)


@pytest.mark.parametrize("hot, widths", [(256, (3, 6, 12)), (2, (3, 6, 12)), (0, (3,)), (5, (2, 4))])
def test_names_equal_a_loop(spark, hot, widths):
    texts, names = texts_and_names()
    t = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in [*names, *names[:9], "", None]], "name string")
    got = [r.name for r in substrings.contained(n, t, widths=widths, hot=hot).collect()]
    want = {x for x in names if x and any(x in (y or "") for y in texts)}
    assert sorted(got) == sorted(want) and 100 < len(want) < len(names)


def test_empty_sides(spark):
    t = spark.createDataFrame([("abc",)], "text string")
    n = spark.createDataFrame([("b",), ("bc",), ("abcd",)], "name string")
    assert substrings.contained(n.limit(0), t).count() == 0
    assert substrings.contained(n, t.limit(0)).count() == 0
    assert sorted(r.name for r in substrings.contained(n, t).collect()) == ["b", "bc"]


def test_frequent_begins_are_no_hot_keys(spark, monkeypatch):
    """Names that all begin with `get` are compared with no more than `hot` texts each."""
    texts, names = texts_and_names(1500)
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    n = spark.createDataFrame([(x,) for x in names if x.startswith("get")], "name string")
    seen, real = [], substrings.staged
    monkeypatch.setattr(substrings, "staged", lambda df: (seen.append(out := real(df)), out)[1])
    substrings.contained(n, t, hot=20).count()
    rarest = [df for df in seen if df.columns == ["name", "n", "gram"]]
    assert rarest and all(df.where("n <= 20").count() == 0 or df.where("n <= 20").groupBy("gram").count().agg({"count": "max"}).head()[0] < 150 for df in rarest)
    assert any(df.where("gram <> 'get' and n <= 20").count() for df in rarest)
