"""Free names of colliding families against the loop that takes them one after the other."""

import random

import pytest

from sieveline.operators import free_names, rewrites


def in_turn(rows, taken):
    seen, last, out = set(taken), {}, {}
    for i, base in sorted(rows):
        n = last.get(base, 0) + 1
        key = base if n == 1 else f"{base}_{n}"
        while key in seen:
            n += 1
            key = f"{base}_{n}"
        last[base] = n
        seen.add(key)
        out[i] = key
    return out


def names(rng, depth):
    return "_".join(["K", *(str(rng.choice((2, 2, 3, 3, 4, 5, 7, 12, 1, "02"))) for _ in range(rng.randint(0, depth)))])


@pytest.mark.parametrize("seed", range(4))
def test_families_equal_the_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(free_names, "BLOCK", 3)
    rng = random.Random(seed)
    rows = [(i, rng.choice(("K", "K", names(rng, 2), names(rng, 3), "L", "L_2"))) for i in rng.sample(range(2000), 120)]
    taken = [] if seed == 0 else ["K", "K_4", "K_2_3", "L_2", "Q_2"][seed:] + ["K_9"]
    df = spark.createDataFrame(rows, "i int, base string").repartition(3)
    got = {r.i: r.key for r in rewrites.free_keys(df, "base", ["i"], taken).collect()}
    want = in_turn(rows, taken)
    assert got == want and len(set(got.values())) == len(rows) and any(want[i] != b and not want[i].startswith(b + "_") or want[i] != b for i, b in rows)


def test_a_chain_of_bases_that_wait_for_each_other(spark):
    """Each second base comes before and each other one after the place where the first base would ask for it."""
    rows = [(10 * k, "A") for k in range(1, 30)] + [(10 * k + (5 if k % 2 else -5), f"A_{k}") for k in range(2, 29)] + [(400 + k, "A_3") for k in range(9)]
    df = spark.createDataFrame(rows, "i int, base string")
    assert {r.i: r.key for r in rewrites.free_keys(df, "base", ["i"], ["A_6"]).collect()} == in_turn(rows, ["A_6"])


def test_no_family_meets_in_one_group(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A_2"), (3, "A")], "i int, base string")
    out = rewrites.free_keys(df, "base", ["i"])
    assert "Pandas" not in out._jdf.queryExecution().toString() and {r.i: r.key for r in out.collect()} == {1: "A", 2: "A_2", 3: "A_3"}
    assert rewrites.free_keys(df.limit(0), "base", ["i"], ["A"]).count() == 0
