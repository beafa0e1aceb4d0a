"""Required strings of patterns, and hits of many rules with and without the pass for them."""

import re

import pytest

from sieveline.operators import literals, rules

PATTERNS = [
    (r"sk_live_[a-z]{3}", ["sk_live_"]), (r"(?i)Password\s*=", ["password"]), (r"foo|bar.*baz", ["bar", "foo"]), (r"a?b*", None), (r"(?:alpha|be)\d+gamma", ["gamma"]), (r"x(?:one|two)+y", ["one", "two"]),
    (r"\d{4}", None), (r"[ab]cde", ["cde"]), (r"^start\b", ["start"]), (r"(?:opt)?", None), (r"bro(ken", None), (r"license\z", ["license"]), (r"(?i)größe", None), (r"[.]env", [".env"]), (r"(q|)r", ["r"]),
]


@pytest.mark.parametrize("pattern, want", PATTERNS)
def test_required_strings(pattern, want):
    assert literals.required(pattern) == want


def test_shipped_shapes_hold_their_strings():
    from sieveline.functions.text import SECRET_SHAPES

    asked = {name: literals.required(p) for name, p in SECRET_SHAPES}
    assert asked["github-fine-grained-pat"] == ["github_pat_"] and asked["private-key-block"] and asked["twilio-key"] == ["sk"]


def test_hits_are_those_of_every_pattern(spark, monkeypatch):
    good = [p for p, _ in PATTERNS if p != r"bro(ken"]
    texts = ["sk_live_abc", "my PASSWORD =1", "foo", "bar baz", "be12gamma", "alpha1gammA", "xoneY xtwoy", "1234", "acde", "start it", "", "none of it", "LICENSE license", "größe GRÖSSE Größe", "a .env", None, "qr"]
    files = spark.createDataFrame([(f"f{i}", "en", t) for i, t in enumerate(texts)], "path string, lang string, text string").repartition(3)
    pack = tuple(rules.Rule(f"t/{i}", "low", text_pattern=p, languages=("de",) if i == 2 else (), path_glob=("f1*",) if i == 6 else ()) for i, p in enumerate(good))
    frame = rules.pack_frame(spark, pack)
    with_pass = sorted((r.path, r.rule_id) for r in rules.text_hits(files, frame, []).collect())
    monkeypatch.setattr(rules, "MANY_PATTERNS", 10**9)
    assert with_pass == sorted((r.path, r.rule_id) for r in rules.text_hits(files, frame, []).collect()) and len(with_pass) > 20


def test_a_text_is_read_once_for_all_patterns(spark):
    files = spark.createDataFrame([("a", "needle7 stands here"), ("b", "nothing")], "path string, text string")
    found = literals.candidates(files, [f"needle{i}[a-z ]" for i in range(5000)]).collect()
    assert [(r.path, r.candidates) for r in found] == [("a", [7])]
    assert literals.candidates(files, []).count() == 0 and literals.candidates(files, ["."]).count() == 2
    assert re.search("needle7[a-z ]", found[0].text)
