"""Wildcard patterns against a small matcher in plain Python."""

import random

import pytest

from tablelens.functions.patterns import contains_pattern, wildcard_regex
from pyspark.sql import functions as F


def in_set(body, c):
    negated, body = body.startswith("^"), body.removeprefix("^")
    found, i = False, 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            found |= body[i] <= c <= body[i + 2]
            i += 3
        else:
            found |= body[i] == c
            i += 1
    return found != negated


def matches(pattern, text):
    """Does the pattern match all of the text?"""
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(matches(pattern[1:], text[i:]) for i in range(len(text) + 1))
    if pattern[0] == "[":
        close = pattern.find("]", 1)
        if close < 0:
            return False
        return bool(text) and in_set(pattern[1:close], text[0]) and matches(pattern[close + 1 :], text[1:])
    return bool(text) and pattern[0] in ("_", text[0]) and matches(pattern[1:], text[1:])


def test_against_matcher(spark):
    rng = random.Random(3)
    alphabet = "ab^-[]%_\\.&\n"
    patterns = ["".join(rng.choices(alphabet, k=rng.randint(0, 5))) for _ in range(150)]
    patterns += ["[a-b]", "[^a-b]", "[]", "[^]", "[b-a]", "[a&&b]", "[\\]", "[-a]", "a%b", "%", "[[]"]
    texts = ["".join(rng.choices("ab^-[]\\.&\n", k=rng.randint(0, 6))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(
        "t", *[contains_pattern(p, True)(F.col("t")).alias(f"p{i}") for i, p in enumerate(patterns)]
    ).collect()
    for row in found:
        for i, p in enumerate(patterns):
            assert row[f"p{i}"] == matches(f"%{p}%", row["t"]), (p, row["t"])


@pytest.mark.parametrize(
    ("pattern", "regex"),
    [("abc", "abc"), ("a%%b", "a.*b"), ("%a_%", "a."), ("[a-f]", "[a-f]"), ("[", "(?!)")],
)
def test_regex(pattern, regex):
    assert wildcard_regex(pattern) == regex


def test_case_and_several(spark):
    df = spark.createDataFrame([("ÄRGER",), ("Straße",), (None,)], "t string")
    out = df.select(
        contains_pattern("ärger")(F.col("t")),
        contains_pattern("ärger", case_sensitive=True)(F.col("t")),
        contains_pattern(["x", "[^a-z]e"])(F.col("t")),
    ).collect()
    assert [tuple(r) for r in out] == [(True, False, False), (False, False, True), (None, None, None)]
