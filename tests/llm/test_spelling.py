"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, documents  # noqa: F401

from tablelens.llm import spelling
from tablelens.llm.queries import QUERIES
from tablelens.llm.spelling import spelling_variants, variant_forms, word_counts

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def counted(rows, min_chars=6, min_count=5, damage=199):
    found = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= min_chars and n >= min_count}


def forms(ns, ratio=5):
    """Every change of one letter to every word is looked up."""
    form, near = {}, {}
    for w in ns:
        changed = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for c in set("".join(ns)):
            changed |= {w[:i] + c + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1)}
        near[w] = (changed & ns.keys()) - {w}
        best = min(near[w], key=lambda v: (-ns[v], v), default=None)
        form[w] = best if best and ns[best] >= ratio * ns[w] else None
    rows = set()
    for w in ns:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, ns[w], len(near[w]), ns[form[w]] if form[w] else None))
    return rows


def got(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def words_table(spark, ns):
    return spark.createDataFrame(list(ns.items()), "word string, n long")


def made_words(seed, size):
    random = np.random.default_rng(seed)
    words = {"".join(random.choice(list("abñ"), random.integers(6, 10))) for _ in range(size)}
    return {w: int(5 ** random.integers(1, 6) + random.integers(3)) for w in words}


def test_words_near_each_other(spark):
    ns = made_words(1, 600)
    assert got(variant_forms(words_table(spark, ns))) == forms(ns)


def test_boxes_dealt_out_over_blocks(spark, monkeypatch, hot):
    """Anagrams share one vector, so no cut parts them; chains of forms are followed to the end."""
    hot(3)
    monkeypatch.setattr(spelling, "BOX_WORDS", 40)
    monkeypatch.setattr(spelling, "BOX_QUERIES", 30)
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", 100)
    random = np.random.default_rng(5)
    anagrams = {"".join(random.permutation(list("aabbcdef"))) for _ in range(150)}
    ns = {w: 5 for w in anagrams} | made_words(2, 200)
    ns |= {"chaina": 5, "chainb": 25, "chaicb": 125, "chdicb": 625, "chdiceb": 3125}
    assert got(variant_forms(words_table(spark, ns))) == forms(ns)


def test_counting_words(spark, documents):
    rows = [*ODD, *[(20 + i, "Straßen straßen Élan ÉLAN élançon élançon colour colours " * 3) for i in range(300)], (1, "y" * 50_000), (2, "colour " * 300_000)]
    df = documents(*rows)
    assert {tuple(r) for r in word_counts(df).collect()} == set(counted(rows).items())
    assert got(spelling_variants(df)) == forms(counted(rows))
    assert got(spelling_variants(documents())) == set()
    assert got(spelling_variants(documents((1, None), (None, "")))) == set()


def test_very_long_words(spark):
    ns = {"x" * 5_000: 50, "x" * 4_999 + "y": 5, "x" * 4_999: 6, "y" + "x" * 5_000: 7}
    assert got(variant_forms(words_table(spark, ns))) == forms(ns)


def test_a_ratio_of_one_is_refused(spark):
    with pytest.raises(ValueError, match="ratio"):
        variant_forms(words_table(spark, {"abcdef": 5}), ratio=1)


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = forms(counted(rows))
    assert len(want) > 500 and any(r[1] for r in want)
    assert got(QUERIES["op12_letter_counts"](spark, folder)) == want
