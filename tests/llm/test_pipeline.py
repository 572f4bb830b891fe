"""The corpus pipeline and its stages against brute force, on rows of every odd kind."""

import math
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from tablelens.llm.queries import JSON, KEEP_SCORE, quality_model

GIVEN = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("predicted", T.StringType()),
        T.StructField("a.b", T.StringType()),
        T.StructField("rep", T.LongType()),
    ]
)


def prose(name, n):
    return " ".join(f"{name}{chr(97 + i % 26)}{i}" for i in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The given documents, and rows with NULL and repeated ids, copies and empty texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").collect()]
    own = max(i for i, _ in rows) + 1
    some = [t for _, t in rows if t and len(t.split()) > 60][:4]
    extra = [(own, some[0]), (own + 1, some[0]), (own + 1, some[1] + " and more"), (own + 1, None), (own + 1, None), (own + 2, "")]
    extra += [(None, some[2]), (None, some[2]), (None, "few words only here"), (None, None), (own + 3, f"{some[3]} {prose('x', 60)}"), (own + 4, f"{prose('y', 30)} {some[3]}")]
    folder = tmp_path_factory.mktemp("corpus")
    full = [(i, t, None if t is None else len(t), f"s{i}", "p", f"dot{k}", k) for k, (i, t) in enumerate(rows + extra)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{GIVEN}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def in_order(rows):
    """By id, NULL last, rows of one id by the hash of the text."""

    def key(r):
        h = 42 if r["text"] is None else xxhash.xxh64(r["text"].encode(), seed=42).intdigest()
        return (r["doc_id"] is None, r["doc_id"] or 0, h - (1 << 64) if h >> 63 else h)

    return sorted(rows, key=key)


def statistics(text):
    t = text or ""
    n, words = max(len(t), 1), regex.sub("[ \t\n\x0b\f\r]+", " ", t).strip(" ").split(" ")
    blank = "[ \t\n\x0b\f\r]"
    share = lambda p: len(regex.findall(p, t)) / n
    repeats = lambda items: 1 - len(set(items)) / len(items)
    return {
        "log_chars": math.log1p(len(t)),
        "mean_word": len(t) / max(len(words), 1),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "punctuation": share(r"[^\p{L}\p{N} \t\n\x0b\f\r]"),
        "sentence_marks": len(regex.findall(rf"[.!?](?:{blank}|$|(?=\n\Z))", t)) / n,
        "commas": share(","),
        "odd_symbols": share(r"[#$%&*@^~_=+<>{}\[\]\\]"),
        "mark_runs": share(r"[^\p{L}\p{N} \t\n\x0b\f\r]{2,}"),
        "bangs": share("!!"),
        "bars": share(r"\|"),
        "links": share(r"https?:|www\."),
        "lines": share("\n"),
        "doubled_words": len(regex.findall(rf"(?<![^ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+){blank}+\1(?![^ \t\n\x0b\f\r])", t)) / n,
        "word_repeats": repeats(words),
        "line_repeats": repeats(t.split("\n")),
    }


def brute_quality(rows, model):
    kept = []
    for r in rows:
        s, total = statistics(r["text"]), model.bias
        for conditions, weight in model.rules:
            if all((s[n] > at) if above else (s[n] <= at) for n, above, at in conditions):
                total += weight
        if 1 / (1 + math.exp(-total)) >= KEEP_SCORE:
            kept.append(r)
    return kept


def brute_near(rows):
    rows = in_order(rows)
    sets = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [r for i, r in enumerate(rows) if find(i) == i]


def brute_substrings(rows):
    seen, out = set(), []
    for r in in_order(rows):
        words = (r["text"] or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = True
            seen.add(window)
        if gone.any():
            text = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
            if text:
                out.append(r | {"text": text, "n_chars": len(text)})
        else:
            out.append(r)
    return out


def as_set(rows):
    return sorted((tuple(r[c] for c in SCHEMA.names) for r in rows), key=repr)


def collected(df):
    assert df.columns == SCHEMA.names
    return [r.asDict() for r in df.collect()]


def check_packing(docs, pieces):
    library = Tokenizer.from_file(JSON)
    want, got = defaultdict(list), defaultdict(list)
    for r in docs:
        want[r["doc_id"]] += [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    for p in sorted(pieces, key=lambda p: p.start):
        got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    counts = defaultdict(int)
    for r in docs:
        counts[r["doc_id"]] += 1
    assert want.keys() == got.keys()
    assert all(got[i] == want[i] if n == 1 else sorted(got[i]) == sorted(want[i]) for i, n in counts.items())


def test_each_stage_and_the_whole_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = collected(docs)
    kept = [
        brute_quality(rows, quality_model(spark, corpus)),
        None,
        None,
    ]
    kept[1] = brute_near(kept[0])
    kept[2] = brute_substrings(kept[1])
    assert len(rows) > len(kept[0]) > len(kept[1]) >= len(kept[2])
    for (_, stage), want in zip(corpus_pipeline.STAGES, kept, strict=False):
        got = collected(stage(spark, docs, corpus))
        assert as_set(got) == as_set(want)
        docs = spark.createDataFrame([tuple(r[c] for c in SCHEMA.names) for r in want], SCHEMA)
    check_packing(kept[2], corpus_pipeline.run(spark, corpus).collect())


def test_a_unique_text_of_a_repeated_id_stays(spark):
    p, u = prose("p", 40), prose("u", 40)
    docs = spark.createDataFrame([(i, t, len(t), None, None, None, None) for i, t in ((1, p), (5, p), (5, u))], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, GIVEN)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, p), (5, u)]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{GIVEN}/labels.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
