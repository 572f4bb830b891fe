"""Registered queries over whole tables, vectors, dialogues and the classifier."""

import zlib

import numpy as np
import pytest
from compare import differences, duck
from conftest_llm import documents  # noqa: F401

from __spark_entry__ import oracle_sql, queries
from tablelens.llm.forest import SPILL, TREES, grow, near_vectors
from tablelens.llm.perspectives import rotate_perspectives
from tablelens.llm.quality import RuleEnsemble, fit_rules, score_quality, train

SMALL = "/root/testdata/sf0.01"


def test_all_are_registered():
    names = {n.partition("_")[0] for n in queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in queries()


def test_perspectives_agree_with_sql(spark):
    got = queries()["op8_perspectives"](spark, SMALL).toArrow()
    assert differences(got, duck(SMALL).sql(oracle_sql()["op8_perspectives"]).to_arrow_table()) == []


def test_perspectives_of_odd_turns(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, None, "x"), (2, 0, "system", "s")]
    got = rotate_perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.participant) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown")}
    for who in ("ann", "bob", "unknown"):
        mine = sorted((r for r in got if r.participant == who), key=lambda r: r.position)
        whole = "".join(r.rendered for r in mine)
        assert [r.start for r in mine] == np.cumsum([0, *[len(r.rendered) for r in mine]])[:-1].tolist()
        spoken = [whole[r.loss_start : r.loss_end] for r in mine if r.speaker == who]
        assert all(s.endswith("<|im_end|>\n") for s in spoken) and len(spoken) == 1
        assert all(r.loss_start == r.loss_end for r in mine if r.speaker != who)
    assert rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_quality_on_held_out_rows(spark):
    got = queries()["op1_quality_rules"](spark, SMALL).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id").quality
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    mine = got[got.held_out].join(labels, how="inner")
    assert (mine.predicted == mine.quality).mean() > 0.9


def test_quality_without_labels_or_texts(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = train(documents((1, "x")), labels)
    got = score_quality(documents((1, None), (2, ""), (2, "")), model).collect()
    assert [r.score for r in got] == [0.5] * 3 and [r.predicted for r in got] == [1] * 3
    assert score_quality(documents(), RuleEnsemble(0.0, ())).collect() == []


def test_rules_find_a_conjunction():
    random = np.random.default_rng(0)
    x = random.random((3_000, 3))
    y = ~((x[:, 0] > 0.6) & (x[:, 1] < 0.5))
    model = fit_rules(x, y, ["a", "b", "c"])
    total = np.full(len(x), model.bias)
    for conditions, weight in model.rules:
        holds = np.ones(len(x), bool)
        for name, above, threshold in conditions:
            v = x[:, "abc".index(name)]
            holds &= v > threshold if above else v <= threshold
        total += weight * holds
    assert ((total > 0) == y).mean() > 0.97


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")


def test_forest_against_brute_force(spark):
    random = np.random.default_rng(3)
    centers = random.standard_normal((300, 32))
    x = np.concatenate([centers, centers[:100] + 0.2 * random.standard_normal((100, 32)), np.repeat(centers[:1], 300, axis=0) + 0.1 * random.standard_normal((300, 32)), centers[:5]])
    x = x.astype(np.float32)
    got = near_vectors(vectors(spark, [(i, v.tolist(), "r") for i, v in enumerate(x)])).toPandas().set_index("vec_id").sort_index()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert (got.n_links <= want).all() and got.n_links.sum() >= 0.98 * want.sum() > 1_000
    assert (got.kept == (got.component_id == got.index)).all()


def test_a_tree_is_as_large_as_its_sample(spark):
    """A depth that a large table asks for costs nothing where the sample is small, and planted
    pairs are still found at the full depth of the sample."""
    random = np.random.default_rng(4)
    x = random.standard_normal((4_096, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    trees = [grow(x, 40, SPILL * np.sqrt(0.2 / 32), seed) for seed in range(TREES)]
    assert all(len(t.nodes) < 512 for t in trees) and len(grow(x[:5], 9, 0.1, 1).nodes) == 0
    noise = random.standard_normal((4_096, 32))
    near = x + 0.44 * noise / np.linalg.norm(noise, axis=1)[:, None]
    near /= np.linalg.norm(near, axis=1)[:, None]
    linked = np.flatnonzero((x * near).sum(axis=1) >= 0.9)
    met = np.zeros(len(x), bool)
    for t in trees:
        seen = set(zip(*t.leaves(x), strict=True))
        for row, leaf in zip(*t.leaves(near), strict=True):
            met[row] |= (row, leaf) in seen
    assert len(linked) > 1_000 and met[linked].mean() > 0.98


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (10, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = {r.vec_id: tuple(r)[1:] for r in near_vectors(vectors(spark, [(*r, "r") for r in rows])).collect()}
    assert got == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)} | {7: (2, 7, True), 8: (2, 7, False), 10: (2, 7, False), None: (0, None, True)}
    assert near_vectors(vectors(spark, [])).collect() == []


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_pipeline_stages(spark, stages):
    counts = [after.count() for _, _, after in stages]
    assert 1_000 > counts[0] > counts[1] >= counts[2]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])
    packed, docs = stages[-1][2], stages[-1][1]
    assert packed.select("doc_id").distinct().count() == docs.count()
    # A second pass of the near-duplicate stage finds nothing more.
    import corpus_pipeline

    assert corpus_pipeline.STAGES[1][1](spark, stages[1][2], SMALL).count() == counts[1]


def test_substring_stage_with_odd_ids(spark, documents):
    import corpus_pipeline

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = words("p", 30)
    rows = [(1, passage), (2, f"a  {passage} b"), (2, f"{passage} c"), (3, passage), (None, f"d {passage}"), (None, None), (None, "x\n y"), (4, "")]
    got = corpus_pipeline.substring_dedup(spark, documents(*rows), SMALL)
    assert got.columns == documents().columns
    left = [(1, passage), (2, "a b"), (2, "c"), (None, "d"), (None, None), (None, "x\n y"), (4, "")]
    want = sorted(((i, t, None, None, None if t is None else len(t), "k", "r", "s") for i, t in left), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
