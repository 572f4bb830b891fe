import random

import pytest
from conftest import rows

from tablelens import alias_hops, resolve_aliases


def follow(links):
    out = []
    for start in links:
        at, hops, seen = start, 0, set()
        while links.get(at) is not None and at not in seen:
            seen.add(at)
            at, hops = links[at], hops + 1
        cyclic = links.get(at) is not None
        out.append((start, None if cyclic else at, None if cyclic else hops, cyclic))
    return sorted(out, key=repr)


def solve(spark, links):
    df = spark.createDataFrame(list(links.items()), "id long, target long")
    return rows(resolve_aliases(df))


def test_chain_cycle_and_unlisted_target(spark, either):
    links = {1: None, 2: 1, 3: 2, 4: 3, 5: 6, 6: 5, 7: 5, 8: 99, 9: 8, 10: 10}
    assert solve(spark, links) == follow(links)


def test_long_chain(spark):
    links = {i: i - 1 if i else None for i in range(300)}
    assert solve(spark, links) == follow(links)


def test_hub_with_a_third_of_all_ids(spark, hot):
    hot(20)
    rng = random.Random(1)
    links = {0: None} | {i: 0 if i % 3 == 0 else rng.randrange(i) for i in range(1, 400)}
    assert solve(spark, links) == follow(links)


@pytest.mark.parametrize("links", [{1: None}, {1: 1}, {1: 2}])
def test_single(spark, links):
    assert solve(spark, links) == follow(links)


def test_roots_are_no_aliases(spark):
    rng = random.Random(2)
    links = {i: rng.choice([None, rng.randrange(200)]) for i in range(200)}
    got = solve(spark, links)
    assert got == follow(links)
    assert all(links.get(root) is None for _, root, _, cyclic in got if not cyclic)


def ways(links, wanted=None):
    out = []
    for start in links if wanted is None else wanted & links.keys():
        at, seen, way = start, {start}, []
        while links.get(at) is not None and links[at] not in seen:
            at = links[at]
            seen.add(at)
            way.append(at)
        cyclic = links.get(at) is not None
        out += [(start, n, via, cyclic) for n, via in enumerate(way, 1)]
    return sorted(out, key=repr)


def listed(spark, links, wanted=None):
    df = spark.createDataFrame(list(links.items()), "id long, target long")
    ids = None if wanted is None else spark.createDataFrame([(i,) for i in wanted], "name long")
    return rows(alias_hops(df, ids=ids))


def test_hops_of_chains_and_cycles(spark, either):
    links = {1: None, 2: 1, 3: 2, 4: 3, 5: 6, 6: 5, 7: 5, 8: 99, 9: 8, 10: 10, 11: 10, 20: 21, 21: 22, 22: 23, 23: 24, 24: 20, 25: 20}
    assert listed(spark, links) == ways(links)
    assert listed(spark, links, {4, 7, 1, 1000, 25}) == ways(links, {4, 7, 1, 1000, 25})


def test_hops_of_random_links(spark):
    dice = random.Random(3)
    links = {i: dice.choice([None, *range(60)]) if i % 9 else None for i in range(50)}
    assert listed(spark, links) == ways(links)


def test_hops_of_one_long_chain(spark):
    links = {i: i - 1 if i else None for i in range(70)}
    assert sorted(listed(spark, links, {69})) == [(69, n, 69 - n, False) for n in range(1, 70)]
    assert listed(spark, {1: None}) == [] == listed(spark, {})
