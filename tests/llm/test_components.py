"""Components against union-find: chains, stars, random links, in one go and in two."""

import random

import pytest

from leafloom.llm.components import components, grow


def plain(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("kind", ["chain", "random"])
def test_components(spark, kind):
    rng = random.Random(4)
    ids = rng.sample(range(1000), 120)
    links = list(zip(ids, ids[1:], strict=False)) if kind == "chain" else [tuple(rng.sample(ids, 2)) for _ in range(90)] + [(5000, k) for k in range(6000, 6030)]
    rng.shuffle(links)
    df = lambda part: spark.createDataFrame(part, "a bigint, b bigint")
    assert {r.key: r.comp for r in components(df(links)).collect()} == plain(links)
    if kind == "random":
        half = grow(grow(None, df(links[:50])), df(links[50:]))
        assert {r.key: r.comp for r in half.collect()} == plain(links)
