"""Connected components of shapes that take a naive method many rounds."""

import random

import pytest

from keystrata.llm.components import components


def roots(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for x in root:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


R = random.Random(6)
SHAPES = {
    "chain": [(i, i + 1) for i in range(200)],
    "falling chain": [(i + 1, i) for i in range(200)],
    "star": [(500, i) for i in range(100)],
    "star the other way": [(i, 500) for i in range(100)],
    "cycle": [(i, (i + 1) % 30) for i in range(30)],
    "random": [(R.randrange(150), R.randrange(150)) for _ in range(90)],
    "loop": [(3, 3), (4, 5), (4, 5), (5, 4)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    edges = SHAPES[shape]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.row)
    assert sorted(map(sorted, got.values())) == roots([e for e in edges if e[0] != e[1]])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
