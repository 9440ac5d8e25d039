import random

import pytest

from inkspark.llm.components import components


def brute(edges):
    label = {v: v for e in edges for v in e}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {v: root(v) for v in label}


PATH = random.Random(1).sample(range(1000), 60)
CASES = {
    "chain": [(i, i + 1) for i in range(40)],
    "chain downwards": [(i + 1, i) for i in range(40)][::-1],
    "star": [(i, 99) for i in range(200, 400)] + [(1, 399)],
    "shuffled chain": list(zip(PATH, PATH[1:])),
    "random": [(random.Random(i).randrange(150), random.Random(-i - 1).randrange(150)) for i in range(120)],
    "loops and repeats": [(1, 1), (2, 3), (3, 2), (2, 3)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    df = spark.createDataFrame(CASES[name], "a long, b long")
    want = {v: c for v, c in brute(CASES[name]).items() if any(a != b and v in (a, b) for a, b in CASES[name])}
    assert {r.v: r.component for r in components(df).collect()} == want
