import random

import pytest
from pyspark.sql import functions as F

from loanloom.llm.components import components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops"])
def test_by_union_find(spark, kind):
    draw = random.Random(4)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(1000, i) for i in range(80)],
        "random": [(draw.randrange(120), draw.randrange(120)) for _ in range(70)],
        "loops": [(1, 1), (2, 2), (3, 4), (4, 3), (4, 3)],
    }[kind]
    links = [(a, b) for a, b in links]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute([(a, b) for a, b in links if a != b])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_no_links(spark):
    none = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert components(none).collect() == []
