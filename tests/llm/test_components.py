from __future__ import annotations

import random

from ledgerloom.llm.order_minhash import components


def brute(edges: list[tuple[int, int]]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        top, bottom = sorted((root(a), root(b)), reverse=True)
        parent[top] = bottom
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5, 2000 + i) for i in range(50)]
    loose = [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(120)]
    edges = [e for e in path + star + loose if e[0] != e[1]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
