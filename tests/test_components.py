"""Components: stars, paths, hubs in parts, odd edges."""

import random

import pytest

from tessella.operators import graph


def brute(edges, nodes):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            at[n] = at[at[n]]
            n = at[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            at[b] = a
    return {n: top(n) for n in nodes}


def cases():
    r = random.Random(7)
    yield "random", [(r.randrange(400), r.randrange(400)) for _ in range(260)], range(400)
    yield "star", [(50_000, k) for k in range(100_001)], range(100_001)
    yield "path", [(k, k + 1) for k in range(3000)], range(3001)
    yield "odd", [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None)], range(7)
    yield "none", [], range(3)


@pytest.mark.parametrize("name, edges, nodes", list(cases()))
def test_components(spark, monkeypatch, name, edges, nodes):
    if name in ("star", "random"):
        monkeypatch.setattr(graph, "HUB", 20)
        monkeypatch.setattr(graph, "HUB_SHARE", 40)
    rounds = []
    table = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or table(df))
    ids = list(nodes)
    random.Random(1).shuffle(ids)
    name_of = dict(zip(nodes, ids, strict=True)) | {None: None}  # so that neighbours aren't neighbours by number
    renamed = [(name_of[a], name_of[b]) for a, b in edges]
    got = graph.components(spark.createDataFrame(renamed, "a long, b long"), spark.createDataFrame([(n,) for n in ids], "n long"))
    assert {r.node: r.component for r in got.collect()} == brute(renamed, ids)
    assert len(rounds) <= 2 * 14 + 1
