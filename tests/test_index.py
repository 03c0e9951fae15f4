"""The stored vector index against a full scan."""

import numpy as np
import pytest

from tessella.operators import index, similarity


def rows(kind):
    r = np.random.default_rng(4)
    n = 1200
    x = {"groups": lambda: 5 * r.standard_normal((30, 16))[r.integers(0, 30, n)] + 0.2 * r.standard_normal((n, 16)), "even": lambda: r.standard_normal((n, 16)), "copies": lambda: np.repeat(r.standard_normal((3, 16)), n // 3, 0)}[kind]()
    return [(k, v) for k, v in enumerate(x.tolist())]


@pytest.mark.parametrize("kind", ["groups", "even", "copies"])
def test_as_a_scan(spark, monkeypatch, kind):
    data = rows(kind)
    df = spark.createDataFrame(data, "id long, v array<double>")
    idx = index.build(df, 40)
    assert idx.sizes.sum() == len(data)
    x = np.array([v for _, v in data])
    for q in (0, 7, 500):
        found, cells = index.search(idx, data[q][1], 20)
        away = np.linalg.norm(x - x[q], axis=1)
        got = [(r.id, r.distance) for r in found.collect()]
        best = np.lexsort((np.arange(len(x)), np.round(away, 9)))[:20]
        assert [d for _, d in got] == pytest.approx(sorted(away)[:20], abs=1e-7) and sorted(i for i, _ in got) == sorted(best.tolist())
        if kind == "groups":
            assert len(cells) <= 0.2 * (idx.sizes > 0).sum()
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
    monkeypatch.setattr(index, "BLOCK", 50)
    graph, share = index.nearest_rows(idx, 5)
    key = lambda df_: sorted((r.src, r["rank"], r.dst) for r in df_.collect())
    assert key(graph) == key(similarity.nearest(df, df, 5))
    if kind == "groups":
        assert share <= 0.2


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    idx = index.build(df)
    assert sorted(r.id for r in index.search(idx, [1.0, 0.0], 5)[0].collect()) == [1, 3]
    assert [(r.src, r.dst) for r in index.nearest_rows(idx, 5)[0].orderBy("src").collect()] == [(1, 3), (3, 1)]
    empty = index.build(df.limit(0))
    assert index.search(empty, [], 5)[0].count() == 0 and index.nearest_rows(empty, 5)[0].count() == 0
