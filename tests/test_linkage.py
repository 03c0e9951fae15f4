"""Average linkage in rounds against one merge at a time, in numpy."""

import numpy as np
import pytest

from tessella.operators.transfer import average_linkage


def brute(x, clusters):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    members = [[k] for k in range(len(x))]
    while len(members) > clusters:
        i, j = min(((i, j) for i in range(len(members)) for j in range(i + 1, len(members))), key=lambda p: d[np.ix_(members[p[0]], members[p[1]])].mean())
        members[i] += members.pop(j)
    return {frozenset(m) for m in members}


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    assert [min(out[k]) for k in sorted(out)] == sorted(min(m) for m in out.values()) and sorted(out) == list(range(len(out)))
    return {frozenset(m) for m in out.values()}


@pytest.mark.parametrize(("local", "clusters"), [(500, 5), (10, 12), (1, 1)])
def test_same_clusters(spark, local, clusters):
    x = np.random.default_rng(clusters).normal(size=(60, 3)) * [1, 5, 1]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    assert groups(average_linkage(df, clusters, local)) == brute(x, clusters)


def test_few_rows(spark):
    df = spark.createDataFrame([(7, [0.0]), (3, [0.0]), (5, [4.0]), (None, [1.0])], "id long, v array<double>")
    assert groups(average_linkage(df, 2)) == {frozenset({3, 7}), frozenset({5})}
    assert groups(average_linkage(df, 9)) == {frozenset({3}), frozenset({5}), frozenset({7})}
    assert average_linkage(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        average_linkage(df, 0)
