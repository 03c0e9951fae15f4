"""Order statistics against numpy."""

import random

import numpy as np
import pytest

from tessella.operators import order


@pytest.mark.parametrize("kind", ["spread", "hot", "few", "one", "odd"])
def test_quantiles_as_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(order, "BOUNDS", 8)
    r = random.Random(3)
    draw = {"spread": lambda: r.lognormvariate(0, 9), "hot": lambda: 5.0 if r.random() < 0.8 else r.uniform(0, 10), "few": lambda: float(r.randrange(3)), "one": lambda: 1.0, "odd": lambda: r.choice([None, float("nan"), r.random()])}[kind]
    rows = [(r.choice(["a", "b", None]), draw()) for _ in range(3000)] + [("lone", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: (x.low, x.mid, x.top) for x in order.quantiles(df, "v", {"low": 0.13, "mid": 0.5, "top": 1.0}, ["k"]).collect()}
    for k in {"a", "b", None, "lone"}:
        v = [x for g, x in rows if g == k and x is not None and x == x]
        assert got[k] == pytest.approx(tuple(np.percentile(v, [13, 50, 100])))
    v = sorted(x for _, x in rows if x is not None and x == x)
    whole = order.quantiles(df, "v", {"q": 0.4}).collect()
    assert [x.q for x in whole] == pytest.approx([np.percentile(v, 40)])
    assert order.lower_median(df, "v").first().x == v[(len(v) - 1) // 2]


def test_nothing_to_order(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert order.quantiles(df, "v", {"q": 0.5}, ["k"]).count() == 0
    assert order.lower_median(df, "v").first().x is None
