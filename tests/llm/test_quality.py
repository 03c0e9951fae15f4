import numpy as np

from tessella.llm import quality as Q


def test_learns_steps_and_interactions():
    r = np.random.default_rng(0)
    x = r.random((4000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.Additive.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert {0, 1} in [{i, j} for i, j, _ in m.pairs]
    brute = [m.base + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(m.edges, m.tables, row)) + sum(t[np.searchsorted(m.coarse[i], row[i], "right"), np.searchsorted(m.coarse[j], row[j], "right")] for i, j, t in m.pairs) for row in x[:50]]
    assert np.allclose(m.score(x[:50]), 1 / (1 + np.exp(-np.array(brute))))


def test_no_labels():
    m = Q.Additive.fit(np.empty((0, len(Q.FEATURES))), np.empty(0))
    assert np.allclose(m.score(np.zeros((2, len(Q.FEATURES)))), 0.5)
    assert Q.Additive.fit(np.zeros((3, len(Q.FEATURES))), np.ones(3)).score(np.zeros((1, len(Q.FEATURES))))[0] == 0.8


def test_features_of_odd_texts():
    for t in (None, "", " \n", "é" * 100_000, "A" * 100_000, "\ud800"):
        assert len(Q.features(t)) == len(Q.FEATURES) and np.isfinite(Q.features(t)).all()


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", None), (None, "x", 1.0), (2, "", None)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    got = Q.scored(df, Q.train(df, labels)).collect()
    assert len(got) == 4 and all(0 <= r.quality_score <= 1 for r in got)
    assert Q.scored(df.limit(0), Q.train(df.limit(0), labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op1_quality(spark, sf).collect()}
    assert all(r.held_out == Q.is_held_out(r.doc_id) for r in got.values())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    right = [got[d].predicted == q for d, q in labels if Q.is_held_out(d)]
    assert len(right) > 30 and np.mean(right) > 0.93
    assert {r.doc_id: r.score for r in Q.op1_quality(spark, sf).collect()} == {d: r.score for d, r in got.items()}
