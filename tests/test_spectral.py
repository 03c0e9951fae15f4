"""Truncated SVD and the sketch against numpy."""

import numpy as np
import pytest

from tessella.operators import spectral


def frame(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, v array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["decay", "wide", "rank"])
def test_as_numpy(spark, kind):
    r = np.random.default_rng(2)
    left, right = r.standard_normal((300, 60)), np.linalg.qr(r.standard_normal((60, 60)))[0]
    x = {"decay": lambda: left @ np.diag(0.8 ** np.arange(60)) @ right, "wide": lambda: left[:, :9], "rank": lambda: left[:, :3] @ right[:3]}[kind]()
    got, values, vectors = spectral.truncated_svd(frame(spark, x), 5)
    u, s, vh = np.linalg.svd(x, full_matrices=False)
    n = min(5, int((s > 1e-9 * s[0]).sum()))
    assert values == pytest.approx(s[:n], rel=1e-6) and len(vectors) == n
    assert np.abs(np.sum(vectors * vh[:n], 1)) == pytest.approx(np.ones(n), abs=1e-5)
    mine = np.array([r.u for r in got.orderBy("id").collect()])
    assert mine.T @ mine == pytest.approx(np.eye(n), abs=1e-5)


def test_no_rows(spark):
    got, values, _ = spectral.truncated_svd(frame(spark, np.ones((2, 3))).limit(0), 2)
    assert got.count() == 0 and not len(values) and np.isnan(spectral.covariance_penalty(got))


def test_penalty_of_narrow_and_wide_rows(spark):
    x = np.random.default_rng(3).standard_normal((200, 12))
    direct = lambda y: np.linalg.norm(np.cov(y.T) * (len(y) - 1) / (len(y) - 1 + 1e-6) - np.eye(y.shape[1]))
    assert spectral.covariance_penalty(frame(spark, x)) == pytest.approx(direct(x))
    wide = np.random.default_rng(4).standard_normal((60, 4096))
    draw = np.vstack([np.random.default_rng([0, at]).standard_normal((256, 32)) for at in range(0, 4096, 256)]) / 64
    assert spectral.covariance_penalty(frame(spark, wide), 32) == pytest.approx(direct(wide @ draw))


def test_few_passes_over_narrow_rows(spark, monkeypatch):
    """Even values take many steps, but only the Gram matrix and the last looks read the rows."""
    x = np.random.default_rng(6).standard_normal((400, 40))
    passes, added = [], spectral._added
    monkeypatch.setattr(spectral, "_added", lambda *a: passes.append(1) or added(*a))
    _, values, _ = spectral.truncated_svd(frame(spark, x), 3)
    assert values == pytest.approx(np.linalg.svd(x, compute_uv=False)[:3], rel=1e-6) and len(passes) <= 4
    monkeypatch.setattr(spectral, "GRAM", 1)
    assert spectral.truncated_svd(frame(spark, x[:, :12]), 3)[1] == pytest.approx(np.linalg.svd(x[:, :12], compute_uv=False)[:3], rel=1e-6)
