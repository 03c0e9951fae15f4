import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import hashing as H

KIND = "vec_id long, embedding array<double>, id long, V string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND)


def brute(rows, top=H.TOP):
    """Per query id: all scores of the other rows, nearest first."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asked = {}
    for i, v in fine:
        if i % H.EVERY == 0:
            asked[i] = min(asked.get(i, v), v)
    return {q: sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != q)[:top] for q, v in asked.items()}


def recall(got, want):
    found = {}
    for q, _, j, s in got:
        found.setdefault(q, []).append((j, s))
    hit = sum(sum(s >= -best[-1][0] - 1e-9 for _, s in found.get(q, [])) for q, best in want.items() if best)
    return hit / sum(map(len, want.values()))


def checked(got, rows, want):
    vectors = {}
    for i, v in rows:
        vectors.setdefault(i, []).append(v)
    by = {}
    for q, rank, j, s in sorted(got):
        by.setdefault(q, []).append((rank, -s, j))
        assert q != j and any(abs(sum(a * b for a, b in zip(v, w)) - s) < 1e-9 for v in vectors[q] for w in vectors[j] if v and w)
    assert set(by) == {q for q, best in want.items() if best}
    for q, found in by.items():
        assert [r for r, *_ in found] == list(range(1, len(want[q]) + 1))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)


@pytest.mark.parametrize("kind", ["unit", "lengths", "clusters", "short"])
def test_recall(spark, kind):
    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 5 if kind == "short" else 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= r.lognormal(0, 0.3, (1500, 1))
    if kind == "clusters":
        x = r.standard_normal((12, 32))[r.integers(0, 12, 1500)] + 0.2 * r.standard_normal((1500, 32))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    index = H.build(H.sound(frame(spark, rows)))
    got = [tuple(t) for t in H.search(index, H.sound(frame(spark, rows)).where(f"id % {H.EVERY} = 0")).collect()]
    want = brute(rows)
    checked(got, rows, want)
    assert recall(got, want) >= 0.9


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "QUERY_BYTES", 200)
    r = random.Random(2)
    rows = [(k, [r.uniform(-1, 1) for _ in range(4)]) for k in range(90)]
    rows += [(500, None), (520, []), (540, [0.0] * 4), (560, [1.0, None]), (580, [float("nan")]), (600, [float("inf")]), (None, [1.0] * 4), (620, [0.5, 0.25])]
    rows += [(100 + k, [0.9, 0.1, 0.1, 0.1]) for k in range(60)] + [(20, rows[20][1])] * 30 + [(40, rows[3][1]), (7, rows[7][1]), (7, rows[8][1])]
    index = H.build(H.sound(frame(spark, rows)))
    wide = H.Index(index.model._replace(radius=H.BITS), index.rows, index.count)
    got = [tuple(t) for t in H.search(wide, H.sound(frame(spark, rows)).where("id % 20 = 0")).collect()]
    want = brute(rows)
    checked(got, rows, want)
    assert {q: [j for _, _, j, _ in sorted(g for g in got if g[0] == q)] for q in want} == {q: [j for _, j in best] for q, best in want.items()}
    narrow = H.Index(index.model._replace(radius=3), index.rows, index.count)  # goes on in wider radii
    checked([tuple(t) for t in H.search(narrow, H.sound(frame(spark, rows)).where("id % 20 = 0")).collect()], rows, want)
    assert H.build(H.sound(frame(spark, rows)).limit(0)) is None


def test_few_rows(spark):
    for n in (1, 2, 5):
        rows = [(20 * k, [1.0, float(k)]) for k in range(n)]
        df = H.sound(frame(spark, rows))
        got = [tuple(t) for t in H.search(H.build(df), df).collect()]
        checked(got, rows, brute(rows))
        assert len(got) == n * (n - 1)


def test_every_code_within_the_radius_is_met():
    r = np.random.default_rng(1)
    own = r.integers(-(2**63), 2**63 - 1, (300, 2))
    asked = own[:20] ^ (1 << r.integers(0, 62, (20, 2)))
    index = H.tables_of(own)
    for radius in (0, 1, 3, 4, 30, 60, 128):
        q, p = H.probe(index, H.pieces(asked), H.bounds(radius, 128 // H.PIECE), 300)
        met = set(zip(q.tolist(), p.tolist(), strict=True))
        bits = [[bin((int(a[0]) ^ int(b[0])) & (2**64 - 1)).count("1") + bin((int(a[1]) ^ int(b[1])) & (2**64 - 1)).count("1") for b in own] for a in asked]
        assert [H.distance(own, a).tolist() for a in asked] == bits
        assert all((i, j) in met for i in range(20) for j in range(300) if bits[i][j] <= radius)
        assert len(met) == len(q)
    assert H.search_block(pa.table({"is_query": pa.array([True]), "id": [1]}), 2, 3, 20).num_rows == 0
