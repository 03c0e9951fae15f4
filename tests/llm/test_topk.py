import math
import random

from tessella.llm import topk as K


def brute(rows, top):
    vs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], {}
    for i, v in vs:
        if i % 100 == 0:
            seen[i] = min(seen.get(i, v), v)
    for i, v in seen.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vs if j != i)[:top]
        out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    return sorted(out)


def test_as_brute_force(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, [round(r.uniform(-1, 1), 1) if r.random() < 0.7 else 0.0 for _ in range(r.choice([6, 6, 6, 3]))]) for k in range(500)]
    rows += [(600, None), (700, [1.0, None]), (800, [float("nan")]), (900, [float("inf")]), (None, [1.0]), (1000, []), (100, rows[100][1]), (7, rows[7][1]), (7, rows[8][1])] + [(9, [0.5, 0.25])] * 300 + [(11, [3.0] * 6)] * 4
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, id long, v string")
    for block in (64, 4096):
        monkeypatch.setattr(K, "CANDIDATE_BLOCK", block)
        monkeypatch.setattr(K, "QUERY_BYTES", 100)
        x = K.integer_vectors(df)
        got = sorted(tuple(t) for t in K.top_k(x.where("id % 100 = 0"), x).collect())
        assert got == brute(rows, 10)
    assert K.top_k(x.limit(0), x).count() == K.top_k(x, x.limit(0)).count() == 0
