import random
import re

import numpy as np
import pytest

from tessella.llm import neardup as N


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, size):
    sets = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            sets.setdefault(d, frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids, inv = sorted(sets), {}
    for d in ids:
        for s in sets[d]:
            inv.setdefault(s, []).append(d)
    seen = set()
    for g in inv.values():
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_hash_minima_estimate_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 1000, np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 1 << 63, 100, np.uint64)])
    m = N.minima([np.unique(a), np.unique(b)])
    assert abs((m[0] == m[1]).mean() - 900 / 1100) < 0.08
    s = N.sketches(m)
    assert sum(bin(int(x) & (1 << 64) - 1).count("1") for x in s[0] ^ s[1]) < N.MOST_APART
    assert (N.band_keys(m)[0] == N.band_keys(m)[1]).any()


def test_shingles():
    assert len(N.shingles(None, 4)) == len(N.shingles(" \n", 4)) == 0
    assert len(N.shingles("a b", 4)) == 1 and len(N.shingles("a b c d e", 4)) == 2
    assert N.shingles("A b\x0bC", 4).tolist() == N.shingles("a B c", 4).tolist() != N.shingles("Ä b c", 4).tolist()
    assert len(N.shingles("a b c", 4)) == 1 and N.shingles("a b c", 4)[0] != N.shingles("a b", 4)[0]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2300)]
    comp = {x: x for e in edges for x in e}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        comp[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in comp if root(x) != x}


@pytest.mark.parametrize(("draws", "cell"), [(4, 256), (0, 7)])
def test_as_brute_force(spark, monkeypatch, draws, cell):
    """Also with no rounds at all, so that the cells find every link that the first stars miss."""
    monkeypatch.setattr(N, "DRAWS", draws)
    monkeypatch.setattr(N, "CELL", cell)
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(500)]
    rows = [(0, None), (1, ""), (2, " "), (3, "a b"), (4, "A  B"), (5, "one two three four")]
    for g in range(40):
        base = r.choices(vocab, k=r.randint(5, 200))
        for _ in range(r.randint(1, 25)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(10, rows[10][1]), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, key int, rep string")
    want = brute(rows, 4)
    got = N.near_duplicates(df, 4).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is None:
            assert x.kept and x.component_id is None
        else:
            assert (x.n_shingles, x.component_id) == want[x.doc_id] and x.kept == (x.doc_id == x.component_id)
    assert N.near_duplicates(df.limit(0), 4).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.op3_neardup(spark, sf).collect()}
    assert got == want


def test_chained_buckets_take_near_linear_work(spark, monkeypatch):
    """Texts of which each shares buckets with the next, but isn't linked: one zone of buckets, yet few comparisons."""
    r, n = random.Random(11), 300
    runs = [[f"w{r.randint(0, 10**9)}" for _ in range(20)] for _ in range(n + 9)]
    rows = [(k, " ".join(w for run in runs[k : k + 9] for w in run)) for k in range(n)]
    done = []

    def counted(loose, nodes, percent):
        done.append(loose.groupBy("key").agg(N.F.sum((N.F.col("component") != N.F.col("main")).cast("long")).alias("out"), N.F.count("*").alias("all")).agg(N.F.sum(N.F.col("out") * N.F.col("all"))).first()[0])
        return nearby(loose, nodes, percent)

    nearby = N.nearby
    monkeypatch.setattr(N, "nearby", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == brute(rows, 4) and len({c for _, c in got.values()}) == n
    assert n < done[0] < 60 * n

