"""Hand tables with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import vector as V
from tessella.operators import descriptions as D
from tessella.operators import glyphs as G
from tessella.operators import graph, paths, retrieval, similarity, tfidf, transfer


def lit(*xs):
    return V.literal_vector(list(xs))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pool_and_dot(spark):
    g = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [0.0, 2.0])], "font string, v array<double>")
    p = similarity.pool(g, ["font"])
    assert p.first().v == pytest.approx([0.3, 0.9])
    assert similarity.search_dot(p, lit(1, 0)).first().score == pytest.approx(0.3)


def test_positive_weights(spark):
    rows = [(k, ["t"] * 2 if k == 0 else [], {}) for k in range(100)]
    d = spark.createDataFrame([(k, a + (["u"] if k < 25 else []), m) for k, a, m in rows], "key int, adjectives array<string>, tags map<string,double>")
    vocab = spark.createDataFrame([("t",), ("u",), ("none",)], "tag string")
    assert {r.tag: r.w for r in D.positive_weights(d, vocab).collect()} == {"t": 50.0, "u": 3.0, "none": 50.0}


def test_weighted_jaccard(spark):
    m = lambda **k: F.create_map(*(x for a, b in k.items() for x in (F.lit(a), F.lit(b)))) if k else F.create_map().cast("map<string,double>")
    assert value(spark, V.weighted_jaccard(m(x=0.5, y=0.2), m(x=0.3, z=0.4))) == pytest.approx(0.272727, abs=1e-6)
    assert value(spark, V.weighted_jaccard(m(x=0.5), m())) == 0


def test_multilabel(spark):
    p, y = [[0.9, 0.6, 0.4, 0.2], [0.3, 0.8, 0.1, 0.7]], [[1, 0, 1, 0], [0, 0, 0, 1]]
    pred = spark.createDataFrame([(i, j, p[i][j], y[i][j]) for i in range(2) for j in range(4)], "id int, tag int, p double, y int")
    m = retrieval.micro_scores(pred).first()
    assert (m.precision, m.recall, m.f1) == (pytest.approx(0.5, abs=1e-6), pytest.approx(0.666667, abs=1e-6), pytest.approx(0.571429, abs=1e-6))
    k = retrieval.at_k(pred, 2).first()
    assert (k.p_at_k, k.r_at_k) == (0.5, 0.75)


def test_average_precision(spark):
    pred = spark.createDataFrame([(k, 0, p, y) for k, (p, y) in enumerate([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)])], "id int, tag int, p double, y int")
    assert retrieval.mean_average_precision(pred).first().map == pytest.approx(0.833333, abs=1e-6)
    assert retrieval.mean_average_precision(pred.where("y = 0")).first().map == 0
    ties = pred.withColumn("p", F.lit(0.5))
    assert retrieval.mean_average_precision(ties).first().map == 0.5


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "bold clean"), (2, "bold clean serif"), (3, "script"), (4, ""), (5, None)], "id int, text string")
    (r,) = tfidf.similar_pairs(docs.where("id < 4")).collect()
    assert (r.i, r.j) == (1, 2) and r.sim == pytest.approx(0.681581, abs=1e-6)
    assert tfidf.similar_pairs(docs).count() == 1


def test_coding_rate_and_friends(spark):
    z = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 1)], "v array<double>, y int")
    assert transfer.coding_rate(z) == pytest.approx(8.517393, abs=1e-5)
    zero = z.withColumn("v", F.transform("v", lambda x: x * 0))
    assert transfer.trans_rate(zero, "y") == 0


def test_log_me_and_ridge_against_plain_numpy(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5))
    y = x @ r.normal(size=(5, 2)) + 0.3 * r.normal(size=(60, 2))
    z = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "v array<double>, y array<double>").repartition(3)
    xc, yc = x - x.mean(0), y - y.mean(0)
    w = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
    assert transfer.linear_mse(z, "y") == pytest.approx(-((yc - xc @ w) ** 2).mean())
    out = []
    for k in range(2):
        a = b = lam = 1.0
        for _ in range(11):
            g = np.linalg.eigvalsh(x.T @ x)
            m = np.linalg.solve(a * np.eye(5) + b * x.T @ x, b * x.T @ y[:, k])
            gamma = (g / (g + lam)).sum()
            am, e = m @ m, ((y[:, k] - x @ m) ** 2).sum()
            a, b = gamma / (am + 1e-5), (60 - gamma) / (e + 1e-5)
            if abs(a / b - lam) / lam < 0.01:
                break
            lam = a / b
        out.append((5 * np.log(a) + 60 * np.log(b) - np.log(a + b * g).sum() - b * (e + 1e-5) - a * (am + 1e-5) - 60 * np.log(2 * np.pi)) / 120)
    assert transfer.log_me(z, "y") == pytest.approx(np.mean(out), abs=1e-6)
    lab = z.withColumn("c", (F.get("y", F.lit(0)) > 0).cast("int"))
    c = (y[:, 0] > 0).astype(int)
    ef = x.T @ x / 60
    t1 = sum(((np.outer(v, v) - ef) ** 2).sum() for v in x) / 60**2
    t2 = ((ef - np.trace(ef) / 5 * np.eye(5)) ** 2).sum()
    al = min(1, t1 / t2)
    rr = np.stack([np.sqrt((c == k).sum()) * x[c == k].mean(0) for k in (0, 1)], 1)
    assert transfer.h_alpha(lab, "c") == pytest.approx((1 - al) / 60 * np.trace(np.linalg.inv((1 - al) * ef + al * np.eye(5)) @ rr @ rr.T))
    with pytest.raises(ValueError):
        transfer.h_alpha(lab.limit(3), "c")


def test_pearson_and_diagonal(spark):
    df = spark.createDataFrame([("s", str(k), a, b) for k, (a, b) in enumerate(zip((1.0, 2.0, 3.0, 5.0), (2.0, 1.0, 4.0, 6.0), strict=True))], "style string, letter string, t double, p double")
    ref = df.select("letter", F.lit(0.0).alias("t"), F.lit(0.0).alias("p"))
    assert retrieval.residual_correlation(df, ref, ["style"]).first().r == pytest.approx(0.902244, abs=1e-6)
    m = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.2), (1, 0, 0.4), (1, 1, 0.3)], "i int, j int, s double")
    d = retrieval.diagonal_scores(m).first()
    assert (d.d, d.auc, d.diff) == (pytest.approx(0.948680, abs=1e-5), 0.75, pytest.approx(0.3))


def test_cycle(spark):
    v = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate([(1, 0), (0, 1), (-1, 0), (0.6, 0.8)])], "font int, v array<double>")
    p = spark.createDataFrame([(0, k, k) for k in range(4)], "path_id int, pos int, font int")
    r = paths.cycle_scores(p, v).first()
    assert (r.edge, r.std, r.out) == (pytest.approx(1.0), pytest.approx(0.424264, abs=1e-6), pytest.approx(0.54))
    assert r.score == pytest.approx(2 * r.far - 2 - 2 * r.std + 0.7 * 0.54)


def test_cycle_total(spark):
    v = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate([(1, 0), (0, 1), (-1, 0), (0.6, 0.8)])], "font int, v array<double>")
    r = paths.cycle_scores(spark.createDataFrame([(0, k, k) for k in range(4)], "path_id int, pos int, font int"), v).first()
    assert r.score == pytest.approx(-0.020528, abs=1e-6) or r.far == pytest.approx(1.225, abs=1e-3)


def test_info_nce(spark):
    q = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 1, [0.6, 0.8])], "id int, fam int, v array<double>")
    k = spark.createDataFrame([(0, 1, [0.8, 0.6]), (1, 2, [0.0, 1.0]), (2, 1, [1.0, 0.0])], "id int, fam int, v array<double>")
    a = retrieval.info_nce(q, k, 0.04).first().loss
    b = retrieval.info_nce(k, q, 0.04).first().loss
    assert (a + b) / 2 == pytest.approx(2.341677, abs=1e-5)


@pytest.mark.parametrize(
    ("text", "want"),
    [("not fun, elegant", {"fun": -1, "funky": -0.5, "elegant": 1}), ("not very fun", {"fun": -1, "funky": -0.5}), ("not, fun", {"fun": 1, "funky": 0.5}), ("not elegant fun", {"elegant": -1, "fun": 1, "funky": 0.5}), ("", {}), ("zzz (.*)", {})],
)
def test_query_weights(spark, text, want):
    vocab = spark.createDataFrame([(0, "fun"), (1, "funky"), (2, "elegant")], "tag_idx int, tag string")
    toks = D.tokens(spark.createDataFrame([(1, text)], "id int, text string"))
    assert {r.tag: r.weight for r in D.query_weights(D.signed_terms(toks), vocab).collect()} == want


def test_vector_fallback_only_without_other_matches(spark):
    vocab = spark.createDataFrame([(0, "fun", [1.0, 0.0]), (1, "warm", [0.8, 0.6])], "tag_idx int, tag string, v array<double>")
    tv = spark.createDataFrame([("fun", [0.8, 0.6]), ("happy", [1.0, 0.0])], "lemma string, v array<double>")
    w = lambda t: {r.tag: round(r.weight, 6) for r in D.query_weights(D.signed_terms(D.tokens(spark.createDataFrame([(1, t)], "id int, text string"))), vocab, 0.5, 0.5, tv).collect()}
    assert w("fun") == {"fun": 1.0} and w("happy") == {"fun": 0.5, "warm": 0.4}


def test_adjectives(spark):
    tags = [("the", "DET"), ("bold", "ADJ"), ("clean", "ADJ"), ("sans", "NOUN"), ("round", "ADJ"), (".", "PUNCT"), ("warm", "ADJ")]
    t = spark.createDataFrame([(1, k, w, g) for k, (w, g) in enumerate(tags)], "id int, pos int, text string, tag string")
    assert [r.text for r in D.adjectives(t).orderBy("pos").collect()] == ["clean", "round"]


def test_location(spark):
    move = lambda p, n: value(spark, V.moved_location(lit(3, 4), p, n, 0.1))
    assert move(lit(1, 0), lit(0, 1)) == pytest.approx([3.0224, 3.9832])
    assert move(lit(0, 1), lit(1, 0)) == [3.0, 4.0]


def test_offsets_and_decoding(spark):
    g = spark.createDataFrame([(f, k) for f, n in (("a", 3), ("b", 2), ("c", 4)) for k in range(n)], "font string, glyph int")
    o = G.pair_offsets(g)
    assert [(r.glyph_off, r.pair_off) for r in o.orderBy("font").collect()] == [(0, 0), (3, 9), (5, 13)]
    idx = spark.createDataFrame([(11,), (0,), (28,), (29,), (-1,)], "idx long")
    got = {r.idx: (r.font, r.left, r.right) for r in G.decode_pairs(idx, o).collect()}
    assert got == {11: ("b", 4, 3), 0: ("a", 0, 0), 28: ("c", 8, 8)}


def test_longest_prefix(spark):
    keys = spark.createDataFrame([("Noto Sans",), ("Noto Sans Mono",), ("Exo",), ("a.*",)], "key string")
    names = spark.createDataFrame([("Noto Sans Mono Bold",), ("Exo 2 Regular",), ("Arial",), ("",), (None,), ("a.*b",)], "name string")
    got = {r.name: r.key for r in D.longest_prefix(names, keys).collect()}
    assert got == {"Noto Sans Mono Bold": "Noto Sans Mono", "Exo 2 Regular": "Exo", "Arial": None, "": None, None: None, "a.*b": "a.*"}


def test_percentile_cut(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "mse double")
    assert sorted(r.mse for r in G.above_percentile(df, "mse").collect()) == [3.0, 10.0]


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www.dafont.com/a.ttf", (True, False)), ("https://www.myfonts.com/x", (True, True)), ("http://www.dafont.com/", (False, False)), ("https://www.dafont.com:443/", (False, False)), ("https://u@www.dafont.com/", (False, False)), ("https://WWW.dafont.com/", (False, False)), ("https://other.com/", (False, False)), (None, (False, False)), ("::", (False, False))],
)
def test_urls(spark, url, want):
    r = spark.createDataFrame([(url,)], "u string").select(X.url_allowed("u").alias("a"), X.url_paid("u").alias("p")).first()
    assert (r.a, r.a and r.p) == want


def test_complete(spark):
    rows = [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 2)]
    for more in ([], [("b", 0)]):
        assert [r.font for r in G.complete(spark.createDataFrame(rows + more, "font string, slot int"), 3).collect()] == ["a"]


def test_greedy(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [0.0, -1.0]), ("e", [0.6, 0.8])], "font string, v array<double>")
    assert [r.font for r in similarity.perpendicular_order(v, lit(0, 1)).orderBy("rank").collect()] == list("aceb" + "d")
    assert [r.font for r in similarity.representatives(v, lit(0, 1)).orderBy("rank").collect()] == list("acbd")


def test_bins(spark):
    bins = lambda n: sorted(r.bin for r in G.equal_bins(spark.range(n).withColumn("x", F.col("id")), "id", "x", 3).collect())
    assert bins(8) == [0, 0, 1, 1, 2, 2, 2, 2] and bins(2) == [2, 2] and bins(0) == []


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)]
    nodes = sorted({x for e in edges for x in e} | {999})
    comp = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "i long, j long"), spark.createDataFrame([(n,) for n in nodes], "id long")).collect()}
    assert got == comp


def test_parsed_list(spark):
    f = "```"
    cases = {'["a", "b"]': ["a", "b"], f'{f}json\n["a"]\n{f}': ["a"], f"{f}\n[]\n{f}": [], '["a", 1]': None, '{"a": 1}': None, "none": None, "": None, '[null]': None, '["a, \\"b\\""]': ['a, "b"']}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.parsed_list("t").alias("x")).collect()
    assert {r.t: r.x for r in got} == cases


def test_best_layer_ignores_nan(spark):
    df = spark.createDataFrame([("a", "x", math.nan), ("a", "x", 1.0), ("b", "x", math.nan)], "image string, text string, score double")
    got = {r.image: r.x for r in retrieval.best_layer(df, ["x"]).collect()}
    assert got["a"] == 1.0 and math.isnan(got["b"])


def test_splits_are_disjoint_and_whole(spark):
    s = G.split(spark.range(103), "id")
    assert s.where("is_train").count() == 82 and s.count() == 103
    assert s.collect() == G.split(spark.range(103), "id").collect()


def test_nearest_takes_all_if_few(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(3)], "id long, v array<double>")
    assert similarity.nearest(v, v, 10).count() == 6
    assert similarity.pairs_at_least(v, -99).count() == 3
    assert similarity.nearest(v.limit(0), v, 2).count() == 0


def test_ema_and_crossover(spark):
    assert value(spark, V.ema(1.0, lit(0, 0), 0.5)) == 0.25
    ab = spark.createDataFrame([([1, 2, 3, 4, 5], [5, 4, 3, 2, 1])], "a array<int>, b array<int>")
    r = ab.select(paths.crossover(F.col("a"), F.col("b"), F.lit(1), F.lit(3)).alias("c"), paths.flipped(F.col("a"), F.lit(1), F.lit(4)).alias("f"), paths.overlap(F.col("a"), F.col("b")).alias("o")).first()
    assert (r.c, r.f, r.o) == ([5, 2, 3, 4, 1], [1, 4, 3, 2, 5], 1.0)


def test_sql_functions(spark):
    from tessella.functions import sql

    assert sql.register(spark) == ["vdot", "vnorm", "vl2", "sigmoid"]
    r = spark.sql("SELECT vdot(array(1D, 2D), array(3D, 4D)) AS a, vnorm(array(3D, 4D)) AS b, vl2(array(0D, 0D), array(3D, 4D)) AS c, sigmoid(0D) AS d").first()
    assert tuple(r) == (11.0, 5.0, 5.0, 0.5)


def test_padding_and_noise(spark):
    df = spark.createDataFrame([(k, [1, 2], [1.0] * 64, " a  b c ") for k in range(5)], "k long, t array<int>, p array<double>, s string")
    r = df.select(V.padded("t", 4).alias("t"), V.noised("p", 8, F.col("k")).alias("p"), V.word_count("s").alias("n")).collect()
    assert all(x.t == [1, 2, 0, 0] and x.n == 3 and 4 <= x.p.count(0.0) < 64 for x in r)
    assert len({tuple(x.p) for x in r}) == 5


def test_p_values(spark):
    # I_x(a, 1/2) has closed forms for whole a; tables give the rest.
    df = spark.createDataFrame([(0.0, 10), (0.5, 10), (-0.5, 10), (0.95, 5), (1.0, 9), (float("nan"), 9), (0.3, 2), (0.02, 100_000)], "r double, n long")
    got = [x.p for x in df.select(retrieval.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    t = lambda r, n: abs(r) * ((n - 2) / (1 - r * r)) ** 0.5
    assert got[0] == 1 and got[1] == got[2] == pytest.approx(0.141111, abs=1e-5) and got[3] == pytest.approx(0.013320, abs=1e-4)
    assert got[4] == 0 and got[5] is None and got[6] is None
    assert got[7] == pytest.approx(math.erfc(t(0.02, 100_000) / 2**0.5), rel=1e-2)  # the normal limit


def test_searches_against_a_plain_simulation(spark, monkeypatch):
    from tessella.operators import simulation

    monkeypatch.setattr(simulation, "BLOCK", 32)
    monkeypatch.setattr(simulation, "CHUNK", 3)
    x = np.random.default_rng(2).normal(size=(90, 5))
    fonts = spark.createDataFrame([(k, x[k].tolist()) for k in range(90)], "font long, v array<double>")
    trials = [(k, (0.3, 2.0)[k % 2], 11 * k) for k in range(7)] + [(7, 0.3, 500)]
    start, want = [1.0, 0.5, -0.2, 0.3, 0.1], {}
    for trial, rate, target in trials[:7]:
        place, goal = np.array(start), x[target]
        for step in range(1, 7):
            unit = place / np.linalg.norm(place)
            want[trial, step] = int((np.round(x @ unit, 9) > round(goal @ unit, 9)).sum())
            if want[trial, step] <= 4:
                break
            taken = []
            for k in sorted(range(90), key=lambda k: (abs(round(x[k] @ unit, 9)), k)):
                if len(taken) < 4 and all(x[k] @ x[o] <= 0 for o in taken):
                    taken.append(k)
            p, n = x[max(taken, key=lambda o: goal @ x[o])], x[min(taken, key=lambda o: goal @ x[o])]
            if unit @ n - unit @ p + 0.1 > 0:
                place = place - rate * ((n - p) - unit * (unit @ (n - p))) / np.linalg.norm(place)
    got = simulation.searches(fonts, spark.createDataFrame(trials, "trial long, rate double, target long"), V.literal_vector(start), 6, 4)
    assert {(r.trial, r.step): r["rank"] for r in got.collect()} == want
    total = {r.rate: (r.trials, r.found) for r in simulation.success(got, 4).collect()}
    assert sum(n for n, _ in total.values()) == 7 and sum(n for _, n in total.values()) == sum(v <= 4 for v in want.values())


@pytest.mark.parametrize("lots", [(1, 2), (2, 5), (24, 96)])
def test_options_come_from_one_pass_or_from_further_ones(spark, monkeypatch, lots):
    """A step reads the fonts once, where all its options lie near; else it goes on, and takes the same ones."""
    from tessella.operators import simulation

    passes = []
    for name in ("_orders", "_pass"):
        monkeypatch.setattr(simulation, name, lambda *a, f=getattr(simulation, name), name=name: passes.append(name) or f(*a))
    monkeypatch.setattr(simulation, "BLOCK", 64)
    monkeypatch.setattr(simulation, "LOTS", lots)
    x = np.random.default_rng(3).normal(size=(150, 4))
    x[60:75] = x[40:55]  # ties
    fonts = spark.createDataFrame([(f"f{k:03}", x[k].tolist()) for k in range(150)], "font string, v array<double>")
    trials = spark.createDataFrame([(k, 0.5, f"f{40 + 9 * k:03}") for k in range(5)], "trial long, rate double, target string")
    got = {(r.trial, r.step): r["rank"] for r in simulation.searches(fonts, trials, V.literal_vector([1.0, -0.2, 0.4, 0.1]), 4, 3).collect()}
    want = {}
    for k in range(5):
        place, goal = np.array([1.0, -0.2, 0.4, 0.1]), x[40 + 9 * k]
        for step in range(1, 5):
            unit, taken = place / np.linalg.norm(place), []
            want[k, step] = int((np.round(x @ unit, 9) > round(goal @ unit, 9)).sum())
            if want[k, step] <= 3:
                break
            for o in sorted(range(150), key=lambda o: (abs(round(x[o] @ unit, 9)), o)):
                if len(taken) < 4 and all(x[o] @ x[t] <= 0 for t in taken):
                    taken.append(o)
            p, n = x[max(taken, key=lambda o: goal @ x[o])], x[min(taken, key=lambda o: goal @ x[o])]
            if unit @ n - unit @ p + 0.1 > 0:
                place = place - 0.5 * ((n - p) - unit * (unit @ (n - p))) / np.linalg.norm(place)
    assert got == want and passes.count("_orders") == max(step for _, step in want)
    assert lots[-1] < 96 or passes.count("_pass") <= 3 * passes.count("_orders")


def test_carried_over_ranges(spark):
    rows = spark.createDataFrame([(k, k if k % 400 == 3 else None) for k in range(3000)], "k long, x long").repartition(8)
    got = {r.k: r.x for r in graph.carried(rows, "x", "k").collect()}
    assert got == {k: None if k < 3 else (k - 3) // 400 * 400 + 3 for k in range(3000)}


def test_running_sums_over_ranges(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x")).repartition(8)
    got = [r.t for r in graph.running(rows, "x", "t", "k").orderBy("k").collect()]
    assert got == list(np.cumsum(np.arange(4000) % 7)) and graph.running(rows.limit(0), "x", "t", "k").count() == 0


def test_copies_of_a_row_do_not_grow_with_the_rows(spark, monkeypatch):
    """However many blocks of the least size there were, a row lies in LANES cells of each side at most."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    v = spark.range(600).select("id", F.array(F.cos("id"), F.sin("id")).alias("v"))
    for n in (150, 600):
        rows = v.where(f"id < {n}")
        assert similarity.grid(rows, rows, False).count() == 2 * n * similarity.LANES
        assert similarity.grid(rows, rows, True).count() == n * (similarity.LANES + 1)
    assert similarity.blocks(6 * similarity.MOST * similarity.LANES) == 6 * similarity.LANES


def test_links_join_as_all_pairs_do(spark, monkeypatch):
    """Few rows leave a cell, whatever the pairs; the components are those of all pairs."""
    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "PRODUCTS", 100)
    x = np.random.default_rng(8).normal(size=(130, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:] = x[7]  # copies
    v = spark.createDataFrame([(k * 3, r) for k, r in enumerate(x.tolist())], "id long, v array<double>")
    for bound in (0.5, 0.97):
        links, pairs = similarity.links_at_least(v, bound), similarity.pairs_at_least(v, bound)
        both = [{(r.node, r.component) for r in graph.components(e.select("i", "j"), v.select("id")).collect()} for e in (links, pairs)]
        assert both[0] == both[1] and all(r.i < r.j for r in links.collect())
        assert links.count() <= 130 * 8 < pairs.count() or bound > 0.9
    got = {(r.i, r.j) for r in similarity.pairs_at_least(v, 0.5).collect()}
    assert got == {(3 * i, 3 * j) for i in range(130) for j in range(i + 1, 130) if x[i] @ x[j] >= 0.5}


def test_nearest_rows_among_copies(spark, monkeypatch):
    """Copies tie, so the least ids come first, whatever the tile they are multiplied in."""
    monkeypatch.setattr(similarity, "BLOCK", 30)
    monkeypatch.setattr(similarity, "PRODUCTS", 64)
    x = np.repeat(np.random.default_rng(9).normal(size=(9, 5)), 12, 0)
    v = spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<double>")
    s = np.round(x @ x.T, 9)
    want = {(i, j) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:15]}
    assert {(r.src, r.dst) for r in similarity.nearest(v, v, 15).collect()} == want


def test_sums_over_pairs_of_glyphs_make_no_pair(spark):
    """A font of many glyphs, repeated, negative and missing ones: as the pair table adds up, without a row for each pair."""
    from tessella.operators import glyphs as G

    rows = [("a", k * 37 - 900) for k in range(60)] + [("a", 5), ("a", 5), ("a", None), ("b", 7), ("c", None), (None, 3)]
    df = spark.createDataFrame(rows, "font string, glyph long")
    mod = F.col("left") * F.col("right") % 97
    want = G.glyph_pairs(df).groupBy("font").agg(F.count("*").alias("pairs"), F.sum((F.col("left") == F.col("right")).cast("long")).alias("own"), F.sum(mod).alias("mark"))
    assert {tuple(r) for r in G.pair_sums(df).collect()} == {tuple(r) for r in want.collect()}
    many = spark.range(300_000).select(F.lit("f").alias("font"), F.col("id").alias("glyph"))
    r = G.pair_sums(many).first()
    n = [300_000 // 97 + (k < 300_000 % 97) for k in range(97)]
    assert (r.pairs, r.own, r.mark) == (300_000**2, 300_000, sum(n[i] * n[j] * (i * j % 97) for i in range(97) for j in range(97)))
