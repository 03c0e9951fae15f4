"""Queries over closed paths, and the transfer scores of the vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators import paths as P
from tessella.operators import simulation as M
from tessella.operators import transfer as T
from tessella.plans.tables import table, vector_of, vectors
from tessella.plans.vectors import rounded

NODES = 12


def path_table(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of NODES vectors: vec_id in runs."""
    v = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / NODES).alias("path_id"), (F.col("vec_id") % NODES).alias("pos"), F.col("vec_id").alias("font"))
    whole = v.groupBy("path_id").agg(F.count("*").alias("n")).where(F.col("n") == NODES).select("path_id")
    return v.join(whole, "path_id")


def cycle_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.cycle_scores(path_table(spark, sf), vectors(spark, sf, "font")))


def top_paths(spark: SparkSession, sf: str) -> DataFrame:
    return cycle_score(spark, sf).select("path_id", "score").orderBy(F.desc("score"), "path_id").limit(5)


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of overlapping paths of ten places."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 9).cast("int").alias("s"))
    a = F.sequence(F.col("s"), F.col("s") + 9)
    b = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k * 7 + F.col("s")) % 19)
    return o.select("o_orderkey", "s", a.alias("a"), b.alias("b"))


def joined(c: Column) -> Column:
    return F.array_join(c, " ")


def path_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("o_orderkey", F.round(P.overlap(F.col("a"), F.col("b")), 6).alias("share"), (P.overlap(F.col("a"), F.col("b")) <= 0.4).alias("may"))


def path_difference(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("o_orderkey", joined(F.array_except("a", "b")).alias("rest"))


def path_crossover(spark: SparkSession, sf: str) -> DataFrame:
    i, j = F.col("s") % 4 + 1, F.col("s") % 4 + 4
    names = F.sequence(F.lit(0), F.lit(20))
    return _lists(spark, sf).select("o_orderkey", joined(P.crossover(F.col("a"), F.col("b"), i, j)).alias("child"), joined(P.flipped(F.col("a"), i, j)).alias("flipped"), joined(P.replaced(F.col("a"), names, F.col("s") % 10, F.col("s"))).alias("replaced"))


def hop_matrix(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.range(NODES + 1)
    return ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j"))).select("i", "j", V.hops("i", "j", NODES).alias("hops"), (F.abs(F.col("i") - F.col("j")) > 1).alias("apart"))  # NODES + 1 rows each


def evolved_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps of the genetic search over the pooled families."""
    from tessella.plans.vectors import _pooled

    return P.evolve(_pooled(spark, sf), nodes=6, population=24, keep=6, steps=2, seed=3)


def _one(spark: SparkSession, name: str, value: float) -> DataFrame:
    return spark.range(1).select(F.lit(round(float(value), 6)).alias(name))


def coding_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, "rate", T.coding_rate(vectors(spark, sf)))


def transrate(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, "score", T.trans_rate(vectors(spark, sf), "fam"))


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", "fam", F.slice("v", 1, 32).alias("v"), F.slice("v", 33, 8).alias("y"))


def logme(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, "score", T.log_me(_halves(spark, sf), "y"))


def ridge_mse(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, "score", T.linear_mse(_halves(spark, sf), "y"))


def h_alpha(spark: SparkSession, sf: str) -> DataFrame:
    z = T.random_projection(vectors(spark, sf), 24).select("fam", V.normalized("proj").alias("v"))
    return _one(spark, "score", T.h_alpha(z, "fam"))


def control_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The controls: vectors of zeros, and seeded random ones, in place of the model's."""
    v = vectors(spark, sf)
    zero = v.withColumn("v", F.transform("v", lambda x: x * 0))
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0 - 0.5
    rand = v.withColumn("v", F.array(*(u(k) for k in range(16))))
    return spark.createDataFrame([(n, round(float(T.trans_rate(z, "fam")), 6)) for n, z in (("zeroes", zero), ("random", rand))], "control string, score double")


def principal_components(spark: SparkSession, sf: str) -> DataFrame:
    return T.principal_components(vectors(spark, sf), 3).select("id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


def singular_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest singular values of the vectors, and each vector's coordinates along them."""
    from tessella.operators.spectral import truncated_svd

    rows, values, _ = truncated_svd(vectors(spark, sf), 3)
    along = F.transform(F.arrays_zip(F.col("u").alias("u"), V.literal_vector(list(values)).alias("s")), lambda x: F.round(x["u"] * x["s"], 5))
    return rows.select("id", along.alias("coordinates"), F.lit(round(float(values[0]), 6)).alias("largest"))


def sketched_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """Distance from the identity of the covariance of the vectors, made four times as wide by products of neighbours, in a sketch of 64."""
    from tessella.operators.spectral import covariance_penalty

    wide = F.concat("v", *(F.transform(F.arrays_zip(F.col("v").alias("a"), F.concat(F.slice("v", F.lit(k + 1), F.size("v") - k), F.slice("v", 1, k)).alias("b")), lambda x: x["a"] * x["b"] * 8) for k in (1, 2, 3)))
    return _one(spark, "penalty", covariance_penalty(vectors(spark, sf).select(wide.alias("v")), 64))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each cluster of the pooled families."""
    from tessella.plans.vectors import _pooled

    rows = T.average_linkage(_pooled(spark, sf).select(F.col("font").cast("long").alias("id"), "v"), 4)
    return rows.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count("*").alias("n"))


RATES = (0.3, 0.1, 0.01, 0.0001)


def _searches(spark: SparkSession, sf: str) -> DataFrame:
    """Every font whose id is divisible by 100 is looked for at each learning rate."""
    fonts = vectors(spark, sf, "font")
    rates = F.posexplode(F.array(*(F.lit(r) for r in RATES))).alias("k", "rate")
    trials = fonts.where("font % 100 = 0").select(F.col("font").alias("target"), rates).select((F.col("target") * len(RATES) + F.col("k")).alias("trial"), "rate", "target")
    return M.searches(fonts, trials, vector_of(spark, sf, 1))


def simulated_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """A user who looks for fonts by feedback: the rank of the target at each search."""
    return _searches(spark, sf).withColumn("found", F.col("rank") <= 10)


def feedback_success(spark: SparkSession, sf: str) -> DataFrame:
    """The share of trials that find their font within 15 searches, by learning rate."""
    return rounded(M.success(_searches(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        cycle_score, top_paths, path_overlap, path_difference, path_crossover, hop_matrix, evolved_paths, coding_rate, transrate, logme, ridge_mse, h_alpha, control_scores,
        principal_components, singular_vectors, sketched_penalty, clusters, simulated_feedback, feedback_success,
    )
}

_C = f"""e AS (SELECT vec_id // {NODES} AS path_id, vec_id % {NODES} AS pos, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id // {NODES} IN (SELECT vec_id // {NODES} FROM embeddings GROUP BY 1 HAVING count(*) = {NODES})),
c AS (SELECT * FROM e UNION ALL SELECT path_id, {NODES}, v FROM e WHERE pos = 0),
p AS (SELECT a.path_id, abs(a.pos - b.pos) AS d, least(abs(a.pos - b.pos), {NODES} - abs(a.pos - b.pos)) AS hop, 1 - list_inner_product(a.v, b.v) AS dist FROM c a JOIN c b USING (path_id)),
f AS (SELECT path_id, sum(hop * dist) FILTER (d > 1) / sum(hop) FILTER (d > 1) AS far, avg(dist) FILTER (d = 1) AS edge, stddev_pop(dist) FILTER (d = 1) AS std FROM p GROUP BY path_id),
o AS (SELECT path_id, avg(list_sum(list_transform(v, lambda x: abs(x))) / len(v)) AS out FROM c GROUP BY path_id),
s AS (SELECT path_id, far, edge, std, out, 2 * far - 2 * edge - 2 * std + 0.7 * out AS score FROM f JOIN o USING (path_id))"""
_AB = "ab AS (SELECT o_orderkey, o_custkey % 9 AS s, range(o_custkey % 9, o_custkey % 9 + 10) AS a, list_transform(range(10), lambda k: (k * 7 + o_custkey % 9) % 19) AS b FROM orders)"

_G = """r AS (SELECT vec_id AS id, label AS fam, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS (SELECT id, fam, d, x - {} AS x FROM r)"""
#: Elimination of a symmetric matrix m (a list of rows), whose pivots give the determinant.
_DET = """det AS (SELECT key, n, m, 1 AS k, 0.0::DOUBLE AS ld FROM m0
UNION ALL SELECT key, n, list_transform(m, lambda row, i: CASE WHEN i > k THEN list_transform(row, lambda x, j: x - row[k] / m[k][k] * m[k][j]) ELSE row END), k + 1, ld + ln(m[k][k]) FROM det WHERE k <= len(m))"""
_RATES = """q AS (SELECT coalesce(a.fam, -1) AS key, a.d AS i, b.d AS j, count(*) AS n, (CASE WHEN a.d = b.d THEN 1 ELSE 0 END) + sum(a.x * b.x) / (count(*) * 1e-4) AS x FROM z a JOIN z b ON a.id = b.id GROUP BY GROUPING SETS ((a.fam, a.d, b.d), (a.d, b.d))),
m0 AS (SELECT key, n, list(row ORDER BY i) AS m FROM (SELECT key, n, i, list(x ORDER BY j) AS row FROM q GROUP BY key, n, i) GROUP BY key, n),
""" + _DET + ", rate AS (SELECT key, ld / 2 AS r FROM det WHERE k > len(m))"

ORACLE = {
    "coding_rate": f"WITH RECURSIVE {_G.format('0')}, {_RATES} SELECT round(r, 6) AS rate FROM rate WHERE key = -1",
    "transrate": f"WITH RECURSIVE {_G.format('avg(x) OVER (PARTITION BY d)')}, {_RATES} SELECT round(max(r) FILTER (key = -1) - avg(r) FILTER (key >= 0), 6) AS score FROM rate",
    "ridge_mse": f"""WITH RECURSIVE {_G.format('avg(x) OVER (PARTITION BY d)')}, c AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS x FROM z a JOIN z b ON a.id = b.id WHERE a.d <= 40 AND b.d <= 40 GROUP BY a.d, b.d),
        g AS (SELECT 1 AS k, list(row ORDER BY i) AS m FROM (SELECT i, list(x + (CASE WHEN i = j THEN 1 ELSE 0 END) ORDER BY j) AS row FROM c WHERE i <= 32 GROUP BY i)
              UNION ALL SELECT k + 1, list_transform(m, lambda row, i: list_transform(row, lambda x, j: CASE WHEN i = k THEN x / m[k][k] ELSE x - row[k] / m[k][k] * m[k][j] END)) FROM g WHERE k <= 32),
        w AS (SELECT i, j, m[i][j] AS w FROM g, range(1, 33) a(i), range(33, 41) b(j) WHERE k = 33),
        err AS (SELECT w.j, max(own.x) - sum(w * (c.x + w)) AS e FROM w JOIN c ON c.i = w.i AND c.j = w.j JOIN c own ON own.i = w.j AND own.j = w.j GROUP BY w.j)
        SELECT round(-avg(e) / (SELECT count(*) FROM embeddings), 6) AS score FROM err""",
    "clusters": """WITH RECURSIVE r AS (SELECT vec_id, label, d, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)),
        p AS (SELECT label, d, avg(x) AS x FROM r GROUP BY label, d),
        m AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.x - b.x) ** 2)) AS s FROM p a JOIN p b USING (d) WHERE a.label <> b.label GROUP BY a.label, b.label),
        g AS (SELECT len(l) AS k, list_transform(l, lambda x: [x]) AS c FROM (SELECT list(DISTINCT label::BIGINT) AS l FROM p)
              UNION ALL SELECT k - 1, list_concat(list_filter(c, lambda x: x <> e.x AND x <> e.y), [list_concat(e.x, e.y)]) FROM (
                SELECT k, c, (SELECT min({'h': h, 'x': x, 'y': y}) FROM (SELECT x, y, (SELECT avg(s) FROM m WHERE list_contains(x, a) AND list_contains(y, b)) AS h FROM (SELECT unnest(c) AS x) u, (SELECT unnest(c) AS y) w WHERE x < y) t) AS e FROM g WHERE k > 4) n),
        o AS (SELECT list_sort(unnest(c)) AS members FROM (SELECT c FROM g ORDER BY k LIMIT 1))
        SELECT (row_number() OVER (ORDER BY members[1]) - 1)::INT AS cluster, members, len(members) AS n FROM o""",
    "cycle_score": f"WITH {_C} SELECT path_id, round(far, 6) AS far, round(edge, 6) AS edge, round(std, 6) AS std, round(out, 6) AS out, round(score, 6) AS score FROM s",
    "top_paths": f"WITH {_C} SELECT path_id, round(score, 6) AS score FROM s ORDER BY round(s.score, 6) DESC, path_id LIMIT 5",
    "path_overlap": f"WITH {_AB} SELECT o_orderkey, round(len(list_intersect(a, b)) / 10, 6) AS share, len(list_intersect(a, b)) / 10 <= 0.4 AS may FROM ab",
    "path_difference": f"WITH {_AB} SELECT o_orderkey, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ' ') AS rest FROM ab",
    "path_crossover": f"""WITH {_AB}, k AS (SELECT *, s % 4 + 1 AS i, s % 4 + 4 AS j FROM ab), f AS (SELECT *, list_filter(b, lambda x: NOT list_contains(a[i + 1:j], x)) AS fl FROM k)
        SELECT o_orderkey, array_to_string(list_concat(fl[1:i], a[i + 1:j], fl[i + 1:i + 10 - j]), ' ') AS child, array_to_string(list_concat(a[1:i], list_reverse(a[i + 1:j]), a[j + 1:10]), ' ') AS flipped,
        array_to_string(list_transform(range(10), lambda n: CASE WHEN n = s % 10 THEN list_filter(range(21), lambda x: NOT list_contains(a, x))[s % 11 + 1] ELSE a[n + 1] END), ' ') AS replaced FROM f""",
    "hop_matrix": f"SELECT i, j, least(abs(i - j), {NODES} - abs(i - j)) AS hops, abs(i - j) > 1 AS apart FROM range({NODES + 1}) x(i), range({NODES + 1}) y(j)",
}
