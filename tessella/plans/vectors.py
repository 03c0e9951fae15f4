"""Queries over vectors: search, pooling, pairs, graphs, feedback locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators import graph, index, retrieval, similarity
from tessella.plans.tables import font_meta, table, vector_of, vectors

THRESHOLD = 0.35


def knn(paid: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = similarity.knn_search(vectors(spark, sf), font_meta(spark, sf), vector_of(spark, sf, 0), 20, paid)
        return out.withColumn("distance", F.round("distance", 6))

    return run


def dot_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = similarity.search_dot(vectors(spark, sf, "font"), V.normalized(vector_of(spark, sf, 0)), 100)
    return found.select("font", F.round("score", 6).alias("score"))


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.pool(vectors(spark, sf).withColumnRenamed("fam", "font"), ["font"])


def font_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf).select("font", "n", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


def font_pool_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = similarity.search_dot(_pooled(spark, sf), V.normalized(vector_of(spark, sf, 0)), 5)
    return found.select("font", F.round("score", 6).alias("score"))


def cosine_matrix_label(spark: SparkSession, sf: str) -> DataFrame:
    p = _pooled(spark, sf)
    a, b = p.select(F.col("font").alias("f1"), F.col("v").alias("v1")), p.select(F.col("font").alias("f2"), F.col("v").alias("v2"))
    return a.crossJoin(b).select("f1", "f2", F.round(V.cosine("v1", "v2"), 6).alias("sim"))  # the matrix of families is the result


def allpairs_ge_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.pairs_at_least(vectors(spark, sf), THRESHOLD).select("i", "j", F.round("sim", 6).alias("sim"))


def knn_graph_10(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return similarity.nearest(v, v, 10).select("src", "dst", F.round("sim", 6).alias("sim"))


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """knn_search through the stored index: only cells that can hold one of the nearest are read."""
    v = vectors(spark, sf)
    query = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    near, _ = index.search(index.build(v.select("id", "v")), [float(x) for x in query], 20)
    rows = font_meta(spark, sf).join(F.broadcast(near), "id")  # 20 rows
    return rows.select("id", "name", F.round("distance", 6).alias("distance"), "location", "file")


def index_graph_10(spark: SparkSession, sf: str) -> DataFrame:
    """knn_graph_10 through the stored index: only pairs of cells that can hold a neighbour are compared."""
    found, _ = index.nearest_rows(index.build(vectors(spark, sf).select("id", "v")), 10)
    return found.select("src", "dst", F.round("sim", 6).alias("sim"))


def perpendicular_order(spark: SparkSession, sf: str) -> DataFrame:
    out = similarity.perpendicular_order(vectors(spark, sf, "font"), vector_of(spark, sf, 0))
    return out.select("font", F.round("score", 6).alias("score"), "rank")


def greedy_diverse_4(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.representatives(vectors(spark, sf, "font"), vector_of(spark, sf, 0), 4).select("rank", "font")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def recall(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return rounded(retrieval.recall_at_k(retrieval.first_positive(v, v), v, 10))


def median(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return retrieval.median_rank(retrieval.first_positive(v, v))


def first_positive_rank(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return retrieval.first_positive(v, v)


def infonce(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return rounded(retrieval.info_nce(v, v, 0.04))


def infonce_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).withColumn("fam", F.lit(None).cast("int"))
    return rounded(retrieval.info_nce(v, v, 0.04))


def infonce_masked(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return rounded(retrieval.info_nce(v, v, 0.04, THRESHOLD))


def positive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return retrieval.positive_pairs(v, v)


def vector_scalars(spark: SparkSession, sf: str) -> DataFrame:
    q = V.normalized(vector_of(spark, sf, 1))
    v = vectors(spark, sf)
    out = v.select("id", V.dot("v", q).alias("dot"), V.norm("v").alias("norm"), V.cosine_distance("v", q).alias("distance"), V.l2_distance("v", q).alias("l2"), V.sigmoid(V.dot("v", q)).alias("sigmoid"), F.get(V.softmax("v"), F.lit(0)).alias("softmax0"), F.get(V.log_softmax("v"), F.lit(0)).alias("log_softmax0"), V.clamp(V.dot("v", q), -0.1, 0.1).alias("clamped"), V.mean_squared_error("v", q).alias("mse"))
    return rounded(out)


def tag_probability_mean(spark: SparkSession, sf: str) -> DataFrame:
    each = vectors(spark, sf).select(F.col("fam").alias("font"), F.posexplode("v").alias("tag_idx", "logit"))
    return rounded(each.groupBy("font", "tag_idx").agg(F.avg(V.sigmoid("logit")).alias("p")))


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    """Two layers: the first and the second half of a vector."""
    v = vectors(spark, sf).withColumnRenamed("fam", "font")
    return v.select("font", F.posexplode(F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("layer", "v"))


def layer_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(similarity.layer_means(_layers(spark, sf), ["layer", "font"]))


def layer_join(spark: SparkSession, sf: str) -> DataFrame:
    image = similarity.layer_means(_layers(spark, sf), ["layer", "font"])
    text = _pooled(spark, sf).select("font", F.posexplode("v").alias("pos", "x"))
    return rounded(image.join(text, ["font", "pos"]).groupBy("layer", "font").agg(F.sum(F.col("mean") * F.col("x")).alias("score"), F.count("*").alias("dims")))


def spatial_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as 4 channels of 4 x 4: the mean over each channel's places."""
    v = vectors(spark, sf).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("v", c * 16 + 1, F.lit(16)))).alias("channel", "cells"))
    return rounded(v.select("id", "channel", (V.total(F.col("cells")) / F.size("cells")).alias("mean")))


def location_update(spark: SparkSession, sf: str) -> DataFrame:
    l, p, n = (vector_of(spark, sf, k) for k in (0, 1, 2))
    one = spark.range(1).select(F.posexplode(V.moved_location(l, p, n, 0.1)).alias("pos", "x"))
    return rounded(one)


def rank_of_target(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.target_rank(vectors(spark, sf, "font"), vector_of(spark, sf, 0), F.lit(7))


def minmax_rgb(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf, "font")
    return similarity.scaled_rgb(v.select("font", *(F.get("v", F.lit(k)).alias(n) for k, n in enumerate("rgb"))))


def _components(spark: SparkSession, sf: str) -> DataFrame:
    """Rows joined by pairs over the threshold; the pairs themselves are found, and aren't handed on."""
    v = vectors(spark, sf)
    return graph.components(similarity.links_at_least(v, THRESHOLD), v.select("id"))


def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    found = _components(spark, sf)
    return found.groupBy("component").agg(F.count("*").alias("n"))


def large_components(spark: SparkSession, sf: str) -> DataFrame:
    found = _components(spark, sf)
    return graph.large(found, 1).select("node", "component")


def greedy_top_n(spark: SparkSession, sf: str) -> DataFrame:
    """The 4 nearest of each family's pooled vector among the other families."""
    p = _pooled(spark, sf).select(F.col("font").cast("long").alias("id"), "v")
    return similarity.nearest(p, p, 4).select("src", "dst", F.round("sim", 6).alias("sim"), "rank")


def running_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The state of a mean after each row of a family."""
    v = vectors(spark, sf).select("fam", "id", F.get("v", F.lit(0)).alias("x"))
    w = W.partitionBy("fam").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    return rounded(v.select("fam", "id", F.avg("x").over(w).alias("mean"), F.count("x").over(w).alias("n")))


QUERIES = {
    "knn_search": knn(True), "knn_search_paid_only": knn(False), "dot_topk": dot_topk, "font_pool": font_pool, "font_pool_topk": font_pool_topk,
    "cosine_matrix_label": cosine_matrix_label, "allpairs_ge_threshold": allpairs_ge_threshold, "knn_graph_10": knn_graph_10, "perpendicular_order": perpendicular_order,
    "greedy_diverse_4": greedy_diverse_4, "family_match_recall_at_k": recall, "median_rank": median, "first_positive_rank": first_positive_rank, "infonce": infonce,
    "infonce_diagonal": infonce_diagonal, "infonce_masked": infonce_masked, "family_positive_pairs": positive_pairs, "vector_scalars": vector_scalars,
    "tag_probability_mean": tag_probability_mean, "layer_mean": layer_mean, "layer_join": layer_join, "spatial_pool": spatial_pool, "location_update": location_update,
    "rank_of_target": rank_of_target, "minmax_rgb": minmax_rgb, "component_sizes": component_sizes, "large_components": large_components, "top_n_similar": greedy_top_n,
    "running_mean": running_mean, "index_search": index_search, "index_graph_10": index_graph_10,
}

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS fam FROM embeddings)"
_N = "n AS (SELECT id, fam, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS u FROM e)"
_P = "p AS (SELECT fam AS font, pos, avg(x) AS x, count(*) AS n FROM (SELECT fam, unnest(range(len(u))) AS pos, unnest(u) AS x FROM n) GROUP BY fam, pos)"
_KNN = "WITH nn AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings ORDER BY d, id LIMIT 20) SELECT id, p_name AS name, round(d, 6) AS distance, p_brand AS location, p_type AS file FROM nn JOIN part ON p_partkey = id"
_S = "s AS (SELECT q.id AS i, k.id AS j, list_inner_product(q.v, k.v) AS logit, q.fam = k.fam OR q.id = k.id AS pos FROM e q CROSS JOIN e k)"
_R = "r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(logit, 9) DESC, j) - 1 AS rank FROM s WHERE i <> j)"
_NCE = "SELECT round(avg(lse - mp), 6) AS loss FROM (SELECT i, max(top) + ln(sum(exp(l - top))) AS lse, avg(l) FILTER (pos) AS mp FROM (SELECT *, max(l) OVER (PARTITION BY i) AS top FROM {}) GROUP BY i)"
_PAIR = f"pr AS (SELECT a.id AS i, b.id AS j, list_inner_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.id < b.id WHERE list_inner_product(a.v, b.v) >= {THRESHOLD})"
_COMP = f"""WITH RECURSIVE {_E}, {_PAIR}, both_ways AS (SELECT i, j FROM pr UNION ALL SELECT j, i FROM pr),
reach AS (SELECT id AS node, id AS other FROM e UNION SELECT node, j FROM reach JOIN both_ways ON other = i),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

ORACLE = {
    "knn_search": _KNN,
    "knn_search_paid_only": f"{_KNN} WHERE p_size <= 25",
    "dot_topk": f"WITH {_E}, {_N} SELECT e.id AS font, round(list_inner_product(v, (SELECT u FROM n WHERE id = 0)), 6) AS score FROM e ORDER BY list_inner_product(v, (SELECT u FROM n WHERE id = 0)) DESC, font LIMIT 100",
    "font_pool": f"WITH {_E}, {_N}, {_P} SELECT font, n, pos, round(x, 6) AS x FROM p",
    "font_pool_topk": f"WITH {_E}, {_N}, {_P}, q AS (SELECT unnest(range(len(u))) AS pos, unnest(u) AS y FROM n WHERE id = 0) SELECT font, round(sum(x * y), 6) AS score FROM p JOIN q USING (pos) GROUP BY font ORDER BY sum(x * y) DESC, font LIMIT 5",
    "cosine_matrix_label": f"WITH {_E}, {_N}, {_P} SELECT a.font AS f1, b.font AS f2, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS sim FROM p a JOIN p b USING (pos) GROUP BY a.font, b.font",
    "allpairs_ge_threshold": f"WITH {_E}, {_PAIR} SELECT i, j, round(sim, 6) AS sim FROM pr",
    "knn_graph_10": f"WITH {_E}, s AS (SELECT a.id AS src, b.id AS dst, list_inner_product(a.v, b.v) AS sim FROM e a JOIN e b ON a.id <> b.id) SELECT src, dst, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) <= 10",
    "perpendicular_order": f"WITH {_E}, s AS (SELECT id AS font, list_inner_product(v, (SELECT v FROM e WHERE id = 0)) AS score FROM e) SELECT font, round(score, 6) AS score, row_number() OVER (ORDER BY abs(round(score, 9)), font) AS rank FROM s",
    "greedy_diverse_4": f"""WITH RECURSIVE {_E}, s AS (SELECT id, v, row_number() OVER (ORDER BY abs(round(list_inner_product(v, (SELECT v FROM e WHERE id = 0)), 9)), id) AS o FROM e),
        w AS (SELECT 1 AS step, [id] AS taken, [v] AS vs FROM s WHERE o = 1
              UNION ALL SELECT step + 1, CASE WHEN ok THEN list_append(taken, id) ELSE taken END, CASE WHEN ok THEN list_append(vs, v) ELSE vs END
              FROM (SELECT w.step, w.taken, w.vs, s.id, s.v, len(list_filter(w.vs, lambda x: list_inner_product(x, s.v) > 0)) = 0 AS ok FROM w JOIN s ON s.o = w.step + 1 WHERE len(w.taken) < 4))
        SELECT unnest(range(len(taken)))::INTEGER AS rank, unnest(taken) AS font FROM (SELECT taken FROM w ORDER BY step DESC LIMIT 1)""",
    "family_match_recall_at_k": f"WITH {_E}, {_S}, {_R} SELECT round(avg(hit), 6) AS recall_at_k FROM (SELECT i, max((pos AND rank < 10)::INT) AS hit FROM r GROUP BY i)",
    "median_rank": f"WITH {_E}, {_S}, {_R} SELECT quantile_disc(f, 0.5)::DOUBLE AS median_rank FROM (SELECT min(rank) AS f FROM r WHERE pos GROUP BY i)",
    "first_positive_rank": f"WITH {_E}, {_S}, {_R} SELECT i, min(rank) AS rank FROM r WHERE pos GROUP BY i",
    "infonce": f"WITH {_E}, {_S}, t AS (SELECT i, logit / 0.04 AS l, pos FROM s) " + _NCE.format("t"),
    "infonce_diagonal": f"WITH {_E}, {_S}, t AS (SELECT i, logit / 0.04 AS l, i = j AS pos FROM s) " + _NCE.format("t"),
    "infonce_masked": f"WITH {_E}, {_S}, m AS (SELECT i, j FROM s WHERE i <> j AND logit >= {THRESHOLD}), t AS (SELECT s.i, CASE WHEN m.i IS NOT NULL AND NOT pos THEN -1e4 ELSE logit / 0.04 END AS l, pos FROM s LEFT JOIN m ON s.i = m.i AND s.j = m.j) " + _NCE.format("t"),
    "family_positive_pairs": f"WITH {_E}, {_S} SELECT i, count(*) FILTER (pos) AS positives, count(*) AS pairs FROM s GROUP BY i",
    "vector_scalars": f"""WITH {_E}, {_N}, q AS (SELECT u AS w FROM n WHERE id = 1), d AS (SELECT id, v, w, list_inner_product(v, w) AS dt, list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS se FROM e, q)
        SELECT id, round(dt, 6) AS dot, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(1 - dt, 6) AS distance, round(list_distance(v, w), 6) AS l2, round(1 / (1 + exp(-dt)), 6) AS sigmoid,
        round(exp(v[1] - list_max(v)) / se, 6) AS softmax0, round(v[1] - list_max(v) - ln(se), 6) AS log_softmax0, round(greatest(least(dt, 0.1), -0.1), 6) AS clamped, round(list_distance(v, w) ** 2 / 64, 6) AS mse FROM d""",
    "tag_probability_mean": f"WITH {_E} SELECT fam AS font, tag_idx, round(avg(1 / (1 + exp(-x))), 6) AS p FROM (SELECT fam, unnest(range(len(v))) AS tag_idx, unnest(v) AS x FROM e) GROUP BY ALL",
    "layer_mean": f"WITH {_E} SELECT k // 32 AS layer, fam AS font, k % 32 AS pos, round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT fam, unnest(range(len(v))) AS k, unnest(v) AS x FROM e) GROUP BY ALL",
    "layer_join": f"WITH {_E}, {_N}, {_P}, l AS (SELECT k // 32 AS layer, fam AS font, k % 32 AS pos, avg(x) AS mean FROM (SELECT fam, unnest(range(len(v))) AS k, unnest(v) AS x FROM e) GROUP BY ALL) SELECT layer, l.font, round(sum(mean * x), 6) AS score, count(*) AS dims FROM l JOIN p ON l.font = p.font AND l.pos = p.pos GROUP BY layer, l.font",
    "spatial_pool": f"WITH {_E} SELECT id, k // 16 AS channel, round(avg(x), 6) AS mean FROM (SELECT id, unnest(range(len(v))) AS k, unnest(v) AS x FROM e) GROUP BY ALL",
    "location_update": f"""WITH {_E}, g AS (SELECT l.v AS l, p.v AS p, n.v AS n, sqrt(list_inner_product(l.v, l.v)) AS s FROM e l, e p, e n WHERE l.id = 0 AND p.id = 1 AND n.id = 2),
        h AS (SELECT *, list_inner_product(l, n) / s - list_inner_product(l, p) / s + 0.1 AS loss, (list_inner_product(l, n) - list_inner_product(l, p)) / s AS al FROM g)
        SELECT unnest(range(64)) AS pos, round(unnest(list_transform(range(1, 65), lambda k: CASE WHEN loss > 0 THEN l[k] - 0.1 * ((n[k] - p[k]) - l[k] / s * al) / s ELSE l[k] END)), 6) AS x FROM h""",
    "rank_of_target": f"WITH {_E}, s AS (SELECT id, round(list_inner_product(v, (SELECT v FROM e WHERE id = 0)), 9) AS score FROM e) SELECT count(*) FILTER (score > (SELECT score FROM s WHERE id = 7)) AS rank FROM s",
    "minmax_rgb": """WITH c AS (SELECT vec_id AS font, embedding[1]::DOUBLE AS r, embedding[2]::DOUBLE AS g, embedding[3]::DOUBLE AS b FROM embeddings),
        s AS (SELECT font, trunc((r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) * 255)::INT AS r, trunc((g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) * 255)::INT AS g, trunc((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) * 255)::INT AS b FROM c)
        SELECT *, 'rgb(' || r || ', ' || g || ', ' || b || ')' AS color FROM s""",
    "component_sizes": f"{_COMP} SELECT component, count(*) AS n FROM comp GROUP BY component",
    "large_components": f"{_COMP} SELECT node, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) > 1)",
    "top_n_similar": f"WITH {_E}, {_N}, {_P}, s AS (SELECT a.font AS src, b.font AS dst, sum(a.x * b.x) AS sim FROM p a JOIN p b ON a.pos = b.pos AND a.font <> b.font GROUP BY a.font, b.font), r AS (SELECT src, dst, round(sim, 6) AS sim, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rank FROM s) SELECT * FROM r WHERE rank <= 4",
    "running_mean": "WITH x AS (SELECT label AS fam, vec_id AS id, embedding[1]::DOUBLE AS x FROM embeddings) SELECT fam, id, round(avg(x) OVER w, 6) AS mean, count(x) OVER w AS n FROM x WINDOW w AS (PARTITION BY fam ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
}
ORACLE |= {"index_search": ORACLE["knn_search"], "index_graph_10": ORACLE["knn_graph_10"]}
