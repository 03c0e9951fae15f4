"""Queries that score predictions. Labels are the truth; predictions come from fixed expressions of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators import retrieval as R
from tessella.operators.order import quantiles
from tessella.plans.tables import table
from tessella.plans.vectors import cosine_matrix_label, rounded


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, tag, p, y) for the tags quality, toxic and long."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.col("n_chars")
    cell = lambda tag, p, y: F.struct(F.lit(tag).alias("tag"), p.alias("p"), y.alias("y"))
    each = F.array(cell("quality", n % 97 / 97.0, F.col("quality")), cell("toxic", n % 89 / 89.0, F.col("toxic")), cell("long", n % 13 / 13.0, (n > 2000).cast("int")))
    return d.select(F.col("doc_id").alias("id"), F.explode(each).alias("e")).select("id", "e.tag", "e.p", "e.y")


def micro_prf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.micro_scores(predictions(spark, sf)))


def precision_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.at_k(predictions(spark, sf), 2))


def mean_avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.mean_average_precision(predictions(spark, sf)))


def average_precision_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.average_precision(predictions(spark, sf)))


def _diagonal(spark: SparkSession, sf: str) -> DataFrame:
    return R.diagonal_scores(cosine_matrix_label(spark, sf).select(F.col("f1").alias("i"), F.col("f2").alias("j"), F.col("sim").alias("s")))


def auc_diag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_diagonal(spark, sf).select("auc"))


def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_diagonal(spark, sf).select("d"))


def diag_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_diagonal(spark, sf).select("diff"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """(layer, f1, f2, c1, c2, s): line items as a tensor of scores."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.select((F.col("l_linenumber") % 3).alias("layer"), F.col("l_returnflag").alias("f1"), F.col("l_linestatus").alias("f2"), (F.col("l_partkey") % 7).alias("c1"), (F.col("l_suppkey") % 7).alias("c2"), F.col("l_discount").alias("s"))


def masked_mean(spark: SparkSession, sf: str) -> DataFrame:
    a = R.masked_mean(_cells(spark, sf), True).withColumn("same", F.lit(True))
    return rounded(a.union(R.masked_mean(_cells(spark, sf), False).withColumn("same", F.lit(False))))


def _style(spark: SparkSession, sf: str) -> DataFrame:
    """(family, style, letter, t, p): one row for each; the first style of a family is its reference."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_returnflag").alias("family"), (F.col("l_suppkey") % 4).alias("style"), (F.col("l_partkey") % 26).alias("letter")).agg(F.avg("l_quantity").alias("t"), F.avg("l_tax").alias("p"))


def pearson_residual(spark: SparkSession, sf: str) -> DataFrame:
    s = _style(spark, sf).where("family = 'A'")
    return rounded(R.residual_correlation(s.where("style > 0"), s.where("style = 0"), ["style"]))


def pearson_p_value(spark: SparkSession, sf: str) -> DataFrame:
    """The correlations of pearson_residual with their two-sided p-values."""
    s = _style(spark, sf).where("family = 'A'")
    r = R.residual_correlation(s.where("style > 0"), s.where("style = 0"), ["style"])
    return r.select("style", F.round("r", 6).alias("r"), "n", F.round(R.correlation_p(F.col("r"), F.col("n")), 6).alias("p"))


def reference_style_series(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations by family and style, keyed by a composed name as files have it."""
    s = _style(spark, sf).withColumn("name", F.concat_ws(" ", "family", "style"))
    first = s.groupBy("family").agg(F.min("style").alias("style"))
    ref = s.join(first, ["family", "style"], "left_semi").select("family", "letter", F.col("t").alias("t0"), F.col("p").alias("p0"))
    both = s.join(ref, ["family", "letter"])
    return rounded(both.groupBy("name").agg(F.corr(F.col("t") - F.col("t0"), F.col("p") - F.col("p0")).alias("r"), F.count("*").alias("n")).where("name NOT LIKE '% 0'"))


def best_layer_pivot(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    scores = o.select(F.col("o_orderpriority").alias("image"), F.col("o_orderstatus").alias("text"), F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("score"))
    return R.best_layer(scores, ["F", "O", "P"])


def covariance_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of the covariance of the vectors from the identity."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.doubles("embedding")).alias("k", "x"))
    means = e.groupBy("k").agg(F.avg("x").alias("m"))
    c = e.join(means, "k").select("vec_id", "k", (F.col("x") - F.col("m")).alias("x"))
    n = c.agg(F.count_distinct("vec_id").alias("n"))
    pairs = c.join(c.select("vec_id", F.col("k").alias("k2"), F.col("x").alias("y")), "vec_id").groupBy("k", "k2").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    off = F.col("s") / (F.col("n") - 1 + 1e-6) - (F.col("k") == F.col("k2")).cast("double")
    return rounded(pairs.crossJoin(F.broadcast(n)).agg(F.sqrt(F.sum(off * off)).alias("penalty")))  # one row


def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.doubles("embedding")).alias("k", "x"))
    pairs = e.join(e.select("vec_id", F.col("k").alias("k2"), F.col("x").alias("y")), "vec_id")
    return rounded(pairs.groupBy("k", "k2").agg(F.sum(F.col("x") * F.col("y")).alias("s")))


def softmax_select(spark: SparkSession, sf: str) -> DataFrame:
    """Selection without replacement by softmax of scores: the highest of score / temperature plus a Gumbel draw of a hash."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("score"))
    t = p.agg(F.stddev_pop("score").alias("t"))
    u = ((F.col("p_partkey") + 1234) * 48271 % 2147483647 + 1) / 2147483649.0
    drawn = p.crossJoin(F.broadcast(t)).select("p_partkey", (F.col("score") / F.col("t") - F.ln(-F.ln(u))).alias("key"))  # one row
    return drawn.orderBy(F.desc("key"), "p_partkey").limit(20).select("p_partkey", F.round("key", 6).alias("key"))


def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Ten bars of the predictions' scores, and the quartiles as box plots have them."""
    p = predictions(spark, sf)
    bars = p.groupBy("tag", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bar")).agg(F.count("*").alias("n"))
    box = quantiles(p, "p", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["tag"])
    return rounded(bars.join(box, "tag"))


QUERIES = {
    f.__name__: f
    for f in (
        micro_prf, precision_recall_at_k, mean_avg_precision, average_precision_by_tag, auc_diag, cohens_d, diag_diff, masked_mean, pearson_residual, pearson_p_value, reference_style_series,
        best_layer_pivot, covariance_penalty, gram_matrix, softmax_select, score_histogram,
    )
}

_P = """d AS (SELECT * FROM documents JOIN labels USING (doc_id)), p AS (SELECT doc_id AS id, 'quality' AS tag, n_chars % 97 / 97.0::DOUBLE AS p, quality AS y FROM d UNION ALL SELECT doc_id, 'toxic', n_chars % 89 / 89.0::DOUBLE, toxic FROM d
UNION ALL SELECT doc_id, 'long', n_chars % 13 / 13.0::DOUBLE, (n_chars > 2000)::INT FROM d)"""
_AVP = f"WITH {_P}, s AS (SELECT tag, p, count(*) AS n, sum(y) AS h FROM p GROUP BY ALL), r AS (SELECT *, sum(n) OVER w AS seen, sum(h) OVER w AS good, sum(h) OVER (PARTITION BY tag) AS al FROM s WINDOW w AS (PARTITION BY tag ORDER BY p DESC)), ap AS (SELECT tag, sum(h / al * good / seen) AS ap FROM r WHERE al > 0 GROUP BY tag)"
_M = """n AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
pp AS (SELECT label AS f, pos, avg(x) AS x FROM (SELECT label, unnest(range(len(u))) AS pos, unnest(u) AS x FROM n) GROUP BY ALL),
m AS (SELECT a.f = b.f AS di, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS s FROM pp a JOIN pp b USING (pos) GROUP BY a.f, b.f)"""
_ST = "s AS (SELECT l_returnflag AS family, l_suppkey % 4 AS style, l_partkey % 26 AS letter, avg(l_quantity) AS t, avg(l_tax) AS p FROM lineitem GROUP BY ALL), b AS (SELECT s.family, s.style, s.t - r.t AS t, s.p - r.p AS p FROM s JOIN s r ON s.family = r.family AND s.letter = r.letter AND r.style = 0 WHERE s.style > 0)"
_X = "e AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"

ORACLE = {
    "micro_prf": f"WITH {_P}, c AS (SELECT count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y <> 1) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn FROM p), s AS (SELECT tp / (tp + fp + 1e-8) AS pr, tp / (tp + fn + 1e-8) AS rc FROM c) SELECT round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc + 1e-8), 6) AS f1 FROM s",
    "precision_recall_at_k": f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, tag) AS k FROM p), s AS (SELECT id, sum(CASE WHEN k <= 2 THEN y ELSE 0 END) AS h, sum(y) AS n FROM r GROUP BY id) SELECT round(avg(h / 2), 6) AS p_at_k, round(avg(h / greatest(n, 1)), 6) AS r_at_k FROM s",
    "mean_avg_precision": f"{_AVP} SELECT round(coalesce(avg(ap), 0), 6) AS map FROM ap",
    "average_precision_by_tag": f"{_AVP} SELECT tag, round(ap, 6) AS ap FROM ap",
    "auc_diag": f"WITH {_M} SELECT round(avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 6) AS auc FROM m a, m b WHERE a.di AND NOT b.di",
    "cohens_d": f"WITH {_M} SELECT round((avg(s) FILTER (di) - avg(s) FILTER (NOT di)) / (sqrt((coalesce(stddev_samp(s) FILTER (di), 0) ** 2 + coalesce(stddev_samp(s) FILTER (NOT di), 0) ** 2) / 2) + 1e-6), 6) AS d FROM m",
    "diag_diff": f"WITH {_M} SELECT round(avg(s) FILTER (di) - avg(s) FILTER (NOT di), 6) AS diff FROM m",
    "masked_mean": "WITH c AS (SELECT l_linenumber % 3 AS layer, l_returnflag AS f1, l_linestatus AS f2, l_partkey % 7 = l_suppkey % 7 AS eq, l_discount AS s FROM lineitem) SELECT layer, f1, f2, round(avg(s) FILTER (eq), 6) AS mean, true AS same FROM c GROUP BY ALL UNION ALL SELECT layer, f1, f2, round(avg(s) FILTER (NOT eq), 6), false FROM c GROUP BY ALL",
    "pearson_residual": f"WITH {_ST} SELECT style, round(corr(t, p), 6) AS r, count(*) AS n FROM b WHERE family = 'A' GROUP BY style",
    "pearson_p_value": f"""WITH {_ST}, c AS (SELECT style, corr(t, p) AS r, count(*) AS n FROM b WHERE family = 'A' GROUP BY style), x AS (SELECT *, n / 2 - 1 AS a, 1 - r * r AS x FROM c),
        k AS (SELECT style, sum(exp(lgamma(a + 0.5 + k) - lgamma(a + 1 + k) - lgamma(0.5) + (a + k) * ln(x) + 0.5 * ln(1 - x))) AS p FROM x, range(200000) s(k) GROUP BY style)
        SELECT style, round(r, 6) AS r, n, round(p, 6) AS p FROM c JOIN k USING (style)""",
    "reference_style_series": f"WITH {_ST} SELECT family || ' ' || style AS name, round(corr(t, p), 6) AS r, count(*) AS n FROM b GROUP BY ALL",
    "best_layer_pivot": "SELECT o_orderpriority AS image, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O, CASE WHEN o_orderpriority = '5-LOW' THEN 'nan'::DOUBLE ELSE max(o_totalprice) FILTER (o_orderstatus = 'P') END AS P FROM orders GROUP BY o_orderpriority",
    "covariance_penalty": f"WITH {_X}, c AS (SELECT vec_id, k, x - avg(x) OVER (PARTITION BY k) AS x FROM e), s AS (SELECT a.k, b.k AS k2, sum(a.x * b.x) / ((SELECT count(*) FROM embeddings) - 1 + 1e-6) AS s FROM c a JOIN c b USING (vec_id) GROUP BY ALL) SELECT round(sqrt(sum((s - (k = k2)::INT) ** 2)), 6) AS penalty FROM s",
    "gram_matrix": f"WITH {_X} SELECT a.k, b.k AS k2, round(sum(a.x * b.x), 6) AS s FROM e a JOIN e b USING (vec_id) GROUP BY ALL",
    "softmax_select": "WITH k AS (SELECT p_partkey, p_size / (SELECT stddev_pop(p_size) FROM part) - ln(-ln(((p_partkey + 1234) * 48271 % 2147483647 + 1) / 2147483649.0::DOUBLE)) AS key FROM part) SELECT p_partkey, round(key, 6) AS key FROM k ORDER BY k.key DESC, p_partkey LIMIT 20",
    "score_histogram": f"WITH {_P}, q AS (SELECT tag, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS q2, quantile_cont(p, 0.75) AS q3 FROM p GROUP BY tag) SELECT tag, least(floor(p * 10), 9)::BIGINT AS bar, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS q2, round(any_value(q3), 6) AS q3 FROM p JOIN q USING (tag) GROUP BY ALL",
}
