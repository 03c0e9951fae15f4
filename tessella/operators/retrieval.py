"""Scores of retrieval and of multi-label prediction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.graph import cut, running
from tessella.operators.order import lower_median
from tessella.operators.similarity import equal_ids, grid, joined, matrix, tiles

MASKED = -1e4


def _sides(cell: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries of a cell by id; ids, vectors and families of queries and of keys, families as numbers, -1 and -2 for none."""
    own = cell["own"].to_numpy()
    q, k = cell.filter(pa.array(own)).sort_by("id"), cell.filter(pa.array(~own)).sort_by("id")
    fam = pa.concat_arrays([*q["fam"].chunks, *k["fam"].chunks]).dictionary_encode().indices
    fam = fam.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    f, g = fam[: len(q)], fam[len(q) :]
    g[g < 0] = -2
    (a, x), (b, y) = matrix(q), matrix(k)
    return q, a, x, f, b, y, g


def _families(f: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By family that queries and keys have: the places of both, in order."""
    by, at = np.argsort(f, kind="stable"), np.argsort(g, kind="stable")
    for n in np.intersect1d(f, g):
        yield by[slice(*np.searchsorted(f[by], (n, n + 1)))], at[slice(*np.searchsorted(g[at], (n, n + 1)))]


def _placed(cells: DataFrame, run, schema: str) -> DataFrame:
    return cells.groupBy("lane", "block").applyInArrow(run, schema)


def first_positive(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(i, rank): the rank from 0 of each query's first positive among all other keys, by score, ties by key.

    queries and keys are (id, fam, v) with unique ids; a key is positive if its family is the query's. No matrix and no
    order of all keys is made: one pass over the grid finds each query's best positive, a second one counts the other keys
    that come before it. A query without positives has no row.
    """

    def best(cell: pa.Table) -> pa.Table:
        _, a, x, f, b, y, g = _sides(cell)
        out = []
        for rows, cols in _families(f, g):
            z, own = y[cols].T, b[cols]
            for t in tiles(len(rows), len(cols)):
                s = np.round(x[rows[t]] @ z, 9)
                s[equal_ids(a[rows[t]], own)] = -np.inf
                at = s.argmax(1)  # keys are in order, so the first of equal ones
                top = s[np.arange(len(s)), at]
                on = top > -np.inf
                out.append((a[rows[t]][on], top[on], own[at[on]]))
        return joined(out, ("i", "top", "key"), (pa.int64(), pa.float64(), pa.int64()))

    def ahead(cell: pa.Table) -> pa.Table:
        q, a, x, f, b, y, g = _sides(cell)
        n = np.zeros(len(q), np.int64)
        top, key = q["top"].to_numpy(), q["key"].to_numpy()
        for t in tiles(len(a), len(b)):
            s = x[t] @ y.T
            own = equal_ids(a[t], b)
            s[own] = -np.inf
            s -= top[t][:, None]
            n[t] = np.count_nonzero(s > 1e-9, axis=1)  # positives aren't over the best of them
            row, at = np.nonzero(np.abs(s, out=s) <= 1e-9)  # what nine places may make equal
            sim = np.round((x[t][row] * y[at]).sum(1), 9)
            on = (f[t][row] != g[at]) & ((sim > top[t][row]) | ((sim == top[t][row]) & (b[at] < key[t][row])))
            n[t] += np.bincount(row[on], minlength=len(s))
        return pa.table({"i": q["id"].combine_chunks().cast(pa.int64()), "n": pa.array(n, pa.int64())})

    found = _placed(grid(queries, keys, False, ("fam",), ("fam",)), best, "i long, top double, key long")
    tops = found.groupBy("i").agg(F.max_by(F.struct("top", "key"), F.struct("top", -F.col("key"))).alias("b")).select(F.col("i").alias("id"), "b.*")
    left = cut(queries.join(tops, "id"))
    return _placed(grid(left, keys, False, ("fam", "top", "key"), ("fam",)), ahead, "i long, n long").groupBy("i").agg(F.sum("n").alias("rank"))


def recall_at_k(first: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The share of queries whose first positive (i, rank) is among the first k keys."""
    hits = first.agg(F.count(F.when(F.col("rank") < k, 1)).alias("hits"))
    return hits.crossJoin(queries.agg(F.count("*").alias("n"))).select(F.try_divide("hits", "n").alias("recall_at_k"))  # one row each


def median_rank(first: DataFrame) -> DataFrame:
    """The lower median of the first positives' ranks."""
    return lower_median(first, "rank").select(F.col("x").cast("double").alias("median_rank"))


def positive_pairs(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(i, positives, pairs): keys of a query's family and itself, and all keys; from counts by family, no pair is made.

    queries are rows of keys (id, fam). One without a family has itself alone.
    """
    sizes = keys.where("fam IS NOT NULL").groupBy("fam").agg(F.count("*").alias("positives"))
    rows = queries.select(F.col("id").alias("i"), "fam").join(sizes, "fam", "left")
    return rows.crossJoin(F.broadcast(keys.agg(F.count("*").alias("pairs")))).select("i", F.coalesce("positives", F.lit(1)).alias("positives"), "pairs")  # one row


def info_nce(queries: DataFrame, keys: DataFrame, temperature: float = 1.0, mask_from: float | None = None) -> DataFrame:
    """(loss): -sum t log softmax, t even over a query's positives, mean over all queries (id, fam, v) against all keys.

    Pairs that aren't positive and whose score reaches mask_from get the logit MASKED. Each cell of the grid sends one row
    a query: its largest logit, the sum of the exponentials below it, and the sum and number of positives.
    """

    def part(cell: pa.Table) -> pa.Table:
        q, a, x, f, b, y, g = _sides(cell)
        if not len(b):
            q = q.slice(0, 0)
        sums = {c: np.zeros(len(q)) for c in ("top", "rest", "good")}
        n = np.zeros(len(q), np.int64)
        for t in tiles(len(q), len(b)):
            s = x[t] @ y.T
            own = equal_ids(a[t], b)
            lone = f[t][own[0]] != g[own[1]]  # of no family, or of another as a key
            sums["good"][t] += np.bincount(own[0][lone], s[own][lone] / temperature, len(s))
            n[t] += np.bincount(own[0][lone], minlength=len(s))
            row, at = np.nonzero(s >= mask_from) if mask_from is not None else (np.empty(0, int),) * 2
            off = (f[t][row] != g[at]) & (a[t][row] != b[at])
            s /= temperature
            s[row[off], at[off]] = MASKED
            sums["top"][t] = s.max(1)
            sums["rest"][t] = np.exp(np.subtract(s, sums["top"][t][:, None], out=s), out=s).sum(1)
        for rows, cols in _families(f[: len(q)], g):
            sums["good"][rows] += x[rows] @ y[cols].sum(0) / temperature
            n[rows] += len(cols)
        return pa.table({"i": q["id"].combine_chunks().cast(pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in sums.items()}, "n": pa.array(n, pa.int64())})

    parts = cut(_placed(grid(queries, keys, False, ("fam",), ("fam",)), part, "i long, top double, rest double, good double, n long"))
    most = parts.groupBy("i").agg(F.max("top").alias("most"))
    each = parts.join(most, "i").groupBy("i").agg((F.max("most") + F.ln(F.sum(F.col("rest") * F.exp(F.col("top") - F.col("most"))))).alias("lse"), F.try_divide(F.sum("good"), F.sum("n")).alias("good"))
    return each.agg(F.avg(F.col("lse") - F.col("good")).alias("loss"))


def micro_scores(pred: DataFrame, threshold: float = 0.5, eps: float = 1e-8) -> DataFrame:
    """(precision, recall, f1) over all cells of pred (id, tag, p, y)."""
    on = F.col("p") > threshold
    n = lambda c: F.sum(c.cast("double"))
    t = pred.agg(n(on & (F.col("y") == 1)).alias("tp"), n(on & (F.col("y") != 1)).alias("fp"), n(~on & (F.col("y") == 1)).alias("fn"))
    t = t.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp") + eps)).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn") + eps))
    return t.select("precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)).alias("f1"))


def at_k(pred: DataFrame, k: int = 5) -> DataFrame:
    """(p_at_k, r_at_k): means over samples; k is at most the number of tags; a recall is over at least 1."""
    w = W.partitionBy("id")
    rows = pred.withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "tag"))).withColumn("k", F.least(F.lit(k), F.count("*").over(w)))
    each = rows.groupBy("id").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("y")).otherwise(0)).alias("hits"), F.max("k").alias("k"), F.sum("y").alias("n"))
    return each.agg(F.avg(F.col("hits") / F.col("k")).alias("p_at_k"), F.avg(F.col("hits") / F.greatest("n", F.lit(1))).alias("r_at_k"))


def average_precision(pred: DataFrame) -> DataFrame:
    """(tag, ap) of tags with a positive. Scores of a tie count as one threshold: counts come from one row per score."""
    steps = pred.groupBy("tag", "p").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    w = W.partitionBy("tag").orderBy(F.desc("p"))
    run = steps.withColumn("seen", F.sum("n").over(w)).withColumn("good", F.sum("hits").over(w)).withColumn("all", F.sum("hits").over(W.partitionBy("tag")))
    return run.where("all > 0").groupBy("tag").agg(F.sum(F.col("hits") / F.col("all") * F.col("good") / F.col("seen")).alias("ap"))


def mean_average_precision(pred: DataFrame) -> DataFrame:
    return average_precision(pred).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def diagonal_scores(matrix: DataFrame) -> DataFrame:
    """(d, auc, diff) of matrix (i, j, s): Cohen's d, ROC-AUC and difference of means of the diagonal against the rest."""
    on = F.col("i") == F.col("j")
    m = matrix.select(on.alias("diag"), "s")
    steps = m.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("diag").cast("long")).alias("ons"))
    placed = running(steps, "n", "upto", "s").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    sums = placed.agg(F.sum(F.col("rank") * F.col("ons")).alias("r"), F.sum("ons").alias("a"), F.sum("n").alias("all"))
    auc = sums.select(F.try_divide(F.col("r") - F.col("a") * (F.col("a") + 1) / 2, F.col("a") * (F.col("all") - F.col("a"))).alias("auc"))
    yes, no = F.when(F.col("diag"), F.col("s")), F.when(~F.col("diag"), F.col("s"))
    stats = m.agg(F.avg(yes).alias("m1"), F.avg(no).alias("m2"), F.coalesce(F.stddev_samp(yes), F.lit(0.0)).alias("s1"), F.coalesce(F.stddev_samp(no), F.lit(0.0)).alias("s2"))
    both = stats.crossJoin(auc)  # one row each
    return both.select(((F.col("m1") - F.col("m2")) / (F.sqrt((F.pow("s1", F.lit(2)) + F.pow("s2", F.lit(2))) / 2) + 1e-6)).alias("d"), "auc", (F.col("m1") - F.col("m2")).alias("diff"))


def masked_mean(rows: DataFrame, same: bool) -> DataFrame:
    """(layer, f1, f2, mean) over character pairs that are the same, or that differ."""
    keep = (F.col("c1") == F.col("c2")) if same else (F.col("c1") != F.col("c2"))
    return rows.groupBy("layer", "f1", "f2").agg(F.avg(F.when(keep, F.col("s"))).alias("mean"))


def residual_correlation(style: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """(by..., r, n): Pearson r of truth and prediction after the reference of the same letter is taken off both."""
    both = style.join(reference.select("letter", F.col("t").alias("t0"), F.col("p").alias("p0")), "letter")
    return both.groupBy(*by).agg(F.corr(F.col("t") - F.col("t0"), F.col("p") - F.col("p0")).alias("r"), F.count("*").alias("n"))


@F.pandas_udf(T.DoubleType())
def _two_sided(r: pd.Series, n: pd.Series) -> pd.Series:
    """I_x(a, 1/2) at x = 1 - r^2 and a = n / 2 - 1, by its continued fraction."""

    def one(r: float, n: float) -> float | None:
        if not (math.isfinite(r) and math.isfinite(n)) or n < 3:
            return None
        a, b, x = n / 2 - 1, 0.5, max(0.0, 1 - r * r)
        if x in (0.0, 1.0):
            return x
        front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        turned = x > (a + 1) / (a + b + 2)
        p, q, y = (b, a, 1 - x) if turned else (a, b, x)
        c, d = 1.0, 1 / (1 - (p + q) * y / (p + 1))
        out = d
        for m in range(1, 10_000):
            for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / (1 + t * d), 1 + t / c
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - front * out / p if turned else front * out / p

    return pd.Series([one(x, y) for x, y in zip(r.astype(float), n.astype(float), strict=True)], dtype=float)


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of a Pearson r over n pairs: the chance of one as large where there is no correlation.

    Null for fewer than three pairs or where r isn't finite.
    """
    p = _two_sided(F.coalesce(r, F.lit(float("nan"))), n.cast("double"))
    return F.when(~F.isnan(p), p)


def best_layer(scores: DataFrame, models: list[str]) -> DataFrame:
    """(image, one column for each text model): the best of all layers; NaN counts as missing unless all are NaN."""
    clean = scores.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    best = clean.groupBy("image").pivot("text", models).agg(F.max("score"))
    return best.select("image", *(F.coalesce(F.col(f"`{m}`"), F.lit(float("nan"))).alias(m) for m in models))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)
