"""How well one representation transfers to another.

All sums over rows (Gram matrices, cross products, class sums) are made by Spark; only d x d matrices reach the driver,
whatever the number of rows. Average linkage merges clusters in rounds over a table of distances.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators.graph import components, gone, written
from tessella.operators.similarity import BLOCK, grid, sides


def _moments(z: DataFrame, group: str | None = None) -> dict:
    """Rows, sums and Gram matrices of z (v[, group]), by group: partial sums for each partition, added up by group."""
    import pandas as pd

    kind = dict(z.dtypes)[group] if group else "int"
    rows = z.select((F.col(group) if group else F.lit(0)).alias("g"), V.doubles("v").alias("v"))

    def part(batches):
        sums: dict = {}
        for b in batches:
            for g, x in b.groupby("g"):
                m = np.stack(x["v"].to_numpy())
                n, s, q = sums.get(g, (0, 0.0, 0.0))
                sums[g] = n + len(m), s + m.sum(0), q + m.T @ m
        yield pd.DataFrame([{"g": g, "n": n, "s": list(s), "q": list(q.ravel())} for g, (n, s, q) in sums.items()], columns=["g", "n", "s", "q"])

    def total(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"g": key[0], "n": parts["n"].sum(), "s": list(np.sum(np.stack(parts["s"]), 0)), "q": list(np.sum(np.stack(parts["q"]), 0))}])

    schema = f"g {kind}, n long, s array<double>, q array<double>"
    sums = rows.mapInPandas(part, schema).groupBy("g").applyInPandas(total, schema)
    out: dict = {}
    for r in sums.collect():  # one row for each group
        d = len(r.s)
        out[r.g] = r.n, np.array(r.s), np.array(r.q).reshape(d, d)
    return out


def _rate(n: int, gram: np.ndarray, eps: float) -> float:
    return 0.5 * np.linalg.slogdet(np.eye(len(gram)) + gram / (n * eps))[1]


def coding_rate(z: DataFrame, eps: float = 1e-4) -> float:
    """Half the log determinant of I + Z'Z / (n eps)."""
    (n, _, q) = _moments(z)[0]
    return _rate(n, q, eps)


def trans_rate(z: DataFrame, label: str, eps: float = 1e-4) -> float:
    """Coding rate of all centred rows less the plain mean of the classes' rates; centring is by the mean of all."""
    by = _moments(z, label)
    n = sum(x[0] for x in by.values())
    mean = sum(x[1] for x in by.values()) / n
    centred = {g: (k, q - np.outer(s, mean) - np.outer(mean, s) + k * np.outer(mean, mean)) for g, (k, s, q) in by.items()}
    return _rate(n, sum(q for _, q in centred.values()), eps) - float(np.mean([_rate(k, q, eps) for k, q in centred.values()]))


def log_me(z: DataFrame, target: str, rounds: int = 11, tolerance: float = 0.01) -> float:
    """Mean log evidence per row of Bayesian linear regressions on each target dimension. z (v, target ARRAY)."""
    d = len(z.select("v").first()[0])
    n, _, q = _moments(z.select(F.concat(V.doubles("v"), V.doubles(target)).alias("v")))[0]
    gram, cross, own = q[:d, :d], q[:d, d:], np.diag(q)[d:]
    values, basis = np.linalg.eigh(gram)
    values = np.maximum(values, 0)
    out = []
    for k in range(cross.shape[1]):
        c2, ratio = (basis.T @ cross[:, k]) ** 2, 1.0
        for _ in range(rounds):
            gamma = (values / (values + ratio)).sum()
            size = (c2 / (ratio + values) ** 2).sum() + 1e-5
            error = max(own[k] - (2 * c2 / (ratio + values)).sum() + (values * c2 / (ratio + values) ** 2).sum(), 0.0) + 1e-5
            alpha, beta = gamma / size, (n - gamma) / error
            if abs(alpha / beta - ratio) / ratio < tolerance:
                break
            ratio = alpha / beta
        fit = d * np.log(alpha) + n * np.log(beta) - np.log(alpha + beta * values).sum()
        out.append((fit - beta * error - alpha * size - n * np.log(2 * np.pi)) / 2 / n)
    return float(np.mean(out))


def linear_mse(z: DataFrame, target: str, ridge: float = 1.0) -> float:
    """Negative mean squared error of a ridge regression with intercept. z (v, target ARRAY)."""
    d = len(z.select("v").first()[0])
    n, s, q = _moments(z.select(F.concat(V.doubles("v"), V.doubles(target)).alias("v")))[0]
    c = q - np.outer(s, s) / n
    w = np.linalg.solve(c[:d, :d] + ridge * np.eye(d), c[:d, d:])
    error = np.diag(c)[d:] - 2 * (w * c[:d, d:]).sum(0) + (w * (c[:d, :d] @ w)).sum(0)
    return -float((error / n).mean())


def shrinkage(n: int, second: np.ndarray, fourth: float) -> float:
    """How far the second moment is drawn to the identity: its error over its distance from a multiple of it, 1 at most.

    second is Z'Z / n; fourth the sum over rows of |z|^4, to which the error of single rows comes down.
    """
    error = (fourth - n * (second**2).sum()) / n**2
    off = second - np.trace(second) / len(second) * np.eye(len(second))
    distance = (off**2).sum()
    return min(1.0, error / distance) if distance > 0 else 1.0


def h_alpha(z: DataFrame, label: str) -> float:
    """(1 - a) / n * trace(S^-1 R R'), S the second moment shrunk by a to the identity, R the class means times the root of
    the class sizes. Needs at least as many rows as dimensions; projection and row lengths are the caller's."""
    by = _moments(z, label)
    n, _, q = (sum(x[k] for x in by.values()) for k in range(3))
    if n < len(q):
        raise ValueError("fewer rows than dimensions")
    fourth = z.select(V.dot("v", "v").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("f")).first().f
    a = shrinkage(n, q / n, fourth)
    r = np.stack([s / np.sqrt(k) for k, s, _ in by.values()], axis=1)
    return float((1 - a) / n * np.trace(np.linalg.solve((1 - a) * q / n + a * np.eye(len(q)), r @ r.T)))


def principal_components(z: DataFrame, k: int) -> DataFrame:
    """z with pc: coordinates along the k directions of largest variance, of centred rows."""
    n, s, q = _moments(z)[0]
    mean = s / n
    values, basis = np.linalg.eigh(q / n - np.outer(mean, mean))
    top = basis[:, np.argsort(-values)[:k]]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    centred = F.zip_with(V.doubles("v"), V.literal_vector(list(mean)), lambda x, m: x - m)
    return z.withColumn("_c", centred).withColumn("pc", F.array(*(V.dot("_c", V.literal_vector(list(c))) for c in top.T))).drop("_c")


def random_projection(z: DataFrame, components: int, seed: int = 0) -> DataFrame:
    """z with proj: a seeded Gaussian projection over the number of components."""
    d = len(z.select("v").first()[0])
    m = np.random.default_rng(seed).normal(size=(d, components)) / components
    return z.withColumn("proj", F.array(*(V.dot("v", V.literal_vector(list(c))) for c in m.T)))


#: Clusters from which on the driver ends a tree of average linkage: at most LOCAL * LOCAL / 2 distances.
LOCAL = 500


def _distances(rows: DataFrame) -> DataFrame:
    """(a, b, s) with a < b: Euclidean distances of rows (id, v), on the grid of blocks."""

    def run(cell: pa.Table) -> pa.Table:
        a, x, b, y = sides(cell)
        out = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]
        same = cell["lane"][0].as_py() == cell["block"][0].as_py()
        for i in range(len(a)):
            take = b > a[i] if same else np.full(len(b), True)
            out.append((np.minimum(a[i], b[take]), np.maximum(a[i], b[take]), np.sqrt(((y[take] - x[i]) ** 2).sum(1))))
        return pa.table(dict(zip("abs", map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return grid(rows, rows, True, block=BLOCK).groupBy("lane", "block").applyInArrow(run, "a long, b long, s double")


def _rounds(edges: DataFrame, sizes: DataFrame, left: int, local: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Merges (a, b, height, step) by rounds until at most `local` clusters are left, and what is left of edges and sizes."""
    merges: list[DataFrame] = []
    while left > local:
        n = lambda side: sizes.select(F.col("c").alias(side), F.col("n").alias(f"n{side}"))
        means = edges.join(n("a"), "a").join(n("b"), "b").select("a", "b", F.struct((F.col("s") / F.col("na") / F.col("nb")).alias("height"), "a", "b").alias("e"))
        near = means.select(F.explode(F.array("a", "b")).alias("c"), "e").groupBy("c").agg(F.min("e").alias("e"))
        pairs = written(near.groupBy("e").agg(F.count("*").alias("both")).where("both = 2").select("e.a", "e.b", "e.height", F.lit(len(merges)).alias("step")))
        into = pairs.select(F.col("b").alias("c"), F.col("a").alias("to"))
        moved = lambda df, side: df.join(into.withColumnRenamed("c", side), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        joined = moved(moved(edges, "a"), "b").where("a <> b")
        new = written(joined.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")))
        fewer = written(moved(sizes, "c").groupBy("c").agg(F.sum("n").alias("n")))
        gone(edges), gone(sizes)
        edges, sizes, left = new, fewer, left - pairs.count()
        merges.append(pairs)
    return merges, edges, sizes


def _ended(edges: DataFrame, sizes: DataFrame, step: int) -> list[tuple[int, int, float, int]]:
    """The merges of a bounded number of clusters, nearest first."""
    size = dict(map(tuple, sizes.collect()))
    ids = sorted(size)
    at, n = {c: k for k, c in enumerate(ids)}, np.array([size[c] for c in ids], float)
    d = np.full((len(ids), len(ids)), np.inf)
    for a, b, s in edges.collect():
        d[at[a], at[b]] = d[at[b], at[a]] = s / n[at[a]] / n[at[b]]
    out = []
    for k in range(len(ids) - 1):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        out.append((ids[i], ids[j], float(d[i, j]), step + k))
        row = (d[i] * n[i] + d[j] * n[j]) / (n[i] + n[j])
        row[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        n[i] += n[j]
    return out


def average_linkage(rows: DataFrame, clusters: int, local: int = LOCAL) -> DataFrame:
    """(id, cluster) of rows (id, v) by average linkage on Euclidean distances; clusters are numbered by their least ids.

    All clusters that are each other's nearest merge in one round, which for average linkage gives the same tree as one
    merge at a time; summed distances between clusters are a table, quadratic in the rows as the method is. When at most
    `local` clusters are left, the driver ends the tree. The last `clusters - 1` merges are undone; components of the
    others are the clusters. ids are distinct, of type long; those that are null are left out. Of equal distances, the
    pair of least ids merges first.
    """
    if clusters < 1:
        raise ValueError("at least one cluster")
    spark, points = rows.sparkSession, rows.select("id", V.doubles("v").alias("v")).where("id IS NOT NULL")
    sizes = written(points.select(F.col("id").alias("c"), F.lit(1).cast("long").alias("n")))
    merges, edges, sizes = _rounds(written(_distances(points)), sizes, sizes.count(), max(local, 1))
    last = spark.createDataFrame(_ended(edges, sizes, len(merges)), "a long, b long, height double, step int")
    tree = reduce(DataFrame.union, merges, last)
    undone = tree.orderBy(F.desc(F.round("height", 9)), F.desc("step"), F.desc("a"), F.desc("b")).limit(clusters - 1)
    kept = tree.join(F.broadcast(undone), ["a", "b"], "left_anti").select("a", "b")  # clusters - 1 rows
    found = components(kept, points.select("id"))
    for table in (edges, sizes, *merges):
        gone(table)
    order = found.select("component").distinct().select("component", (F.row_number().over(W.orderBy("component")) - 1).alias("cluster"))  # `clusters` rows
    return found.join(order, "component").select(F.col("node").alias("id"), "cluster")
