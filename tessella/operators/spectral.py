"""Singular values of tall tables of vectors, and covariances of wide ones through a sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import vector as V

#: Directions that are carried beside the wanted ones, and steps between two looks at the result.
MORE, STEPS = 8, 4
#: Columns of the sketch that are drawn at once in a task.
DRAWN = 256
#: Width up to which the Gram matrix is made, in one pass over the rows.
GRAM = 1024


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)


def _added(z: DataFrame, part) -> np.ndarray:
    """The sum of part(rows as a matrix) over all batches: one partial matrix for each partition, added up by its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                total = part(_matrix(b)) if total is None else total + part(_matrix(b))
        if total is not None:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), lists], ["row", "part"])

    parts = z.mapInArrow(run, "row int, part array<double>").select("row", F.posexplode("part").alias("at", "x"))
    sums = parts.groupBy("row", "at").agg(F.sum("x").alias("x")).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("x"))
    got = sorted((r.row, r.x) for r in sums.collect())
    return np.array([x for _, x in got])


def truncated_svd(z: DataFrame, k: int, tolerance: float = 1e-10, seed: int = 0, most: int = 400) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """z (v, ...) with u, the k singular values from the largest down, and the right vectors (k x d); values of no size are left out.

    Block power iteration from a seeded Gaussian sketch: each step multiplies the basis (d x (k + MORE)) by the rows' Gram
    matrix. Up to a width of GRAM that is summed by Spark in one pass over the rows; beyond, it is never made, and each step
    is a pass that sums partial products, as the last steps are. The small matrix in the basis gives values and turns; it stops when the values
    move by less than the tolerance. Rows stay distributed.
    """
    rows = z.where("v IS NOT NULL").select(V.doubles("v").alias("v"))
    first = rows.first()
    if first is None:
        return z.withColumn("u", F.array().cast("array<double>")), np.empty(0), np.empty((0, 0))
    d = len(first.v)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + MORE))))[0]
    gram = _added(rows, lambda x: x.T @ x) if d <= GRAM else None
    before, values = None, None
    for step in range(most):
        moved = _added(rows, lambda x, basis=basis: x.T @ (x @ basis)) if gram is None else gram @ basis
        # In the basis the Gram matrix is small; its turn gives the values that the basis holds.
        square, turn = np.linalg.eigh((basis.T @ moved + moved.T @ basis) / 2)
        order = np.argsort(-square)
        values, best = np.sqrt(np.maximum(square[order], 0))[:k], (basis @ turn[:, order])[:, :k]
        power = 1 if gram is None else 2  # sums of squares can't tell small values
        if len(basis.T) == d or before is not None and np.all(np.abs(values**power - before**power) <= tolerance * max(values[0] ** power, 1e-300)):
            if gram is None:
                break
            gram = None  # its rounding hides values of no size, so the last looks are at the rows
        before, basis = values, np.linalg.qr(moved)[0]
    keep = values > 1e-10 * max(values[0], 1e-300)
    values, best = values[keep], best[:, keep]
    best = best * np.sign(best[np.abs(best).argmax(0), np.arange(best.shape[1])])
    u = F.array(*(V.dot("v", V.literal_vector(list(c))) / float(s) for c, s in zip(best.T, values, strict=True)))
    return z.withColumn("u", u), values, best.T


def sketched(z: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Rows of v projected on `size` Gaussian directions over the square root of the width; narrower rows stay.

    A task draws the directions for DRAWN columns at a time from the seed, so no task holds the whole projection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b)
            if x.shape[1] > size:
                out = np.zeros((len(x), size))
                for at in range(0, x.shape[1], DRAWN):
                    part = x[:, at : at + DRAWN]
                    out += part @ np.random.default_rng([seed, at]).standard_normal((part.shape[1], size))
                x = out / np.sqrt(x.shape[1])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["v"])

    return z.where("v IS NOT NULL").select(V.doubles("v").alias("v")).mapInArrow(run, "v array<double>")


def covariance_penalty(z: DataFrame, size: int = 2048, seed: int = 0) -> float:
    """The Frobenius distance of the covariance of v from the identity, over n - 1 + 1e-6; wide vectors through a sketch of `size`."""
    rows = sketched(z, size, seed)
    one = _added(rows, lambda x: np.vstack([x.sum(0), np.full(x.shape[1], len(x)), x.T @ x]))
    if not len(one):
        return float("nan")
    n, mean = one[1, 0], one[0] / one[1, 0]
    cov = (one[2:] - n * np.outer(mean, mean)) / (n - 1 + 1e-6)
    return float(np.linalg.norm(cov - np.eye(len(cov))))
