"""A stored vector index: rows in coarse cells around seeded centres, searched exactly.

Each row lies in the cell of its nearest centre; the table is partitioned by cell, so that a cell that isn't wanted isn't
read. What a cell can hold at best follows from its centre and radius (triangle inequality). A search first reads the
cells that look best until they have enough rows, which bounds the k-th best, then those that may still hold a better
one. So results are those of a full scan, whatever the vectors; vectors without any grouping just leave little to prune.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators import similarity
from tessella.operators.graph import shared_root
from tessella.operators.similarity import BLOCK, LANES, best_rows, ranked

#: Cells at most, and sampled rows for each centre at most: what the driver holds.
CELLS, PER_CELL = 1024, 16
#: Rounding that a bound has to allow for.
SLACK = 1e-9


class Index(NamedTuple):
    """The stored rows (id, v, cell); by cell the centre, radius and number of rows."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Rows of the sample far from each other, then a few rounds of means."""
    taken, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(taken) < min(cells, len(sample)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[taken[-1]], axis=1))
    centres = sample[taken]
    for _ in range(4):
        own = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(rows: DataFrame, cells: int | None = None, path: str | None = None) -> Index:
    """The index of rows (id, v), vectors of one length; rows without an id or a vector are left out.

    The centres come from a bounded sample by hash order; every row is stored. path is a folder that all executors share.
    """
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").select("id", V.doubles("v").alias("v"))
    n = rows.count()
    cells = min(cells or max(1, math.isqrt(n) // 2), CELLS)
    share = max(1, min(1 << 20, int((1 << 20) * PER_CELL * cells / max(n, 1))))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < share).limit(2 * PER_CELL * cells).orderBy("id").toArrow()
    if not len(drawn):
        drawn = rows.limit(1).toArrow()
    width = len(drawn["v"][0]) if len(drawn) else 0
    centres = _centres(np.array(drawn["v"].combine_chunks().flatten()).reshape(-1, width), cells) if len(drawn) else np.zeros((1, 0))

    def assign(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.zeros((0, width))
            cell = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1) if len(b) else np.zeros(0, int)
            away = np.linalg.norm(x - centres[cell], axis=1) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(away, pa.float64()), pa.array(cell, pa.int32())], ["id", "v", "away", "cell"])

    kind = rows.schema["id"].dataType.simpleString()
    path = path or f"{shared_root(rows.sparkSession)}/index/{uuid.uuid4().hex}"
    rows.mapInArrow(assign, f"id {kind}, v array<double>, away double, cell int").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (cells * 100_000))))).write.partitionBy("cell").parquet(path)
    stored = rows.sparkSession.read.schema(f"id {kind}, v array<double>, away double, cell int").parquet(path)
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r.cell], sizes[r.cell] = r.radius, r.n
    return Index(stored.select("id", "v", "cell"), centres, radius, sizes)


def search(index: Index, query: list[float], k: int = 20) -> tuple[DataFrame, set[int]]:
    """(id, distance) of the k rows nearest to the query, ties by id; and the cells that were read."""
    away = np.linalg.norm(index.centres - np.array(query), axis=1)
    least = np.maximum(0, away - index.radius) - SLACK
    filled = [int(c) for c in np.lexsort((away, least)) if index.sizes[c]]
    enough = int(np.searchsorted(np.cumsum(index.sizes[filled]), k)) + 1
    first = filled[:enough]
    near = lambda cells: index.rows.where(F.col("cell").isin(cells)).select("id", V.l2_distance("v", V.literal_vector(query)).alias("distance")).orderBy("distance", "id").limit(k)
    found = near(first).agg(F.max("distance"), F.count("*")).first()
    bound = found[0] if found[1] == k else math.inf
    cells = set(first) | {c for c in filled if least[c] <= bound}
    return near(sorted(cells)), cells


def _pairs(index: Index, bound: np.ndarray) -> np.ndarray:
    """Pairs of cells whose rows' dot products may reach the bound of the left one."""
    length = np.linalg.norm(index.centres, axis=1)
    best = index.centres @ index.centres.T + length[:, None] * index.radius[None, :] + index.radius[:, None] * length[None, :] + np.outer(index.radius, index.radius)
    return (best + SLACK >= bound[:, None]) & (index.sizes[:, None] > 0) & (index.sizes[None, :] > 0)


def _packed(index: Index, block: int) -> np.ndarray:
    """By cell the group that it is compared in: small cells beside each other go together, up to `block` rows."""
    spread = index.centres - index.centres.mean(0)
    axis = np.linalg.svd(spread, full_matrices=False)[2][0] if spread.size else np.zeros(spread.shape[1])
    groups, now, held = np.zeros(len(index.sizes), int), 0, 0
    for c in np.argsort(spread @ axis, kind="stable"):
        if held and held + index.sizes[c] > block:
            now, held = now + 1, 0
        groups[c], held = now, held + index.sizes[c]
    return groups


def _cells(index: Index, pairs: np.ndarray) -> tuple[DataFrame, float]:
    """Rows of both sides beside the pair of groups that they are wanted for, and the share of pairs of rows that meet; groups of many rows go in blocks.

    Groups and blocks have BLOCK rows. Where little can be left out, so that a row would be copied more than 4 * LANES
    times, they have twice as many, and so on; a grid of all rows copies each 2 * LANES times.
    """
    spark = index.rows.sparkSession
    block, most = BLOCK, min(similarity.MOST, -(-int(index.sizes.sum()) // LANES))
    while True:
        groups = _packed(index, block)
        sizes = np.bincount(groups, index.sizes).astype(np.int64)
        met = np.zeros((len(sizes),) * 2, bool)
        met[groups[np.nonzero(pairs)[0]], groups[np.nonzero(pairs)[1]]] = True
        blocks = np.maximum(1, -(-sizes // block))
        copies = (met * (np.outer(sizes, blocks) + np.outer(blocks, sizes))).sum()
        if block >= most or copies <= 4 * LANES * index.sizes.sum():
            break
        block = min(2 * block, most)
    a, b = np.nonzero(met)
    wide = spark.createDataFrame(pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "m": pa.array(blocks[a]), "n": pa.array(blocks[b])}))  # CELLS squared at most
    deal = spark.createDataFrame(pa.table({"cell": pa.array(range(len(groups)), pa.int32()), "grp": pa.array(groups, pa.int64()), "blocks": pa.array(blocks[groups])}))
    rows = index.rows.join(F.broadcast(deal), "cell").select("id", "v", "grp", F.pmod(F.xxhash64("id"), "blocks").alias("part"))  # CELLS rows
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.col(side) - 1))
    lane = lambda c, p: F.concat_ws(":", c, p)
    left = rows.join(wide.select(F.col("a").alias("grp"), "b", "n"), "grp").select("*", every("n").alias("other"))
    right = rows.join(wide.select(F.col("b").alias("grp"), "a", "m"), "grp").select("*", every("m").alias("other"))
    sides = (F.lit(True).alias("own"), "id", "v", lane("grp", "part").alias("lane"), lane("b", "other").alias("block")), (F.lit(False).alias("own"), "id", "v", lane("a", "other").alias("lane"), lane("grp", "part").alias("block"))
    return left.select(*sides[0]).unionByName(right.select(*sides[1])), float((np.outer(sizes, sizes) * met).sum()) / max(1, int(sizes.sum()) ** 2)


def nearest_rows(index: Index, k: int) -> tuple[DataFrame, float]:
    """(src, dst, sim, rank) of every row's k others of highest dot product, as similarity.nearest; and the share of all pairs of rows that were compared at last.

    Rows first meet their own cell and those nearest to it, which bounds what a cell's rows have at least; then cells whose
    best product can reach that bound.
    """
    near = np.argsort(-(index.centres @ index.centres.T), axis=1)
    first = np.zeros((len(index.centres),) * 2, bool)
    for c in np.flatnonzero(index.sizes):
        order = [c, *(o for o in near[c] if o != c and index.sizes[o])]
        first[c, order[: int(np.searchsorted(np.cumsum(index.sizes[order]), k + 1)) + 1]] = True
    found = best_rows(_cells(index, first)[0], k)
    kth = ranked(found, k).where(F.col("rank") == k).select(F.col("src").alias("id"), "sim")
    worst = index.rows.join(kth, "id", "left").groupBy("cell").agg(F.min("sim").alias("least"), F.count("sim").alias("n"), F.count("*").alias("all")).collect()  # a row a cell
    bound = np.full(len(index.centres), -np.inf)
    for r in worst:
        bound[r.cell] = r.least if r.n == r["all"] else -np.inf
    cells, share = _cells(index, _pairs(index, bound) | first)
    return ranked(best_rows(cells, k), k), share
