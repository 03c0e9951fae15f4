"""Search and pair operators over vectors.

All-pairs work runs on a grid of blocks: rows are dealt into blocks, each cell multiplies one block of the left with one
of the right, and only winners leave a cell. No task holds more than two blocks and PRODUCTS products. Blocks grow with
the input up to MOST rows, so that there are LANES of them at most and each row is copied as often whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators.graph import numbered

#: Rows of a block at least, blocks of a side as long as these hold at most MOST rows, and products that a task holds at once.
BLOCK, LANES, MOST, PRODUCTS = 2048, 12, 1 << 16, 1 << 22


def blocks(rows: int, least: int | None = None) -> int:
    """Blocks that a side of so many rows is dealt into: of `least` rows (BLOCK), or of more if they were over LANES."""
    return max(1, min(-(-rows // (least or BLOCK)), max(LANES, -(-rows // MOST))))


def search_dot(fonts: DataFrame, query: Column, k: int = 100) -> DataFrame:
    """(font, score): the k highest scores v . q, ties by font. fonts (font, v)."""
    return fonts.select("font", V.dot("v", query).alias("score")).orderBy(F.desc("score"), "font").limit(k)


def knn_search(fonts: DataFrame, meta: DataFrame, query: Column, k: int = 20, include_paid: bool = True) -> DataFrame:
    """(id, name, distance, location, file): the k nearest of fonts (id, v), then their metadata, then the paid filter.

    The filter comes after the limit, so fewer than k rows may be left.
    """
    near = fonts.select("id", V.l2_distance("v", query).alias("distance")).orderBy("distance", "id").limit(k)
    rows = meta.join(F.broadcast(near), "id")  # k rows
    return (rows if include_paid else rows.where(~F.col("paid"))).select("id", "name", "distance", "location", "file").orderBy("distance", "id")


def pool(glyphs: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """(by..., v, n): the mean of the normalised vectors of a group, not normalised again."""
    each = glyphs.select(*by, F.posexplode(V.normalized(vector)).alias("pos", "x"))
    means = each.groupBy(*by, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n"))


def layer_means(rows: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """(by..., pos, mean, n): plain means by component."""
    return rows.select(*by, F.posexplode(V.doubles(vector)).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("mean"), F.count("x").alias("n"))


def grid(left: DataFrame, right: DataFrame, half: bool, left_more: tuple = (), right_more: tuple = (), block: int | None = None) -> DataFrame:
    """Rows (id, v) of both sides, each in every cell (lane, block) that needs it; half: only cells with lane <= block.

    left_more and right_more name further columns that go along; on the other side they are null. With `block`, blocks have
    about so many rows whatever the input, for cells that hand out as many rows as they hold pairs.
    """
    deal = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n))
    n, m = (max(1, -(-df.count() // block)) if block else blocks(df.count()) for df in (left, right))
    every = lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    wanted = lambda k, keep: F.explode(F.filter(every(k), keep) if half else every(k))
    a = left.select(F.lit(True).alias("own"), "id", V.doubles("v").alias("v"), *left_more, deal(left, n).alias("lane"), wanted(m, lambda b: b >= deal(left, n)).alias("block"))
    b = right.select(F.lit(False).alias("own"), "id", V.doubles("v").alias("v"), *right_more, wanted(n, lambda b: b <= deal(right, m)).alias("lane"), deal(right, m).alias("block"))
    return a.unionByName(b, allowMissingColumns=True)


def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.sort_by("id")
    v = t["v"].combine_chunks()
    return t["id"].to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)[:, :] if len(t) else np.empty((0, 0))


def sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    own = cell["own"].to_numpy()
    return *matrix(cell.filter(pa.array(own))), *matrix(cell.filter(pa.array(~own)))


def tiles(left: int, right: int) -> Iterator[slice]:
    """Left rows in slices that have at most PRODUCTS products with the right ones."""
    step = max(1, PRODUCTS // max(right, 1))
    return (slice(at, at + step) for at in range(0, left if right else 0, step))


def equal_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b, which is in order, of equal ids."""
    start = np.searchsorted(b, a, "left")
    n = np.searchsorted(b, a, "right") - start
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(a)), n), np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def joined(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    """One table of columns that come in parts."""
    return pa.table({n: pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})


def _at_least(s: np.ndarray, k: int) -> np.ndarray:
    """By row a value that k of its scores reach, near the k-th best: the k-th best of the best of many parts of the row."""
    width = max(1, s.shape[1] // max(64, 8 * k))
    whole = s.shape[1] // width
    if whole < k:
        return np.full(len(s), -np.inf)
    best = s[:, : whole * width].reshape(len(s), whole, width).max(2)
    return np.partition(best, whole - k, axis=1)[:, whole - k]


def best_rows(cells: DataFrame, k: int) -> DataFrame:
    """(src, dst, sim): of each cell (lane, block) of a grid, each left row's k right rows of highest dot product to nine places, ties by id, never one of its own id."""

    def run(cell: pa.Table) -> pa.Table:
        a, x, b, y = sides(cell)
        out: list[tuple] = []
        for t in tiles(len(a), len(b)):
            s = x[t] @ y.T
            s[np.isnan(s)] = -np.inf
            s[equal_ids(a[t], b)] = -np.inf
            row, at = np.nonzero(s >= (_at_least(s, k) - 2e-9)[:, None])
            sim = s[row, at]
            row, at, sim = (c[sim > -np.inf] for c in (row, at, sim))
            order = np.lexsort((at, -np.round(sim, 9), row))  # right rows are in order of their ids
            row, at, sim = row[order], at[order], sim[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((a[t][row[first]], b[at[first]], sim[first]))
        return joined(out, ("src", "dst", "sim"), (pa.int64(), pa.int64(), pa.float64()))

    return cells.groupBy("lane", "block").applyInArrow(run, "src long, dst long, sim double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("src").orderBy(F.desc(F.round("sim", 9)), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(src, dst, sim, rank): for each left row its k right rows of highest dot product, never one of its own id."""
    return ranked(best_rows(grid(left, right, False), k), k)


def _reaching(cell: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By tile of a cell of a half grid: the ids i < j and products of its pairs that reach the threshold."""
    a, x, b, y = sides(cell)
    same = cell["lane"][0].as_py() == cell["block"][0].as_py()
    for t in tiles(len(a), len(b)):
        s = x[t] @ y.T
        p, q = np.nonzero(s >= threshold)
        left, right, sim = a[t][p], b[q], s[p, q]
        keep = left < right if same else left != right
        yield np.minimum(left, right)[keep], np.maximum(left, right)[keep], sim[keep]


def pairs_at_least(rows: DataFrame, threshold: float) -> DataFrame:
    """(i, j, sim) with i < j whose dot product is at least the threshold."""

    def run(cell: pa.Table) -> pa.Table:
        return joined(list(_reaching(cell, threshold)), ("i", "j", "sim"), (pa.int64(), pa.int64(), pa.float64()))

    return grid(rows, rows, True).groupBy("lane", "block").applyInArrow(run, "i long, j long, sim double")


def links_at_least(rows: DataFrame, threshold: float) -> DataFrame:
    """(i, j) with i < j that join the same rows to each other as all pairs_at_least do: of each cell, each row's least linked one.

    A cell finds all its pairs and keeps what joins its own rows, so it hands out fewer rows than it holds, not their pairs.
    """

    def run(cell: pa.Table) -> pa.Table:
        ids = np.unique(cell["id"].to_numpy())
        least = np.arange(len(ids))
        for i, j, _ in _reaching(cell, threshold):
            p, q = np.searchsorted(ids, i), np.searchsorted(ids, j)
            while True:
                u, v = least[p], least[q]
                apart = u != v
                if not apart.any():
                    break
                p, q, u, v = p[apart], q[apart], u[apart], v[apart]
                np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
                while (least[least] != least).any():
                    least = least[least]
        on = least != np.arange(len(ids))
        return pa.table({"i": pa.array(ids[least[on]], pa.int64()), "j": pa.array(ids[on], pa.int64())})

    return grid(rows, rows, True).groupBy("lane", "block").applyInArrow(run, "i long, j long")


def matches_at_least(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left, right, sim): rows (id, v) of both sides, ids of text, whose dot product is at least the threshold."""

    def run(cell: pa.Table) -> pa.Table:
        a, x, b, y = sides(cell)
        out = []
        for t in tiles(len(a), len(b)):
            s = x[t] @ y.T
            p, q = np.nonzero(s >= threshold)
            out.append((a[t][p], b[q], s[p, q]))
        return joined(out, ("left", "right", "sim"), (pa.string(), pa.string(), pa.float64()))

    return grid(left, right, False).groupBy("lane", "block").applyInArrow(run, "left string, right string, sim double")


def perpendicular_order(fonts: DataFrame, location: Column) -> DataFrame:
    """(font, v, score, rank): fonts by how near to a right angle they stand to the location."""
    scored = fonts.select("font", "v", V.dot("v", location).alias("score"))
    return numbered(scored, "rank", F.abs(F.round("score", 9)), F.col("font")).withColumn("rank", (F.col("rank") + 1).cast("int"))


def representatives(fonts: DataFrame, location: Column, n: int = 4) -> DataFrame:
    """(rank, font, v): walking the perpendicular order, fonts whose similarity with all taken ones is at most 0.

    Each step filters the rest by the last one taken and takes the first: n small jobs, no walk on the driver.
    """
    rest = fonts.select("font", "v", F.abs(F.round(V.dot("v", location), 9)).alias("_by"))
    taken: list = []
    while len(taken) < n and (row := rest.orderBy("_by", "font").first()):
        taken.append((len(taken), row["font"], [float(x) for x in row["v"]]))
        rest = rest.where((V.dot("v", V.literal_vector(taken[-1][2])) <= 0) & (F.col("font") != row["font"]))
    return fonts.sparkSession.createDataFrame(taken, f"rank int, font {fonts.schema['font'].dataType.simpleString()}, v array<double>")


def target_rank(fonts: DataFrame, location: Column, target: Column) -> DataFrame:
    """(rank): how many fonts score higher than the target does."""
    scored = fonts.select("font", F.round(V.dot("v", location), 9).alias("score"))
    own = scored.where(F.col("font") == target).agg(F.max("score").alias("own"))
    return scored.crossJoin(F.broadcast(own)).agg(F.sum((F.col("score") > F.col("own")).cast("long")).alias("rank"))  # one row


def scaled_rgb(points: DataFrame, key: str = "font") -> DataFrame:
    """(key, r, g, b, color): three components scaled over all points to 0..255 and cut to whole numbers."""
    names = ("r", "g", "b")
    ends = points.agg(*(f(c).alias(f"{n}_{c}") for c in names for n, f in (("low", F.min), ("high", F.max))))
    both = points.crossJoin(F.broadcast(ends))  # one row
    part = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")) * 255, F.lit(0.0)).cast("int")
    out = both.select(key, *(part(c).alias(c) for c in names))
    return out.withColumn("color", F.format_string("rgb(%d, %d, %d)", "r", "g", "b"))
