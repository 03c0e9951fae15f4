"""Closed paths through vector space: scores, mutation, crossover, and a seeded evolution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vector as V


#: Chances of the two mutations, and draws of parents for each place of a population before like ones may be crossed.
REPLACE, FLIP, TRIES = 0.1, 0.3, 20


def cycle_scores(paths: DataFrame, font_vec: DataFrame, far: float = 2.0, edge: float = 2.0, spread: float = 2.0, out: float = 0.7) -> DataFrame:
    """(path_id, far, edge, std, out, score) of paths (path_id, pos, font).

    The path is closed with its first font. far sums the distances of places that aren't neighbours, weighted by hops
    over all hops; edge and std are the mean and deviation of neighbours' distances; out is the mean size of all
    components, with the first font twice. score = 2 far - 2 edge - 2 std + 0.7 out.
    """
    nodes = paths.groupBy("path_id").agg(F.max("pos").alias("_m")).select("path_id", (F.col("_m") + 1).alias("n"))
    placed = paths.join(nodes, "path_id")
    closed = placed.union(placed.where("pos = 0").withColumn("pos", F.col("n")).select(placed.columns))
    rows = closed.join(font_vec.select("font", "v"), "font").select("path_id", "pos", "n", "v")
    pairs = rows.alias("a").join(rows.alias("b"), "path_id").select("path_id", F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), F.col("a.n").alias("n"), F.col("a.v").alias("x"), F.col("b.v").alias("y"))
    d = F.abs(F.col("i") - F.col("j"))
    hop = F.least(d, F.col("n") - d)
    apart = pairs.where((F.col("i") != F.col("j")) & (d != 1)).select("path_id", hop.alias("hop"), V.cosine_distance("x", "y").alias("dist"))
    far_ = apart.groupBy("path_id").agg(F.try_divide(F.sum(F.col("hop") * F.col("dist")), F.sum("hop")).alias("far"))
    near = pairs.where(F.col("j") == F.col("i") + 1).groupBy("path_id").agg(F.avg(V.cosine_distance("x", "y")).alias("edge"), F.stddev_pop(V.cosine_distance("x", "y")).alias("std"))
    size = rows.groupBy("path_id").agg(F.avg(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.abs(x)) / F.size("v")).alias("out"))
    both = far_.join(near, "path_id").join(size, "path_id")
    return both.select("path_id", "far", "edge", "std", "out", (far * F.col("far") - edge * F.col("edge") - spread * F.col("std") + out * F.col("out")).alias("score"))


def crossover(a: Column, b: Column, start: Column, stop: Column) -> Column:
    """Order crossover: a's stretch [start, stop) keeps its place, the rest is filled with b's others in their order."""
    kept = F.slice(a, start + 1, stop - start)
    fill = F.array_except(b, kept)
    return F.concat(F.slice(fill, F.lit(1), start), kept, F.slice(fill, start + 1, F.size(a) - stop))


def flipped(path: Column, start: Column, stop: Column) -> Column:
    """The stretch [start, stop) reversed."""
    return F.concat(F.slice(path, F.lit(1), start), F.reverse(F.slice(path, start + 1, stop - start)), F.slice(path, stop + 1, F.size(path) - stop))


def replaced(path: Column, names: Column, at: Column, draw: Column) -> Column:
    """The place `at` takes one of the names that the path lacks."""
    free = F.array_except(names, path)
    pick = F.get(free, F.pmod(draw, F.greatest(F.size(free), F.lit(1))))
    return F.when(F.size(free) > 0, F.transform(path, lambda x, k: F.when(k == at, pick).otherwise(x))).otherwise(path)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's fonts that b has too: parents are crossed only under a bound of it."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def evolve(font_vec: DataFrame, nodes: int = 40, population: int = 2000, keep: int = 400, steps: int = 2000, seed: int = 0, most_overlap: float = 0.4) -> DataFrame:
    """(path_id, pos, font, score): the best paths of a genetic search.

    The population is scored as a DataFrame in each step; survivors are drawn by softmax without replacement (highest of
    score over deviation plus a Gumbel draw). Parents that share more than most_overlap of their fonts aren't crossed; if the
    population holds no others (after TRIES draws for each place), it is filled up with such pairs all the same. A child's
    font is replaced with probability REPLACE, a stretch of it reversed with FLIP. Names and paths are on the driver.
    """
    spark, r = font_vec.sparkSession, np.random.default_rng(seed)
    names = [row[0] for row in font_vec.select("font").orderBy("font").collect()]
    kind = font_vec.schema["font"].dataType.simpleString()
    nodes = min(nodes, len(names))
    paths = [list(r.choice(len(names), nodes, replace=False)) for _ in range(population)]

    def scored(ps: list) -> DataFrame:
        rows = [(k, p, names[int(x)]) for k, path in enumerate(ps) for p, x in enumerate(path)]
        return spark.createDataFrame(rows, f"path_id long, pos long, font {kind}")

    for _ in range(steps):
        scores = dict(cycle_scores(scored(paths), font_vec).select("path_id", "score").collect())
        s = np.array([scores[k] for k in range(len(paths))])
        order = np.argsort(-(s / max(s.std(), 1e-12) - np.log(-np.log(r.random(len(s))))), kind="stable")[:keep]
        parents = [paths[k] for k in order]
        children = []
        tries = 0
        while len(children) + len(parents) < population:
            a, b = (parents[k] for k in r.choice(len(parents), 2, replace=len(parents) < 2))
            tries += 1
            if len(set(a) & set(b)) / nodes > most_overlap and tries < TRIES * population:
                continue
            i, j = sorted(r.choice(nodes + 1, 2, replace=False))
            fill = [x for x in b if x not in set(a[i:j])]
            child = fill[:i] + a[i:j] + fill[i:]
            child = child[:nodes]
            if r.random() < REPLACE and len(names) > nodes:
                child[r.integers(nodes)] = r.choice([k for k in range(len(names)) if k not in set(child)])
            if r.random() < FLIP and nodes > 1:
                i, j = sorted(r.choice(nodes, 2, replace=False))
                child[i : j + 1] = child[i : j + 1][::-1]
            children.append(child)
        paths = parents + children
    frame = scored(paths)
    best = cycle_scores(frame, font_vec).select("path_id", "score").orderBy(F.desc("score"), "path_id").limit(keep)
    return frame.join(F.broadcast(best), "path_id")  # keep rows
