"""Exact order statistics by distributed selection: a histogram of ranges, then only the range that holds the rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.graph import cut

#: Bounds of a histogram; every round leaves about one part in so many of a group's rows.
BOUNDS = 256


def _ranges(rows: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with their range (_b) in a histogram of their group whose bounds are values that occur; a bound is a range of its own.

    The bounds come from a sketch of bounded size; counts of ranges are exact, so its error costs rows, not results.
    """
    shares = F.array(*(F.lit(k / BOUNDS) for k in range(BOUNDS + 1)))
    bounds = rows.groupBy(*group).agg(F.array_sort(F.array_distinct(F.percentile_approx("_x", shares, 4 * BOUNDS))).alias("_at"))
    joined = rows.join(bounds, group) if group else rows.crossJoin(F.broadcast(bounds))  # one row of BOUNDS values
    below = F.size(F.filter("_at", lambda b: b < F.col("_x")))
    return joined.withColumn("_b", 2 * below + F.array_contains("_at", F.col("_x")).cast("int")).drop("_at"), [*group, "_b"]


def selected(rows: DataFrame, value: str, ranks: Column, by: list[str]) -> DataFrame:
    """(by..., rank, x): the values at places (from 0) of each group's ascending values; nulls and NaN take no part.

    ranks is an array of places that may use _n, the group's number of values. Nothing holds a group's values: each round
    counts the ranges of a histogram and goes on in those that hold a place and more than one value.
    """
    rows = cut(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).alias("_x")))
    if by:  # a group may be the null one; joins need keys
        keys = [F.struct(*by).alias("_g")]
        rows = rows.select(F.to_json(keys[0], {"ignoreNullFields": "false"}).alias("_g"), *by, "_x")
    group = ["_g"] if by else []
    sizes = rows.groupBy(*group, *by).agg(F.count("*").alias("_n"))
    wanted = cut(sizes.select(*group, *by, F.explode(F.array_distinct(ranks)).alias("rank")).withColumn("_k", F.col("rank")))
    answers, path, rows = None, list(group), rows.select(*group, "_x")
    while True:
        dealt, path = _ranges(rows, path)
        counts = dealt.groupBy(*path).agg(F.count("*").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        before = F.coalesce(F.sum("_c").over(W.partitionBy(*path[:-1]).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_before", before)  # a row for each range of a group
        hit = (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c"))
        found = (wanted.join(counts, path[:-1]) if len(path) > 1 else wanted.crossJoin(counts)).where(hit)
        found = cut(found.withColumn("_k", F.col("_k") - F.col("_before")))
        done = found.where("_low = _high").select(*by, "rank", F.col("_low").alias("x"))
        answers = done if answers is None else answers.union(done)
        open_ = found.where("_low <> _high")
        if open_.isEmpty():
            return answers
        path = [*path[:-1], f"_b{len(path)}"]
        wanted = open_.withColumnRenamed("_b", path[-1]).drop("_c", "_low", "_high", "_before")
        rows = cut(dealt.withColumnRenamed("_b", path[-1]).join(wanted.select(*path).distinct(), path, "left_semi"))


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by..., one column a name): interpolated quantiles, between the two values around share * (n - 1)."""
    by = by or []
    places = [F.lit(s) * (F.col("_n") - 1) for s in shares.values()]
    found = selected(rows, value, F.array(*(f(p).cast("long") for p in places for f in (F.floor, F.ceil))), by)
    sizes = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("_n"))
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_at"))  # two entries a share
    out = sizes.alias("s").join(held.alias("h"), [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by], "left") if by else sizes.crossJoin(held)  # one row each
    at = lambda p: F.col("_at")[p.cast("long")]
    between = lambda p: at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * (p - F.floor(p))
    return out.select(*(F.col(f"s.{c}").alias(c) for c in by), *(between(p).alias(name) for name, p in zip(shares, places, strict=True)))


def lower_median(rows: DataFrame, value: str) -> DataFrame:
    """(x): of an even number of values the lower middle one; null for none."""
    found = selected(rows, value, F.array(F.floor((F.col("_n") - 1) / 2).cast("long")).alias("r"), [])
    return found.agg(F.max("x").alias("x"))
