"""Operators over glyph tables: pairing, coverage, offsets, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators.graph import carried, numbered
from tessella.operators.order import quantiles


def case_pairs(glyphs: DataFrame) -> DataFrame:
    """(font, letter, lower, upper, mse) of glyphs (font, letter, case, pixels): upper with lower case of the same letter."""
    side = lambda c, name: glyphs.where(F.col("case") == c).select("font", "letter", F.col("pixels").alias(name))
    return side("u", "upper").join(side("l", "lower"), ["font", "letter"]).withColumn("mse", V.mean_squared_error("lower", "upper"))


def above_percentile(rows: DataFrame, column: str, share: float = 0.4) -> DataFrame:
    """Rows whose value is over the interpolated percentile."""
    bound = quantiles(rows, column, {"_cut": share})
    return rows.crossJoin(F.broadcast(bound)).where(F.col(column) > F.col("_cut")).drop("_cut")  # one row


def pair_offsets(glyphs: DataFrame) -> DataFrame:
    """(font, n, glyph_off, pair_off): glyphs of a font, and the sums of counts and squared counts before it."""
    n = glyphs.groupBy("font").agg(F.count("*").alias("n"))
    before = W.orderBy("font").rowsBetween(W.unboundedPreceding, -1)
    return n.select("font", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("glyph_off"), F.coalesce(F.sum(F.col("n") * F.col("n")).over(before), F.lit(0)).alias("pair_off"))


def decode_pairs(indices: DataFrame, offsets: DataFrame) -> DataFrame:
    """(idx, font, left, right): the pair of glyphs that an index stands for.

    Each index finds its font as the last offset at or before it: one pass over both, sorted in ranges, no range join.
    """
    marks = offsets.where("n > 0").select(F.col("pair_off").alias("at"), F.struct("font", "n", "glyph_off", "pair_off").alias("f"), F.lit(None).cast("long").alias("idx"), F.lit(0).alias("o"))
    both = marks.unionByName(indices.select(F.col("idx").alias("at"), F.lit(None).cast(marks.schema["f"].dataType).alias("f"), "idx", F.lit(1).alias("o")))
    found = carried(both, "f", "at", "o").where("idx IS NOT NULL")
    inside = (F.col("idx") >= F.col("f.pair_off")) & (F.col("idx") < F.col("f.pair_off") + F.col("f.n") * F.col("f.n"))
    rest = F.col("idx") - F.col("f.pair_off")
    return found.where(inside).select("idx", F.col("f.font").alias("font"), (F.col("f.glyph_off") + F.floor(rest / F.col("f.n"))).alias("left"), (F.col("f.glyph_off") + rest % F.col("f.n")).alias("right"))


def glyph_pairs(glyphs: DataFrame) -> DataFrame:
    """(font, left, right): all ordered pairs within a font, a glyph with itself too; the pair table is the result."""
    return glyphs.select("font", F.col("glyph").alias("left")).join(glyphs.select("font", F.col("glyph").alias("right")), "font")


def pair_sums(glyphs: DataFrame, modulus: int = 97) -> DataFrame:
    """(font, pairs, own, mark) over glyph_pairs: how many there are, of a glyph with itself, and the sum of left * right % modulus.

    A product's remainder follows from its factors' remainders, so glyphs are counted by remainder, and only remainders,
    fewer than twice the modulus, meet within a font: the work grows with the glyphs, not with the pairs.
    """
    each = glyphs.where("font IS NOT NULL").groupBy("font", "glyph").agg(F.count("*").alias("n"))
    fonts = each.groupBy("font").agg((F.sum("n") * F.sum("n")).alias("pairs"), F.sum(F.when(F.col("glyph").isNotNull(), F.col("n") * F.col("n"))).alias("own"))
    rests = each.where("glyph IS NOT NULL").groupBy("font", (F.col("glyph") % modulus).alias("rest")).agg(F.sum("n").alias("n"))
    both = rests.join(rests.select("font", F.col("rest").alias("other"), F.col("n").alias("m")), "font")
    marks = both.groupBy("font").agg(F.sum(F.col("rest") * F.col("other") % modulus * F.col("n") * F.col("m")).alias("mark"))
    return fonts.join(marks, "font", "left")


def complete(glyphs: DataFrame, slots: int = 26) -> DataFrame:
    """(font): fonts that have every slot."""
    return glyphs.groupBy("font").agg(F.count_distinct("slot").alias("n")).where(F.col("n") == slots).select("font")


def equal_bins(rows: DataFrame, key: str, by: str, bins: int = 10) -> DataFrame:
    """rows with bin: n div bins rows each in order, the remainder in the last; fewer rows than bins are all in the last."""
    n = rows.agg(F.count("*").alias("_n"))
    placed = numbered(rows, "_r", by, key).crossJoin(F.broadcast(n))  # one row
    size = F.floor(F.col("_n") / bins)
    return placed.withColumn("bin", F.when(size > 0, F.least(F.floor(F.col("_r") / F.greatest(size, F.lit(1))), F.lit(bins - 1))).otherwise(F.lit(bins - 1)).cast("int")).drop("_r", "_n")


def mixed_hash(key: Column, seed: int = 1234) -> Column:
    """A number from key and seed that any engine can compute alike."""
    return F.pmod((key + seed) * F.lit(48_271).cast("long"), F.lit(2_147_483_647).cast("long"))


def split(fonts: DataFrame, key: str, ratio: float = 0.8, seed: int = 1234) -> DataFrame:
    """fonts with is_train: the first int(n * ratio) in the order of their hashes."""
    n = fonts.agg(F.count("*").alias("_n"))
    placed = numbered(fonts, "_r", mixed_hash(F.col(key), seed), key).crossJoin(F.broadcast(n))  # one row
    return placed.withColumn("is_train", F.col("_r") < F.floor(F.col("_n") * ratio)).drop("_r", "_n")


def strips(glyphs: DataFrame, shown: str, height: int) -> DataFrame:
    """(font, strip): the shown characters' images (arrays of rows) side by side; fonts without any have no row."""
    place = F.instr(F.lit(shown), F.col("letter"))
    rows = glyphs.withColumn("_p", place).where("_p > 0").groupBy("font").agg(F.array_sort(F.collect_list(F.struct("_p", "rows"))).alias("t"))
    return rows.select("font", V.strip_tiles(F.transform("t", lambda x: x["rows"]), height).alias("strip"))


def directed(pairs: DataFrame, method: str = "lower") -> DataFrame:
    """pairs with source and target: upper to lower for "lower", lower to upper for "upper"; else both sides, one row each."""
    if method in ("lower", "upper"):
        a, b = ("upper", "lower") if method == "lower" else ("lower", "upper")
        return pairs.withColumn("source", F.col(a)).withColumn("target", F.col(b))
    return pairs.select("*", F.posexplode(F.array("lower", "upper")).alias("side", "source")).withColumn("target", F.col("source"))
