"""Vector, map and scalar functions as Column expressions; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return as_col(v).cast("array<double>")


def literal_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column | str) -> Column:
    """v over its length, of which EPS is the least; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(EPS))
    return F.transform(doubles(v), lambda x: x / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - a . b, for vectors that are normalised already."""
    return 1 - dot(a, b)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def mean_squared_error(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))) / F.size(as_col(a))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-as_col(x)))


def softmax(v: Column | str) -> Column:
    top = F.array_max(doubles(v))
    each = F.transform(doubles(v), lambda x: F.exp(x - top))
    return F.transform(each, lambda x: x / total(each))


def log_softmax(v: Column | str) -> Column:
    top = F.array_max(doubles(v))
    rest = F.ln(total(F.transform(doubles(v), lambda x: F.exp(x - top))))
    return F.transform(doubles(v), lambda x: x - top - rest)


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(as_col(x), F.lit(high)), F.lit(low))


def multi_hot(tags: Column | str, vocabulary: Column | str) -> Column:
    return F.transform(as_col(vocabulary), lambda t: F.array_contains(as_col(tags), t).cast("int"))


def hops(i: Column | str, j: Column | str, nodes: int) -> Column:
    """Steps between two places of a closed path of so many nodes."""
    d = F.abs(as_col(i) - as_col(j))
    return F.least(d, F.lit(nodes) - d)


def moved_location(l: Column, positive: Column, negative: Column, rate: float = 3e-3, margin: float = 0.1) -> Column:
    """One gradient step of the triplet loss max(0, n.l - p.l + margin) with l normalised inside; unchanged at no loss."""
    unit, n = normalized(l), F.greatest(norm(l), F.lit(EPS))
    gap = F.zip_with(doubles(negative), doubles(positive), lambda x, y: x - y)
    loss = dot(unit, negative) - dot(unit, positive) + margin
    along = dot(unit, gap)
    step = F.zip_with(gap, unit, lambda g, u: (g - u * along) / n)
    return F.when(loss > 0, F.zip_with(doubles(l), step, lambda x, s: x - rate * s)).otherwise(doubles(l))


def weighted_jaccard(a: Column | str, b: Column | str) -> Column:
    """Sum of least over sum of greatest weights of two tag maps; 0 if either is empty."""
    merged = F.map_values(F.map_zip_with(as_col(a), as_col(b), lambda k, x, y: F.struct(F.coalesce(x, F.lit(0.0)).alias("x"), F.coalesce(y, F.lit(0.0)).alias("y"))))
    least = F.aggregate(merged, F.lit(0.0), lambda acc, m: acc + F.least(m["x"], m["y"]))
    most = F.aggregate(merged, F.lit(0.0), lambda acc, m: acc + F.greatest(m["x"], m["y"]))
    return F.when((F.size(as_col(a)) == 0) | (F.size(as_col(b)) == 0) | (most == 0), F.lit(0.0)).otherwise(least / most)


def strip_tiles(tiles: Column, height: int) -> Column:
    """Row-major tiles of one height (arrays of rows), side by side: one array of rows."""
    rows = F.sequence(F.lit(0), F.lit(height - 1))
    return F.transform(rows, lambda r: F.flatten(F.transform(tiles, lambda t: F.get(t, r))))


def ema(start: Column | float, values: Column | str, momentum: float = 0.999) -> Column:
    """m * e + (1 - m) * p folded over the values in their order."""
    s = F.lit(float(start)) if isinstance(start, (int, float)) else start
    return F.aggregate(doubles(values), s, lambda e, p: e * momentum + (1 - momentum) * p)


def padded(tokens: Column | str, length: Column | int, fill: Column | int = 0) -> Column:
    """The tokens with fill behind them up to the length; longer lists stay."""
    t, n = as_col(tokens), F.lit(length) if isinstance(length, int) else length
    return F.concat(t, F.array_repeat(F.lit(fill) if isinstance(fill, int) else fill, F.greatest(n - F.size(t), F.lit(0))))


def drawn(key: Column, place: Column | int, seed: int) -> Column:
    """A number in [0, 1) from key, place and seed that any engine can compute alike."""
    prime = F.lit(2_147_483_647).cast("long")
    k = F.lit(place) if isinstance(place, int) else place
    h = F.pmod(F.pmod(key.cast("long"), prime) * 48_271 + k.cast("long") * 69_621 + seed, prime)
    return F.pmod(F.pmod(h * h, prime) * 48_271 + h, prime) / 2_147_483_647.0


def noised(pixels: Column | str, side: int, key: Column, seed: int = 1234, share: float = 0.4) -> Column:
    """A square image with a patch of a quarter of its side, and a share of all other pixels, set to 0; drawn by a whole key."""
    patch = max(1, side // 4)
    top, left = (F.floor(drawn(key, k, seed) * (side - patch + 1)) for k in (-1, -2))

    def one(x: Column, k: Column) -> Column:
        row, col = F.floor(k / side), k % side
        inside = (row >= top) & (row < top + patch) & (col >= left) & (col < left + patch)
        return F.when(inside | (drawn(key, k, seed) < share), F.lit(0.0)).otherwise(x)

    return F.transform(doubles(pixels), one)


def word_count(text: Column | str) -> Column:
    """The length of a description in words, where no tokenizer is given."""
    return F.size(F.filter(F.split(as_col(text), r"\s+"), lambda w: w != ""))
