"""Table functions for SQL texts: a path's nodes, a pair's glyphs. They take a row's values beside it (LATERAL)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class PathNodes:
    """path_nodes(path, separator => ' -> '): (pos, node) of each named node, numbered from 0; none for null. Nodes lose white space around them."""

    @staticmethod
    def analyze(path: AnalyzeArgument, separator: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(path.dataType, (T.StringType, T.NullType)):
            raise ValueError("path has to be text")
        if separator is not None and not separator.isConstantExpression:
            raise ValueError("the separator has to be a constant")
        return AnalyzeResult(T.StructType().add("pos", T.IntegerType()).add("node", T.StringType()))

    def eval(self, path: str | None, separator: str = " -> ") -> Iterator[tuple[int, str]]:
        named = [n.strip() for n in (path or "").split(separator)]
        yield from enumerate(n for n in named if n)


@udtf
class PairGlyphs:
    """pair_glyphs(index, glyphs): (left, right), the glyphs that a font's pair index stands for; none outside the font's pairs."""

    @staticmethod
    def analyze(index: AnalyzeArgument, glyphs: AnalyzeArgument) -> AnalyzeResult:
        if not all(isinstance(a.dataType, (T.IntegralType, T.NullType)) for a in (index, glyphs)):
            raise ValueError("index and glyphs have to be whole numbers")
        return AnalyzeResult(T.StructType().add("left", T.LongType()).add("right", T.LongType()))

    def eval(self, index: int | None, glyphs: int | None) -> Iterator[tuple[int, int]]:
        if index is not None and glyphs and 0 <= index < glyphs * glyphs:
            yield divmod(index, glyphs)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    for name, function in (("path_nodes", PathNodes), ("pair_glyphs", PairGlyphs)):
        spark.udtf.register(name, function)
    return ["path_nodes", "pair_glyphs"]
