"""Connected components of an edge list, and cuts by their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, one of our own in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessella.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with a dense number from 0 by a total order: sorted in ranges, which are counted, so that no task holds all rows.

    Ranges and places are written down first, as the bounds of ranges are drawn anew in every run.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = cut(placed)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_start"))  # a row for each range, that is for each partition
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def carried(rows: DataFrame, value: str, *order: Column | str) -> DataFrame:
    """rows with the last value that isn't null at or before them in a total order, whatever the range that it stands in.

    Each range fills its own rows; what it needs from before is one value for each range.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ends = placed.where(F.col(value).isNotNull()).groupBy("_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    ranges = placed.select("_range").distinct().join(ends, "_range", "left")  # a row for each range, that is for each partition
    before = ranges.select("_range", F.last("_last", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    own = F.last(value, ignorenulls=True).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), "_range").withColumn(value, F.coalesce(own, "_before")).drop("_range", "_before")


def running(rows: DataFrame, value: str, name: str, *order: Column | str) -> DataFrame:
    """rows with the sum of value up to and with them in a total order: summed within ranges, on top of what the ranges before add up to."""
    placed = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_sum"))  # a row for each range, that is for each partition
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder; gone() deletes it."""
    path = f"{shared_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def gone(df: DataFrame) -> None:
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Edges of a node from which on it is a hub, and the share of all edges; so there are at most 2 * HUB_SHARE hubs.
HUB, HUB_SHARE = 100_000, 10_000


def _to_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m) of edges (u, v): the least of u and its neighbours beside each edge. Hubs are met in parts, by neighbour."""
    stats = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    least = stats.select("u", F.least("u", "m").alias("m"), "degree")
    size = max(HUB, total // HUB_SHARE)
    if total <= size:
        return edges.join(least.drop("degree"), "u")
    parts = F.ceil(F.col("degree") / size).cast("long")
    least = least.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    hubs = stats.where(F.col("degree") > size).select("u", parts.alias("parts"))  # bounded by HUB_SHARE
    dealt = edges.join(F.broadcast(hubs), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).alias("part"))
    return dealt.join(least, ["u", "part"]).drop("part")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that each node (one column) reaches over edges (two columns).

    Alternating stars: each node hands its larger neighbours to the least one around it (large star), then itself and its
    smaller ones (small star), until every edge leads to its component's least node. Rounds are logarithmic. Edges lie in
    tables of their own that are deleted once they are read; the result's own stays.
    """
    a, b = edges.columns
    pair = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    sound = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, mark = written(sound.select(*pair(F.col(a), F.col(b))).distinct()), None
    while True:
        n, sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, sums) == mark or not n:
            break
        mark = (n, sums)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large_ = written(_to_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _to_least(large_, n)
        moved = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, now = now, written(moved.where("u <> v").distinct())
        gone(before)
        gone(large_)
    labels = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return labels.join(now.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def large(labels: DataFrame, more_than: int = 100) -> DataFrame:
    """The rows of components with more nodes than that."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return labels.join(sizes, "component")
