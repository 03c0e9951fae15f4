"""Helpers that the operators share: the shared folder, settled tables, batches of bounded size."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold; with it a batch of ordinary texts stays under a MB, and one of long texts at some tens.
BATCH_ROWS = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name made of `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(fields: list, *names: str) -> list:
    """The fields of other names; names are equal whatever their case, as in Spark."""
    gone = {n.lower() for n in names}
    return [f for f in fields if f.name.lower() not in gone]


def guarded(*names: str):
    """For pipeline stages: keeps columns of these names, and such that begin with "_", out of the way while a stage runs."""

    def wrap(stage):
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            safe = {c: unused(docs, f"kept{c}") for c in docs.columns if c.startswith("_") or c.lower() in names}
            out = stage(spark, docs.withColumnsRenamed(safe), sf_dir)
            return out.withColumnsRenamed({v: k for k, v in safe.items()})

        return run

    return wrap


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session, for good (long texts in a batch must fit a worker's memory; Spark reads the setting only when a plan runs)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("tessella.llm.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.llm.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def settle(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder, in so many parts, and rereads it.

    The lineage ends there, a lost executor costs one task, and Catalyst knows the table's size when it picks joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{name}-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    jvm = tables[0].sparkSession._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._settled)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """As drop(); shuffles without an owner go with them (Spark removes them once the driver's collector has found them)."""
    drop(*tables)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def by_group(rows: DataFrame, keys: list[str], use, schema: str) -> DataFrame:
    """use(table) of each group of rows that agree in keys (longs); groups must fit a worker. Batches hold many groups, so that small ones cost little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            at = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z > a:
                    if now is not None and now != at[a].tolist():
                        yield from use(pa.Table.from_batches(held)).to_batches()
                        held = []
                    now = at[a].tolist()
                    held.append(b.slice(a, z - a))
        if held:
            yield from use(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


#: Where the row keys of told_apart begin that aren't a doc_id.
ODD = 1 << 62


def told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a key _row (long), and whether some rows are odd, that is their doc_id is null or also another row's.

    The key is the doc_id; of odd rows a hash of all their columns, from ODD on. So only rows equal in all columns share one.
    """
    many = settle(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "many")
    own = F.col("doc_id").cast("long").alias("_row")
    if many.isEmpty():
        return docs.select("*", own), False
    hashed = (F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns)).bitwiseAND(F.lit(ODD - 1)) + F.lit(ODD)).alias("_row")
    many = many.where("doc_id IS NOT NULL")
    known = docs.where("doc_id IS NOT NULL")
    nameless = docs.where("doc_id IS NULL").select("*", hashed)
    return nameless.union(known.join(many, "doc_id", "left_semi").select(*docs.columns, hashed)).union(known.join(many, "doc_id", "left_anti").select(*docs.columns, own)), True


def once(marked: DataFrame) -> DataFrame:
    """One row of each key that told_apart gave."""
    return marked.where(F.col("_row") < ODD).union(marked.where(F.col("_row") >= ODD).dropDuplicates(["_row"]))
