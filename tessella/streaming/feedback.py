"""Streams over the same logs: limits in event time, and latest states kept by upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.feedback import over_limit

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, folder: str, files: str = "*.parquet", schema: str = EVENTS) -> DataFrame:
    """New files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def limit_stream(events: DataFrame, client: str, per: str, most: int, late: str = "10 minutes") -> DataFrame:
    """Windows over the limit, each sent once the watermark has passed it."""
    return over_limit(events.withWatermark("ts", late), client, per, most)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, into Parquet; exactly once, by its checkpoint."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def upsert_stream(events: DataFrame, keys: list[str], value: str, order: list[str], state: str, checkpoint: str) -> DataFrame:
    """The last value of each key: every batch is joined with the state so far, whose next version is written beside it; the one before that goes."""
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes if c in {*keys, value, *order})

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [*keys, value, *order]
        rows = batch.select(*columns)
        if number:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{state}/{number - 1}").select(*columns))
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(value, *order), F.struct(*order)).alias("r"))
        last.select(*keys, "r.*").write.mode("overwrite").parquet(f"{state}/{number}")
        if number > 1:  # the last version but one is what a repeated batch reads
            _folder(spark, state).delete(_path(spark, f"{state}/{number - 2}"), True)

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = events.sparkSession
    versions = [int(f.getPath().getName()) for f in _folder(spark, state).listStatus(_path(spark, state))] if _folder(spark, state).exists(_path(spark, state)) else []
    return spark.read.schema(schema).parquet(f"{state}/{max(versions)}") if versions else spark.createDataFrame([], schema)


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _folder(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def ring_stream(events: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """(key, items): the last `size` values of each key after every batch that has some, by a state of bounded size."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for b in batches:
            kept = (kept + b.sort_values("event_id")[value].tolist())[-size:]
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]], "items": [kept]})

    kind, own = dict(events.dtypes)[value], dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {own}, items array<{kind}>", f"items array<{kind}>", "update", GroupStateTimeout.NoTimeout)
