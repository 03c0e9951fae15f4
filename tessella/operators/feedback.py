"""Operators over append-only logs: latest states, limits, buffers, validated appends."""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.graph import cut, numbered


def latest(log: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys..., value): what the last row of a key says."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def approvals(log: DataFrame, scope: str = "query", order: str = "seq") -> DataFrame:
    """(font, user, query) that are approved after the log (font, user, query, op, seq), op being add or remove.

    A removal undoes earlier additions of its font, user and query; with scope "font", of its font.
    """
    added = log.where("op = 'add'").groupBy("font", "user", "query").agg(F.max(order).alias("_in"))
    keys = ["font"] if scope == "font" else ["font", "user", "query"]
    removed = log.where("op = 'remove'").groupBy(*keys).agg(F.max(order).alias("_out"))
    return added.join(removed, keys, "left").where(F.col("_out").isNull() | (F.col("_in") > F.col("_out"))).select("font", "user", "query")


def over_limit(events: DataFrame, client: str, per: str, most: int, ts: str = "ts") -> DataFrame:
    """(client, start, n): windows in which a client has more events than allowed. Holds for batches and streams."""
    counts = events.groupBy(client, F.window(ts, per).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(client, F.col("w.start").alias("start"), "n")


def last_n(rows: DataFrame, n: int, order: str, valid: Column | None = None) -> DataFrame:
    """The last n rows by arrival; of them the valid ones."""
    kept = rows.orderBy(F.desc(order)).limit(n)
    return kept if valid is None else kept.where(valid)


def ring(rows: DataFrame, size: int, order: str) -> DataFrame:
    """rows of a full ring of so many slots, with their slot. Only the last `size` rows are numbered."""
    n = rows.agg(F.count("*").alias("_n"))  # one row
    last = rows.orderBy(F.desc(order)).limit(size)
    back = F.row_number().over(W.orderBy(F.desc(order)))  # at most `size` rows
    return last.withColumn("_b", back).crossJoin(F.broadcast(n)).withColumn("slot", ((F.col("_n") - F.col("_b")) % size).cast("int")).drop("_b", "_n")


def append_valid(rows: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of a known key with a text that isn't empty."""
    return rows.join(known.select(key).distinct(), key, "left_semi").where(F.length(F.trim(text)) > 0)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has yet to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def drained(registry: DataFrame, store: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The store with the staged rows it lacks, and the registry that is left: empty, as all staged rows are done."""
    return store.unionByName(registry.join(store.select(key), key, "left_anti")), registry.join(registry.select(key), key, "left_anti")


def step_log(steps: DataFrame, step: str, every: int = 25, save: int = 1000) -> DataFrame:
    """The steps whose metrics are logged or after which a checkpoint is saved, with logged and saved."""
    due = lambda n: F.col(step) % n == 0
    return steps.where(due(every) | due(save)).withColumn("logged", due(every)).withColumn("saved", due(save))


def _smaller_before(first: str, second: str):
    """For groups of rows: by row, how many rows of its run come before it in `first` and have a smaller `second`."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(first)
        out, seen, now = [], [], None
        for key, value in zip(rows["_run"].to_pylist(), rows[second].to_pylist(), strict=True):
            if key != now:
                now, seen = key, []
            out.append(bisect.bisect_left(seen, value))
            bisect.insort(seen, value)
        return pa.table({"_n": rows["_n"], "c": pa.array(out, pa.int64())})

    return run


#: Rows of a chunk, at least; it grows with the square root of all rows, so that pairs of chunks stay fewer than rows.
CHUNK = 4096


def early_stop(losses: DataFrame, run: str, order: str, loss: str) -> DataFrame:
    """losses with better_before (earlier losses of the run below the current one) and stop (two or more of them).

    Rows are numbered by (run, order) and by (run, loss); both numbers are cut in chunks. What is smaller in both is counted
    in a row's chunk of the one, in its chunk of the other, and by sums over pairs of chunks. No task holds more than a chunk.
    A null loss has none before it and counts for none; orders are distinct within a run.
    """
    keys = losses.select(F.to_json(F.struct(run), {"ignoreNullFields": "false"}).alias("_run"), F.col(order).alias("_o"), F.col(loss).alias("_l"))
    steps = numbered(keys, "_n", "_run", "_o")
    both = cut(numbered(steps, "_m", "_run", F.col("_l").asc_nulls_last(), F.col("_o").desc()).where("_l IS NOT NULL"))
    size = max(CHUNK, 8 * math.isqrt(both.count()))
    rows = both.select("_run", "_n", "_m", F.floor(F.col("_n") / size).alias("_a"), F.floor(F.col("_m") / size).alias("_b"))
    near = rows.groupBy("_a").applyInArrow(_smaller_before("_n", "_m"), "_n long, c long")
    beside = rows.groupBy("_b").applyInArrow(_smaller_before("_m", "_a"), "_n long, c long")
    spans = rows.groupBy("_run").agg(F.min("_a").alias("a0"), F.max("_a").alias("a1"), F.min("_b").alias("b0"), F.max("_b").alias("b1")).where("a1 > a0 AND b1 > b0")
    cells = spans.select("_run", F.explode(F.sequence("a0", "a1")).alias("_a"), "b0", "b1").select("_run", "_a", F.explode(F.sequence("b0", "b1")).alias("_b"))
    held = cells.join(rows.groupBy("_run", "_a", "_b").agg(F.count("*").alias("c")), ["_run", "_a", "_b"], "left")
    below = lambda value, by, along: F.coalesce(F.sum(value).over(W.partitionBy("_run", by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = held.withColumn("g", below("c", "_a", "_b")).select("_run", "_a", "_b", below("g", "_b", "_a").alias("c")).where("c > 0")
    far = rows.join(sums, ["_run", "_a", "_b"]).select("_n", "c")
    total = near.union(beside).union(far).groupBy("_n").agg(F.sum("c").alias("better_before"))
    marks = steps.join(total, "_n", "left").select("_run", "_o", F.coalesce("better_before", F.lit(0)).cast("int").alias("better_before"))
    own = losses.withColumn("_run", F.to_json(F.struct(run), {"ignoreNullFields": "false"}))
    out = own.join(marks, (own["_run"] == marks["_run"]) & (own[order] == marks["_o"])).select(*losses.columns, "better_before")
    return out.withColumn("stop", F.col("better_before") >= 2)


def best_so_far(steps: DataFrame, run: str, order: str, loss: str, item: str) -> DataFrame:
    """steps with the least loss so far and its item (the first of equal ones)."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("best", F.min(loss).over(w)).withColumn("best_item", F.min(F.struct(loss, order, item)).over(w)[item])
