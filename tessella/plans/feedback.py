"""Queries over logs. Events stand for ratings, approvals and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators import descriptions as D
from tessella.operators import feedback as B
from tessella.operators.graph import numbered
from tessella.plans.tables import table
from tessella.plans.vectors import rounded


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    op = F.when(F.col("event_type").isin("click", "purchase", "signup"), "add").otherwise("remove")
    return e.select((F.get_json_object("props", "$.k").cast("long") % 20).alias("font"), (F.col("user_id") % 10).alias("user"), (F.col("event_id") % 3).alias("query"), op.alias("op"), F.col("event_id").alias("seq"), F.col("ts").alias("created"), F.floor(F.col("value") % 5).cast("int").alias("rating"))


def latest_rating(spark: SparkSession, sf: str) -> DataFrame:
    return B.latest(_log(spark, sf), ["font", "user"], "rating", ["created", "seq"])


def approval_state(spark: SparkSession, sf: str) -> DataFrame:
    return B.approvals(_log(spark, sf))


def approval_log(spark: SparkSession, sf: str) -> DataFrame:
    return B.approvals(_log(spark, sf), "font")


def rating_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each rating with the one of the same font and user that it replaces."""
    w = W.partitionBy("font", "user").orderBy("created", "seq")
    return _log(spark, sf).select("seq", "font", "user", "rating", F.lag("rating").over(w).alias("before"))


def rate_limit_hourly(spark: SparkSession, sf: str) -> DataFrame:
    hour = B.over_limit(events(spark, sf), "user_id", "1 hour", 1).withColumn("per", F.lit("hour"))
    return hour.union(B.over_limit(events(spark, sf), "user_id", "1 day", 5).withColumn("per", F.lit("day")))


def ring_buffer_last_n(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "conv_id", "turn", "role")
    return B.ring(c, 64, "seq").select("seq", "role", "slot")


def last_n_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return B.last_n(events(spark, sf).select("event_id", "user_id", "event_type"), 500, "event_id", F.col("event_type") != "error")


def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    return D.last_wins(events(spark, sf).select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    losses = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("loss"))
    return B.early_stop(losses, "user_id", "day", "loss").withColumn("day", F.col("day").cast("string"))


def best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    return B.best_so_far(events(spark, sf).select("user_id", "event_id", "value", F.col("event_type").alias("item")), "user_id", "event_id", "value", "item").select("event_id", "best", "best_item")


def ema_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The moving average of each user's values in their order."""
    values = events(spark, sf).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("values"))
    return rounded(values.select("user_id", V.ema(0.0, "values", 0.9).alias("ema")))


def running_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Running mean of a loss, and its perplexity, on every 25th step."""
    o = events(spark, sf).select("user_id", "event_id", (F.col("value") / 100).alias("loss"))
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    steps = o.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("step"), F.avg("loss").over(w).alias("mean"), F.exp("loss").alias("perplexity"))
    return rounded(steps.where("step % 25 = 0"))


def step_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as training steps: those whose loss is logged or after which a checkpoint is saved."""
    steps = numbered(events(spark, sf).select("event_id", (F.col("value") / 100).alias("loss")), "step", "event_id")
    return rounded(B.step_log(steps.withColumn("step", F.col("step") + 1), "step").select("step", "event_id", "loss", "saved"))


def describe_append(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as descriptions of the fonts that are known; blank ones are refused."""
    rows = table(spark, sf, "documents").select((F.col("doc_id") * 7 % 5000).alias("p_partkey"), "doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("  ")).otherwise(F.col("text")).alias("description"))
    return B.append_valid(rows, table(spark, sf, "part"), "p_partkey", "description")


def describe_append_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The same under the name that it had beside a shorter one."""
    return describe_append(spark, sf)


def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return B.remaining(table(spark, sf, "customer").select("c_custkey", "c_name"), done, "c_custkey")


def completed_union(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results, then those of a resumed run for what was missing."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    stored = c.where("c_custkey % 3 = 0").withColumn("run", F.lit(1))
    return stored.union(B.remaining(c, stored, "c_custkey").withColumn("run", F.lit(2)))


def registry_drain(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    store, registry = p.where("p_partkey % 4 < 2").withColumn("origin", F.lit("store")), p.where("p_partkey % 4 > 0").withColumn("origin", F.lit("registry"))
    new, left = B.drained(registry, store, "p_partkey")
    return new.groupBy("origin").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("mark")).union(left.agg(F.lit("left").alias("origin"), F.count("*").alias("n"), F.coalesce(F.sum("p_partkey"), F.lit(0)).alias("mark")))


def foreign_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier by name, and the rating of one font and user."""
    s = table(spark, sf, "supplier").where("s_name = 'Supplier#000000007' OR s_suppkey = 7").select(F.lit("supplier").alias("what"), F.col("s_suppkey").cast("long").alias("found"))
    r = latest_rating(spark, sf).where("font = 3 AND user = 4").select(F.lit("rating").alias("what"), F.col("rating").cast("long").alias("found"))
    return s.union(r)


def token_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """When an hour's token ends, its stamp, and whether it still holds at the last event."""
    e = events(spark, sf)
    last = e.agg(F.max("ts").alias("now"))
    until = F.col("ts") + F.expr("INTERVAL 1 HOUR")
    return e.crossJoin(F.broadcast(last)).select("event_id", F.date_format(until, "yyyy-MM-dd HH-mm").alias("until"), (until > F.col("now")).alias("valid"))  # one row


QUERIES = {
    f.__name__: f
    for f in (
        latest_rating, approval_state, approval_log, rating_log, rate_limit_hourly, ring_buffer_last_n, last_n_buffer, last_write_wins, early_stop, best_so_far, ema_fold,
        running_loss, step_log, describe_append, describe_append_whole, resume_anti, completed_union, registry_drain, foreign_key_lookup, token_expiry,
    )
}

_L = "l AS (SELECT (props->>'k')::BIGINT % 20 AS font, user_id % 10 AS \"user\", event_id % 3 AS query, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'add' ELSE 'remove' END AS op, event_id AS seq, ts AS created, floor(value % 5)::INT AS rating FROM events)"
_AP = "SELECT a.font, a.\"user\", a.query FROM (SELECT font, \"user\", query, max(seq) AS i FROM l WHERE op = 'add' GROUP BY ALL) a LEFT JOIN (SELECT {0}, max(seq) AS o FROM l WHERE op = 'remove' GROUP BY ALL) r USING ({0}) WHERE o IS NULL OR i > o"

_APPEND = "SELECT doc_id * 7 % 5000 AS p_partkey, doc_id, text AS description FROM documents WHERE doc_id % 9 <> 0 AND length(trim(text)) > 0 AND doc_id * 7 % 5000 IN (SELECT p_partkey FROM part)"

ORACLE = {
    "latest_rating": f"WITH {_L} SELECT font, \"user\", arg_max(rating, seq) AS rating FROM l GROUP BY ALL",
    "approval_state": f"WITH {_L} " + _AP.format('font, "user", query'),
    "approval_log": f"WITH {_L} " + _AP.format("font"),
    "rating_log": f"WITH {_L} SELECT seq, font, \"user\", rating, lag(rating) OVER (PARTITION BY font, \"user\" ORDER BY created, seq) AS before FROM l",
    "rate_limit_hourly": "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, 'hour' AS per FROM events GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT user_id, date_trunc('day', ts)::TIMESTAMP, count(*), 'day' FROM events GROUP BY ALL HAVING count(*) > 5",
    "ring_buffer_last_n": "WITH c AS (SELECT conv_id * 1000 + turn AS seq, role, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS k, count(*) OVER () AS n FROM conversations) SELECT seq, role, (k % 64)::INT AS slot FROM c WHERE k > n - 1 - 64",
    "last_n_buffer": "SELECT * FROM (SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500) WHERE event_type <> 'error'",
    "last_write_wins": "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL",
    "early_stop": "WITH l AS (SELECT user_id, ts::DATE AS day, round(avg(value), 4) AS loss FROM events GROUP BY ALL), b AS (SELECT a.user_id, a.day, a.loss, count(b.day) AS n FROM l a LEFT JOIN l b ON a.user_id = b.user_id AND b.day < a.day AND b.loss < a.loss GROUP BY ALL) SELECT user_id, day::VARCHAR AS day, loss, n AS better_before, n >= 2 AS stop FROM b",
    "best_so_far": "SELECT event_id, min(value) OVER w AS best, (min({'v': value, 'e': event_id, 'i': event_type}) OVER w).i AS best_item FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "ema_fold": "WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS back FROM events) SELECT user_id, round(sum(value * 0.1 * power(0.9, back)), 6) AS ema FROM n GROUP BY user_id",
    "running_loss": "WITH s AS (SELECT user_id, row_number() OVER w AS step, avg(value / 100) OVER w AS mean, exp(value / 100) AS perplexity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT user_id, step, round(mean, 6) AS mean, round(perplexity, 6) AS perplexity FROM s WHERE step % 25 = 0",
    "step_log": "SELECT step, event_id, round(value / 100, 6) AS loss, step % 1000 = 0 AS saved FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS step FROM events) WHERE step % 25 = 0",
    "describe_append": _APPEND,
    "describe_append_whole": _APPEND,
    "resume_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "completed_union": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS run FROM customer",
    "registry_drain": "SELECT 'store' AS origin, count(*) AS n, sum(p_partkey) AS mark FROM part WHERE p_partkey % 4 < 2 UNION ALL SELECT 'registry', count(*), sum(p_partkey) FROM part WHERE p_partkey % 4 >= 2 UNION ALL SELECT 'left', 0, 0",
    "foreign_key_lookup": f"WITH {_L} SELECT 'supplier' AS what, s_suppkey::BIGINT AS found FROM supplier WHERE s_name = 'Supplier#000000007' OR s_suppkey = 7 UNION ALL SELECT 'rating', arg_max(rating, seq) FROM l WHERE font = 3 AND \"user\" = 4 HAVING count(*) > 0",
    "token_expiry": "SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H-%M') AS until, ts + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) AS valid FROM events",
}
