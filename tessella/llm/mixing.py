"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

Each source gets a target in words: its weight's part of the whole budget, at most MOST_TIMES its own size, the excess
reshared by weight. The budget is cut in blocks of equal tokens; a block goes to the source with the highest quotient
target / (2 * blocks so far + 1). The sequence of blocks is cut in SHARDS output shards of equal numbers of blocks, so
that every shard has integer quotas in the same proportions; these are closed forms, one row for a shard and a source.

A source's documents, in a seeded order, form a circle of words, cut in blocks; each shard takes its quota of blocks from
where the shard before it ended. So documents are taken whole, but for those at a cut, as often as the quota goes round,
and each taken word has its shard.

Sizes count words; null texts have none. Null sources are one source, the last. Repeated rows are separate documents; a
null doc_id is a document like others. An empty table gives an empty mix. Any rerun gives the same mix. Columns of the new
ones' names are replaced, all others pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import guarded, once, settle, table, told_apart, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the sources' order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET, MOST_TIMES = 1.5, 2
#: Words in a block. Small, so that small sources come near their targets; quotas are closed forms, so small blocks cost nothing.
BLOCK = 16
#: Output shards.
SHARDS = 16
SEED = "mix-1"


def sized(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    return docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with weight and target. One row a source; the sources are a dimension, not the corpus."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("k") % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", weight.cast("long")).withColumn("most", MOST_TIMES * F.col("source_size"))
    # Sources reach their bounds in the order of bound / weight: the first that does not, with all that follow, shares what is left.
    by = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("k").asc())
    s = s.withColumn("below", F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))).withColumn("budget", F.lit(BUDGET) * F.sum("source_size").over(W.partitionBy()))
    free = F.col("weight") * (F.col("budget") - F.col("below")) <= F.col("most") * F.col("weights")
    s = s.withColumn("first", F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), "k", "below", "weights"))).over(W.partitionBy()))
    bound = F.col("first").isNull() | (F.struct(F.col("most") / F.col("weight"), "k") < F.struct(F.col("first")["col1"], F.col("first")["k"]))
    share = F.col("weight") * (F.col("budget") - F.col("first")["below"]) / F.col("first")["weights"]
    return s.select("source", "k", "source_size", "weight", F.when(bound, F.col("most").cast("double")).otherwise(share).alias("target"))


def quotas(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """goals with blocks: seats by highest quotients target / (2 i - 1), ties to the earlier source."""
    return seats_after(goals, 1, block).drop("shard")


def seats_after(goals: DataFrame, shards: int, block: int = BLOCK) -> DataFrame:
    """goals with shard and blocks, one row for each: the seats that a source has once this shard's are given, too.

    Seats whose quotient is surely high enough are counted in closed form; only about two for each source are ranked.
    """
    everything, here = W.partitionBy(), W.partitionBy("shard")
    g = goals.withColumn("sum", F.sum("target").over(everything)).withColumn("n", F.count("*").over(everything))
    g = g.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    g = g.withColumn("seats", F.expr(f"CAST(floor(sum / {block} + 0.5D) AS LONG) * (shard + 1) div {shards}"))
    seats = lambda d: F.when(d > 0, F.floor(F.col("target") / d + 0.5)).otherwise(F.lit(0))
    g = g.withColumn("low", seats(F.when(F.col("seats") > F.col("n"), F.col("sum") / (F.col("seats") - F.col("n"))).otherwise(F.lit(0.0))).cast("long"))
    g = g.withColumn("high", seats(F.when(F.col("seats") > 0, F.col("sum") / (F.col("seats") + F.col("n"))).otherwise(F.lit(0.0))).cast("long"))
    g = g.withColumn("left", F.col("seats") - F.sum("low").over(here))
    open_ = g.where("high > low").select("*", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("i"))
    order = W.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("i") - 1)).desc(), F.col("k").asc(), F.col("i").asc())
    won = open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("left")).groupBy("shard", "k").agg(F.count("*").alias("won"))
    return g.join(won, ["shard", "k"], "left").select("source", "k", "source_size", "weight", "target", "shard", (F.col("low") + F.coalesce("won", F.lit(0))).alias("blocks"))


def shard_quotas(plan: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(shard, source, blocks): each shard's integer quotas; the blocks of a source over all shards are its quota."""
    before = F.coalesce(F.lag("blocks").over(W.partitionBy("k").orderBy("shard")), F.lit(0))
    return seats_after(plan, shards, block).withColumn("blocks", F.col("blocks") - before).where("blocks > 0").select("shard", "source", "blocks")


def _overlap(start: Column, stop: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(stop, high) - F.greatest(start, low))


def mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target, taken (words) and shards: those that words are taken for, with how many."""
    docs = docs.drop("source_size", "target", "taken", "shards")
    of, hashed, bucket, before, within = (unused(docs, x) for x in ("of", "hashed", "bucket", "before", "within"))
    lines = docs.withColumn(hashed, F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    rows = docs.count()
    digits = 1
    while 16 ** (2 * digits) < rows:  # about as many buckets in a source as rows in a bucket
        digits += 1
    lines = lines.withColumn(bucket, F.substring(hashed, 1, digits))
    parts = settle(lines.groupBy("source", F.col(bucket).alias("b")).agg(F.sum("size").alias("n")), "mix-parts")
    # Words of a source that its first shards take: at most MOST_TIMES its size.
    each = seats_after(targets(parts.groupBy("source").agg(F.sum("n").alias("source_size"))), shards, block)
    end = F.least(F.col("blocks") * block, MOST_TIMES * F.col("source_size"))
    goals = settle(each.groupBy("source", "source_size", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", end.alias("end")))), lambda x: x["end"]).alias("ends")), "mix-plan")
    offset = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select(F.col("source").alias("s"), "b", offset.alias("o"))
    placed = placed.join(goals, placed["s"].eqNullSafe(goals["source"])).select(F.struct("s", "b", "o", "source_size", "target", "ends").alias(of))
    placed = settle(placed, "mix-places")
    order = W.partitionBy("source", bucket).orderBy(hashed, "doc_id", "size")
    lines = lines.withColumn(within, F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    p = F.col(of)
    out = lines.join(placed, lines["source"].eqNullSafe(p["s"]) & (lines[bucket] == p["b"])).withColumn(before, p["o"] + F.col(within))
    # The words of a document stand at its place in every turn round the circle.
    turn = lambda k: (F.col(before) + k * p["source_size"], F.col(before) + k * p["source_size"] + F.col("size"))
    taken = lambda low, high: sum((_overlap(*turn(k), low, high) for k in range(1, MOST_TIMES)), _overlap(*turn(0), low, high))
    zero = F.lit(0).cast("long")
    pieces = F.transform(p["ends"], lambda high, k: F.struct(k.cast("long").alias("shard"), taken(F.when(k > 0, F.get(p["ends"], k - 1)).otherwise(zero), high).alias("words")))
    out = out.withColumn("shards", F.filter(pieces, lambda x: x["words"] > 0))
    out = out.withColumn("taken", F.aggregate("shards", zero, lambda acc, x: acc + x["words"]))
    return out.select(*docs.columns, p["source_size"].alias("source_size"), p["target"].alias("target"), "taken", "shards")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settle(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "sizes")
    parts = F.array_join(F.transform("shards", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), ",")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", parts.alias("shards"))


@guarded()
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts as often as they are taken; the one at a source's cut ends after the words taken of it.

    Rows are told apart by doc_id, those whose doc_id is null or repeated by all their columns; each takes what mix() says.
    """
    marked, odd = told_apart(docs)
    sizes = settle(sized(marked.select(F.col("_row").alias("doc_id"), "source", "text")).drop("text"), "sizes")
    # Rows that are equal share a key: so many of them take so many words.
    taken = mix(sizes).where("taken > 0").groupBy("doc_id", "size", "taken").agg(F.count("*").alias("rows"))
    plan = settle(taken.select(F.struct("doc_id", "size", "taken", "rows").alias("_plan")), "mix-taken")
    rows, p = once(marked) if odd else marked, F.col("_plan")
    joined = rows.join(plan, rows["_row"] == p["doc_id"])
    if odd:
        joined = joined.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), p["rows"])))
    copies = F.sequence(F.lit(0).cast("long"), F.expr("(_plan.taken - 1) div _plan.size"))
    each = joined.withColumn("_c", F.explode(copies)).withColumn("_n", F.least(p["size"], p["taken"] - F.col("_c") * p["size"]))
    cut = each.withColumn("text", F.when(F.col("_n") == p["size"], F.col("text")).otherwise(_first_words(F.col("text"), F.col("_n"))))
    out = cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut
    return out.select(docs.columns)


def _first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, with the white space between them."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    return F.array_join(F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), n.cast("int")).alias("g"), F.slice(words, F.lit(1), n.cast("int")).alias("w")), lambda x: F.concat(x["g"], x["w"])), "")


ORACLE = {
    "op5_mixing": f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, [3, 1, 2][(k % 3 + 1)::INT] AS weight, 2 * source_size AS most FROM s),
    r AS (SELECT *, most / weight AS ratio, coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
          (sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights, {BUDGET}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM w),
    f AS (SELECT ratio AS fr, k AS fk, below AS fb, weights AS fw FROM r WHERE weight * (budget - below) <= most * weights ORDER BY ratio, k LIMIT 1),
    t AS (SELECT source, k, source_size, CASE WHEN fk IS NULL OR (ratio, k) < (fr, fk) THEN most::DOUBLE ELSE weight * (budget - fb) / fw END AS target FROM r LEFT JOIN f ON true),
    q AS (SELECT k, target / (2 * i - 1) AS quotient, i FROM t, LATERAL (SELECT unnest(generate_series(1, (2 * source_size / {BLOCK})::BIGINT + 3)) AS i)),
    seat AS (SELECT k, row_number() OVER (ORDER BY quotient DESC, k, i) AS place FROM q),
    total AS (SELECT floor(sum(target) / {BLOCK} + 0.5)::BIGINT AS seats FROM t),
    shard AS (SELECT shard, seats * (shard + 1) // {SHARDS} AS upto FROM total, LATERAL (SELECT unnest(generate_series(0, {SHARDS - 1})) AS shard)),
    b AS (SELECT k, shard, count(place) AS blocks FROM t CROSS JOIN shard LEFT JOIN seat USING (k) WHERE place <= upto OR place IS NULL GROUP BY k, shard),
    g AS (SELECT source, source_size, target, list(least(coalesce(blocks, 0) * {BLOCK}, 2 * source_size) ORDER BY shard) AS ends FROM t CROSS JOIN shard LEFT JOIN b USING (k, shard) GROUP BY ALL),
    l AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('{SEED}' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS o FROM d),
    p AS (SELECT doc_id, size, source_size, target, list_transform(range(1, {SHARDS + 1}), lambda s: (greatest(0, least(o + size, ends[s]) - greatest(o, coalesce(ends[s - 1], 0))) + greatest(0, least(o + source_size + size, ends[s]) - greatest(o + source_size, coalesce(ends[s - 1], 0))))::BIGINT) AS words
    FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target, list_sum(words)::BIGINT AS taken, array_to_string(list_filter(list_transform(words, lambda w, i: CASE WHEN w > 0 THEN (i - 1)::VARCHAR || ':' || w::VARCHAR END), lambda x: x IS NOT NULL), ',') AS shards FROM p"""
}
