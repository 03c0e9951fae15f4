"""Exact top-k search by term-at-a-time accumulation.

Vectors are sparse integer rows: component d of value w is the posting (d, w). For a block of queries and a block of
candidates, the candidates' postings are laid out by dimension; each query scatters its weights, one dimension at a
time, into a dense score array over the block, and a partition selection keeps its best. The blocks' winners are merged.
Blocks have fixed numbers of candidates and fixed bytes of queries, so no task's memory grows with the input; every query
block meets every candidate block. Equal rows (of one id and vector) travel as one, with their number.

Vectors that are null or hold null or non-finite components take no part. Components beyond a shorter vector's length
count as 0. Ties go to the smaller id. A query row repeated under one id counts once (the least vector); candidates of
the query's own id are left out; one that is repeated under its id is found as often as it is there. Rows without an id
take no part. Empty tables give no rows; other columns of the tables aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

SCALE, EVERY, TOP = 1024, 100, 10
CANDIDATE_BLOCK = 4096
#: Vectors of queries in a block: they are only read, and each block more is one more copy of all candidates.
QUERY_BYTES = 16 << 20


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): components floor(scale * x), of the rows that take part."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    out = rows.where(F.col(key).isNotNull() & x.isNotNull()).where(sound)
    return out.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _postings(vectors: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By dimension: rows that have it, and their weights."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    flat = flat[offsets[0] : offsets[-1]] if len(offsets) else flat
    dim = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)
    keep = flat != 0
    row, flat, dim = row[keep], flat[keep], dim[keep]
    order = np.argsort(dim, kind="stable")
    row, flat, cuts = row[order], flat[order], np.cumsum(np.bincount(dim)) if len(dim) else np.empty(0, int)
    return [(row[a:b], flat[a:b]) for a, b in zip(np.concatenate([[0], cuts[:-1]]).astype(int), cuts, strict=True)] if len(cuts) else []


def search_block(cell: pa.Table, top: int) -> pa.Table:
    """The best `top` candidates of each query in a cell (is_query, id, v, n), n being the number of equal rows."""
    mask = cell["is_query"].to_numpy()
    queries, rest = cell.filter(pa.array(mask)), cell.filter(pa.array(~mask)).sort_by("id")
    ids, copies, postings = rest["id"].to_numpy(), rest["n"].to_numpy(), _postings(rest["v"])
    whole = [len(r) == len(ids) for r, _ in postings]
    out_q, out_v, out_s, out_n = [], [], [], []
    for q, vector in zip(queries["id"].to_pylist(), queries["v"], strict=True):
        if not len(ids):
            break
        scores = np.zeros(len(ids), np.int64)
        for d, w in enumerate(vector.values.to_numpy(zero_copy_only=False)[: len(postings)]):
            if w:
                r, x = postings[d]
                if whole[d]:
                    scores += w * x
                else:
                    scores[r] += w * x  # a row has a dimension once
        other = np.flatnonzero(ids != q)
        if len(other) > top:
            least = np.partition(scores[other], len(other) - top)[len(other) - top]
            sure = other[scores[other] > least]
            other = np.concatenate([sure, other[scores[other] == least][: top - len(sure)]])
        out_q += [q] * len(other)
        out_v.append(ids[other])
        out_s.append(scores[other])
        out_n.append(copies[other])
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(join(out_v), pa.int64()), "score": pa.array(join(out_s), pa.int64()), "n": pa.array(join(out_n), pa.int64())})


def top_k(queries: DataFrame, rows: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (id, v) against rows (id, v)."""
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n, (m, width) = rows.count(), queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks, lanes = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m * 8 * max(width, 1) // QUERY_BYTES))
    part = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = queries.select(F.lit(True).alias("is_query"), "id", "v", F.lit(1).cast("long").alias("n"), part(lanes, "id", F.lit(1)).alias("lane"), every(blocks).alias("block"))
    apart = rows.groupBy("id", "v").agg(F.count("*").alias("n"))
    right = apart.select(F.lit(False).alias("is_query"), "id", "v", "n", every(lanes).alias("lane"), part(blocks, "id", "v").alias("block"))
    cells = left.unionByName(right).groupBy("lane", "block")
    found = cells.applyInArrow(lambda cell: search_block(cell, top), "query_id long, vec_id long, score long, n long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    whole = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(top).cast("long")))))
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return top_k(rows.where(F.col("id") % EVERY == 0), rows)


ORACLE = {
    "op10_topk": f"""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {TOP}"""
}
