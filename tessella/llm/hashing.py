"""Approximate nearest neighbours by multi-index hashing.

A bounded sample of the vectors teaches rotations (iterative quantisation: principal axes, then the rotation under which
signs lose least), whose signs are a binary code for every row. Codes are split into substrings of 64 bits and each
substring is indexed. Two codes that differ in r of their bits differ, in some substring, in no more than the pigeonhole
bound; so a query probes, table by table, the values within that bound, and what it meets holds every code within r.
Those within r are ranked anew by the inner product of the original vectors.

The radius is learned on the sample: the distance that holds RECALL of its nearest pairs, at a rank that matches TOP
in all rows. A query that finds fewer than it needs searches again in a wider radius, at last in all. Longer vectors are
no nearer for their length alone: rows get one more component, what their length lacks of the greatest (queries 0).

The index is stored in blocks of BLOCK rows with tables of their own, and a block of queries, bounded in bytes, visits each
block of rows; only winners leave a cell. Whatever the vectors, a cell's memory is bounded, and rows of one hot code or
vector are dealt to blocks (equal vectors travel as one, with as many of their ids as can be wanted).

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Components
beyond a shorter vector's length count as 0. A query row repeated under one id counts once (the least vector); candidates
of the query's own id are left out; one repeated under its id is found as often as it is there. Ties go to the smaller id.
Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

EVERY, TOP, BITS, PIECE = 20, 20, 256, 64
#: Rows, and bytes, that the rotations and the radius are learned from at most.
SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20
#: Rows of the sample that are searched for to learn the radius, and the share of their nearest that it has to hold.
TRIALS, RECALL = 500, 0.975
BLOCK, QUERY_BYTES = 4096, 16 << 20
#: Queries that are probed at once in a cell.
BATCH = 64


class Model(NamedTuple):
    """Components of a vector, the greatest length, the sample's mean, the rotations side by side, the radius."""

    width: int
    longest: float
    mean: np.ndarray
    rotation: np.ndarray
    radius: int


def sound(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(x, lambda c: c != 0)
    v = x if rows.schema[vector].dataType.simpleString() == "array<float>" else x.cast("array<double>")
    return rows.where(F.col(key).isNotNull() & x.isNotNull()).where(fine).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def points(rows: DataFrame, top: int = TOP) -> DataFrame:
    """(v, ids) of rows (id, v): each distinct vector with its top + 1 smallest ids and how often each is there, up to top."""
    each = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(top)).cast("int").alias("n"))
    first = each.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= top + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))


def dense(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    lists = vectors.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    keep = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    fits = keep < width
    out[rows[fits], keep[fits]] = flat[fits]
    return out


def _longer(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors of length 1: queries scaled, rows over the greatest length and with what they lack."""
    if query:
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([x / np.where(norms > 0, norms, 1), np.zeros((len(x), 1))])
    y = x / longest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))])


def _rotations(x: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(0)
    value, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    use = [k for k in np.argsort(-value)[:bits] if value[k] > 1e-4 * max(value.max(), 1e-300)] or [int(np.argmax(value))]
    axes = axes[:, use]
    z, out = (x - mean) @ axes, []
    for seed in range(-(-bits // len(use))):
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(use), len(use))))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(z.T @ np.where(z @ turn > 0, 1.0, -1.0))
            turn = left @ right
        out.append(axes @ turn)
    return mean, np.hstack(out)[:, :bits]


def codes(model: Model, x: np.ndarray, query: bool) -> np.ndarray:
    """(rows, BITS / 64) of longs."""
    signs = (_longer(x, model.longest, query) - model.mean) @ model.rotation > 0
    return np.packbits(signs, axis=1, bitorder="little").view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, by row."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(-1, dtype=np.int64)  # of signed numbers it would count the absolute value's bits


def learn(vectors: DataFrame, top: int = TOP, bits: int = BITS, sample: int = SAMPLE) -> Model | None:
    """The model of vectors (v), distinct ones; None for an empty table."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return None
    size = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
    scale = 1 << 30
    share = scale if n <= size else int(scale * size * 0.9 / n)
    drawn = vectors.where(F.pmod(F.xxhash64("v", F.lit(7)), F.lit(scale)) < share).select(F.xxhash64("v").alias("h"), F.col("v").cast("array<double>").alias("v")).limit(size).toArrow().sort_by("h")
    x = dense(drawn["v"], width)
    mean, rotation = _rotations(_longer(x, longest, False), bits) if len(x) else (np.zeros(width + 1), np.random.default_rng(0).standard_normal((width + 1, bits)))
    model = Model(width, longest, mean, rotation, bits)
    rank = max(1, min(len(x) - 1, round(top * len(x) / n)))
    if len(x) < 2:
        return model
    own, tried = codes(model, x, False), codes(model, x[:TRIALS], True)
    far = []
    for k, code in enumerate(tried):
        score = x @ x[k]
        score[k] = -np.inf
        far.append(distance(own[np.argpartition(-score, rank - 1)[:rank]], code))
    return model._replace(radius=int(np.quantile(np.concatenate(far), RECALL, method="higher")))


def encoded(rows: DataFrame, model: Model, query: bool) -> DataFrame:
    """rows with code, an array of longs."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            c = codes(model, dense(t["v"], model.width), query)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(c.ravel(), pa.int64()))
            yield from t.append_column("code", lists).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, code array<bigint>")


def pieces(code: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(code).view(np.uint64)


def bounds(radius: int, tables: int) -> list[int]:
    """How far a substring may be, by table, so that no code within the radius is missed: -1 for not at all."""
    least, rest = divmod(radius, tables)
    return [least if t <= rest else least - 1 for t in range(tables)]


def probe(index: list[tuple], wanted: np.ndarray, limit: list[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row), each once, that agree to within the bound in some substring."""
    met = np.zeros((len(wanted), rows), bool)
    for (values, starts, order), own, most in zip(index, wanted.T, limit, strict=True):
        if most >= 0:
            q, u = np.nonzero(np.bitwise_count(values[None, :] ^ own[:, None]) <= most)
            n = starts[u + 1] - starts[u]
            ends = np.cumsum(n)
            at = np.repeat(starts[u] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            met[np.repeat(q, n), order[at]] = True
    return np.nonzero(met)


def tables_of(code: np.ndarray) -> list[tuple]:
    """By substring: the values that occur, where each one's rows begin, rows in order of value."""
    out = []
    for column in pieces(code).T:
        order = np.argsort(column, kind="stable")
        values, starts = np.unique(column[order], return_index=True)
        out.append((values, np.append(starts, len(order)), order))
    return out


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("n", pa.int32())])


def search_block(cell: pa.Table, width: int, radius: int, top: int) -> pa.Table:
    """The best `top` rows that each query of a cell (is_query, id, v, code, ids) finds within the radius."""
    mask = cell["is_query"].to_numpy()
    queries, rest = cell.filter(pa.array(mask)), cell.filter(pa.array(~mask))
    if not (len(queries) and len(rest)):
        return FOUND.empty_table()
    code = lambda t: np.array(t["code"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(t), -1)
    theirs, ours, x, y = code(rest), code(queries), dense(rest["v"], width), dense(queries["v"], width)
    ids = rest["ids"].to_pylist()
    least = np.array([i[0]["id"] for i in ids])
    index, limit = tables_of(theirs), bounds(radius, theirs.shape[1] * 64 // PIECE)
    out: list[tuple] = []
    for k in range(0, len(queries), BATCH):
        q, p = probe(index, pieces(ours[k : k + BATCH]), limit, len(rest))
        near = distance(theirs[p], ours[k + q]) <= radius
        q, p = q[near], p[near]
        score = np.einsum("ij,ij->i", x[p], y[k + q])
        cuts = np.searchsorted(q, np.arange(min(BATCH, len(queries) - k) + 1))
        for own, a, z in zip(queries["id"][k : k + BATCH].to_pylist(), cuts[:-1], cuts[1:], strict=True):
            rows, s = p[a:z], score[a:z]
            if len(s) > top + 1:
                keep = np.flatnonzero(s >= -np.partition(-s, top)[top])
                rows, s = rows[keep], s[keep]
            best = np.lexsort((least[rows], -s))[: top + 1]
            wins = sorted((-v, e["id"], e["n"]) for v, r in zip(s[best].tolist(), rows[best].tolist(), strict=True) for e in ids[r] if e["id"] != own)[:top]
            out += [(own, i, -v, n) for v, i, n in wins]
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


class Index(NamedTuple):
    """The stored rows (v, ids, code), and what is needed to search them."""

    model: Model
    rows: DataFrame
    count: int


def build(rows: DataFrame, top: int = TOP, bits: int = BITS) -> Index | None:
    """The index over rows (id, v); None for an empty table."""
    distinct = settle(points(rows, top), "points")
    model = learn(distinct.select("v"), top, bits)
    return model and Index(model, settle(encoded(distinct, model, False), "codes"), distinct.count())


def within(index: Index, queries: DataFrame, radius: int, top: int) -> DataFrame:
    """(query_id, vec_id, score, n): the best of every block of rows for queries (id, v, code)."""
    m = queries.count()
    blocks, lanes = max(1, -(-index.count // BLOCK)), max(1, -(-m * 8 * index.model.width // QUERY_BYTES))
    part = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    none = F.lit(None).cast(index.rows.schema["ids"].dataType)
    left = queries.select(F.lit(True).alias("is_query"), "id", "v", "code", none.alias("ids"), part(lanes, "id").alias("lane"), every(blocks).alias("block"))
    right = index.rows.select(F.lit(False).alias("is_query"), F.lit(None).cast("long").alias("id"), "v", "code", "ids", every(lanes).alias("lane"), part(blocks, "v").alias("block"))
    width = index.model.width
    return left.unionByName(right).groupBy("lane", "block").applyInArrow(lambda cell: search_block(cell, width, radius, top), "query_id long, vec_id long, score double, n int")


def search(index: Index, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of the index that each query (id, v) finds."""
    queries = settle(encoded(queries.groupBy("id").agg(F.min("v").alias("v")), index.model, True), "queries")
    bits = index.model.rotation.shape[1]
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    radius, whole = index.model.radius, None
    while True:
        best = within(index, queries, radius, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        each = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "n")))
        found = settle(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), "found")
        if radius >= bits:
            return found if whole is None else whole.union(found)
        enough = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"))
        done = found.join(enough, found["query_id"] == enough["id"], "left_semi")
        whole = done if whole is None else whole.union(done)
        queries = settle(queries.join(enough, "id", "left_anti"), "short")
        if queries.isEmpty():
            return whole
        radius = min(bits, radius + bits // 8)


EMPTY = "query_id long, rank int, vec_id long, score double"


def op12_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sound(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    index = build(rows)
    return search(index, rows.where(F.col("id") % EVERY == 0)) if index else spark.createDataFrame([], EMPTY)
