"""MinHash near-duplicates.

Documents are sets of word shingles (64-bit hashes). Equal sets become one node at once. Of each node many universal
hash minima are taken; BANDS bands of ROWS minima each make bucket keys, so two sets of similarity 0.8 share a bucket
but for about 5 in a million; a sketch with two bits of every minimum and the sets' sizes verify pairs before whole sets
are compared.

Pairs of a bucket are not all compared, as pairs inside a component can add nothing to it. First every node is compared
with the bucket centre that it shares most bands with. Then, in rounds, nodes outside their bucket's main component are
compared with the nearest of some members drawn from it, one for each bucket. What is left outside, then, is compared with
all nodes of its buckets in cells of bounded size: by sketches, each pair in the first bucket that it shares; then, those
of a bucket that have anything near, by full sets. The cells hand out nodes and one confirmed link for a node and a
component, not pairs; so no link is lost. Components come from alternating large-star and small-star steps.

Links are confirmed on full sets. A set is made once, when its node is first compared; beyond a sieve of fixed size, the
texts for it come by a join on doc_id. Plans are the same at every size.

Null and empty texts, and texts without words, have no shingles and are linked with nothing. A null doc_id is never
linked and always kept. Rows that repeat give repeated results. A doc_id must tell texts apart: rows of one doc_id that
hold different texts have the class of their own text, or one for all of them (stage() tells such rows apart first). An
empty table gives an empty result. doc_id must be a number; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import by_group, drop, forget, guarded, once, settle, table, told_apart, tuned

BANDS, ROWS = 40, 6
#: Two sets of similarity 0.8 differ in 51 of 512 sketch bits on average, and in more than 92 about once in a million times.
SKETCH, MOST_APART = 256, 92
SKETCH_BITS = 2 * SKETCH
#: Rounds with drawn members, at most, and the nearest of them that a node is compared with in a round.
DRAWS, NEAREST = 2, 3
#: Rows of either side of a comparison cell, about, and shingles of their sets.
CELL, CELL_SHINGLES = 256, 2_000_000
#: Shingles, about, whose minima are taken at a time.
TOGETHER = 30_000
#: Edges that one file of an iteration holds, about.
EDGES_IN_PART = 250_000
#: Bits of the sieve that keeps most texts from a join with the documents to be compared. At most SIEVE / 64 words of 8 bytes, whatever the input.
SIEVE = 1 << 23
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(50_000)
def _word(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle as a whole."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out = _mixed(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


@functools.lru_cache(4)
def _functions(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the universal hash functions (a x + b mod 2^64), high half."""
    r = np.random.default_rng(seed)
    n = max(BANDS * ROWS, SKETCH)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each set (no set empty): sets by functions."""
    a, b = _functions()
    flat = np.concatenate(sets) & np.uint64(0xFFFFFFFF)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(a)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(len(a)):
            out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    with np.errstate(over="ignore"):
        out = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(m), BANDS))
        for k in range(ROWS):
            out = _mixed(out * np.uint64(31) + m[:, k : BANDS * ROWS : ROWS].astype(np.uint64))
    return out.view(np.int64)


def sketches(m: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed in 64-bit words."""
    mixed = m[:, :SKETCH] * np.uint32(2654435761)
    bits = np.concatenate([mixed >> np.uint32(31), mixed >> np.uint32(30) & np.uint32(1)], 1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)[: len(x) + 1]), pa.array(np.ascontiguousarray(x).ravel()))


def fingerprints(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands, sketch); the last three are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), size) for x in b.column(1)]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            new: dict[bytes, int] = {}
            at = [new.setdefault(k, len(new)) if k else 0 for k in ids]
            own = [s for k, s in zip(ids, sets, strict=True) if k and new.pop(k, None) is not None]  # one set of each kind, in order
            held = np.array([k is not None for k in ids], bool)
            if own:
                ends = np.cumsum([len(s) for s in own])
                cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), len(own)]
                m = np.concatenate([minima(own[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if z > a])[at]
            else:
                m = np.zeros((len(sets), len(_functions()[0])), np.uint32)
            mask = pa.array(~held)
            bands, sketch = _lists(band_keys(m)), _lists(sketches(m))
            none = pa.nulls(len(b), bands.type)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pc.if_else(mask, none, bands), pc.if_else(mask, none, sketch)], names=["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>")


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))


def sets_of(ids: DataFrame, docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(id, set) of the documents in ids (id, each once): sorted 64-bit hashes, one after another."""
    bit = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    word = lambda b: F.floor(b / 64).cast("long")
    one = lambda b: F.expr(f"shiftleft(1L, cast({b} % 64 as int))")
    sieve = ids.select(bit.alias("bit")).groupBy(word(F.col("bit")).alias("word")).agg(F.bit_or(one("bit")).alias("bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL").withColumn("bit", bit)
    some = texts.join(F.broadcast(sieve), word(F.col("bit")) == F.col("word")).where(F.col("bits").bitwiseAND(one("bit")) != 0).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py(), size).tobytes() for x in b.column(1)], pa.binary())], names=["id", "set"])

    return some.join(ids, "id", "left_semi").mapInArrow(run, "id long, set binary").where(F.length("set") > 0)


def _met(s: np.ndarray, others: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Of sets that lie one after another (n: their sizes), which meet 100 * intersection >= percent * union with s."""
    place = np.minimum(np.searchsorted(s, others), len(s) - 1)
    both = np.add.reduceat((s[place] == others).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
    return 100 * both >= percent * (len(s) + n - both)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a column one after another, and their sizes."""
    each = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    return np.concatenate(each), np.array([len(x) for x in each])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union.

    The pairs of one a, a bucket's centre or a drawn member, are dealt into cells of about CELL; each has a's set once.
    """
    hot = pairs.groupBy("a").count().where(F.col("count") > CELL).select("a", F.ceil(F.col("count") / CELL).alias("cells"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("cells", F.lit(1))).alias("cell"))
    other = dealt.select("a", "cell", F.lit(1).alias("own"), F.col("b").alias("id"))
    hub = dealt.select("a", "cell").distinct().select("a", "cell", F.lit(0).alias("own"), F.col("a").alias("id"))

    def run(group: pa.Table) -> pa.Table:
        own = group["own"].to_numpy()
        ids, hubs = group["id"].to_numpy()[own == 1], group.filter(pa.array(own == 0))["set"]
        ok = np.zeros(len(ids), bool)
        if len(ids):
            flat, n = _flat(group.filter(pa.array(own == 1))["set"])
            for h in hubs:
                ok |= _met(np.frombuffer(h.as_buffer(), np.uint64), flat, n, percent)
        return pa.table({"a": pa.array(group["a"].to_numpy()[own == 1][ok], pa.int64()), "b": pa.array(ids[ok], pa.int64())})

    return by_group(other.union(hub).join(sets, "id"), ["a", "cell"], run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable over edges (a, b), by alternating large-star and small-star steps."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    count, before = edges.count(), None
    while count:
        parts = 1 + count // EDGES_IN_PART
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", parts)
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        old, edges = edges, settle(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct(), "edges", parts)
        drop(old, large)
        count, *now = edges.agg(F.count("*"), F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._settled = edges._settled
    return out


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) after further links (a, b): only components are joined, not all edges again."""
    at = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(ends)
    moved = found.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    out = settle(moved.select("node", F.coalesce("to", "component").alias("component")).union(new), "found")
    drop(new, found)
    return out


def unsettled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, rep, component, main) of rows (key, rep): buckets that hold several components; main is the least of them."""
    placed = rows.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("main"), F.max("component").alias("other")).where("main <> other").drop("other")
    return placed.join(mixed, "key")


def _cells(rows: DataFrame, size: str) -> DataFrame:
    """rows (key, left, right, rep, ...) dealt into lanes (left ones) and blocks (right ones) of their key: each lane meets each block."""
    deal = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    parts = lambda on: F.ceil(F.greatest(F.sum(F.expr(f"int({on})")) / CELL, F.sum(F.expr(f"if({on}, {size}, 0)")) / CELL_SHINGLES))
    counts = rows.groupBy("key").agg(parts("left").alias("lanes"), parts("right").alias("blocks")).where("lanes > 0 AND blocks > 0")
    each = rows.join(counts, "key")
    outside = each.where("left").select("*", deal(F.col("lanes"), 1).alias("lane"), every(F.col("blocks")).alias("block"), F.lit(True).alias("outside"))
    inside = each.where("right").select("*", every(F.col("lanes")).alias("lane"), deal(F.col("blocks"), 2).alias("block"), F.lit(False).alias("outside"))
    return outside.union(inside).drop("left", "right", "lanes", "blocks")


def nearby(loose: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, rep, component, size, left, right): nodes of unsettled buckets that have a near one of another component there.

    left: nodes outside the bucket's main component; right: what they are near to. A pair counts in the first bucket that
    it shares. Sketches are compared in cells.
    """
    rows = loose.join(nodes.select("rep", "sketch", "size", "bands"), "rep").select("key", "rep", "component", "size", "sketch", "bands", (F.col("component") != F.col("main")).alias("left"), F.lit(True).alias("right"))

    def run(cell: pa.Table) -> pa.Table:
        outside, rep, comp, size, key = (cell[c].to_numpy() for c in ("outside", "rep", "component", "size", "key"))
        sketch = cell["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cell), -1)  # bits of signed numbers are counted without their sign
        bands = cell["bands"].combine_chunks().flatten().to_numpy().reshape(len(cell), -1)
        inside, hit = np.flatnonzero(~outside), np.zeros(len(cell), bool)
        for i in np.flatnonzero(outside):
            close = (100 * np.minimum(size[inside], size[i]) >= percent * np.maximum(size[inside], size[i])) & (comp[inside] != comp[i])
            at = inside[close]
            at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(1) <= MOST_APART]
            if len(at):
                first = bands[at, (bands[at] == bands[i]).argmax(1)] == key[i]
                hit[at[first]] = True
                hit[i] = first.any()
        out = cell.filter(pa.array(hit)).select(["key", "rep", "component", "size", "outside"])
        return out

    found = by_group(_cells(rows, "0"), ["key", "lane", "block"], run, "key long, rep long, component long, size long, outside boolean")
    return found.groupBy("key", "rep", "component", "size").agg(F.bool_or("outside").alias("left"), F.bool_or(~F.col("outside")).alias("right"))


def bucket_links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of nearby(): full sets are compared in cells, one link of a node with a component is handed out."""

    def run(cell: pa.Table) -> pa.Table:
        outside, rep, comp = (cell[c].to_numpy() for c in ("outside", "rep", "component"))
        out: list[tuple[int, int]] = []
        at = np.flatnonzero(~outside)
        if len(at):
            flat, n = _flat(cell.filter(pa.array(~outside))["set"])
            for i in np.flatnonzero(outside):
                hit = at[_met(np.frombuffer(cell["set"][int(i)].as_buffer(), np.uint64), flat, n, percent) & (comp[at] != comp[i])]
                out += [(int(rep[i]), int(rep[j])) for j in hit[np.unique(comp[hit], return_index=True)[1]]]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    cells = _cells(near, "size").join(sets.withColumnRenamed("id", "rep"), "rep")
    return by_group(cells, ["key", "lane", "block"], run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    marks = settle(fingerprints(docs, size, text), "marks")
    some = marks.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    nodes = settle(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    keyed = nodes.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = settle(keyed.join(buckets, "key"), "members")
    sketch = nodes.select("rep", "sketch", "size")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches and sizes are near enough, with their distance."""
        with_a = pairs.join(sketch.withColumnsRenamed({"rep": "a", "sketch": "sa", "size": "na"}), "a")
        both = with_a.join(sketch.withColumnsRenamed({"rep": "b", "sketch": "sb", "size": "nb"}), "b")
        near = (_apart("sa", "sb") <= MOST_APART) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return both.where(near).select("a", "b", _apart("sa", "sb").alias("apart"))

    sets: DataFrame | None = None

    def have(ids: DataFrame) -> DataFrame:
        """Sets of all these ids (id) and those before."""
        nonlocal sets
        ids = ids.distinct()
        more = settle(sets_of(ids if sets is None else ids.join(sets.select("id"), "id", "left_anti"), docs, size, text), "sets")
        sets = more if sets is None else sets.union(more)
        return sets

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id"))
    shared = members.where("rep <> centre").groupBy("rep", "centre").count()
    best = shared.groupBy("rep").agg(F.max(F.struct("count", (-F.col("centre")).alias("c"))).alias("best"))
    tried = settle(verified(best.select((-F.col("best.c")).alias("a"), F.col("rep").alias("b"))).select("a", "b"), "tried")
    links = settle(confirmed(tried, have(ends(tried)), percent), "links")
    found = components(links)
    loose = settle(unsettled(members, found), "unsettled")
    forget(links, members)
    for draw in range(DRAWS):
        drawn = loose.where("component = main").groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key", F.lit(draw))).alias("a"))
        pairs = loose.where("component <> main").join(drawn, "key").select("a", F.col("rep").alias("b")).distinct()
        rank = F.row_number().over(W.partitionBy("b").orderBy("apart", "a"))
        pairs = settle(verified(pairs.join(tried, ["a", "b"], "left_anti")).withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("a", "b"), "pairs")
        more = settle(confirmed(pairs, have(ends(pairs)), percent), "more")
        tried = tried.union(pairs)
        if more.isEmpty():
            break
        found = joined(found, more)
        before, loose = loose, settle(unsettled(loose, found), "unsettled")
        forget(more, before)

    near = settle(nearby(loose, nodes, percent), "near")
    more = settle(bucket_links(near, have(near.select(F.col("rep").alias("id"))), percent), "more")
    if not more.isEmpty():
        found = joined(found, more)
    forget(loose, near, more)

    classes = nodes.select("set_hash", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classes = settle(classes.where("n > 1 OR component IS NOT NULL").select("set_hash", F.coalesce("component", "rep").alias("class")), "classes")
    out = marks.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), size=4)


@guarded()
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays (five words, similarity 0.8), and one of rows that are equal.

    Rows are told apart by doc_id, those whose doc_id is null or repeated by all their columns.
    """
    tuned(spark)
    rows, odd = told_apart(docs)
    if odd:
        rows = settle(once(rows), "rows")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    gone = settle(found.where("NOT kept").select(F.col("doc_id").alias("_row")).distinct(), "gone")
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Compares all pairs that share a shingle; for small tables.
ORACLE = {
    "op3_neardup": f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda k: array_to_string(ws[k:k + 3], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_ AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT i, j FROM both_ JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
    r AS (SELECT i AS node, j AS other FROM e UNION SELECT node, e.j FROM r JOIN e ON other = e.i),
    c AS (SELECT node, least(node, min(other)) AS component FROM r GROUP BY node)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id"""
}
