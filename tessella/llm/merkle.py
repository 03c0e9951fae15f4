"""Merkle manifest of a dataset: built bottom-up, proofs pushed top-down.

Every row is a leaf, the digest of its fields. Within a group leaves are ordered; every two consecutive nodes become the
digest of both (a lone last one the digest of itself alone) until one is left, the group's subroot. The subroots, ordered
by group, become one root in the same way. A row's proof lists what stands beside it at each level, from the leaf to the
root; with it the root can be recomputed from the row alone.

Four levels at a time are made and persisted as one table: a block gathers the 16 nodes below it at most, whatever the
group's size, and holds their levels. Downwards a table of blocks is joined with its parents' proofs; each child of a
block prepends its own siblings to the proof that the block inherits. So all joins are between blocks, a sixteenth of the
rows, and a third of all rows in one group are blocks like others.

A null field is `-`; a null group is one of its own, before all others. Rows that agree in group and order keys are ordered
by digest; rows equal in all fields have equal leaves, each its own place. An empty table gives no rows. Other columns
aren't read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import drop, settle, table

#: Levels that a block holds, and so the nodes below it.
LEVELS = 4
WIDTH = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every row whose id has a crc32 that this number divides is tampered with in the query.
TAMPER = 7


def leaf(*fields: Column) -> Column:
    """The digest of fields: `-` for a null, else byte count, `:` and value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root recomputed from a leaf's digest and its proof, an array of (side, digest): side 1 if the sibling stands on the left."""
    other = lambda s, side: F.when(s["side"] == side, F.coalesce(s["digest"], F.lit(""))).otherwise("")
    return F.aggregate(proof, start, lambda node, s: F.sha2(F.concat(other(s, 1), node, other(s, 0)), 256))


def placed(leaves: DataFrame, *order: str) -> tuple[DataFrame, list[DataFrame]]:
    """leaves with idx, a number from 0 within k by the order, and total, the rows of k; and the tables that this reads.

    Rows are sorted in ranges over all groups; counts by group and range, a row for each partition and group, give the offsets.
    """
    rows = settle(leaves.repartitionByRange("k", *order).sortWithinPartitions("k", *order).withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33).alias("part")
    counts = rows.groupBy("k", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = settle(counts.select("k", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("k")).alias("total")), "starts", 1)
    out = rows.withColumn("part", part).join(starts, ["k", "part"]).withColumn("idx", F.col("at") + F.col("shift"))
    return out.drop("part", "at", "shift"), [rows, starts]


def _up(nodes: Column, final: Column) -> Column:
    """The level above: two consecutive digests become one. The last level of a tree, a single node, stays."""
    pair = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.when(final & (F.size(nodes) == 1), nodes).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(k, block, total, final, ups, levels, digest, rows) of nodes (k, idx, total, digest, row)."""
    block = F.shiftright("idx", LEVELS).alias("block")
    held = nodes.groupBy("k", "total", block).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "row"))).alias("nodes"))  # WIDTH at most
    final = F.col("total") <= WIDTH
    out = held.select("k", "total", "block", final.alias("final"), F.transform("nodes", lambda n: n["row"]).alias("rows"), F.transform("nodes", lambda n: n["digest"]).alias("l0"))
    for t in range(LEVELS):
        out = out.withColumn(f"l{t + 1}", _up(F.col(f"l{t}"), F.col("final")))
    ups = sum((F.col("total") > (1 << t)).cast("int") for t in range(LEVELS))
    return out.select("k", "block", "total", "final", ups.alias("ups"), F.array(*(f"l{t}" for t in range(LEVELS))).alias("levels"), F.get(f"l{LEVELS}", F.lit(0)).alias("digest"), "rows")


def build(nodes: DataFrame) -> list[DataFrame]:
    """The persisted tables of blocks, from the leaves' blocks upwards, of nodes (k, idx, total, digest, row)."""
    out, most = [], None
    while most is None or most > 1:
        out.append(settle(_blocks(nodes), f"level-{len(out) * LEVELS}"))
        if most is None:
            most = out[0].agg(F.max("total")).first()[0] or 1
        nodes = out[-1].where("NOT final").select("k", F.col("block").alias("idx"), F.ceil(F.col("total") / WIDTH).cast("long").alias("total"), "digest", F.lit(None).cast(out[0].schema["rows"].dataType.elementType).alias("row"))
        most = -(-most // WIDTH)
    return out


def subroots(levels: list[DataFrame]) -> DataFrame:
    """(k, digest) of each group."""
    tops = [level.where("final").select("k", "digest") for level in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


def push(levels: list[DataFrame], outer: DataFrame) -> DataFrame:
    """(k, row, digest, proof, *) of every leaf; outer (k, proof, *) has what the proofs of a group end with."""
    more = [c for c in outer.columns if c not in ("k", "proof")]
    below = None
    for h in range(len(levels) - 1, -1, -1):
        blocks = levels[h]
        top = blocks.where("final").join(outer, "k")
        whole = top if below is None else top.unionByName(blocks.where("NOT final").join(below, ["k", "block"]))
        node = F.posexplode(F.arrays_zip(F.col("levels")[0].alias("digest"), F.col("rows").alias("row"))).alias("pos", "node")
        each = whole.select("k", "block", "levels", "ups", "proof", *more, node)
        place = lambda s: F.call_function("shiftright", F.col("pos"), s)
        beside = lambda nodes, s: F.struct(place(s).bitwiseAND(F.lit(1)).alias("side"), F.get(nodes, place(s).bitwiseXOR(F.lit(1))).alias("digest"))
        own = F.transform(F.slice("levels", F.lit(1), F.col("ups")), beside)
        each = each.select("k", (F.col("block") * WIDTH + F.col("pos")).alias("block"), F.concat(own, "proof").alias("proof"), *more, "node")
        if not h:
            return each.select("k", F.col("node.row").alias("row"), F.col("node.digest").alias("digest"), "proof", *more)
        below = settle(each.drop("node"), f"proofs-{h * LEVELS}")


def proofs(leaves: DataFrame, *order: str) -> DataFrame:
    """(k, row, digest, proof, subroot, root) of leaves (k, digest, row, order columns): each leaf with the whole proof up to the root."""
    rows, held = placed(leaves, *order)
    levels = build(rows.select("k", "idx", "total", "digest", "row"))
    drop(*held)
    tops = subroots(levels).select(F.lit("").alias("k"), F.col("k").alias("row"), "digest")
    ranked, held = placed(tops, "row")
    above = build(ranked.select("k", "idx", "total", "digest", "row"))
    drop(*held)
    root = subroots(above).select("k", F.array().cast("array<struct<side:int,digest:string>>").alias("proof"), F.col("digest").alias("root"))
    outer = settle(push(above, root).select(F.col("row").alias("k"), "proof", F.col("digest").alias("subroot"), "root"), "groups")
    return push(levels, outer)


def manifest(rows: DataFrame, fields: tuple[str, ...], group: str, order: str, row: Column) -> DataFrame:
    """(row, digest, proof, subroot, root) of rows: leaves over fields, trees by group, leaves ascending by order."""
    k = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
    leaves = rows.select(k.alias("k"), F.col(order).alias("by"), leaf(*(F.col(f) for f in fields)).alias("digest"), row.alias("row"))
    return proofs(leaves, "by", "digest").drop("k")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    changed = [F.when(odd, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in FIELDS]
    out = manifest(docs, FIELDS, "lang", "doc_id", F.struct("doc_id", leaf(*changed).alias("changed")))
    folded = out.select(F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat_ws("", F.transform("proof", lambda s: s["digest"])), 256).alias("proof_sha256"), fold(F.col("row.changed"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of ASCII text in SQL: the table of 256 remainders by its rule, then byte by byte.
CRC = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n))"

ORACLE = {
    "op13_merkle": f"""
    WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC} AS t),
    d AS (SELECT *, coalesce(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 0) AS c FROM documents, crc),
    e AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
            || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS a, n_chars, n_chars + CASE WHEN doc_id IS NOT NULL AND xor(c, 4294967295::BIGINT) % {TAMPER} = 0 THEN 1 ELSE 0 END AS changed,
            coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS z FROM d),
    f AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || z) AS leaf,
            sha256(a || coalesce(strlen(changed::VARCHAR)::VARCHAR || ':' || changed::VARCHAR, '-') || z) AS start FROM e),
    p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f),
    tree AS (SELECT lang, 0 AS lv, list(leaf ORDER BY pos) AS l FROM p GROUP BY lang
      UNION ALL SELECT lang, lv + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM tree WHERE len(l) > 1),
    g AS MATERIALIZED (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS nth FROM tree WHERE len(l) = 1),
    crown AS (SELECT 0 AS lv, list(subroot ORDER BY nth) AS l FROM g
      UNION ALL SELECT lv + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM crown WHERE len(l) > 1),
    s AS (SELECT p.lang, p.pos, t.lv, (p.pos >> t.lv) & 1 AS side, t.l[xor(p.pos >> t.lv, 1) + 1] AS h FROM p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang AND len(t.l) > 1
      UNION ALL SELECT p.lang, p.pos, 1000 + t.lv, (g.nth >> t.lv) & 1, t.l[xor(g.nth >> t.lv, 1) + 1] FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang JOIN crown t ON len(t.l) > 1),
    q AS (SELECT lang, pos, string_agg(h, '' ORDER BY lv) AS proof, list((CASE WHEN h IS NULL THEN '-' WHEN side = 1 THEN 'L' ELSE 'R' END) || coalesce(h, '') ORDER BY lv) AS path FROM s GROUP BY ALL),
    o AS (SELECT p.doc_id, p.leaf, g.subroot, (SELECT l[1] FROM crown WHERE len(l) = 1) AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
            list_reduce(coalesce(q.path, []), lambda n, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || n WHEN 'R' THEN n || x[2:] ELSE n END), p.start) AS folded_root
          FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang LEFT JOIN q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.pos)
    SELECT *, folded_root = root AS verified FROM o"""
}
