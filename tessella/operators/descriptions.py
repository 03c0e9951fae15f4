"""Operators over descriptions (key, adjectives, tags, plain_text) and their tag vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vector as V
from tessella.operators.graph import cut
from tessella.operators.similarity import matches_at_least

#: Generic families whose generated queries are left out.
GENERIC = ("noto", "unifont", "quivira", "symbola", "dejavu", "gnu unifont")
#: Words that turn the next content word around.
NEGATIONS = ("not", "no", "non", "without", "less", "least", "never", "anti", "un")
#: Words without content of their own, for the token lookup.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "very", "was", "with")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key the last one, whole."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def override_union(sources: list[DataFrame], key: str = "key") -> DataFrame:
    """All descriptions; one of a later source replaces the whole record of an earlier one."""
    rows = None
    for k, s in enumerate(sources):
        s = s.withColumn("_order", F.lit(k))
        rows = s if rows is None else rows.unionByName(s)
    return last_wins(rows, [key], "_order").drop("_order")


def longest_prefix(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(name, key): the longest key that the name begins with, or null. An equi-join on all prefixes, no nested loop."""
    prefixes = names.select("name").distinct().select("name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda n: F.left(F.col("name"), n))).alias("key"))
    found = prefixes.join(keys.select("key").distinct(), "key").groupBy("name").agg(F.max_by("key", F.length("key")).alias("key"))
    return names.join(found, "name", "left")


def merge_tags(descriptions: DataFrame, family_tags: DataFrame) -> DataFrame:
    """descriptions (key, ..., tags) with the tags of families (family, tag, weight, seq) in place where there are any.

    Families without a description are skipped; of a tag that repeats, the last weight counts.
    """
    last = last_wins(family_tags.select("family", "tag", "weight", "seq"), ["family", "tag"], "seq")
    maps = last.groupBy("family").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "weight")))).alias("_tags"))
    joined = descriptions.join(maps, descriptions["key"] == maps["family"], "left")
    return joined.withColumn("tags", F.coalesce("_tags", "tags")).drop("_tags", "family")


def tag_list() -> Column:
    """Adjectives, then tag names; a name may occur twice."""
    return F.concat("adjectives", F.map_keys("tags"))


def vocabulary(descriptions: DataFrame, min_count: int = 10) -> DataFrame:
    """(tag_idx, tag, n): tags that occur often enough, numbered in order."""
    counts = descriptions.select(F.explode(tag_list()).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return counts.withColumn("tag_idx", F.row_number().over(W.orderBy("tag")) - 1)


def positive_weights(descriptions: DataFrame, vocab: DataFrame) -> DataFrame:
    """(tag, w): min(50, (N - c) / max(c, 1)), c being the descriptions that have the tag."""
    n = descriptions.agg(F.count("*").alias("all"))
    counts = descriptions.select(F.explode(F.array_distinct(tag_list())).alias("tag")).groupBy("tag").agg(F.count("*").alias("c"))
    joined = vocab.select("tag").join(counts, "tag", "left").crossJoin(F.broadcast(n))  # one row
    c = F.coalesce("c", F.lit(0))
    return joined.select("tag", F.least(F.lit(50.0), (F.col("all") - c) / F.greatest(c, F.lit(1))).alias("w"))


#: Names from which on a tag is hot: it makes no pairs of names by a join.
HOT = 1000


def _hot_cell(cell: pa.Table, n: int) -> pa.Table:
    """Each own key's n best of a cell's other keys, by postings of their tags."""
    own = cell["own"].to_numpy()
    left, right = cell.filter(pa.array(own)), cell.filter(pa.array(~own)).sort_by("key")
    out: list[tuple] = []
    if len(left) and len(right):
        names, totals = np.array(right["key"].to_pylist(), object), right["total"].to_numpy()
        lists = right["t"].combine_chunks()
        row = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy(zero_copy_only=False))
        terms, weights = lists.flatten().to_numpy(), right["w"].combine_chunks().flatten().to_numpy()
        order = np.argsort(terms, kind="stable")
        terms, weights, row = terms[order], weights[order], row[order]
        for key, total, t, w in zip(left["key"].to_pylist(), left["total"].to_pylist(), left["t"], left["w"], strict=True):
            mine, by = t.values.to_numpy(), w.values.to_numpy()
            start = np.searchsorted(terms, mine, "left")
            size = np.searchsorted(terms, mine, "right") - start
            ends = np.cumsum(size)
            at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            least = np.bincount(row[at], np.minimum(weights[at], np.repeat(by, size)), len(names))
            whole = total + totals - least
            sim = np.round(np.divide(least, whole, out=np.zeros(len(names)), where=whole != 0), 9)
            best = np.lexsort((np.arange(len(names)), -sim))[: n + 1]
            out += [(key, names[k], float(sim[k])) for k in best if names[k] != key]
    return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate((("key", pa.string()), ("other", pa.string()), ("sim", pa.float64())))})


def _hot_pairs(tags: DataFrame, totals: DataFrame, wanted: DataFrame, n: int, block: int = 2048) -> DataFrame:
    """(key, other, sim): the n best of every block for the wanted keys, against all keys that have tags. No row for each pair is made."""
    rows = tags.groupBy("key").agg(F.collect_list(F.struct(F.xxhash64("tag").alias("t"), "w")).alias("f")).join(totals, "key").select("key", "total", F.col("f.t").alias("t"), F.col("f.w").alias("w"))
    mine = rows.join(wanted.select("key"), "key", "left_semi")
    lanes, blocks = (max(1, -(-df.count() // block)) for df in (wanted, totals))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    deal = lambda k: F.pmod(F.xxhash64("key"), F.lit(k))
    left = mine.select(F.lit(True).alias("own"), "*", deal(lanes).alias("lane"), every(blocks).alias("block"))
    right = rows.select(F.lit(False).alias("own"), "*", every(lanes).alias("lane"), deal(blocks).alias("block"))
    return left.unionByName(right).groupBy("lane", "block").applyInArrow(lambda cell: _hot_cell(cell, n), "key string, other string, sim double")


def rare_pairs(tags: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(key, other, least) over the tags that `hot` names at most have, by a join of at most `hot` rows for each row; and the hot tags' rows."""
    counted = tags.join(tags.groupBy("tag").agg(F.count("*").alias("df")), "tag")
    rare = counted.where(F.col("df") <= hot).select("key", "tag", "w")
    other = rare.select(F.col("key").alias("other"), "tag", F.col("w").alias("w2"))
    return rare.join(other, "tag").where("key <> other").groupBy("key", "other").agg(F.sum(F.least("w", "w2")).alias("least")), counted.where(F.col("df") > hot).select("key", "tag", "w")


def similar(descriptions: DataFrame, n: int = 4) -> DataFrame:
    """(key, other, sim, rank): the n descriptions of highest weighted Jaccard similarity, other than the own key. Weights are at least 0.

    Pairs come from rare tags that both have; the hot ones are added to them from maps. A pair of hot tags alone is at most
    the hot share of a key's weight: a key whose n-th best lies over that is done. The others are compared with all keys
    in blocks, of which only the n best come out. Pairs without a shared tag are 0 and follow, by key, where there are too
    few others: a key of n - 1 better ones finds what it lacks among the first 2 n keys.
    """
    keys = descriptions.where("key IS NOT NULL").select("key").distinct()
    tags = descriptions.where("key IS NOT NULL").select("key", F.explode("tags").alias("tag", "w")).where("w > 0").groupBy("key", "tag").agg(F.sum("w").alias("w"))
    totals = tags.groupBy("key").agg(F.sum("w").alias("total"))
    least, hot = rare_pairs(tags, HOT)
    both = least.join(totals, "key").join(totals.select(F.col("key").alias("other"), F.col("total").alias("total2")), "other")
    order = W.partitionBy("key").orderBy(F.desc(F.round("sim", 9)), "other")
    if hot.isEmpty():
        found = both.select("key", "other", (F.col("least") / (F.col("total") + F.col("total2") - F.col("least"))).alias("sim"))
    else:
        maps = hot.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "w"))).alias("hot"), F.sum("w").alias("heat"))
        both = both.join(maps.select("key", "hot"), "key", "left").join(maps.select(F.col("key").alias("other"), F.col("hot").alias("hot2")), "other", "left")
        common = F.aggregate(F.map_entries("hot"), F.lit(0.0), lambda a, e: a + F.coalesce(F.least(e["value"], F.when(F.map_contains_key(F.col("hot2"), e["key"]), F.col("hot2")[e["key"]]).otherwise(0.0)), F.lit(0.0)))
        both = both.withColumn("least", F.col("least") + F.coalesce(common, F.lit(0.0)))
        joined = cut(both.select("key", "other", (F.col("least") / (F.col("total") + F.col("total2") - F.col("least"))).alias("sim")))
        nth = joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == n).select("key", F.col("sim").alias("nth"))
        reach = F.col("heat") / F.col("total") + 1e-9
        left = cut(totals.join(maps.select("key", "heat"), "key").join(nth, "key", "left").where(F.coalesce("nth", F.lit(0.0)) <= reach).select("key"))
        found = joined.join(left, "key", "left_anti").unionByName(_hot_pairs(tags, totals, left, n))
    first = keys.orderBy("key").limit(2 * n).select(F.col("key").alias("other"))
    rest = keys.crossJoin(F.broadcast(first)).where("key <> other").withColumn("sim", F.lit(None).cast("double"))  # 2 n rows
    every = found.select("key", "other", "sim").union(rest).groupBy("key", "other").agg(F.coalesce(F.max("sim"), F.lit(0.0)).alias("sim"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tokens(texts: DataFrame) -> DataFrame:
    """(id, pos, text, lemma, is_stop, is_punct, is_cue) of texts (id, text): words and single punctuation marks in lower case.

    The lemma takes a plural s off words of four letters and more; negation cues aren't stop words.
    """
    each = texts.select("id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+|[^a-z0-9\s]"), F.lit(0))).alias("pos", "text"))
    lemma = F.when(F.col("text").rlike("^[a-z]{3,}[^s]s$"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return each.select("id", "pos", "text", lemma.alias("lemma"), F.col("text").isin(*STOP_WORDS).alias("is_stop"), (~F.col("text").rlike("^[a-z0-9]+$")).alias("is_punct"), F.col("text").isin(*NEGATIONS).alias("is_cue"))


def signed_terms(toks: DataFrame) -> DataFrame:
    """(id, pos, text, lemma, negative): content tokens and whether a cue turns them around.

    The last of cue, punctuation and content before a token decides: a cue makes it negative; stop words change nothing.
    """
    event = F.when(F.col("is_cue"), 1).when(F.col("is_punct") | ~F.col("is_stop"), 0)
    before = F.last(event, ignorenulls=True).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    content = toks.withColumn("negative", F.coalesce(before == 1, F.lit(False)))
    return content.where("NOT is_cue AND NOT is_punct AND NOT is_stop").select("id", "pos", "text", "lemma", "negative")


def query_weights(terms: DataFrame, vocab: DataFrame, threshold: float = 0.5, scale: float = 1.0, term_vectors: DataFrame | None = None) -> DataFrame:
    """(id, tag_idx, tag, weight): exact lemma 1, word inside a tag 0.5, and only without either the nearest tags by cosine.

    vocab (tag_idx, tag[, v]); term_vectors (lemma, v) serve the last. A tag's weight is its largest positive match less
    its largest negative one.
    """
    words = terms.select("text", "lemma").distinct()
    exact = words.join(vocab, words["lemma"] == vocab["tag"]).select("text", "lemma", "tag_idx", "tag", F.lit(1.0).alias("m"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("tag")), lambda a: F.transform(F.sequence(F.lit(1), F.length("tag") - a + 1), lambda n: F.substring(F.col("tag"), a, n))))
    pieces = vocab.where("tag <> ''").select("tag_idx", "tag", F.explode(F.array_distinct(spans)).alias("word"))  # a tag is short: an equi-join on what it contains
    sides = words.select("text", "lemma", F.explode(F.array_distinct(F.array("text", "lemma"))).alias("word"))
    part = sides.join(pieces, "word").where("lemma <> tag").select("text", "lemma", "tag_idx", "tag", F.lit(0.5).alias("m")).distinct()
    found = exact.union(part)
    if term_vectors is not None:
        rest = words.join(found, ["text", "lemma"], "left_anti").join(term_vectors.withColumnRenamed("v", "_v"), "lemma")
        unit = lambda df, key, v: df.select(F.col(key).alias("id"), V.normalized(v).alias("v")).dropDuplicates(["id"])
        near = matches_at_least(unit(rest, "lemma", "_v"), unit(vocab.where("v IS NOT NULL"), "tag", "v"), threshold)
        close = rest.select("text", "lemma").join(near.withColumnsRenamed({"left": "lemma", "right": "tag"}), "lemma").join(vocab.select("tag_idx", "tag"), "tag")
        found = found.union(close.select("text", "lemma", "tag_idx", "tag", F.col("sim") * scale))
    hits = terms.join(found, ["text", "lemma"])
    side = lambda neg: F.coalesce(F.max(F.when(F.col("negative") == neg, F.col("m"))), F.lit(0.0))
    return hits.groupBy("id", "tag_idx", "tag").agg((side(False) - side(True)).alias("weight"))


def tag_search(font_tags: DataFrame, weights: DataFrame, k: int = 100) -> DataFrame:
    """(font, score) of font_tags (font, tag, p): every font has a score; without a weighted tag it is 0."""
    fonts = font_tags.select("font").distinct()
    scores = font_tags.join(weights.select("tag", "weight"), "tag").groupBy("font").agg(F.sum(F.col("p") * F.col("weight")).alias("score"))
    return fonts.join(scores, "font", "left").select("font", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc(F.round("score", 9)), "font").limit(k)


def tags_for(font_tags: DataFrame, font, k: int = 10) -> DataFrame:
    """(tag, p): a font's k likeliest tags."""
    return font_tags.where(F.col("font") == font).select("tag", "p").orderBy(F.desc("p"), F.desc("tag")).limit(k)


def adjectives(toks: DataFrame) -> DataFrame:
    """(id, pos, text): adjectives (tag ADJ) that another kind of word follows; of several in a row the last; none at the end."""
    after = F.lead("tag").over(W.partitionBy("id").orderBy("pos"))
    return toks.withColumn("_next", after).where("tag = 'ADJ' AND _next <> 'ADJ'").select("id", "pos", "text")


def sampled(descriptions: DataFrame, seed: int = 1234, most: int = 12) -> DataFrame:
    """(key, text): tags kept by their weight, shuffled, cut to a drawn number, as "a x, y font". Draws are seeded hashes."""
    u = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    tags = descriptions.select("key", F.explode("tags").alias("tag", "w"))
    kept = tags.where(u(F.col("key"), F.col("tag")) < F.col("w")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("key", "tag", F.lit(seed + 1)).alias("h"), "tag"))).alias("t"))
    n = F.greatest(F.lit(1), F.floor((0.6 + 0.4 * u(F.col("key"), F.lit("n"))) * most)).cast("int")
    return kept.select("key", F.concat(F.lit("a "), F.array_join(F.transform(F.slice("t", F.lit(1), n), lambda x: x["tag"]), ", "), F.lit(" font")).alias("text"))
