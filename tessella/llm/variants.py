r"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions; words that share one of these keys are candidates, and a pair
counts if its distance is exactly one inserted, deleted or replaced code point. Two such words share exactly one key (of a
replacement, what is left of both; else the shorter word), so no pair comes twice and nothing has to be made distinct. A key
is shared by no more words than can be made from it by one insertion, so a key's group is bounded by the alphabet and the
word's length, whatever the input.

Words of more than LONG code points would emit as many keys of their own length. Those keys are 61-bit hashes that roll over the
word, and go with the word's number instead of the word; both words are fetched for the check by two joins. Words of
LONG code points emit both kinds, so that pairs across the bound are met.

A word's form is its near word of highest count if that is RATIO times its own at least; roots follow forms to the last
one. Counts grow tenfold along a chain, so chains are short; pointers are doubled round by round until none moves.

Texts that are null or without words give none. A null doc_id hashes as the empty text before the colon in the query. Equal rows count
each for itself. Ties go to the smaller word in code-point order. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import drop, settle, table, tuned

RUN = r"[A-Za-zÀ-ÿ]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: From this length on words emit hashed keys.
LONG = 48
#: A prime below 2**31, and two bases for the rolling hashes: fixed, so that reruns agree.
PRIME, BASES = 2_147_483_629, (911_382_323, 972_663_749)


def occurrences(text: Column, least: int = LEAST_LENGTH) -> Column:
    """Maximal runs of letters of at least that many code points, with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN % least), F.lit(0))


def mutated(doc_id: Column, run: Column, every: int = EVERY) -> Column:
    """The run, or for one in `every` by the crc32 of `<doc_id>:<run>` the run without the code point at that hash."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, without(run, at)).otherwise(run)


def without(word: Column, at: Column) -> Column:
    """The word without the code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words (word), those that are long and frequent enough."""
    kept = words.where(F.char_length("word") >= least_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def hashed_deletions(codes: np.ndarray) -> np.ndarray:
    """The 61-bit hashes of a word (first) and of its distinct single deletions, in linear time."""
    both = []
    n = len(codes)
    for base in BASES:
        before, powers = [0] * (n + 1), [1] * (n + 1)
        for i, c in enumerate(codes.tolist()):
            before[i + 1] = (before[i] * base + c + 1) % PRIME
            powers[i + 1] = powers[i] * base % PRIME
        head, power = np.array(before, np.int64), np.array(powers, np.int64)
        # What follows place i, as a hash of its own; products stay below 2**62.
        tail = (head[n] - head[1:] * power[n - 1 :: -1] % PRIME) % PRIME
        both.append(np.concatenate([[head[n]], (head[:-1] * power[n - 1 :: -1] + tail) % PRIME]))
    keys = (both[0] << 30) ^ both[1]
    last = np.append(codes[1:] != codes[:-1], True)  # the last of a run of equal letters stands for all of them
    return np.concatenate([keys[:1], keys[1:][last]])


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for number, word in zip(b["number"].to_pylist(), b["word"].to_pylist(), strict=True):
            keys = hashed_deletions(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64))
            for k in range(0, len(keys), 10_000):
                part = keys[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([number] * len(part), pa.binary())], ["key", "number"])


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced, in linear time."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in (a, b))
    other = np.flatnonzero(x != y[: len(x)])
    k = int(other[0]) if len(other) else len(x)
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([one_apart(x, y) for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)], pa.bool_()))


def _short_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn), a < b, both below the length from which keys are hashed, or of it."""
    short = words.where(F.char_length("word") <= LONG)
    cuts = F.transform(F.sequence(F.lit(0), F.char_length("word") - 1), lambda i: without(F.col("word"), i))
    keys = short.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), cuts))).alias("key"))
    a, b = (keys.select("key", F.col("word").alias(x), F.col("n").alias(f"{x}n")) for x in "ab")
    return a.join(b, "key").where("a < b").where(F.levenshtein("a", "b", 1) == 1).drop("key")


def _long_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn), a < b, one at least of hashed keys."""
    number = F.sha2(F.col("word").cast("binary"), 256).cast("binary").alias("number")
    long = words.where(F.char_length("word") >= LONG).select(number, "word", "n")
    tuned(words.sparkSession)
    keys = long.select("number", "word").mapInArrow(_long_keys, "key long, number binary")
    a, b = (keys.select("key", F.col("number").alias(x)) for x in ("x", "y"))
    met = a.join(b, "key").where("x < y").select("x", "y").distinct()  # hashes may agree by chance
    first, second = (long.select(F.col("number").alias(x), F.col("word").alias(w), F.col("n").alias(f"{w}n")) for x, w in (("x", "a"), ("y", "b")))
    found = met.join(first, "x").join(second, "y").where(F.greatest(F.char_length("a"), F.char_length("b")) > LONG)
    found = found.select("a", "an", "b", "bn").mapInArrow(_confirmed, "a string, an long, b string, bn long")
    turn = F.col("a") < F.col("b")
    side = lambda p, q, name: F.when(turn, F.col(p)).otherwise(F.col(q)).alias(name)
    return found.select(side("a", "b", "a"), side("an", "bn", "an"), side("b", "a", "b"), side("bn", "an", "bn"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn), a < b, of words (word, n), each word once, that are exactly one code point apart."""
    short = _short_pairs(words)
    return short if words.where(F.char_length("word") > LONG).isEmpty() else short.unionByName(_long_pairs(words))


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near ones; form is null where none is frequent enough."""
    both = near_pairs(words).select(F.explode(F.array(*(F.struct(F.col(p).alias("word"), F.col(f"{p}n").alias("n"), F.col(q).alias("near"), F.col(f"{q}n").alias("near_n")) for p, q in ("ab", "ba")))).alias("e"))
    best = both.select("e.*").groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    return best.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), chains without cycles: the last word that forms lead to."""
    now = settle(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        now = new.select("word", "root")
        now._settled = new._settled
        if new.where("moved").isEmpty():
            return now


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each word once."""
    words = settle(words.select("word", F.col("n").cast("long").alias("n")), "words")
    found = settle(forms(words, ratio), "forms")
    last = roots(found.where("form IS NOT NULL").select("word", "form"))
    out = words.join(found, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(occurrences(F.col("text"))).alias("run"))
    return grouped(counted(runs.select(mutated(F.col("doc_id"), F.col("run")).alias("word"))))


_CRC = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n))"

ORACLE = {
    "op11_variants": f"""
    WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC} AS t),
    r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{LEAST_LENGTH},}}')) AS run FROM documents),
    u AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r GROUP BY ALL),
    b AS (SELECT doc_id, run, k, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END)) AS bytes FROM u),
    h AS (SELECT run, k, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, crc),
    w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM h),
    v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
    d AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.key = y.key AND x.i = y.i AND x.word <> y.word
      UNION ALL SELECT DISTINCT x.word, y.word, y.n FROM d x JOIN v y ON x.key = y.word
      UNION ALL SELECT DISTINCT x.word, y.word, y.n FROM v x JOIN d y ON x.word = y.key),
    f AS MATERIALIZED (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM e GROUP BY word),
    g AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
    chain AS (SELECT word, word AS tip, 0 AS step FROM g UNION ALL SELECT c.word, g.form, step + 1 FROM chain c JOIN g ON c.tip = g.word WHERE g.form IS NOT NULL),
    last AS (SELECT word, arg_max(tip, step) AS root FROM chain GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM g JOIN last USING (word)"""
}
