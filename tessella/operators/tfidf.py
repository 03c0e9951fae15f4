"""TF-IDF similarity of texts: exact pairs over a cosine threshold, on a grid of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.descriptions import STOP_WORDS
from tessella.operators.graph import gone, written

#: Rows of a block at least, and blocks of a side as long as these hold at most MOST rows.
BLOCK, LANES, MOST = 1024, 8, 1 << 16
#: Of the terms that most texts have, so many are only bounded at first, by norms over GROUPS parts of them. Left rows that meet a block at once.
FREQUENT, GROUPS, TILE = 2048, 64, 256
#: A part of the texts counts its terms alone: it has at most PART kinds of pairs of words, and leaves out counts under a SHAREth of its terms.
PART, SHARE = 1 << 22, 1 << 20
#: Characters of texts that are split at once.
CHARS = 1 << 22
_GAP = r"[^\p{L}\p{N}\p{M}_]+"


def _words(texts: pa.Array, stop: frozenset[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The kinds of words of texts; and for each word in place its text and its kind. Words have two characters at least."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _GAP)
    coded = lists.values.dictionary_encode()
    kinds, at = coded.dictionary, coded.indices.to_numpy()
    fit = pc.and_(pc.greater_equal(pc.utf8_length(kinds), 2), pc.invert(pc.is_in(kinds, pa.array(sorted(stop), kinds.type)))).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    keep = fit[at]
    return kinds, text[keep], at[keep]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about CHARS bytes of text, and of a row at least."""
    for batch in batches:
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", batch["text"].cast(pa.large_string()))
        part = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)) // CHARS
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, z in zip([0, *ends], ends):
            if z > a:
                yield batch.slice(a, z - a)


def _summed(keys: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and the sums of each; whole numbers."""
    order = np.argsort(keys, kind="stable")
    keys, by = keys[order], by[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(by, first) if len(first) else by[:0]


class _Part:
    """Counts of the terms of a part: words by their numbers, pairs by both numbers in one."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.pairs, self.more, self.waiting, self.total = np.zeros(1 << 16, np.int64), (np.empty(0, np.int64),) * 2, [], 0, 0

    def add(self, texts: pa.Array, copies: np.ndarray, stop: frozenset[str]) -> None:
        kinds, text, at = _words(texts, stop)
        own = np.array([self.number.setdefault(k, len(self.number)) for k in kinds.to_pylist()], np.int64)
        if len(self.words) < len(self.number):
            self.words = np.concatenate([self.words, np.zeros(max(len(self.number), len(self.words)), np.int64)])
        word, n = own[at], copies[text]
        np.add.at(self.words, word, n)
        side = text[1:] == text[:-1]
        self.more.append((word[:-1][side] << 32 | word[1:][side], n[1:][side]))
        self.waiting += len(self.more[-1][0])
        self.total += int(n.sum() + n[1:][side].sum())
        if self.waiting >= PART // 2:
            self.settle()

    def settle(self) -> None:
        self.pairs = _summed(*(np.concatenate([p[k] for p in (self.pairs, *self.more)]) for k in range(2)))
        self.more, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.pairs[0]) >= PART

    def terms(self, share: int) -> Iterator[pa.RecordBatch]:
        """(term, n, short) of counts that aren't short, and a row without a term: what at most a term that isn't there has."""
        self.settle()
        least = max(1, self.total // share) if share else 1
        names = pa.array(list(self.number), pa.string())
        word, (pair, n) = np.flatnonzero(self.words >= least), self.pairs
        pair, n = pair[n >= least], n[n >= least]
        both = pc.binary_join_element_wise(names.take(pa.array(pair >> 32)), names.take(pa.array(pair & 0xFFFFFFFF)), " ")
        found = pa.table({"term": pa.chunked_array([names.take(pa.array(word)), both, pa.nulls(1, pa.string())]), "n": np.concatenate([self.words[word], n, [0]])})
        yield from found.append_column("short", pa.array(np.full(len(found), least - 1, np.int64))).combine_chunks().to_batches(1 << 16)


def _likely(texts: DataFrame, most: int, stop: frozenset[str]) -> list[str]:
    """Terms among which are the `most` of highest count, ties by term.

    Each part hands on its frequent terms. What it leaves out is short of a count that it tells, so the sum of what a term
    got and may lack is a bound; where such sums leave too much open, all is counted again with more handed on.
    """
    share = SHARE
    while True:

        def run(batches: Iterator[pa.RecordBatch], share: int = share) -> Iterator[pa.RecordBatch]:
            part = _Part()
            for b in _slices(batches):
                part.add(b["text"], b["copies"].to_numpy(), stop)
                if part.full():
                    yield from part.terms(share)
                    part = _Part()
            if part.total:
                yield from part.terms(share)

        told = written(texts.select("text", "copies").mapInArrow(run, "term string, n long, short long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("short").alias("short")))
        (row,) = told.where("term IS NULL").agg(F.coalesce(F.sum("short"), F.lit(0)).alias("short")).collect()
        known = told.where("term IS NOT NULL")
        best = known.orderBy(F.desc("n"), "term").limit(most)
        if not row.short:
            found = best
        else:
            least, n = best.agg(F.min("n"), F.count("*")).first()
            if n < most or row.short > least * 3 // 4:
                share = share * 8 if share < 1 << 40 else 0
                gone(told)
                continue
            found = known.where(F.col("n") + (row.short - F.col("short")) >= least)
        found = found.select("term").toArrow()["term"].to_pylist()
        gone(told)
        return found


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at, at + 1, ... n times, for each of them."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _lists(texts: DataFrame, terms: list[str], stop: frozenset[str]) -> DataFrame:
    """(id, copies, t, n): of each text, in order, the places of its terms in `terms` and how often they occur."""
    split = [t.split(" ") for t in terms]
    names = sorted({w for t in split for w in t})
    number = {w: k for k, w in enumerate(names)}
    single = np.full(len(names) + 1, -1, np.int64)
    for k, t in enumerate(split):
        if len(t) == 1:
            single[number[t[0]]] = k
    pairs = np.array([(number[t[0]] << 32 | number[t[1]], k) for k, t in enumerate(split) if len(t) == 2], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    pair, to = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], -1)
    names = pa.array(names, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            kinds, text, at = _words(b["text"], stop)
            word = pc.fill_null(pc.index_in(kinds, names), len(names)).to_numpy(zero_copy_only=False).astype(np.int64)[at]
            side = np.flatnonzero((text[1:] == text[:-1]) & (word[1:] < len(names)) & (word[:-1] < len(names)))
            both = word[side] << 32 | word[side + 1]
            found = np.searchsorted(pair, both)
            term, row = np.concatenate([single[word], np.where(pair[found] == both, to[found], -1)]), np.concatenate([text, text[side]])
            term, row = term[term >= 0], row[term >= 0]
            key, n = _summed(row << 32 | term, np.ones(len(term), np.int64))
            starts = pa.array(np.searchsorted(key, np.arange(len(b) + 1) << 32).astype(np.int32))
            lists = (pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, n))
            yield pa.RecordBatch.from_arrays([b["id"], b["copies"], *lists], ["id", "copies", "t", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "copies", "text").mapInArrow(run, f"id {kind}, copies long, t array<int>, n array<int>")


def _flat(c: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(), pc.list_value_length(c).to_numpy(zero_copy_only=False)


def _counted(docs: DataFrame, max_features: int, stop_words: tuple[str, ...], copies: str | None) -> tuple[DataFrame, pa.Table, np.ndarray]:
    """(id, copies, t, n) of docs, t among likely terms; (term, df, idf) of the terms that stay, those of most texts first; and their place for each t, or -1."""
    stop = frozenset(stop_words)
    texts = written(docs.select("id", "text", (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("copies")))
    likely = _likely(texts, max_features, stop)
    rows = written(_lists(texts, likely, stop))
    total = texts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    gone(texts)

    def run(batches: Iterator[pa.RecordBatch], size: int = len(likely)) -> Iterator[pa.RecordBatch]:
        df, cf = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            (t, m), n = _flat(b["t"]), _flat(b["n"])[0].astype(np.int64)
            by = np.repeat(b["copies"].to_numpy(), m)
            np.add.at(df, t, by)
            np.add.at(cf, t, n * by)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (on.astype(np.int32), df[on], cf[on])], ["t", "df", "cf"])

    sums = rows.select("copies", "t", "n").mapInArrow(run, "t int, df long, cf long").groupBy("t").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).toArrow()
    sums = sums.append_column("term", pa.array(likely, pa.string()).take(sums["t"])).sort_by([("cf", "descending"), ("term", "ascending")])
    known = sums.slice(0, max_features).sort_by([("df", "descending"), ("term", "ascending")])
    place = np.full(len(likely), -1, np.int64)
    place[known["t"].to_numpy()] = np.arange(len(known))
    idf = np.log((1 + total) / (1 + known["df"].to_numpy())) + 1
    return rows, pa.table({"term": known["term"], "df": known["df"], "idf": idf}), place


def features(docs: DataFrame, max_features: int = 50_000, stop_words: tuple[str, ...] = STOP_WORDS, copies: str | None = None) -> DataFrame:
    """(id, term, df, w) of docs (id, text): one- and two-word terms, (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit rows.

    Words have two letters, marks, digits or underscores at least; stop words go before pairs are made. The terms of highest
    count stay. With copies, a column that says how many documents a row stands for, n, df and counts are taken over all
    of them. Texts are split where they lie; the terms that stay are max_features at most, so they go to every task.
    """
    rows, known, place = _counted(docs, max_features, stop_words, copies)
    spark = docs.sparkSession
    named = spark.createDataFrame(known.append_column("t", pa.array(np.flatnonzero(place >= 0)[np.argsort(place[place >= 0])].astype(np.int32))))
    each = rows.select("id", F.explode(F.arrays_zip("t", "n")).alias("x")).select("id", "x.t", "x.n")
    raw = each.join(F.broadcast(named), "t").select("id", "term", "df", ((1 + F.ln("n")) * F.col("idf")).alias("w"))  # max_features rows
    return raw.select("id", "term", "df", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))).alias("w"))


def _packed(rows: DataFrame, place: np.ndarray) -> DataFrame:
    """(id, t, n, more) of rows that keep a term: its terms' places by their steps, low and high bytes, their counts in a byte, and counts over 254."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (t, m), n = _flat(b["t"]), _flat(b["n"])[0]
            t, row = place[t], np.repeat(np.arange(len(b)), m)
            on = t >= 0
            order = np.argsort((row << 32 | t)[on], kind="stable")
            t, n, row = t[on][order], n[on][order], row[on][order]
            step = np.diff(t, prepend=0)
            step[new] = t[new := np.flatnonzero(np.diff(row, prepend=-1))]
            size, big = np.bincount(row, minlength=len(b)), n > 254
            planes = np.empty((3, len(t)), np.uint8)
            for k in range(3):
                planes[k] = step >> 8 * k & 255
            at, wide = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(np.bincount(row[big], minlength=len(b)))])
            # one row's planes stand behind each other
            inside = np.repeat(at[:-1] * 3, size) + np.arange(len(t)) - np.repeat(at[:-1], size)
            lows = np.empty(3 * len(t), np.uint8)
            for k in range(3):
                lows[inside + k * np.repeat(size, size)] = planes[k]
            blob = lambda offsets, data: pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            out = pa.RecordBatch.from_arrays([b["id"].cast(pa.int64()), blob(at * 3, lows), blob(at, np.minimum(n, 255).astype(np.uint8)), blob(wide * 4, n[big].astype(np.int32))], ["id", "t", "n", "more"])
            yield out.filter(pa.array(size > 0))

    return rows.select("id", "t", "n").mapInArrow(run, "id long, t binary, n binary, more binary")


def _bytes(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column, and where each row's begin."""
    c = c.combine_chunks()
    if not len(c):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    return np.frombuffer(c.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


class _Side:
    """Unit rows of a side of a cell: ids, and by row its first place, terms and counts; weights are worked out when asked for."""

    def __init__(self, rows: pa.Table, idf: np.ndarray) -> None:
        self.ids, self.idf = rows["id"].to_numpy(), idf
        (n, self.at), (steps, _), (more, _) = _bytes(rows["n"]), _bytes(rows["t"]), _bytes(rows["more"])
        self.size = np.diff(self.at)
        self.n = n.astype(np.int32)
        self.n[n == 255] = more.view(np.int32)
        self.log = 1 + np.log(np.arange(1, self.n.max(initial=0) + 1)) if self.n.max(initial=0) < 1 << 20 else None
        self.t, self.length = np.empty(len(n), np.int32), np.empty(len(self.ids))
        for a in range(0, len(self.ids), 4096):
            z = min(a + 4096, len(self.ids))
            part, m = slice(self.at[a], self.at[z]), self.size[a:z]
            inside = _ranges(self.at[a:z] * 3, m)
            step = sum(steps[inside + k * np.repeat(m, m)].astype(np.int64) << 8 * k for k in range(3))
            so_far = np.cumsum(step)
            first = self.at[a:z] - self.at[a]
            self.t[part] = so_far - np.repeat(so_far[first] - step[first], m)
            w = self.logs(part) * idf[self.t[part]]
            self.length[a:z] = np.sqrt(np.add.reduceat(w * w, first))

    def logs(self, at: np.ndarray | slice) -> np.ndarray:
        """1 + ln of counts, from a table unless they are huge."""
        return self.log[self.n[at] - 1] if self.log is not None else 1 + np.log(self.n[at])

    def weights(self, at: np.ndarray | slice, row: np.ndarray | int) -> np.ndarray:
        return self.logs(at) * self.idf[self.t[at]] / self.length[row]

    def norms(self) -> np.ndarray:
        """By row, the lengths of what it has of the frequent terms, in GROUPS parts."""
        out = np.zeros((len(self.ids), GROUPS), np.float32)
        for a in range(0, len(self.ids), 4096):
            z = min(a + 4096, len(self.ids))
            part, row = slice(self.at[a], self.at[z]), np.repeat(np.arange(a, z), self.size[a:z])
            few = self.t[part] < FREQUENT
            w = self.weights(part, row)[few]
            out[a:z] = np.sqrt(np.bincount((row[few] - a) * GROUPS + self.t[part][few] % GROUPS, w * w, (z - a) * GROUPS)).reshape(-1, GROUPS)
        return out

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, weight) of the terms that aren't frequent, by term, and where each term's begin."""
        out, at = np.empty(np.count_nonzero(self.t >= FREQUENT), [("row", np.int32), ("w", np.float32)]), 0
        terms = np.empty(len(out), np.uint16 if len(self.idf) <= 1 << 16 else np.int32)
        for a in range(0, len(self.ids), 4096):
            z = min(a + 4096, len(self.ids))
            part, row = slice(self.at[a], self.at[z]), np.repeat(np.arange(a, z), self.size[a:z])
            rare = self.t[part] >= FREQUENT
            to = slice(at, at := at + np.count_nonzero(rare))
            out["row"][to], out["w"][to], terms[to] = row[rare], self.weights(part, row)[rare], self.t[part][rare]
        first = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(self.idf)))])
        return out[np.argsort(terms, kind="stable")], first


def _cell(cell: pa.Table, threshold: float, selves: bool, idf: np.ndarray) -> pa.Table:
    """Pairs of a cell's own rows with its other rows.

    Rare terms' products are summed by scattering the postings of each own row's terms; what the frequent ones can add is at
    most the sum, over parts of them, of the products of the rows' lengths there. Pairs that may reach the threshold are worked out whole.
    """
    own = cell["own"].to_numpy()
    left, right = (_Side(cell.filter(pa.array(x)), idf) for x in (own, ~own))
    same = bool(len(own)) and cell["lane"][0].as_py() == cell["block"][0].as_py()
    del cell
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(left.ids) and len(right.ids):
        postings, first = right.postings()
        flat, mine, theirs = postings.view(np.int64), left.norms(), right.norms().T
        x, total = np.zeros(len(idf)), len(right.ids)
        for tile in range(0, len(left.ids), TILE):
            most = mine[tile : tile + TILE] @ theirs
            for k in range(len(most)):
                r = tile + k
                terms = left.t[part := slice(left.at[r], left.at[r + 1])]
                by = left.weights(part, r)
                bound = most[k]
                rare = terms >= FREQUENT
                a, z = first[t := terms[rare]], first[t + 1]
                if (n := z - a).any():
                    met = np.concatenate([flat[p:q] for p, q in zip(a.tolist(), z.tolist(), strict=True)]).view(postings.dtype)
                    bound = bound + np.bincount(met["row"], met["w"] * np.repeat(by[rare], n), total)
                i = left.ids[r]
                hit = np.flatnonzero(bound >= threshold - 1e-4)
                hit = hit[(right.ids[hit] >= i if selves else right.ids[hit] > i) if same else (right.ids[hit] != i)]
                if len(hit):
                    x[terms] = by * idf[terms]
                    at = _ranges(right.at[hit], size := right.size[hit])
                    sim = np.add.reduceat(x[right.t[at]] * right.logs(at), np.cumsum(size) - size) / right.length[hit]
                    x[terms] = 0
                    hit, sim = hit[sim >= threshold], sim[sim >= threshold]
                    out.append((np.full(len(hit), i), right.ids[hit], sim))
    a, b, sim = (np.concatenate([x[k] for x in out]) if out else np.empty(0) for k in range(3))
    return pa.table({"i": pa.array(np.minimum(a, b).astype(np.int64)), "j": pa.array(np.maximum(a, b).astype(np.int64)), "sim": pa.array(sim.astype(float))})


def similar_pairs(docs: DataFrame, threshold: float = 0.35, max_features: int = 50_000, copies: str | None = None, selves: bool = False) -> DataFrame:
    """(i, j, sim), i < j (with selves i <= j), cosine at least the threshold; ids are whole numbers. For copies see features.

    Rows are dealt into blocks, of BLOCK rows or of more if they were over LANES; each cell of the grid holds two of them
    and hands out only pairs over the threshold. So a term that all texts share costs a bound, not joined rows, and no
    pair of rows is shuffled. Rows hold numbers of terms and how often these occur, packed; the terms' weights, max_features
    at most, go to every task.
    """
    listed, known, place = _counted(docs, max_features, STOP_WORDS, copies)
    idf = known["idf"].to_numpy()
    rows = written(_packed(listed, place))
    gone(listed)
    total = rows.count()
    n = max(1, min(-(-total // BLOCK), max(LANES, -(-total // MOST))))
    own = rows.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(n)))
    every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    packed = ("t", "n", "more")
    left = own.select(F.lit(True).alias("own"), "id", *packed, F.col("deal").alias("lane"), F.explode(F.filter(every, lambda b: b >= F.col("deal"))).alias("block"))
    right = own.select(F.lit(False).alias("own"), "id", *packed, F.explode(F.filter(every, lambda b: b <= F.col("deal"))).alias("lane"), F.col("deal").alias("block"))
    return left.union(right).groupBy("lane", "block").applyInArrow(lambda cell: _cell(cell, threshold, selves, idf), "i long, j long, sim double")


def similar_documents(docs: DataFrame, threshold: float = 0.35, max_features: int = 50_000) -> DataFrame:
    """(kind, i, j, sim) of docs (id, text), ids unique whole numbers: similarities of all documents, copies by class.

    A class holds the documents of one text and has their least id. Rows of kind "member" give each document j its class i;
    rows of kind "pair" are the similar classes, i <= j. Two documents are similar where their classes are; those of one
    class where it has a pair with itself, which a text without terms lacks. So copies cost rows, not pairs of rows.
    """
    key = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("key")
    texts = written(docs.groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    members = docs.select(F.col("id").cast("long").alias("j"), key).join(written(texts.select(F.col("id").cast("long").alias("i"), key)), "key")
    pairs = similar_pairs(texts, threshold, max_features, "copies", selves=True)
    gone(texts)
    member = members.select(F.lit("member").alias("kind"), "i", "j", F.lit(None).cast("double").alias("sim"))
    return member.unionByName(pairs.select(F.lit("pair").alias("kind"), "i", "j", "sim"))
