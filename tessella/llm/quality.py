"""Quality classifier: a generalised additive model with pairwise interactions.

Each round of boosting visits every feature in turn (then every chosen pair) and fits a shallow tree on that feature's
bins to the gradient; all trees of a feature add up to one lookup table. A score is the logistic of the sum of the
tables' entries, added for whole batches at a time. Features are taken from the whole text alone.

Labels: rows of the label table whose crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of them (smallest
hashes), each with one text, the least of those under its doc_id. Null texts count as empty; an empty text has a score
like any other. Without labels every score is the prior 0.5. Repeated rows give repeated results; a doc_id with several
labels counts once, with the larger one. A null doc_id is scored, but neither held out nor not: held_out is null. An empty
table gives an empty result. A column quality_score is replaced, all others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import guarded, others, table, tuned

#: Bound of the training sample.
TRAIN_ROWS = 20_000
BINS, ROUNDS, PAIRS, RATE = 64, 120, 6, 0.1
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "upper", "digit", "mark", "bang", "bar", "space", "lines_per_word", "word_length", "distinct_words",
    "repeated_lines", "high_bytes", "marked_words", "digit_words", "short_words", "repeated_pairs", "longest_word", "words_per_stop", "capital_words", "top_word",
)

_MARKS = np.frombuffer(b"#$%&*+<=>@[]\\^_`{|}~", np.uint8)


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(h[65:91].sum() + h[97:123].sum() + h[128:].sum()))
    words = raw.split()
    k = max(1, len(words))
    kinds = set(words)
    lines = [x for x in raw.split(b"\n") if x]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    marked = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    return [
        float(np.log1p(len(raw))),
        h[65:91].sum() / letters,
        h[48:58].sum() / n,
        h[_MARKS].sum() / n,
        h[33] / n,
        h[124] / n,
        (h[32] + h[9:14].sum()) / n,
        h[10] / k,
        sum(map(len, words)) / k,
        len(kinds) / k**0.5,
        1 - len(set(lines)) / max(1, len(lines)),
        h[128:].sum() / n,
        marked / k,
        sum(1 for w in words if any(48 <= c < 58 for c in w)) / k if h[48:58].any() else 0.0,
        sum(1 for w in words if len(w) <= 3) / k,
        1 - len(pairs) / max(1, len(words) - 1),
        float(np.log1p(max(map(len, kinds), default=0))),
        k / (1 + int(h[46])),
        sum(1 for w in words if w.isupper()) / k,
        max(counts.values(), default=0) / k,
    ]


def _best_cut(g: np.ndarray, h: np.ndarray, low: int, high: int, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of the bins low..high-1."""
    if high - low < 2:
        return 0.0, -1
    cg, ch = np.cumsum(g[low:high]), np.cumsum(h[low:high])
    left, right = cg[:-1] ** 2 / (ch[:-1] + ridge), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + ridge)
    gain[(ch[:-1] < 1) | (ch[-1] - ch[:-1] < 1)] = -1
    k = int(gain.argmax())
    return float(gain[k]), low + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> np.ndarray:
    """A shallow regression tree over ordered bins: the step function it predicts."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, p = max((*_best_cut(g, h, *p, ridge), p) for p in parts)
        if gain <= 1e-9 or at < 0:
            break
        parts.remove(p)
        parts += [(p[0], at), (at, p[1])]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """A tree over a grid of two features' bins: one cut of the first, then one cut of the second on each side."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + ridge)))
    for gg, hh, flip in ((g, h, False), (g.T, h.T, True)):
        for cut in range(1, gg.shape[0]):
            gain, out = -gg.sum() ** 2 / (hh.sum() + ridge), np.empty(gg.shape)
            for side in (slice(0, cut), slice(cut, None)):
                a, b = gg[side].sum(0), hh[side].sum(0)
                step = _tree(a, b, 2, ridge)
                out[side] = step
                for v in np.unique(step):
                    m = step == v
                    gain += a[m].sum() ** 2 / (b[m].sum() + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, out.T.copy() if flip else out)
    return best


class Additive:
    """edges: cut points of each feature's bins. tables: per feature; pairs: (i, j, table over coarse bins)."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]) -> None:
        self.base, self.edges, self.tables, self.coarse, self.pairs = base, edges, tables, coarse, pairs

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Additive:
        """Boosting on the rows x with labels y (0 or 1). Rows of one label, or none, give the smoothed prior alone."""
        prior = (y.sum() + 1) / (len(y) + 2)
        base = float(np.log(prior / (1 - prior)))
        if len(y) < 2 or y.min() == y.max():
            return Additive(base, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [np.empty(0)] * len(FEATURES), [])
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        coarse = [np.unique(np.quantile(c, np.linspace(0, 1, 9)[1:-1])) for c in x.T]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
        small = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
        tables = [np.zeros(len(e) + 1) for e in edges]
        score = np.full(len(y), base)
        for _ in range(ROUNDS):
            for k, b in enumerate(bins):
                p = 1 / (1 + np.exp(-score))
                step = RATE * _tree(np.bincount(b, y - p, len(tables[k])), np.bincount(b, p * (1 - p), len(tables[k])))
                tables[k] += step
                score += step[b]

        def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            p, w = 1 / (1 + np.exp(-score)), len(coarse[j]) + 1
            at, n = small[i] * w + small[j], (len(coarse[i]) + 1) * w
            return np.bincount(at, y - p, n).reshape(-1, w), np.bincount(at, p * (1 - p), n).reshape(-1, w), at

        found = sorted(((-_tree2(*grid(i, j)[:2])[0], i, j) for i in range(len(bins)) for j in range(i)))[:PAIRS]
        pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in found if gain < 0]
        for _ in range(ROUNDS // 4):
            for i, j, t in pairs:
                g, h, at = grid(i, j)
                step = RATE * _tree2(g, h)[1]
                t += step
                score += step.ravel()[at]
        return Additive(base, edges, tables, coarse, pairs)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by adding the bins' entries."""
        z = np.full(len(x), self.base)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            z += t[np.searchsorted(e, c, "right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _matrix(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return np.array([features(x.as_py()) for x in batch.column(text)], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, text: str = "text") -> Additive:
    """A model from at most `most` labelled rows that aren't held out."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    same = F.col("doc_id").cast("string").alias("_same")  # both tables' ids as text, whatever their types
    rows = docs.select(same, "doc_id", text).join(F.broadcast(known.select(same, "quality")), "_same")  # `most` rows at most
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(text).alias(text))  # one of each doc_id, however often it repeats
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, text)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), flat], names=["doc_id", "quality", "x"])

    got = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), text).mapInArrow(run, schema).toArrow().sort_by([("doc_id", "ascending")])
    x = got["x"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(got) else np.empty((0, len(FEATURES)))
    order = np.lexsort((*x.T, np.unique(got["doc_id"].to_numpy(), return_inverse=True)[1])) if len(got) else []
    return Additive.fit(x[order], got["quality"].to_numpy()[order].astype(float))


def scored(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """docs with a column quality_score."""
    schema = T.StructType(others(docs.schema.fields, "quality_score") + [T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(_matrix(b, text)))], names=[*b.schema.names, "quality_score"])

    return docs.drop("quality_score").mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


@guarded("quality_score")
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    tuned(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).where(F.col("quality_score") >= THRESHOLD).select(docs.columns)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
