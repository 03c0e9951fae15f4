import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_neardup import brute as groups

import corpus_pipeline
from tessella.llm import bpe, mixing, pii, quality
from tessella.llm.common import table

SF = "/root/testdata/sf0.001"


def test_as_brute_force(spark):
    """Every stage against plain Python on what the stage before kept."""
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = {d: r for d, r in docs.items() if model.score(np.array([quality.features(r.text)]))[0] >= quality.THRESHOLD}
    assert 0 < len(kept) < len(docs)
    found = groups([(d, r.text) for d, r in kept.items()], 5)
    kept = {d: r for d, r in kept.items() if found[d][1] == d}
    crf = pii.Crf.fit(pii.sample_counts(table(spark, SF, "documents").where(F.col("doc_id").isin(list(kept)))))
    texts = {}
    for d, r in kept.items():
        base, added = pii.find(r.text, crf)
        out, at, last = [], 0, -1
        for a, b, k in sorted((a, b, k) for k, a, b in base + added):
            if a >= last:
                out += [r.text[at:a], f"<{pii.KINDS[k].upper()}>"]
            last = at = max(last, b)
        texts[d] = "".join([*out, r.text[at:]])
    rows = spark.createDataFrame([(d, kept[d].source, t) for d, t in texts.items()], "doc_id long, source string, text string")
    plan = {x.doc_id: x for x in mixing.mix(mixing.sized(rows).drop("text")).collect()}
    want, c = Counter(), bpe.codec(bpe.vocabulary_path())
    for d, t in texts.items():
        left = plan[d].taken
        spots = [m.end() for m in re.finditer(mixing.WORD, t)]
        while left > 0:
            part = t if left >= len(spots) else t[: spots[left - 1]]
            want[d, tuple(c.encode(part).tolist())] += 1
            left -= len(spots)
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "x y z", "en", None, 5), (2, "", "en", "a", 0), (3, "one two three four five six seven", "en", "a", 9), (3, "one two three four five six seven", "en", "a", 9), (4, "w " * 5000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if stage is not bpe.stage:
                assert out.columns == docs.columns
            out.count()
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).where("doc_id = 3").count() == 1
