"""Top-n weighted Jaccard similarity against plain Python, with hot tags."""

import random

import pytest

from tessella.operators import descriptions as D


def brute(tags, n):
    out = set()
    for a, x in tags.items():
        best = []
        for b, y in tags.items():
            if a != b:
                low = sum(min(w, y[t]) for t, w in x.items() if t in y)
                high = sum(x.values()) + sum(y.values()) - low
                best.append((-round(low / high if high else 0.0, 9), b))
        out |= {(a, b, rank + 1, round(-s, 6)) for rank, (s, b) in enumerate(sorted(best)[:n])}
    return out


@pytest.mark.parametrize("hot", [0, 3, 20, 1000])
def test_with_hot_tags(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    r = random.Random(hot)
    tags = {f"k{k}": {"all": r.choice([0.1, 0.5, 5.0])} | {f"t{r.randrange(40)}": round(r.random() + 0.1, 2) for _ in range(r.randrange(4))} for k in range(60)}
    tags |= {"alone": {"own": 1.0}, "empty": {}, "only": {"all": 0.5}}
    got = D.similar(spark.createDataFrame(list(tags.items()), "key string, tags map<string,double>"), 4).collect()
    assert {(x.key, x.other, x["rank"], round(x.sim, 6)) for x in got} == brute(tags, 4)


def test_a_hot_tag_makes_no_rows_for_pairs(spark):
    """The join of rare tags is linear in the names, though one tag is on all of them."""
    rows = [(f"k{k}", t, 1.0) for k in range(3000) for t in ("all", f"t{k // 5}")]
    met, hot = D.rare_pairs(spark.createDataFrame(rows, "key string, tag string, w double"), 1000)
    assert met.count() == 3000 * 4 and hot.count() == 3000


def test_words_near_tags_by_vectors(spark):
    terms = spark.createDataFrame([(1, "bold", "bold", False), (1, "heavy", "heavy", False), (2, "art", "art", True), (2, "zz", "zz", False)], "id long, text string, lemma string, negative boolean")
    vocab = spark.createDataFrame([(0, "bold", [1.0, 0.0]), (1, "smart", [0.0, 1.0])], "tag_idx int, tag string, v array<double>")
    words = spark.createDataFrame([("heavy", [0.8, 0.6]), ("zz", [-1.0, 0.0]), ("bold", [0.0, 1.0])], "lemma string, v array<double>")
    got = {(r.id, r.tag, round(r.weight, 6)) for r in D.query_weights(terms, vocab, 0.5, 1.0, words).collect()}
    assert got == {(1, "bold", 1.0), (1, "smart", 0.6), (2, "smart", -0.5)}
