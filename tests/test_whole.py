"""Queries and operators that take all rows and whole values: what a cut would lose."""

import pytest

from tessella.operators import descriptions, tfidf
from tessella.plans import feedback


def test_similar_documents_keep_copies(spark):
    texts = {1: "bold clean", 2: "bold clean serif", 3: "script", 4: "", 5: "bold clean", 6: "", 7: None, 8: "bold clean"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = tfidf.similar_documents(docs).collect()
    assert {r.j: r.i for r in got if r.kind == "member"} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 4, 7: 7, 8: 1}
    classes = {r.j: r.i for r in got if r.kind == "member"}
    pairs = {(r.i, r.j): r.sim for r in got if r.kind == "pair"}
    every = {(r.i, r.j): r.sim for r in tfidf.similar_pairs(docs).collect()}  # each document a row of its own
    spread = {(a, b): s for a in texts for b in texts if a < b and (s := pairs.get(tuple(sorted((classes[a], classes[b])))))}
    assert spread == pytest.approx(every) and (5, 8) in every and (2, 8) in every
    assert pairs[1, 1] == pytest.approx(1) and (4, 4) not in pairs


def test_descriptions_are_whole(spark, tmp_path):
    texts = [(1, " " * 30 + "late text"), (2, "a text of far more than twenty characters"), (3, "   "), (9, "dropped")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k * 7,) for k in range(10)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.doc_id: r.description for r in feedback.describe_append_whole(spark, str(tmp_path)).collect()}
    assert got == dict(texts[:2])


def test_similar_fills_up_with_keys_that_share_no_tag(spark):
    tags = {"a": {"x": 1.0}, "b": {"x": 1.0, "y": 1.0}, "c": {"z": 1.0}, "d": {}, "e": {"y": 1.0}, "f": {"u": 1.0}}
    got = descriptions.similar(spark.createDataFrame(list(tags.items()), "key string, tags map<string,double>"), 3).collect()
    ranked = {k: [r.other for r in sorted(got, key=lambda r: r["rank"]) if r.key == k] for k in tags}
    assert ranked == {"a": ["b", "c", "d"], "b": ["a", "e", "c"], "c": ["a", "b", "d"], "d": ["a", "b", "c"], "e": ["b", "a", "c"], "f": ["a", "b", "c"]}


def test_upserts_over_several_batches(spark, tmp_path):
    """The last version of the state, however many batches the stream took."""
    from pyspark.sql import functions as F

    from tessella.streaming import feedback as S

    rows = spark.range(60).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), (F.col("id") * 1.5).alias("value"))
    for k in range(3):
        rows.where(F.floor(F.col("event_id") / 20) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = S.upsert_stream(S.event_stream(spark, f"{tmp_path}/in", schema="event_id BIGINT, user_id BIGINT, value DOUBLE"), ["user_id"], "value", ["event_id"], f"{tmp_path}/state", f"{tmp_path}/checkpoint")
        last = {e % 7: e * 1.5 for e in range(20 * (k + 1))}
        assert {r.user_id: r.value for r in got.collect()} == last


def test_numbers_are_dense_and_in_order(spark):
    from pyspark.sql import functions as F

    from tessella.operators.graph import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.lit("a").alias("y")).repartition(16)
    got = sorted((r.n, r.x) for r in numbered(rows, "n", "x").collect())
    assert [n for n, _ in got] == list(range(5000)) and [x for _, x in got] == sorted(x for _, x in got)
    assert numbered(rows.limit(0), "n", "x").count() == 0


def test_evolution_fills_its_population(spark):
    from tessella.operators import paths

    fonts = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(5)], "font int, v array<double>")
    got = paths.evolve(fonts, nodes=4, population=10, keep=4, steps=2).collect()
    assert len({r.path_id for r in got}) == 4 and all(len({r.font for r in got if r.path_id == p}) == 4 for p in {r.path_id for r in got})


def test_retrieval_scores_over_several_blocks(spark, monkeypatch):
    """All rows as queries, ties, rows without a family or a relative, on a grid of many cells."""
    import numpy as np

    from tessella.operators import retrieval, similarity

    monkeypatch.setattr(similarity, "BLOCK", 16)
    x = np.random.default_rng(5).normal(size=(70, 6))
    x[7] = x[3]  # a tie
    fam = [None if k % 11 == 0 else 99 if k == 5 else k % 4 for k in range(70)]
    v = spark.createDataFrame([(k, fam[k], x[k].tolist()) for k in range(70)], "id long, fam int, v array<double>")
    s = np.round(x @ x.T, 9)
    same = np.array([[a == b or (fam[a] is not None and fam[a] == fam[b]) for b in range(70)] for a in range(70)])
    want = {}
    for i in range(70):
        order = sorted((j for j in range(70) if j != i), key=lambda j: (-s[i, j], j))
        if hits := [r for r, j in enumerate(order) if same[i, j]]:
            want[i] = hits[0]
    first = retrieval.first_positive(v, v)
    assert {r.i: r["rank"] for r in first.collect()} == want and 5 not in want and 0 not in want
    assert retrieval.recall_at_k(first, v, 3).first().recall_at_k == pytest.approx(sum(r < 3 for r in want.values()) / 70)
    assert {r.i: (r.positives, r.pairs) for r in retrieval.positive_pairs(v, v).collect()} == {i: (same[i].sum(), 70) for i in range(70)}
    for bound in (None, 1.0):
        logit = x @ x.T / 0.5
        if bound:
            logit[(x @ x.T >= bound) & ~same] = retrieval.MASKED
        lse = np.log(np.exp(logit - logit.max(1, keepdims=True)).sum(1)) + logit.max(1)
        assert retrieval.info_nce(v, v, 0.5, bound).first().loss == pytest.approx((lse - (logit * same).sum(1) / same.sum(1)).mean())
    assert retrieval.first_positive(v.limit(0), v.limit(0)).count() == 0 and retrieval.info_nce(v.limit(0), v.limit(0)).first().loss is None


def test_similar_pairs_copy_a_text_a_fixed_number_of_times(spark, monkeypatch):
    """Blocks grow with the texts: however many there are, a row lies in LANES + 1 cells of the half grid; pairs are those of few blocks."""
    words = ("bold", "clean", "serif", "script", "round", "light", "wide", "narrow")
    docs = spark.createDataFrame([(k, " ".join(words[(k * 5 + k // 3 * j + j) % 8] for j in range(5))) for k in range(90)], "id long, text string")
    want = {(r.i, r.j): r.sim for r in tfidf.similar_pairs(docs).collect()}
    monkeypatch.setattr(tfidf, "BLOCK", 3)
    got = tfidf.similar_pairs(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()  # texts would be dealt into 30
    assert {(r.i, r.j): r.sim for r in got.collect()} == pytest.approx(want) and want
    assert f", 42), {tfidf.LANES}) AS deal" in plan


def test_similar_pairs_leave_out_only_what_cannot_reach_the_threshold(spark, monkeypatch):
    """Terms counted in many parts, most of them short, and bounds on frequent terms: still the pairs of the SQL's words, marks and digits too."""
    import random

    import duckdb
    from tessella.plans import tags

    r = random.Random(4)
    words = ["der", "la", "x²", "Ⅷa", "é́t", "_1", "b", "12½"] + [f"w{k}" for k in range(40)]
    texts = {k: " ".join(r.choice(words[: 12 if k % 3 else 48]) for _ in range(r.randrange(1, 30))) for k in range(150)} | {150: None, 151: "", 152: "la " * 700 + "der", 153: "der " + "la " * 300}
    monkeypatch.setattr(tfidf, "FREQUENT", 6)
    monkeypatch.setattr(tfidf, "GROUPS", 2)
    monkeypatch.setattr(tfidf, "PART", 200)
    monkeypatch.setattr(tfidf, "SHARE", 60)
    monkeypatch.setattr(tfidf, "CHARS", 400)
    monkeypatch.setattr(tfidf, "BLOCK", 40)
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (50_000, 30):
        with duckdb.connect() as db:
            db.register("documents", documents.toArrow())
            want = {(i, j): s for i, j, s in db.execute(tags.ORACLE["tfidf_similar_pairs"].replace("LIMIT 50000", f"LIMIT {most}")).fetchall()}
        docs = documents.groupBy("text").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "id").repartition(2)
        got = tfidf.similar_pairs(docs, max_features=most).collect()
        assert {(x.i, x.j): x.sim for x in got} == pytest.approx(want, abs=2e-6) and len(want) > 100


def test_parts_hand_on_few_terms(spark):
    """What a part hands on doesn't grow with its terms once they are many: rare ones stay where they are."""
    import numpy as np
    import pyarrow as pa

    part = tfidf._Part()
    part.add(pa.array([" ".join(f"u{k}" for k in range(2000)), "bold clean " * 40]), np.ones(2, int), frozenset())
    got = {r["term"]: (r["n"], r["short"]) for b in part.terms(1000) for r in b.to_pylist()}
    assert got == {"bold": (40, 3), "clean": (40, 3), "bold clean": (40, 3), "clean bold": (39, 3), None: (0, 3)}
