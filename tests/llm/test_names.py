"""Columns whose names differ from new ones in case only, and doc_ids that aren't longs."""

import pytest

from tessella.llm import bpe, hashing, licenses, media, merkle, neardup, pii, quality, topk, variants

TEXT = "the quick brown fox jumps over the lazy dog and mails ann@mail.org about it"


def frame(spark, kind="long", **more):
    rows = [(int(k) if kind != "string" else f"d{k}", f"{TEXT} {k % 3}", *more.values()) for k in range(30)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string" + "".join(f", {c} string" for c in more))


def counted(df, n=30):
    names = [c.lower() for c in df.columns]
    assert len(names) == len(set(names)) and len(df.collect()) == n
    return df


def test_clashing_names(spark):
    path = bpe.vocabulary_path()
    assert "LICENSES" not in counted(licenses.scan(frame(spark, LICENSES="x"))).columns
    assert "PII_spans" not in counted(pii.detect(frame(spark, PII_spans="x"), None)).columns
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    model = quality.train(frame(spark, QUALITY="x").drop("QUALITY"), labels)
    assert "Quality_Score" not in counted(quality.scored(frame(spark, Quality_Score="x"), model)).columns
    coded = counted(bpe.encode_documents(frame(spark, IDS="x", N_Tokens="y", Ids_SHA256="z"), path))
    assert counted(bpe.digest(coded, path)).columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"]
    made = counted(media.encode_column(frame(spark, N_BYTES="x", Media="y")))
    counted(media.index_column(made.withColumnRenamed("doc_id", "FRAMES")))


@pytest.mark.parametrize("kind", ["int", "string"])
def test_types_of_ids(spark, kind):
    docs = frame(spark, kind)
    labels = docs.selectExpr("doc_id", "cast(length(text) % 2 as int) AS quality")
    counted(quality.scored(docs, quality.train(docs, labels)))
    counted(pii.detect(docs, None))
    counted(licenses.scan(docs))
    rows = [r.root for r in merkle.manifest(docs, ("doc_id", "text"), "text", "doc_id", merkle.F.col("doc_id")).collect()]
    assert len(rows) == 30 and len(set(rows)) == 1
    if kind == "int":
        found = counted(neardup.near_duplicates(docs)).collect()
        assert {r.component_id for r in found} == {0}
        v = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(30)], "vec_id int, embedding array<double>")
        assert hashing.search(hashing.build(hashing.sound(v)), hashing.sound(v).where("id = 20")).count() == 20
        assert topk.top_k(topk.integer_vectors(v).where("id = 20"), topk.integer_vectors(v)).count() == 10
        words = docs.select(variants.F.explode(variants.occurrences(variants.F.col("text"), 4)).alias("word"))
        assert variants.counted(words, 4).count() > 0
