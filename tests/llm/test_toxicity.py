import zlib

from strataflow.llm import toxicity as T
from strataflow.llm.shared import documents


def rates(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = T.toxicity(documents(spark, sf), labels).join(labels, "doc_id").where("held_out").collect()
    of = lambda label: [r.predicted for r in got if r.toxic == label]
    return sum(of(1)) / len(of(1)), sum(of(0)) / len(of(0))


def test_held_out_rows(spark):
    found, wrong = rates(spark, "/root/testdata/sf0.1")
    assert found >= 0.8 and wrong <= 0.03


def test_fold_range_nulls_and_clashing_names(spark, sf):
    docs = documents(spark, sf).limit(50).selectExpr("doc_id", "text", "'x' AS score", "1 AS toxic", "2 AS held_out")
    docs = docs.unionByName(spark.createDataFrame([(None, None, "x", 1, 2), (900, "", "x", 1, 2), (900, "", "x", 1, 2), (901, "idiot " * 30000, "x", 1, 2)], docs.schema))
    labels = spark.read.parquet(f"{sf}/labels.parquet").unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 7)], "doc_id long, quality int, toxic int"))
    got = T.toxicity(docs, labels).collect()
    assert len(got) == 54
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert T.toxicity(docs.limit(0), labels).count() == 0
    assert len({r.score for r in T.toxicity(docs, labels.limit(0)).collect()}) == 1


def test_held_out_labels_and_labels_of_others_are_not_used(spark, sf):
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    rows = lambda x: sorted((r.doc_id, r.score) for r in T.toxicity(docs, x).collect())
    assert rows(labels) == rows(flipped)


def test_one_huge_text_does_not_empty_the_sample(spark, monkeypatch):
    monkeypatch.setattr(T, "TEXT_BYTES", 2000, raising=False)
    monkeypatch.setattr(T, "SAMPLE_BYTES", 5000)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    first = {label: labels.where(f"toxic = {label}").selectExpr("doc_id").orderBy(T.F.xxhash64("doc_id")).first()[0] for label in (0, 1)}
    docs = spark.createDataFrame([(i, "some words " * (900 if i in first.values() else 2)) for i in ids], "doc_id long, text string")
    got = T.sample(docs, labels)
    assert len(got) == len(ids) - 2 and {x[2] for x in got} == {0, 1}
