import re

from strataflow.llm import quality_rules as Q
from strataflow.llm.shared import documents


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def rows(df):
    return sorted((tuple(r) for r in Q.quality(df).collect()), key=str)


def test_counts_equal_brute_force(spark, sf):
    docs = documents(spark, sf).where("length(text) < 20000")
    got = {r[0]: r[1:7] for r in rows(docs)}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_edges(spark):
    line = "the a of to in one two three four five six seven eight nine ten eleven twelve it is so"
    texts = [None, "", " \n\t ", line, line + "\n" + line, "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 300, "é# |\x0b😀\r\n\n\n😀", "w" * 200000 + " " + line]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in enumerate(texts)] + [(None, line, "z", 5), (3, line, "z", 5)], "doc_id long, text string, n_words string, kept int")
    assert {str((r[0], *r[1:7])) for r in rows(df)} == {str((i, *brute(t))) for i, t in enumerate(texts)} | {str((None, *brute(line)))}
    assert len(rows(df)) == 12
    kept = {r[0]: r[7] for r in rows(df)}
    assert kept[3] and kept[None] and not kept[0] and not kept[4] and not kept[7]
    assert rows(df.limit(0)) == []


def test_clean_documents_are_kept_and_junk_goes(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.quality(documents(spark, sf)).where("n_words >= 20").join(labels, "doc_id").groupBy("quality").agg({"*": "count", "kept": "count"}).collect()
    kept = {r.quality: r["count(1)"] for r in Q.quality(documents(spark, sf)).where("n_words >= 20 AND kept").join(labels, "doc_id").groupBy("quality").count().withColumnRenamed("count", "count(1)").collect()}
    total = {r.quality: r["count(1)"] for r in got}
    assert kept[1] >= 0.97 * total[1]
    assert kept.get(0, 0) <= 0.1 * total[0]


def test_one_projection(spark, sf):
    plan = Q.quality(documents(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
