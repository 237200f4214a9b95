from collections import Counter

import corpus_pipeline
from test_decontamination import brute as brute_items
from test_mixing import check
from test_pii import base
from test_simhash import brute_components, brute_fingerprint

from strataflow.llm import mixing, quality_rules
from strataflow.llm.shared import documents


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 30000").cache()
    columns = docs.columns
    (_, good), (_, distinct), (_, clean), (_, private), (_, mixed) = corpus_pipeline.STAGES
    a = good(spark, docs, sf).cache()
    verdict = {r.doc_id: r.kept for r in quality_rules.quality(docs).collect()}
    assert {r.doc_id: r for r in docs.collect() if verdict[r.doc_id]} == by_id(a) and 0 < a.count() < docs.count()
    b = distinct(spark, a, sf).cache()
    groups = brute_components({r.doc_id: brute_fingerprint(r.text) for r in a.collect()})
    assert set(by_id(b)) == set(groups.values()) and b.count() < a.count()
    c = clean(spark, b, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = b.collect()
    assert set(by_id(c)) == {r.doc_id for r, found in zip(rows, brute_items([r.text for r in rows], items), strict=True) if not found}
    d = private(spark, c, sf).cache()
    before, after = by_id(c), by_id(d)
    assert set(before) == set(after)
    for i, r in after.items():
        assert base(r.text) == ""
        assert (r.text == before[i].text) == (base(before[i].text) == "") or "[ID]" in r.text
    assert all(x.columns == columns for x in (a, b, c, d))
    e = mixed(spark, d, sf)
    taken = mixing.mix(d).collect()
    check(taken, d.collect())
    assert Counter(r.doc_id for r in e.collect()) == Counter({r.doc_id: r.times for r in taken if r.times})


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*spark.read.parquet(f"{sf}/documents.parquet").columns, "copy"]
    assert out.count() > 0


def test_repeated_rows_and_empty_tables(spark, sf):
    text = "The end of the road is in that of a few words for which it was to be by one and all"
    rows = spark.createDataFrame([(7, text), (7, text), (5, text + " so"), (None, "x y"), (None, "x y")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.distinct(spark, rows, sf).collect()))) == ["5", "7", "None"]
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_one_row_of_each_group_stays_under_shared_and_null_ids(spark, sf):
    near = [" ".join(f"w{k}" for k in range(400)) + end for end in ("", " x", " y")]
    far = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(7, near[0]), (7, near[1]), (None, near[2]), (7, far[0]), (None, far[1]), (None, far[1]), (None, far[2]), (None, far[2] + ""), (9, None), (None, "")]
    groups = brute_components(dict(enumerate(brute_fingerprint(t or "") for _, t in rows)))
    assert len(set(groups.values())) == 5
    got = [(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()]
    assert len(got) == 5 and len({groups[rows.index(x)] for x in got}) == 5
    assert Counter(i for i, _ in got) == {7: 2, None: 2, 9: 1}


def test_extra_columns_that_clash_stay_as_they_are(spark, sf):
    names = ["quality_rules", "kept_id", "kept_hash", "text_hash", "repeat", "fp", "root", "benchmark_items", "found_row", "found_spans", "row", "times", "taken_id", "own_size", "own_id", "own_hash", "n_alike", "size", "part", "copy", "COPY_"]
    text = "The end of the road is in that of a few words for which it was to be by one and all, a@b.co said"
    other = "When they came to it at last the house was as old and quiet as it had been to all of us in the year"
    rows = [(1, text, "s", *[f"{n}!" for n in names]), (2, other, "s", *[f"{n}?" for n in names])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, source string", *[f"{n} string" for n in names]]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == {1, 2}, name
        assert all(got[i][n] == f"{n}{sign}" for i, sign in ((1, "!"), (2, "?")) for n in names), name
    assert out.columns[len(docs.columns) :] == ["copy__"] and got[2].text == other


def test_null_ids_of_one_size_are_taken_as_the_mix_says(spark, sf):
    rows = [(None, f"{w} b c d", s) for w in "abcdefgh" for s in "xyz"] + [(5, "q r", None)] * 7 + [(None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs).collect()
    out = mixing.copies(docs).collect()
    assert Counter((r.doc_id, len((r.text or "").split()), r.source) for r in out) == sum((Counter({(r.doc_id, r.size, r.source): r.times}) for r in taken if r.times), Counter())


def test_scratch_of_earlier_stages_is_deleted(spark, sf):
    import os

    from strataflow.llm import shared

    shared.clear(spark)
    folder = shared.checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert "stage" in left and not left & {"fingerprints", "pii", "slots", "kept", "items"}
    shared.clear(spark)
    assert set(os.listdir(folder)) == before
