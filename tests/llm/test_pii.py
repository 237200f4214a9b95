import hashlib
import random
import re

from pyspark.sql import functions as F

from strataflow.llm import pii as P
from strataflow.llm.shared import documents

# The stated patterns.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    n = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 14 <= len(n) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0
    return kind == "email" or 10 <= len(n) <= 15


def base(text):
    spans = sorted((m.start(), i, k, m.end()) for i, k in enumerate(STATED) for m in re.finditer(STATED[k], text or "") if passes(k, m[0]))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def reported(df):
    return {r.doc_id: r for r in P.report(df).collect()}


def test_base_spans_equal_the_stated_patterns(spark, sf):
    docs = documents(spark, sf)
    got = reported(docs)
    for d in docs.collect():
        want, r = base(d.text), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(f"{k}:", want)) for k in STATED]


def test_random_texts(spark):
    rng = random.Random(4)
    bits = ["@", ".", "a", "é", "😀", "+1", "+", "(", ")", " ", "-", "4242", "42", "0", "255", "256", "\n", "a@b.c", "_", "1.2.3.4", "4242424242424242", "%"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(600)]
    texts += ["a@b.c_d@e.f.", "1.2.3.4.5.6.7.8", "+1 (555) 555-1234 +2 5555555555 3", "0000255.1.1.1 256.1.1.1", "4242 4242 4242 4242-1", None, "", "1" * 3000, "x" * 3000 + "@", "a-" * 2000, "+1" + " " * 3000, "9 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = reported(df)
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(base(t).encode()).hexdigest(), t


def test_very_long_texts_take_linear_time(spark):
    texts = ["1" * 100000, "x" * 100000 + "@", "a-" * 50000, "+1" + " " * 100000, "9 " * 50000, "1.2.3." * 16000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [sum(r[1:5]) for r in sorted(map(tuple, P.report(df).collect()))] == [0, 0, 0, 0, 0, 12000]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"Some words. Contact: user{i}@mail.example.com and so on, order 7{i} was sent") for i in range(8)]
    rows += [(100, "Another text. Contact: 99-4411-xk and so on"), (101, "nothing to see: page 123456 of a book"), (102, "a plain text")]
    got = reported(spark.createDataFrame(rows, "doc_id long, text string"))
    start = rows[8][1].index("99-")
    assert got[100].spans == f"id:{start}:{start + 10}" and got[100].n_email == 0
    assert got[101].spans == got[102].spans == ""
    assert all(got[i].spans.startswith("email:") and "," not in got[i].spans for i in range(8))


def test_redaction(spark):
    rows = [(1, "é a@b.co, call +1 (555) 555-1234 now", "en"), (1, "é a@b.co, call +1 (555) 555-1234 now", "en"), (2, None, "fr"), (None, "9.8.7.6", "x"), (3, "clean", "x")]
    out = P.redact(spark.createDataFrame(rows, "doc_id long, text string, base string"))
    assert out.columns == ["doc_id", "text", "base"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(["é [EMAIL], call [PHONE] now"] * 2 + ["None", "[IP]", "clean"])


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a@b.c", "q"), (1, "a@b.c", "q"), (None, None, "q")], "doc_id long, text string, row string")
    got = [tuple(r) for r in P.report(df).collect()]
    assert len(got) == 3 and got.count((1, 1, 0, 0, 0, hashlib.sha256(b"email:0:5").hexdigest(), "email:0:5")) == 2
    assert P.report(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = P.report(documents(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_found_identifiers_are_seeds_of_the_next_round(spark):
    rows = [(i, f"Some words. Contact: user{i}@mail.example.com and so on") for i in range(8)]
    rows += [(100 + i, f"Another text. Contact: 99-44{i}1-xk and so on") for i in range(6)]
    rows += [(200 + i, f"see ticket= 99-44{i}1-xk !") for i in range(6)] + [(300, "a ticket= 55-1234-zz ."), (301, "some page= 123456 .")]
    got = reported(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[100 + i].spans.startswith("id:") for i in range(6))
    assert got[300].spans == "id:10:20" and got[301].spans == ""


def test_labelled_secrets_of_letters_are_discovered(spark):
    rows = [(i, f"Some words. api_key: user{i}@mail.example.com and so on") for i in range(6)]
    rows += [(100, "x api_key: sk-qwertyuiopasdfgh , y"), (101, 'see "api_key:" but not this'), (102, "x api_key:plainletters y"), (103, "note: nothing here")]
    got = reported(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[100].spans == "id:11:30" and got[102].spans == "id:10:22"
    assert got[103].spans == ""


def test_contexts_are_whole_words(spark):
    common = "z" * 80
    rows = [(i, f"some {'a' * 13}{common} user{i}@mail.example.com and so on") for i in range(6)]
    rows += [(100, f"some {'b' * 13}{common} 44-1234 and more"), (101, f"some {'a' * 13}{common} 44-1234 and more")]
    got = reported(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[100].spans == "" and got[101].spans.startswith("id:")


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a@b.co now", "x", "y", 3), (2, "plain", "x", "y", 4)], "doc_id long, text string, found_row string, found_spans string, row int")
    out = sorted(map(tuple, P.redact(df).collect()))
    assert out == [(1, "[EMAIL] now", "x", "y", 3), (2, "plain", "x", "y", 4)]


def test_very_long_words_around_take_linear_time(spark):
    rows = [(i, "w" * 200000 + " " + "v" * 200000 + f" 12-3456{i} " + "u" * 200000) for i in range(3)]
    assert P.report(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def brute_masked(text, spans):
    names, out, at = ["EMAIL", "IP", "CARD", "PHONE", "ID"], "", 0
    for s, k, e in spans:
        if s >= at:
            out += text[at:s] + f"[{names[k]}]"
        at = max(at, e)
    return out + text[at:]


def test_masks_of_any_size_equal_brute_force(spark):

    rng = random.Random(1)
    rows = []
    for n in (1, 5, 300, 3000):
        text = "".join(rng.choice("aé東🙂 \n") for _ in range(n * 7))
        starts = sorted(rng.sample(range(len(text) - 3), n))
        rows.append((text, [(s, rng.randrange(5), s + rng.randrange(1, 9)) for s in starts]))
    df = spark.createDataFrame([*rows, ("kept", [])], "text string, spans array<struct<s:int,k:int,e:int>>")
    got = [r[0] for r in df.select(P.masked(F.col("text"), F.col("spans"))).collect()]
    assert got == [brute_masked(t, x) for t, x in [*rows, ("kept", [])]]


def test_many_spans_in_a_text_take_linear_time(spark):
    """Seeds among candidates; twice the spans take about twice the time, in the report and the redaction."""
    import time

    def seconds(f, n):
        text = " ".join(f"id: k{i}-7 u{i}@a.bc" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        f(df).write.format("noop").mode("overwrite").save()
        return time.time() - began

    for f in (P.report, P.redact):
        seconds(f, 100)
        once, twice = seconds(f, 8_000), seconds(f, 16_000)
        assert twice < 3 * once + 2, (once, twice)
        assert twice < 30
