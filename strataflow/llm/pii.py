"""Personal data: base patterns, and identifiers that bootstrapped contexts discover.

Base spans are the leftmost matches, without overlap per kind, of four patterns, checked further by
kind. They are the seeds. A slot is a seed or any other token that might be an identifier, outside all
seeds: one with a digit or with a sign between letters, or any token after a label (a word that ends in
: or =, or what stands before such a sign within a word). It comes with the lexical patterns it stands
in, of whole words however long: the two words before it, the words on both sides, or the label. Patterns and the values
in their slots form a graph, which is scored in rounds: a pattern is as good as the mean of its
values' scores, a value as good as its patterns together (one less the product of what each leaves).
Seeds stay at 1. Values that reach a high score count as seeds of the next round, each as much as its
score. A pattern with enough seeds and a high score then makes spans of kind id of its other slots.

All of it is DataFrame functions. Text is scanned once; beyond that scan there are only slots, few
per document. Graph edges are distinct (pattern, value) pairs with partial aggregates before each
shuffle, so a pattern in a third of all documents is a row per task. Rows are known by two hashes of id
and text (128 bits). Positions are code points, ends exclusive. Null texts are empty; repeated rows
give repeated results; a doc_id may be null. Extra columns are kept by redact(), under their own
names and with their values whatever those are, and dropped by report().

The patterns below are the stated ones in forms that a backtracking matcher runs in linear time:
possessive where nothing that follows could use what is given back, and begun only where a leftmost
match can begin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.shared import cut, unused

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN, _PART = (rf"[A-Za-z0-9](?:[A-Za-z0-9._{more}/+-]*[A-Za-z0-9])?" for more in (":=", ""))
#: A token that may be an identifier: any after a label, with what stands between; one of four digits or more; or one with a digit, or a sign between letters, that is no label itself.
CANDIDATE = (
    rf"(?<=[:=])[\x20\x09-\x0D]*+[\"'(]?+{_TOKEN}"
    rf"|(?<![A-Za-z0-9._:/+=-])(?:(?![A-Za-z._/+-]++[:=])(?=(?:[A-Za-z._:/+=-]*+[0-9]){{4}}){_TOKEN}"
    rf"|(?=[A-Za-z]*+(?:[0-9]|[._/+-]++[A-Za-z0-9]))(?>{_PART})(?![:=]))"
)
_SPACES, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
ROUNDS, LEAST_SEEDS, LEAST_SCORE = 3, 3, 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value found once for a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches whose positions are summed at once; appending within such blocks keeps long texts linear.
BLOCK = 256
FOUND = "struct<s:int,e:int,v:string,b:string,l:string,r:string>"


def around(gap: Column, following: Column) -> list[Column]:
    """Of what stands before a match the last two words (b, l), of what follows the first (r); words are found from the match outwards, in linear time however long they are."""
    back = F.reverse(gap)
    word = lambda text, before: F.regexp_extract(text, rf"^{before}({_WORD}++)", 1)
    return [F.reverse(word(back, rf"{_SPACES}*+{_WORD}++{_SPACES}++")).alias("b"), F.reverse(word(back, rf"{_SPACES}*+")).alias("l"), word(following, rf"{_SPACES}*+").alias("r")]


def matches(text: Column, pattern: str) -> Column:
    """All matches as structs (s, e, v, b, l, r): start, end, value, the two words left of it and the one right of it, up to the neighbouring matches.

    Splitting at the pattern gives the gaps; positions are running sums of lengths, found in blocks first.
    """

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["v"])
        one = F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"), *around(x["gap"], x["next"]))
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    def block(b: Column) -> Column:
        return F.aggregate(b, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("all")), place)

    def move(acc: Column, b: Column) -> Column:
        moved = F.transform(b["all"], lambda m: F.struct((m["s"] + acc["at"]).alias("s"), (m["e"] + acc["at"]).alias("e"), m["v"].alias("v"), m["b"].alias("b"), m["l"].alias("l"), m["r"].alias("r")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(moved)).alias("all"))

    def gaps(found: Column) -> Column:
        def pairs(g: Column) -> Column:
            before = F.zip_with(F.slice(g, F.lit(1), F.size(found)), found, lambda gap, v: F.struct(gap.alias("gap"), v.alias("v")))
            return F.zip_with(before, F.slice(g, F.lit(2), F.size(found)), lambda x, n: F.struct(x["gap"].alias("gap"), x["v"].alias("v"), n.alias("next")))

        return let(F.split(text, pattern, -1), pairs)

    def placed(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: block(F.slice(p, i * BLOCK + 1, BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{FOUND}>>").alias("all"))
        return F.aggregate(blocks, start, move, lambda acc: F.flatten(acc["all"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(gaps(found), placed)).otherwise(F.array().cast(f"array<{FOUND}>")))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def holds(kind: str, v: Column) -> Column:
    """What is asked of a match beyond its pattern."""
    n = F.length(digits(v))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(v))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ip":
        return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    return F.lit(True)


#: What a text must have for any match, found faster than by the pattern.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}
SPANS = "array<struct<s:int,k:int,e:int>>"
SLOTS = "array<struct<s:int,k:int,e:int,v:string,patterns:array<string>>>"


def slots_of(text: Column, k: int) -> Column:
    """Matches of kind k (its place in KINDS; after the last, candidates) as slots: span, value in lower case, and the lexical patterns it stands in."""
    if k < len(KINDS):
        kept = F.filter(matches(text, PATTERNS[KINDS[k]]), lambda m: holds(KINDS[k], m["v"]))
        needed = NEEDS[KINDS[k]](text)
    else:
        bare = F.transform(matches(text, CANDIDATE), lambda m: F.struct(F.regexp_replace(m["v"], rf"^{_SPACES}*+[\"'(]?+", "").alias("v"), *(m[c].alias(c) for c in "eblr")))
        kept = F.transform(bare, lambda m: F.struct((m["e"] - F.length(m["v"])).alias("s"), *(m[c].alias(c) for c in "evblr")))
        needed = text.rlike("[A-Za-z0-9][._:/+=-]|[0-9:=]")
    slots = F.transform(kept, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), F.lower(m["v"]).alias("v"), contexts(F.lower(m["b"]), F.lower(m["l"]), F.lower(m["r"])).alias("patterns")))
    return F.when(needed, slots).otherwise(F.array().cast(SLOTS))


def contexts(second: Column, last: Column, first: Column) -> Column:
    """The lexical patterns of a place, as strings: from the two words before it, and the one after."""
    some = F.array(
        F.when(second != "", F.concat_ws(" ", F.lit("before"), second, last)),
        F.when((last != "") & (first != ""), F.concat(F.lit("around "), last, F.lit(" _ "), first)),
        F.when(last.rlike("[:=]$"), F.concat(F.lit("label "), last)),
    )
    return F.filter(some, lambda p: p.isNotNull())


def row_key(doc_id: Column, text: Column) -> Column:
    """Two hashes of a row, 128 bits."""
    return F.struct(F.xxhash64(doc_id, text).alias("h1"), F.xxhash64(F.lit("second"), text, doc_id).alias("h2"))


def scanned(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, row, base, slots): a row's key, its base spans in order, and all its slots."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", row_key(F.col("doc_id"), text).alias("row"), F.concat(*[slots_of(text, k) for k in range(len(KINDS) + 1)]).alias("slots"))
    base = F.transform(F.filter("slots", lambda x: x["k"] < len(KINDS)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return rows.withColumn("base", F.sort_array(base))


def apart(slots: DataFrame) -> DataFrame:
    """slots(row, s, k, e, v, patterns) without the candidates that overlap a seed of their row."""
    seed = F.col("k") < len(KINDS)
    order = Window.partitionBy("row").orderBy("s", "k")
    reached = F.max(F.when(seed, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k"))  # frames that only grow take one step a row
    following = F.min(F.when(seed, F.col("s"))).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = slots.withColumn("reached", F.coalesce(reached, F.lit(0))).withColumn("following", following)
    return rows.where(seed | ((F.col("reached") <= F.col("s")) & (F.col("following").isNull() | (F.col("following") >= F.col("e"))))).drop("reached", "following")


def scored(slots: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, seeds) of slots(v, k, pattern): the graph's patterns after so many rounds, and how many distinct seeds each has, values found in earlier rounds by their score."""
    edges = cut(slots.groupBy("pattern", "v").agg(F.max((F.col("k") < len(KINDS)).cast("int")).alias("seed")), "edges")
    known = edges.groupBy("v").agg(F.max("seed").cast("double").alias("known"))
    score = known.select("v", F.col("known").alias("score"))
    for at in range(rounds):
        pattern = cut(edges.join(score, "v").groupBy("pattern").agg(F.avg("score").alias("good"), F.sum(F.when(F.col("score") >= LEAST_SCORE, F.col("score")).otherwise(0.0)).alias("seeds")), "patterns")
        if at < rounds - 1:
            left = F.sum(F.log(F.greatest(1 - F.least("good", F.lit(0.99)), F.lit(1e-9))))
            score = edges.join(pattern.where(f"seeds >= {LEAST_SEEDS}"), "pattern").groupBy("v").agg((1 - F.exp(left)).alias("reached"))
            score = cut(known.join(score, "v", "left").select("v", F.when(F.col("known") == 1, 1.0).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score")), "scores")
    return pattern.select("pattern", F.col("good").alias("score"), "seeds")


def find(docs: DataFrame, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, row, base, spans) for each row of docs(doc_id, text): base spans, and all spans in order."""
    rows = cut(scanned(docs), "pii")
    slots = cut(apart(rows.where(F.size("slots") > 0).dropDuplicates(["row"]).select("row", F.explode("slots").alias("x")).select("row", "x.*")), "slots")
    slots = slots.select("row", "s", "e", "v", "k", F.explode("patterns").alias("pattern"))
    good = scored(slots).where((F.col("seeds") >= least_seeds) & (F.col("score") >= least_score)).select("pattern")
    span = F.struct("s", F.lit(len(KINDS)).alias("k"), "e").alias("x")
    found = slots.where(F.col("k") == len(KINDS)).join(good, "pattern", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set(span)).cast(SPANS).alias("found"))
    out = rows.select("doc_id", "row", "base").join(found, "row", "left")
    return out.select("doc_id", "row", "base", F.sort_array(F.concat("base", F.coalesce("found", F.array().cast(SPANS)))).alias("spans"))


def name(span: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "id")]), span["k"] + 1)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs(doc_id, text)."""


    def n(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return find(docs).select("doc_id", *map(n, range(len(KINDS))), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: Code points of a text's piece, and spans put together at once.
PIECE, AT_ONCE = 1024, 256


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or each run of overlapping ones, replaced by its first kind in brackets.

    The text is cut to pieces once, from which what lies between spans is taken, and spans go in blocks
    whose strings are joined once: the time is linear in the text and in its spans.
    """

    def replaced(pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            own = lambda i: F.substring(F.get(pieces, i), F.greatest(a - i * PIECE, F.lit(0)) + 1, F.least(b - i * PIECE, F.lit(PIECE)) - F.greatest(a - i * PIECE, F.lit(0)))
            return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")), own), "")).otherwise("")

        def step(acc: Column, x: Column) -> Column:
            fresh = F.array_append(acc["out"], F.concat(between(acc["at"], x["s"]), F.lit("["), F.upper(name(x)), F.lit("]")))
            return F.struct(F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

        def block(acc: Column, i: Column) -> Column:
            start = F.struct(F.array().cast("array<string>").alias("out"), acc["at"].alias("at"))
            done = F.aggregate(F.slice(spans, i * AT_ONCE + 1, AT_ONCE), start, step)
            return let(done, lambda d: F.struct(F.array_append(acc["all"], F.array_join(d["out"], "")).alias("all"), d["at"].alias("at")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / AT_ONCE).cast("int"))
        start = F.struct(F.array().cast("array<string>").alias("all"), F.lit(0).alias("at"))
        return F.aggregate(blocks, start, block, lambda acc: F.concat(F.array_join(acc["all"], ""), between(acc["at"], F.size(pieces) * PIECE)))

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), replaced)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans of text replaced; other columns, and null texts, as they are. Texts without a digit or one of @ . _ : / + = - have no span, and pass by the join that brings the others their spans."""
    row, spans = unused(docs.columns, "found_row"), unused(docs.columns, "found_spans")
    found = find(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(spans)).dropDuplicates([row])
    may = F.coalesce(F.col("text").rlike("[0-9@._:/+=-]"), F.lit(False))
    joined = docs.where(may).join(found.hint("merge"), row_key(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))) == F.col(row), "left")
    text = F.when(F.col(spans).isNotNull(), masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return docs.where(~may).unionByName(joined.withColumn("text", text).select(*docs.columns))
