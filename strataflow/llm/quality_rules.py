"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each text's counts are found once; ratios of them are held against the table's bounds in the same
projection. There is no shuffle, no user function and no join. Nulls count as empty texts, which
fail the base rules; repeated rows are judged each; a doc_id may be null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.shared import unused

# Frequent words without meaning of their own, of four languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "de la le et les des en un du une que pour est dans qui par sur pas au avec "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el y los se las del por con no una su para al es lo"
).split()
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Rule(NamedTuple):
    """ratio: numerator over denominator (at least 1), counts by name; a text is rejected below least or above most."""

    name: str
    numerator: str
    denominator: str
    least: float | None
    most: float | None


#: Of these, the counts by character are a share of the words' characters.
THRESHOLDS = (
    Rule("symbol share", "n_symbols", "word_chars", None, 0.05),
    Rule("exclamation share", "n_exclamations", "word_chars", None, 0.05),
    Rule("capitals share", "n_capitals", "word_chars", None, 0.5),
    Rule("mean word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("stop-word share", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.4),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value found once for a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in windows of so many words that occur twice or more among them.

    Windows are compared by 64-bit hashes of their words' hashes: sorted with their places, equal
    neighbours are repeats, and the union of the repeats' spans is counted. A text without repeats,
    as nearly all are, ends at the first comparison of distinct windows.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))

    def spans(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            n = F.size(p) - 1
            pairs = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(let(placed, twice), start, step, lambda acc: acc["n"])

    count = let(let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), spans(w)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > window, count).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """A struct of all counts of a text, as longs."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of(words: Column) -> list[Column]:
        return [F.size(words).alias("n_words"), repeated_words(words).alias("n_repeat_words"), F.size(F.filter(words, lambda w: F.array_contains(stop, F.lower(w)))).alias("n_stop_words")]

    def of_lines(lines: Column) -> list[Column]:
        return [F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")]

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    by_character = [
        without(text, SPACES).alias("word_chars"),
        (F.length(text) - without(text, SYMBOLS)).alias("n_symbols"),
        (F.length(text) - without(text, "!")).alias("n_exclamations"),
        (F.length(text) - without(text, capitals)).alias("n_capitals"),
    ]
    return F.struct(let(words, lambda w: F.struct(*of(w))).alias("w"), let(lines, lambda x: F.struct(*of_lines(x))).alias("l"), F.struct(*by_character).alias("c"))


COUNTS = {"n_words": "w", "n_repeat_words": "w", "n_stop_words": "w", "n_lines": "l", "n_dup_lines": "l", "word_chars": "c", "n_symbols": "c", "n_exclamations": "c", "n_capitals": "c"}


def verdict(c: dict[str, Column], rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """True where no rule of the table rejects."""
    kept = F.lit(True)
    for r in rules:
        ratio = c[r.numerator] / F.greatest(c[r.denominator], F.lit(1))
        for bound, fits in ((r.least, ratio >= r.least if r.least is not None else None), (r.most, ratio <= r.most if r.most is not None else None)):
            if bound is not None:
                kept = kept & fits
    return kept


def with_quality(docs: DataFrame, into: str = "quality_rules") -> DataFrame:
    """docs and a struct of all counts, base_failed and kept, in a column of that name, or with underscores after it where docs has that name."""
    into = unused(docs.columns, into)
    rows = docs.withColumn(into, counts(F.coalesce("text", F.lit(""))))
    c = {n: F.col(into)[part][n].cast("long") for n, part in COUNTS.items()}
    failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    return rows.withColumn(into, F.struct(*[v.alias(n) for n, v in c.items()], failed.alias("base_failed"), (~failed & verdict(c)).alias("kept")))


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs(doc_id, text)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return with_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *[F.col("quality_rules")[n].alias(n) for n in names])


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    sep = r"[^\x20\x09-\x0D]+"
    rules = " AND ".join(f"{r.numerator} / CAST(greatest({r.denominator}, 1) AS DOUBLE) {op} {b}" for r in THRESHOLDS for op, b in ((">=", r.least), ("<=", r.most)) if b is not None)
    return rf"""
WITH d AS (SELECT CAST(row_number() OVER () AS BIGINT) AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{sep}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{sep}')) AS ls FROM d),
e AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, len(ws) AS n, array_to_string(ws[i + 1 : i + {WINDOW}], ' ') AS g FROM (SELECT r, ws, unnest(range(len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) > {WINDOW})),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
q AS (SELECT r, sum(least({WINDOW}, i - coalesce(before, -{WINDOW}))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p) GROUP BY r),
s AS (SELECT r, count(*) FILTER (WHERE lower(w) IN ({stop})) AS n FROM e GROUP BY r),
c AS (SELECT d.doc_id, len(ws) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(t) - len(replace(t, '!', '')) AS n_exclamations, len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words, coalesce(s.n, 0) AS n_stop_words
  FROM d JOIN w USING (r) LEFT JOIN q USING (r) LEFT JOIN s USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM f"""


ORACLE_SQL = _oracle()
