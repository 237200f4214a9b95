"""Mixing sources to target weights by the cube method.

A source whose target is t times its size takes each of its documents floor(t) times, and a balanced
sample of them once more: all start with the probability t - floor(t), and the flight phase moves the
probabilities of three documents at a time along the null space of the two balancing equations (words
and documents), which fixes one of the three at 0 or 1 and leaves both totals as they were. That is
done in groups of a source's documents, dealt by a hash of the id; the two or fewer that each group
leaves undecided meet in further levels of groups, until a source has one group. What it leaves, two
documents at most, is the landing problem, decided to miss the totals least.

A group holds GROUP documents at most on average, however large a source; nothing but ids and sizes
is shuffled. Directions come from hashes of ids and levels, so reruns agree.

Null texts have size 0; a null source is one, the last; null ids and repeated rows are documents of
their own (which of two equal rows is taken makes no difference to the result's rows). Extra columns
are kept by copies(), under their own names, and dropped by mix().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.shared import WORD, cut, unused

WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words, and the most times that a source is repeated.
SHARE, MOST_REPEATS = 1.5, 2.0
GROUP = 4096
EPSILON = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, target) of sizes(source, size): one row per source.

    Weights go round by the sources' order. Sources are filled in order of the share of their weight
    that fills them; the water level is the highest that any prefix of filled ones leaves to the rest.
    The windows see a row per source, not documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(at - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumn("words", share * F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("words") - before) / rest)
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def flight(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves the probabilities p until two or fewer lie between 0 and 1; keeps sum(p) and sum(size * p). draw: a number in [0, 1) for each step."""
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    u = draw.tolist()
    waiting = [i for i, x in enumerate(p) if EPSILON < x < 1 - EPSILON]
    held, at, step = waiting[:3], 3, 0
    while len(held) == 3:
        a, b, c = held
        v = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(v):
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[i] if x > 0 else p[i]) / abs(x) for i, x in zip(held, v, strict=True) if x)
        down = min((p[i] if x > 0 else 1 - p[i]) / abs(x) for i, x in zip(held, v, strict=True) if x)
        t = up if u[step % len(u)] * (up + down) < down else -down
        step += 1
        for i, x in zip(held, v, strict=True):
            p[i] += t * x
            if p[i] <= EPSILON or p[i] >= 1 - EPSILON:
                p[i] = float(round(p[i]))
        held = [i for i in held if 0 < p[i] < 1]
        while len(held) < 3 and at < len(waiting):
            held.append(waiting[at])
            at += 1
    return np.array(p)


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Decides what the flight left, two at most, so that the words miss their total least, then the documents."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    ways = [[k >> j & 1 for j in range(len(left))] for k in range(1 << len(left))]

    def misses(way: list[int]) -> tuple[float, float]:
        return (abs(sum((w - p[i]) * float(size[i]) for w, i in zip(way, left, strict=True))), abs(sum(w - p[i] for w, i in zip(way, left, strict=True))))

    p = p.copy()
    for i, w in zip(left, min(ways, key=misses), strict=True):
        p[i] = w
    return p


def _level(rows: DataFrame, level: int, groups: DataFrame, last: bool) -> DataFrame:
    """One level of groups over rows(doc_id, size, source, text_hash, p); groups(source, n): how many groups a source has."""

    def run(table: pa.Table) -> pa.Table:
        key, size, text_hash, p = (table[c].to_numpy() for c in ("key", "size", "text_hash", "p"))
        order = np.lexsort((text_hash, size, key))
        size, p, key = size[order], p[order], key[order].astype(np.uint64)
        draw = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / float(1 << 53)
        done = flight(size, p, draw)
        if last:
            done = landing(size, done)
        out = np.empty(len(done))
        out[order] = done
        return table.select(["doc_id", "size", "source", "text_hash"]).append_column("p", pa.array(out))

    keyed = rows.withColumn("key", F.xxhash64("doc_id", "size", F.lit(level)))
    dealt = keyed.join(groups.withColumnRenamed("source", "group_source"), F.col("source").eqNullSafe(F.col("group_source"))).drop("group_source")
    dealt = dealt.withColumn("part", F.pmod(F.shiftright("key", 3), F.col("n"))).drop("n")
    return dealt.groupBy("source", "part").applyInArrow(run, "doc_id long, size long, source string, text_hash long, p double")


def size_of(text: str) -> Column:
    """A text's number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(doc_id, size, source, text_hash, source_size, target, times, taken) for each row of docs(doc_id, text, source): how often the mix takes it, and how many words that is."""
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of("text").alias("size"), "source", F.xxhash64("text").alias("text_hash")), "sizes")
    shares = cut(targets(sizes, weights, share, most), "targets")
    times = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    own = shares.select(F.col("source").alias("own"), "source_size", "target", F.floor(times).alias("whole"), (times - F.floor(times)).alias("part_of"), "n_docs")
    whole = own.select(F.col("own").alias("source"), "part_of", "n_docs")
    rows = sizes.join(own.select("own", F.col("part_of").alias("p")), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    most_left, level, decided = shares.agg(F.max("n_docs")).first()[0] or 0, 0, []
    n = whole.select("source", F.ceil(F.col("n_docs") / GROUP).cast("long").alias("n"))
    while True:
        last = most_left <= GROUP
        done = cut(_level(rows, level, n.withColumn("n", F.lit(1).cast("long")) if last else n, last), "flight")
        undecided = F.col("p").between(EPSILON, 1 - EPSILON)
        if last:
            decided.append(done)
            break
        decided.append(done.where(~undecided))
        rows, level, most_left = done.where(undecided), level + 1, 2 * math.ceil(most_left / GROUP)
        n = n.select("source", F.ceil(2 * F.col("n") / GROUP).cast("long").alias("n"))
    chosen = decided[0]
    for d in decided[1:]:
        chosen = chosen.unionByName(d)
    out = chosen.join(own, F.col("source").eqNullSafe(F.col("own")))
    count = (F.col("whole") + F.round("p").cast("long")).cast("long")
    return out.select("doc_id", "size", "source", "text_hash", "source_size", "target", count.alias("times"), (count * F.col("size")).alias("taken"))


def copies(docs: DataFrame, copy: str = "copy", **how) -> DataFrame:
    """docs, each row as often as the mix takes it, with the copy's number from 1, in a column of that name, or with underscores after it where docs has that name.

    Rows are known by id, size, source and their text's hash; what the mix takes of rows equal in all
    four is dealt among them evenly. Only for such rows does a window sort anything; sums stand for them otherwise.
    """
    own = ["doc_id", "size", "source", "text_hash"]
    key = [unused(docs.columns, c) for c in ("own_id", "own_size", "own_source", "own_hash")]
    n, sure, more, at, copy = (unused(docs.columns, c) for c in ("n_alike", "n_sure", "n_more", "n_before", copy))
    taken = mix(docs, **how).groupBy(*own).agg(F.count("*").alias(n), F.sum("times").alias(more)).where(F.col(more) > 0)
    taken = taken.select(*(F.col(c).alias(k) for c, k in zip(own, key, strict=True)), n, F.floor(F.col(more) / F.col(n)).alias(sure), (F.col(more) % F.col(n)).alias(more))
    values = (F.col("doc_id").cast("long"), size_of("text"), F.col("source"), F.xxhash64("text"))
    same = F.lit(True)
    for k, v in zip(key, values, strict=True):
        same = same & F.col(k).eqNullSafe(v)
    joined = docs.join(taken, same)
    alike = Window.partitionBy(*key).orderBy(F.lit(0))
    single = joined.where(F.col(n) == 1).withColumn(at, F.lit(0))
    several = joined.where(F.col(n) > 1).withColumn(at, F.row_number().over(alike) - 1)
    times = F.col(sure) + (F.col(at) < F.col(more)).cast("long")
    out = single.unionByName(several).where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return out.select(*docs.columns, copy)
