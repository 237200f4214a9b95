"""Toxicity by compression distance: which of two zstandard dictionaries makes a window shorter.

A window is a word, without punctuation around it, between constant bytes that both dictionaries
know (a frame as short as a bare word would be stored as it is, and lengths would tell nothing).
The toxic dictionary is made of words that recur in toxic texts and hardly elsewhere; the ordinary
one of the ordinary texts' words that are most like them, so that what both kinds of text share
makes both lengths shorter. Compression is at a level with optimal parsing, so lengths are those of
the best matches. How many bytes the toxic dictionary saves, with the window's length, is a class;
the calibration, on texts that the dictionaries weren't made from, gives each class the log ratio of
the shares of toxic and ordinary texts that have such a window. A text's score is a logistic
function of its highest ratio, the sum of its highest few and its number of words.

Dictionaries and calibration come from a bounded sample of labelled rows: SAMPLE texts of each label
and SAMPLE_BYTES at most, by hash of the id, whole texts; texts longer than TEXT_BYTES aren't sampled.
All windows of all texts are scored.
Workers remember words' ratios; a word that shares no four bytes with the toxic dictionary can't be
made shorter by it and isn't compressed.

Null and empty texts have no windows, and the score of a text without. Rows without an id aren't held
out, and never labelled. Labels that contradict each other count as toxic; other than 0 and 1 they are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.shared import joined, utf8

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 4000, 32 << 20, 1 << 20
#: A toxic word is in so many sampled texts at least, and so many times likelier in a toxic one; ordinary words in the dictionary, at most.
LEAST_TEXTS, LEAST_ODDS, MOST_ORDINARY = 3, 20.0, 6000
BEFORE, AFTER = b"~carrier of some more bytes", b"@tail=of.ten"
PUNCTUATION = b".,;:!?#$%&*|\"'()[]<>"
LEVEL, SHORTEST = 19, 4
HIGHEST = 8
#: Share of toxic texts that scores are calibrated for, whatever the sample's.
PRIOR = 0.25
MOST_WORDS = 500_000


class Trained(NamedTuple):
    """What workers need: both dictionaries, the classes' log ratios, and the logistic function's weights."""

    toxic: bytes
    ordinary: bytes
    ratios: dict[tuple[int, int], float]
    weights: tuple[float, ...]


def compressor(content: bytes):
    import zstandard

    content += BEFORE
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), min_match=SHORTEST, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


class Windows(dict):
    """The class of a word: bytes that the toxic dictionary saves, and the word's length; (0, 0) where it saves none."""

    def __init__(self, trained: Trained):
        super().__init__()
        self.a, self.b = compressor(trained.ordinary), compressor(trained.toxic)
        self.parts = {trained.toxic[i : i + SHORTEST] for i in range(len(trained.toxic) - SHORTEST + 1)}

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > MOST_WORDS:
            self.clear()
        w = word.strip(PUNCTUATION)
        bare = b" " + w + b" "
        found = (0, 0)
        if any(bare[i : i + SHORTEST] in self.parts for i in range(len(bare) - SHORTEST + 1)):
            window = BEFORE + bare + AFTER
            saved = len(self.a.compress(window)) - len(self.b.compress(window))
            if saved > 0:
                found = (min(saved, 9), min(len(w), 16))
        self[word] = found
        return found


def words_of(text: bytes) -> set[bytes]:
    return set(text.lower().split())


def features(classes: list[tuple[int, int]], ratios: dict[tuple[int, int], float], n: int) -> tuple[float, float, float, float]:
    top = sorted((ratios.get(c, 0.0) for c in classes if c != (0, 0)), reverse=True)[:HIGHEST]
    top = [x for x in top if x > 0]
    return 1.0, top[0] if top else 0.0, sum(top), math.log1p(n)


def logistic(x: np.ndarray, y: np.ndarray, prior: float = PRIOR, penalty: float = 0.5) -> np.ndarray:
    """Weights of a logistic function by Newton steps, labels weighed as if the prior share had label 1; weights but the first are drawn to 0."""
    w, pull = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    pull[0, 0] = 1e-3
    weigh = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weigh * (y - p)) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(samples: list[tuple[int, bytes, int]]) -> Trained:
    """samples: (id, text, label 0 or 1). Ids' order parts them: three fifths make the dictionaries, the rest calibrates."""
    samples = sorted(samples)
    part = lambda k: k % 5 < 3
    made: list[list[set[bytes]]] = [[], []]
    for k, (_, text, label) in enumerate(samples):
        if part(k):
            made[label].append({w.strip(PUNCTUATION) for w in words_of(text)})
    ordinary, toxic = (Counter(w for t in texts for w in t) for texts in made)
    share = lambda n, texts: n / max(1, len(texts))
    marked = sorted((n, w) for w, n in toxic.items() if n >= LEAST_TEXTS and len(w) > 3 and share(n, made[1]) >= LEAST_ODDS * share(ordinary[w] + 0.5, made[0]))
    parts = {w[i : i + 5] for _, w in marked for i in range(len(w) - 4)}
    alike = sorted((n, w) for w, n in ordinary.items() if any(w[i : i + 5] in parts for i in range(len(w) - 4)))[-MOST_ORDINARY:]
    content = lambda found: b" " + b" ".join(w for _, w in found) + b" "
    draft = Trained(content(marked), content(alike), {}, ())
    windows = Windows(draft)
    held: list[list[tuple[list[tuple[int, int]], int]]] = [[], []]
    for k, (_, text, label) in enumerate(samples):
        if not part(k):
            words = words_of(text)
            held[label].append(([windows[w] for w in words], len(words)))
    seen = [Counter(c for classes, _ in h for c in set(classes)) for h in held]
    ratios = {c: math.log((seen[1][c] + 0.5) / (len(held[1]) + 1) / ((seen[0][c] + 0.5) / (len(held[0]) + 1))) for c in {*seen[0], *seen[1]} - {(0, 0)}}
    x = np.array([features(classes, ratios, n) for h in held for classes, n in h]).reshape(-1, 4)
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    return draft._replace(ratios=ratios, weights=tuple(logistic(x, y).tolist()) if len(x) else (-3.0, 0.0, 0.0, 0.0))


def sample(docs: DataFrame, labels: DataFrame, folds: int = 5) -> list[tuple[int, bytes, int]]:
    """The bounded sample of labelled rows outside the held-out fold: (hash of the id, text, label)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0).withColumn("h", F.xxhash64("doc_id"))
    out = []
    for label in (0, 1):
        few = known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("labelled"), "h")
        texts = docs.join(F.broadcast(few), F.col("doc_id") == F.col("labelled")).select("h", F.coalesce("text", F.lit("")).cast("binary").alias("text")).dropDuplicates(["h"]).where(F.octet_length("text") <= TEXT_BYTES)
        size = F.sum(F.octet_length("text")).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out += [(r["h"], bytes(r["text"]), label) for r in texts.withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES).drop("size").collect()]
    return out


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text), from labels(doc_id, toxic) outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trained = fit(sample(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, weights = Windows(trained), np.array(trained.weights)
        for t in joined(batches):
            found = []
            for text in utf8(t):
                words = words_of(text)
                found.append(features(list(map(windows.__getitem__, words)), trained.ratios, len(words)))
            score = 1 / (1 + np.exp(-np.clip(np.array(found) @ weights, -30, 30)))
            yield pa.record_batch({"doc_id": t["doc_id"].combine_chunks(), "held_out": t["held_out"].combine_chunks(), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    own = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return rows.withColumn("held_out", own).mapInArrow(run, SCHEMA)
