"""Vector code compression: product codes by partial-distance search.

A vector's components become integers, floor(SCALE * x), and it is cut into PARTS consecutive parts. Each
part has a codebook, which starts as that part of the vectors of the ENTRIES smallest ids. Each of ROUNDS
rounds assigns every part to its nearest entry and moves each entry to its parts' mean; then all are
assigned once more. All of it is in integers, so results don't depend on order or partitioning.

Assignment is a partial-distance search, for a block of parts at once: dimensions go in descending order of
the codebook's variance. After the first of them, FIRST eighths, the entry that is least so far is completed, and its
distance is the best so far. From then on a mask drops each entry of each part whose accumulated distance
strictly exceeds that part's best; whenever a dimension has dropped half of them, the entries that are
least among those left are completed and may lower the best. What survives all dimensions has its complete
distance, and the least of these, of least index among ties, is the nearest entry.

Vectors stay in their partitions: a round returns, for each task, the sums and counts of the entries that
its vectors fell to, which Spark adds up; only the codebooks, of a size that depends on the dimensions
alone, go through the driver. The rounds read the integers from a table written once.

Rows whose vector is null, or has a component that is null, NaN or infinite, are dropped. Integers are
held within +-MOST, 65,536 before scaling, which keeps sums of squares within 64 bits. A vector shorter
than the longest has zeros after its end, and so has the longest up to a multiple of PARTS; with no
dimensions at all every distance is 0. Null ids come after all others, and rows of one id are ordered by
their integers. Fewer vectors than ENTRIES make fewer entries. Repeated rows are coded alike. Labels may
be null; null labels are one. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.shared import cut, joined

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 26
#: Eighths of the dimensions that all entries are compared in before any is dropped: whole rows are faster than picked entries while most are left.
FIRST = 5
#: Parts that are compared with all entries at once.
BLOCK = 1024
#: Sums of an entry go by rows of so many dimensions.
WIDTH = 16


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of codebook (entries x dimensions, int64) to each of parts, and its squared distance."""
    order = np.argsort(-codebook.var(axis=0), kind="stable")
    entries = np.ascontiguousarray(codebook[:, order].T)
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for start in range(0, len(parts), BLOCK):
        block = np.ascontiguousarray(parts[start : start + BLOCK, order].T)
        code[start : start + BLOCK], error[start : start + BLOCK] = _searched(block, entries)
    return code, error


def _searched(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for x (dimensions x parts) and c (dimensions x entries), in the order of their dimensions."""
    dims, n = x.shape
    so_far = np.zeros((n, c.shape[1]), np.int64)
    first = -(-dims * FIRST // 8)
    for d in range(first):
        so_far += (x[d][:, None] - c[d][None, :]) ** 2
    guess = so_far.argmin(axis=1)
    best = ((x - c[:, guess]) ** 2).sum(axis=0)
    who, entry = np.nonzero(so_far <= best[:, None])
    sums, last = so_far[who, entry], len(who)
    for d in range(first, dims):
        sums += (x[d][who] - c[d][entry]) ** 2
        alive = sums <= best[who]
        who, entry, sums = who[alive], entry[alive], sums[alive]
        if 2 * len(who) < last and d + 1 < dims:
            last = len(who)
            leads = _least(who, sums)
            best[who[leads]] = np.minimum(best[who[leads]], ((x[:, who[leads]] - c[:, entry[leads]]) ** 2).sum(axis=0))
    leads = _least(who, sums)
    return entry[leads], sums[leads]


def _least(who: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The places of the first least sum of each of who, which is sorted, as entries are within it."""
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    lows = np.repeat(np.minimum.reduceat(sums, starts), np.diff(np.r_[starts, len(who)]))
    hits = np.flatnonzero(sums == lows)
    return hits[np.r_[True, who[hits][1:] != who[hits][:-1]]]


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the kept vectors' integers."""
    kept = vectors.where(F.col("embedding").isNotNull()).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * SCALE))).cast("int")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", whole).alias("v"))


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of v as rows of int64, zeros after their end."""
    column = table["v"].combine_chunks()
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def initial(rows: DataFrame, width: int) -> np.ndarray:
    """The starting codebooks, PARTS x entries x dimensions of a part."""
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "v").select("v").limit(ENTRIES).toArrow()
    return _matrix(first, width).reshape(first.num_rows, PARTS, width // PARTS).swapaxes(0, 1).copy()


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    entries, dims = books.shape[1:]
    pieces = max(1, -(-dims // WIDTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS * entries, pieces * WIDTH), np.int64), np.zeros(PARTS * entries, np.int64)
        for t in joined(batches, "v"):
            vectors = _matrix(t, PARTS * dims)
            for p in range(PARTS):
                part = vectors[:, p * dims : (p + 1) * dims]
                slot = p * entries + nearest(part, books[p])[0]
                counts += np.bincount(slot, minlength=len(counts))
                order = np.argsort(slot, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(slot[order]) > 0])
                if dims:
                    sums[slot[order][starts], :dims] += np.add.reduceat(part[order], starts, axis=0)
        used = np.flatnonzero(counts)
        for k in range(pieces):
            yield pa.record_batch({"slot": pa.array(used), "piece": pa.array(np.full(len(used), k)), "n": pa.array(counts[used]), **{f"s{i}": pa.array(sums[used, k * WIDTH + i]) for i in range(WIDTH)}})

    names = [f"s{i}" for i in range(WIDTH)]
    found = rows.select("v").mapInArrow(run, "slot long, piece long, n long, " + ", ".join(f"{s} long" for s in names))
    total = found.groupBy("slot", "piece").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).toArrow()
    out = np.zeros((PARTS * entries, pieces * WIDTH), np.int64)
    out[:, :dims] = books.reshape(PARTS * entries, dims)
    at = total["slot"].to_numpy()[:, None], total["piece"].to_numpy()[:, None] * WIDTH + np.arange(WIDTH)
    if total.num_rows:
        out[at] = np.stack([total[s].to_numpy() for s in names], axis=1) // total["n"].to_numpy()[:, None]
    return out[:, :dims].reshape(books.shape)


def codebooks(rows: DataFrame) -> np.ndarray:
    """The final codebooks of integers(): PARTS x entries x dimensions of a part."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    books = initial(rows, -(-longest // PARTS) * PARTS)
    for _ in range(ROUNDS if books.shape[1] else 0):
        books = moved(rows, books)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of integers(): the entries' indexes as hex, and the squared distances' sum."""
    dims = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in joined(batches, "v"):
            vectors = _matrix(t, PARTS * dims)
            found = [nearest(vectors[:, p * dims : (p + 1) * dims], books[p]) for p in range(PARTS)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = sum(e for _, e in found)
            for b in t.drop_columns("v").append_column("code", pa.array([row.tobytes().hex() for row in codes])).append_column("error", pa.array(error)).to_batches():
                yield b

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each kept row of vectors(vec_id, embedding, label).

    Errors are summed by label in part before they are shuffled; the sums are joined back by the label, which
    adaptive execution broadcasts where they are few and splits where one label has many rows.
    """
    rows = cut(integers(vectors), "integers")
    books = codebooks(rows)
    out = cut(coded(rows, books), "codes")
    sums = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL of the same rows, for unique ids and vectors of one length that PARTS divides."""
    near = """
a{k} AS (SELECT r, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM
  (SELECT r, part, entry, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS dist FROM x JOIN b{k} b USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part),"""
    move = """
b{next} AS (SELECT part, pos, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN
  (SELECT part, pos, entry, CAST(floor(sum(x.v)::DOUBLE / count(*)) AS BIGINT) AS v FROM x JOIN a{k} USING (r, part) GROUP BY part, pos, entry) m USING (part, pos, entry)),"""
    rounds = "".join(near.format(k=k) + (move.format(k=k, next=k + 1) if k < ROUNDS else "") for k in range(ROUNDS + 1))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, i // (len(e) // {PARTS}) AS part, i % (len(e) // {PARTS}) AS pos, CAST(floor({SCALE} * e[i + 1]::DOUBLE) AS BIGINT) AS v FROM (SELECT r, e, unnest(range(len(e))) AS i FROM kept)),
b0 AS (SELECT part, pos, r AS entry, v FROM x WHERE r < {ENTRIES}),{rounds.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")}
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
s AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN kept USING (r), s"""


ORACLE_SQL = _oracle()
