"""Token counts by a compiled finite-state transducer.

A piece model tokenizes by merging neighbours, best score first, whenever their concatenation is a
piece. A text's tokens are then the one sequence of pieces in which each adjacent pair is stable
(tokenizing the two pieces together gives the two back). So, reading a text from the left, the last
token of each prefix is found from the last tokens of shorter prefixes, no further back than the
longest piece. What is needed of the past is therefore finite: the suffix that may still grow into
a piece, and for each of its places the last token and the count there relative to the present.
That is the state of a deterministic transducer, whose transitions carry the change of the token
count. States are compiled when a text first reaches them, and shared by all texts of a worker.

As no piece has a space after another character, the transducer is back in its initial state at
each run of spaces. Chunks of a text thus have state maps of a simple form (open head, closed
count, open tail) that compose associatively; a long text is cut into chunks, their maps are
scanned as prefixes in a tree, and the last one gives the text's count.

Nulls count as empty texts: no bytes, no tokens. Repeated rows are counted each; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.shared import joined

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Code points of a chunk.
CHUNK = 1 << 16
#: A worker drops its compiled states and word counts beyond so many, and compiles anew what it meets again.
MOST_STATES, MOST_WORDS = 200_000, 500_000
SPACE = "▁"


class Transducer:
    """Counts tokens of segments: a run of SPACE (may be empty), then characters other than SPACE."""

    def __init__(self, pieces: dict[str, float]):
        self.scores = pieces
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.names = list(pieces)
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.chars = {p for p in pieces if len(p) == 1}
        self.stable: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        #: A state: the open suffix, and for each place in it (from its start) the last token there (-1: none) and the count relative to now.
        self.keys: list[tuple[str, tuple[tuple[int, int], ...]]] = [("", ((-1, 0),))]
        self.numbers = {self.keys[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """Tokens by the definition: merge the neighbours of best score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_stable(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay as they are side by side; a = -1: whether b is a token of its own."""
        key = a * 1_000_000 + b
        if (known := self.stable.get(key)) is None:
            both = ([] if a < 0 else [self.names[a]]) + [self.names[b]]
            known = self.stable[key] = self.merged("".join(both)) == both
        return known

    def move(self, state: int, char: str) -> tuple[int, int]:
        """Compiles a transition: the next state and how many tokens more there are."""
        if char not in self.chars:  # stands alone as its bytes; nothing merges across it
            return 0, len(char.encode())
        suffix, places = self.keys[state]
        text = suffix + char
        for k in range(len(suffix) + 1):
            last, count = places[k]
            piece = self.ids.get(text[k:])
            if piece is not None and self.is_stable(last, piece):
                break
        else:
            raise AssertionError("each text has a last token")
        delta = count + 1
        drop = 0
        while text[drop:] not in self.prefixes:
            drop += 1
        places = (*((t, c - delta) for t, c in places[drop:]), (piece, 0))
        key = (text[drop:], places)
        if (to := self.numbers.get(key)) is None:
            to = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return to, delta

    def count(self, segment: str) -> int:
        state, n, moves = 0, 0, self.moves
        for c in segment:
            step = moves[state].get(c)
            if step is None:
                step = moves[state][c] = self.move(state, c)
            state, delta = step
            n += delta
        return n


class Counts(dict):
    """Token counts by segment, run through the transducer at first sight."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, segment: str) -> int:
        if len(self.transducer.keys) > MOST_STATES:
            self.transducer.clear()
        n = self.transducer.count(segment.replace(" ", SPACE))
        if len(segment) <= 64:
            if len(self) > MOST_WORDS:
                self.clear()
            self[segment] = n
        return n


SEGMENT = re.compile(r" +[^ ]*")
#: The state map of a chunk: the text before its first space (joins what is open), the tokens of its closed segments, and the open segment at its end; None where the chunk has no space.
Map = tuple[str, int, str | None]


def chunk_map(counts: Counts, chunk: str) -> Map:
    first = chunk.find(" ")
    if first < 0:
        return chunk, 0, None
    segments = SEGMENT.findall(chunk, first)
    return chunk[:first], sum(map(counts.__getitem__, segments[:-1])), segments[-1]


def compose(counts: Counts, a: Map, b: Map) -> Map:
    if a[2] is None:
        return a[0] + b[0], b[1], b[2]
    open_ = a[2] + b[0]
    if b[2] is None:
        return a[0], a[1], open_
    if not b[0] and not a[2].strip(" "):  # the run of spaces goes on
        return a[0], a[1] + b[1], a[2] + b[2] if b[1] == 0 else b[2]
    return a[0], a[1] + counts[open_] + b[1], b[2]


def scanned(counts: Counts, maps: list[Map]) -> list[Map]:
    """Inclusive prefix scan: pairs are composed first, their scan then gives every other prefix."""
    if len(maps) < 2:
        return maps
    pairs = scanned(counts, [compose(counts, maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
    return [maps[0] if i == 0 else pairs[i // 2] if i % 2 else compose(counts, pairs[i // 2 - 1], maps[i]) for i in range(len(maps))]


def cuts(text: str, chunk: int) -> list[str]:
    """The text in chunks; none ends within a run of spaces, so that a run is one segment's."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + chunk)
        while to < len(text) and text[to - 1] == " ":
            to += 1
        out.append(text[at:to])
        at = to
    return out


def count_tokens(counts: Counts, text: str, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    text = " " + text.replace(SPACE, " ")  # the model puts a space first, and writes spaces as SPACE
    if len(text) <= chunk:
        return sum(map(counts.__getitem__, SEGMENT.findall(text)))
    head, n, tail = scanned(counts, [chunk_map(counts, c) for c in cuts(text, chunk)])[-1]
    return n + (counts[tail] if tail else 0)


@lru_cache(maxsize=2)
def compiled(path: str) -> Counts:
    """The transducer of a piece model; one for each worker and model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    return Counts(Transducer({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)}))


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text). model_path: a piece model on each worker; None: the installed piece_bpe_32k.model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counts = compiled(model_path or str(public_tokenizers.path("piece_bpe_32k.model")))
        for t in joined(batches):
            n = [count_tokens(counts, x or "") for x in t["text"].to_pylist()]
            yield pa.record_batch({"doc_id": t["doc_id"].combine_chunks(), "n_bytes": t["n_bytes"].combine_chunks(), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, SCHEMA)
