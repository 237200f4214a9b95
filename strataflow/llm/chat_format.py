"""Chat formatting: conversations as windows of whole turns within a token budget.

A window holds the conversation's system turn (if its first turn is one), a limited part of the turns
before (history), and new turns; all turn-aligned. Prefix sums of the turns' tokens tell how far back
history may go and how many new turns fit. Each turn is new in one window; a turn over the budget is
a window's only new one, whole. The loss mask covers the texts of new assistant turns, so targets that
are repeated as history are masked.

Turns are read in order from sorted partitions; only a budget's worth of them is held, however long a
conversation is. Ties of turn go by role, then text; null turns come first, null texts and roles are
empty, a null conv_id is a conversation of its own. Repeated rows are turns of their own.

The template opens a turn with OPEN, the role and a line feed, and closes it with CLOSE. In roles and
texts a backslash is doubled, and a control string (any of CONTROLS) gets one after its first
character; both are undone by reading(). Tokens are words and two for each turn's marks, unless
another count is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


OPEN, CLOSE = "<|turn|>", "<|end|>\n"
# Strings that templates of chats use as controls.
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)
BUDGET, HISTORY = 1024, 256
WINDOWS = "conv_id long, window long, n_repeated long, formatted string, loss array<struct<s:long,e:long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\|)", r"\1", text)


def tokens(text: str) -> int:
    return len(text.encode().split()) + 2


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int


class Formatted(NamedTuple):
    n_repeated: int
    text: str
    loss: list[tuple[int, int]]


def formatted(repeated: list[Turn], new: list[Turn]) -> Formatted:
    parts, at, loss = [], 0, []
    for k, t in enumerate([*repeated, *new]):
        head, body = f"{OPEN}{escaped(t.role).replace(chr(10), chr(92) + 'n')}\n", escaped(t.text)
        if k >= len(repeated) and t.role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return Formatted(len(repeated), "".join(parts), loss)


def windows(turns: Iterable[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = tokens) -> Iterator[Formatted]:
    """The windows of one conversation's (role, text) turns."""
    system: list[Turn] = []
    past: list[Turn] = []  # old turns within the history limit
    new: list[Turn] = []
    for k, (role, text) in enumerate(turns):
        turn = Turn(role, text, count(text))
        if new and sum(t.tokens for t in (*system, *past, *new)) + turn.tokens > budget:
            yield formatted([*system, *past], new)
            if not system and new[0].role == "system" and k == len(new):
                system = [new[0]]
            old = [*past, *new]
            if system and old and old[0] is system[0]:
                old = old[1:]
            fixed = sum(t.tokens for t in system)
            back = np.cumsum([t.tokens for t in reversed(old)])
            room = min(history, budget - fixed - turn.tokens)
            n = int(np.searchsorted(back, room, side="right"))
            past, new = old[len(old) - n :], []
        new.append(turn)
    if new:
        yield formatted([*system, *past], new)


def reading(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted window, as they were."""
    return [(unescaped(_role(m[1])), unescaped(m[2])) for m in _TURN.finditer(text)]


def _role(role: str) -> str:
    """A role with escaped line feeds, told from doubled backslashes before an n."""
    return re.sub(r"\\\\|\\n", lambda m: "\n" if m[0] == "\\n" else m[0], role)


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, formatted, loss) of conversations(conv_id, turn, role, text): a row per window, in order within partitions that hold whole conversations. loss: spans of formatted, in code points."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        held, size = [], 0
        for conv, own in groupby(turns, key=lambda x: x[0]):
            for k, w in enumerate(windows(((role, text) for _, role, text in own), budget, history)):
                held.append({"conv_id": conv, "window": k, "n_repeated": w.n_repeated, "formatted": w.text, "loss": [{"s": s, "e": e} for s, e in w.loss]})
                size += len(w.text)
                if size > 1 << 22 or len(held) >= 256:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)

    return dealt.mapInArrow(run, WINDOWS)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])


def digest(formatted_windows: DataFrame) -> DataFrame:
    """One row per conversation of format_conversations()'s rows, read back from them in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        held = []
        names = [c.split()[0] for c in DIGEST.split(", ")]
        schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
        for conv, own in groupby(rows, key=lambda x: x[0]):
            turns, loss, n, chars, masked = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, repeated, text, spans in own:
                for role, said in reading(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for x in spans:
                    said = unescaped(text[x["s"] : x["e"]])
                    loss.update(said.encode())
                    masked += len(said)
                chars += len(text)
            held.append(dict(zip(names, (conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars), strict=True)))
            if len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return formatted_windows.mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(own)))
