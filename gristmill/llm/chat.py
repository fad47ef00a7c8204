r"""Chat formatting from event logs.

Events are (conv_id, turn, seq, kind, role, text). They are partitioned by conversation, sorted by turn and sequence, and
folded as they stream by: `message` opens a message, `delta` appends to it, `edit` puts another text in its place,
`regenerate` starts it anew and takes back what later turns had received before it. The fold holds one message at a time,
however long a conversation is, and emits one rendered row for each final message.

A rendered message is `<|im_start|>role\ntext<|im_end|>\n`. Inside texts and roles `<|` never stays: a backslash goes
between, and one more where backslashes already stand between, so that the escape can be taken back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"
EVENTS = ("message", "delta", "edit", "regenerate")

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(role: str, text: str) -> tuple[str, int, int]:
    """The message in the template, and the part of it that the loss is taken over (start, end; empty if none)."""
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    end = len(head) + len(body)
    return f"{head}{body}{CLOSE}", len(head) if role == LEARNT else end, end


class Reader:
    """Reads a formatted conversation back, given in pieces of any size that end with a message."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, piece: str, masks: list[tuple[int, int]]) -> None:
        self.chars += len(piece)
        at = 0
        while at < len(piece):
            assert piece.startswith(OPEN, at), "not a message"
            end = piece.index(CLOSE, at)
            role, _, body = piece[at + len(OPEN) : end].partition("\n")
            self.turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            at = end + len(CLOSE)
        for s, e in masks:
            text = unescape(piece[s:e])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)


class Fold:
    """Folds one conversation's events, given by turn and sequence, into final messages (turn, role, text)."""

    def __init__(self) -> None:
        self.turn: object = self
        self.role: str | None = None
        self.parts: list[str] | None = None
        self.restarted = self.restarting = -1

    def feed(self, turn: int | None, seq: int, kind: str, role: str | None, text: str) -> Iterator[tuple]:
        if turn != self.turn:
            yield from self.flush()
            self.restarted = max(self.restarted, self.restarting)
            self.turn, self.restarting = turn, -1
        if seq < self.restarted:  # a turn before it was regenerated later on
            return
        if kind == "message":
            yield from self.flush()
            self.role, self.parts = role, [text]
        elif kind == "delta":
            self.role = self.role if role is None else role
            self.parts = self.parts if self.parts is not None else []
            self.parts.append(text)
        elif kind in ("edit", "regenerate"):
            self.role, self.parts = self.role if role is None else role, [text]
            if kind == "regenerate":
                self.restarting = max(self.restarting, seq)

    def flush(self) -> Iterator[tuple]:
        if self.parts is not None:
            yield self.turn, self.role or "", "".join(self.parts)
        self.role = self.parts = None


MESSAGES = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int"


def format_chat(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_end): a row for each final message, sorted by turn within a conversation.

    A conversation is what its rows' `formatted` give one after the other; the loss covers loss_start to loss_end of each (code
    points). Rows of a conversation lie in one partition, in order. Nulls: a null text is empty, a null kind `message`, a
    null role empty, a null seq 0; null conv_ids are one conversation; null turns come first. Rows of `message` that repeat a
    turn are turns of their own, by seq, role and text. Events of unknown kinds are left out; `unknown_events` counts them. Long texts are taken whole, a message at a time. Extra columns are left out. Empty tables give empty results.
    """
    has = set(events.columns)
    kind = F.coalesce(F.col("kind"), F.lit("message")) if "kind" in has else F.lit("message")
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in has else F.lit(0).cast("long")
    rows = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), seq.alias("seq"), kind.alias("kind"), F.col("role").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return in_order(rows.filter(F.col("kind").isin(*EVENTS)), "conv_id", "turn", "seq", "role", "text").mapInArrow(_fold, MESSAGES)


def unknown_events(events: DataFrame) -> DataFrame:
    """(conv_id, kind, n): how many events of each conversation `format_chat` leaves out, by kind."""
    odd = events.filter(F.col("kind").isNotNull() & ~F.col("kind").isin(*EVENTS)) if "kind" in events.columns else events.limit(0).withColumn("kind", F.lit(None).cast("string"))
    return odd.groupBy(F.col("conv_id").cast("long").alias("conv_id"), "kind").agg(F.count("*").alias("n"))


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*by)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    fold, conv, began = Fold(), None, False
    for rows in batches:
        for c, turn, seq, kind, role, text in zip(*(x.to_pylist() for x in rows.columns), strict=True):
            done = []
            if not began or c != conv:
                done += [(conv, *m) for m in fold.flush()]
                fold, conv, began = Fold(), c, True
            done += [(conv, *m) for m in fold.feed(turn, seq, kind, role, text)]
            for of, t, r, body in done:
                out.append((of, t, r, *render(r, body)))
                held += len(body)
            if held > 4_000_000 or len(out) > 4000:
                yield batch()
                out, held = [], 0
    out += [(conv, t, r, *render(r, body)) for t, r, body in fold.flush()]
    if out:
        yield batch()


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digests(messages: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the rows of format_chat as they stream by in their partitions."""
    return messages.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digest, DIGESTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    reader, conv, out = None, None, []
    for rows in batches:
        for c, piece, s, e in zip(*(x.to_pylist() for x in rows.columns), strict=True):
            if reader is None or c != conv:
                if reader:
                    out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
                reader, conv = Reader(), c
            reader.feed(piece, [(s, e)] if s < e else [])
        if len(out) > 4000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
            out = []
    if reader:
        out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
