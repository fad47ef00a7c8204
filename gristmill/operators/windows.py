"""Windows and chunks of long texts, and which of them are worth a classifier's time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.arrays import let
from gristmill.functions.text import suspicion, text_or_empty, trimmed
from gristmill.sources.tables import stored

WINDOWS = "array<struct<chunk_index:int,text:string,window_type:string,start_char:int,end_char:int,anchor_center:int>>"
CHUNKS = "array<struct<chunk_index:int,text:string,start_char:int,end_char:int>>"
SHORT, HEAD, RADIUS = 2500, 1500, 400


def _window(k: int, text: Column, kind: str, start: Column, end: Column, center: Column | None = None) -> Column:
    part = F.substring(text, start + 1, end - start)
    return F.struct(F.lit(k).alias("chunk_index"), part.alias("text"), F.lit(kind).alias("window_type"), start.cast("int").alias("start_char"), end.cast("int").alias("end_char"), (F.lit(None) if center is None else center).cast("int").alias("anchor_center"))


def windows(c: Column, head: int = HEAD, radius: int = RADIUS) -> Column:
    """The whole of a short text; of a long one its head, and what surrounds the first anchor word that starts behind the head.

    No anchor word stands inside another one, so the search can begin behind the head, and it ends with the first one. It is made once; how long the word is
    follows from the end of what it has read.
    """
    none = F.array().cast(WINDOWS)
    words = P.java(P.ANCHORS)

    def of(text: Column) -> Column:
        size = F.length(text)
        first = _window(0, text, "HEAD", F.lit(0), F.least(F.lit(head), size))

        def around(center: Column) -> Column:
            near = _window(1, text, "ANCHOR_LOCUS", F.greatest(F.lit(0), center - radius), F.least(size, center + radius), center)
            return F.array(first, near).cast(WINDOWS)

        def behind(seen: Column) -> Column:
            word = lambda part: F.length(F.regexp_extract(part, rf"(?is)(?<=.)(?:{words})\z", 0))
            near = word(F.substring(seen, F.greatest(F.length(seen) - 200, F.lit(0)) + 1, F.lit(201)))
            center = let(F.when(near > 0, near).otherwise(word(seen)), lambda n: head + F.length(seen) - n + F.floor(n / 2))
            return F.when(F.length(seen) > 0, let(center, around)).otherwise(F.array(first).cast(WINDOWS))

        seen = F.regexp_extract(F.substring(text, F.lit(head + 1), size), rf"(?is)\A.+?(?:{words})", 0)
        short = F.array(_window(0, text, "FULL", F.lit(0), size)).cast(WINDOWS)
        return F.when(size == 0, none).when(size <= SHORT, short).otherwise(let(seen, behind))

    return let(trimmed(text_or_empty(c)), of)


_FULL = re.compile(f"[^{P.BLANKS}]")
#: A cut leaves so many characters at least.
LEAST = 1000
#: Characters of a block: starts that lie in it are its own.
BLOCK = 1 << 20


def cut_end(text: str, start: int, end: int) -> int:
    """Where a chunk from `start` ends: behind the last line or sentence end up to `end`, if that leaves more than LEAST characters."""
    least = start + LEAST + 1  # ends before it don't count
    stop = max(text.rfind("\n", least, end + 1), text.rfind(". ", least, end + 2))
    return stop + 1 if stop >= least else end


def _next(part: str, start: int, left: int, most: int, overlap: int) -> tuple[int, int]:
    """(end, next start or -1) of the chunk at `start`; `left` characters of the text begin with the part's first."""
    end = min(start + most, left)
    if end < left:
        end = cut_end(part, start, end)
    return end, -1 if end >= left else end - overlap


def chunked(text: str | None, most: int = 8000, overlap: int = 600) -> Iterator[tuple[int, str, int, int]]:
    """(index, text, start, end) of a text's chunks; blank ones are left out. A text of `most` characters or less is one, as it is."""
    if not text:
        return
    if len(text) <= most:
        yield 0, text, 0, len(text)
        return
    start = index = 0
    while start >= 0:
        end, after = _next(text, start, len(text), most, overlap)
        if part := text[start:end].strip(P.BLANKS):
            yield index, part, start, end
            index += 1
        start = after


def block_map(part: str, left: int, first: bool, size: int, most: int, overlap: int) -> tuple[list[int], list[int], list[int]]:
    """A block as a function of where the first chunk in it starts: (starts, exits, chunks), one entry for each run of starts with the same outcome.

    An exit is the first start behind the block, from the block's own beginning on; -1 if the text ends. Cuts draw together: most starts meet after a chunk or two, so
    what follows a place is worked out once.
    """
    known: dict[int, tuple[int, int]] = {}
    starts, exits, many = [], [], []
    for begin in range(1 if first else min(most, size, left)):
        path, at = [], begin
        while 0 <= at < size and at not in known:
            end, after = _next(part, at, left, most, overlap)
            path.append((at, _FULL.search(part, at, end) is not None))
            at = after
        out, n = known[at] if 0 <= at < size else (at, 0)
        for place, full in reversed(path):
            n += full
            known[place] = out, n
        out, n = known[begin]
        if not starts or (exits[-1], many[-1]) != (out, n):
            starts.append(begin)
            exits.append(out)
            many.append(n)
    return starts, exits, many


def long_chunks(df: DataFrame, text: str = "text", most: int = 8000, overlap: int = 600, block: int = BLOCK) -> DataFrame:
    """A row for each chunk of each text: all columns but `text`, with chunk_index, text, start_char, end_char. No text of more than a block is one sequential loop.

    Where a chunk starts depends on all before it, but what a block does to the first start in it doesn't: blocks of all texts are made functions in parallel,
    those of a text are composed (a fold of some numbers a block), and blocks then cut their own chunks in parallel. Texts of one block are cut where they lie, unshuffled. Null and empty texts have no chunks. Rows may repeat; columns named
    like results are replaced.
    """
    _fitting(most, overlap)
    block = max(block, most)
    df = df.drop("chunk_index", "start_char", "end_char")
    others = [c for c in df.columns if c != text]
    named = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_of") if others else F.lit(None).cast("string").alias("_of"), F.col(text).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = batch.column("_text")[k].as_py()
                for b, at in enumerate(range(0, len(t), block)):
                    one = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([one.column("_row"), one.column("_of"), pa.array([b], pa.int32()), pa.array([len(t) - at], pa.int64()), pa.array([t[at : at + block + most + 2]])], ["_row", "_of", "_block", "_left", "_part"])

    kind = named.schema["_of"].dataType.simpleString()
    result = f"_of {kind}, chunk_index int, `{text}` string, start_char int, end_char int"

    def rows_of(of: pa.Array, k: int, rows: list[tuple]) -> pa.RecordBatch:
        taken = of.take(pa.array([k] * len(rows), pa.int64()))
        return pa.RecordBatch.from_arrays([taken, *(pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32())))], ["_of", "chunk_index", text, "start_char", "end_char"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in enumerate(batch.column("_text")):
                yield rows_of(batch.column("_of"), k, [*chunked(t.as_py(), most, overlap)])

    short = named.filter(F.length("_text") <= block).mapInArrow(whole, result)
    cut = named.filter(F.length("_text") > block).mapInArrow(split, f"_row long, _of {kind}, _block int, _left long, _part string")
    pieces = stored(cut.repartition("_row", "_block"), "pieces")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [block_map(p.as_py(), left, b == 0, block, most, overlap) for b, left, p in zip(batch.column("_block").to_pylist(), batch.column("_left").to_pylist(), batch.column("_part"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_block")), *(pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in range(3))], ["_row", "_block", "starts", "exits", "many"])

    functions = pieces.select("_row", "_block", "_left", "_part").mapInArrow(maps, "_row long, _block int, starts array<int>, exits array<int>, many array<int>")

    def step(acc: Column, f: Column) -> Column:
        # exits count from the beginning of the block that they leave; a block that is passed over leaves the start to a later one
        run = F.size(F.filter(f["starts"], lambda s: s <= acc["at"]))
        into = (acc["at"] >= 0) & (acc["at"] < block)
        there = F.struct(f["_block"].alias("_block"), acc["at"].alias("_at"), acc["n"].alias("_n"))
        at = F.when(into, F.get(f["exits"], run - 1)).otherwise(acc["at"])
        return F.struct(
            F.when(at < 0, -1).otherwise(at - block).cast("int").alias("at"),
            (acc["n"] + F.when(into, F.get(f["many"], run - 1)).otherwise(0)).cast("int").alias("n"),
            F.when(into, F.concat(acc["out"], F.array(there))).otherwise(acc["out"]).alias("out"),
        )

    nothing = F.array().cast("array<struct<_block:int,_at:int,_n:int>>")
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("_block", "starts", "exits", "many"))), F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), nothing.alias("out")), step, lambda acc: acc["out"])
    entered = functions.groupBy("_row").agg(folded.alias("e")).select("_row", F.explode("e").alias("e")).select("_row", "e.*")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b, left, part, at, n = (batch.column(c)[k].as_py() for c in ("_block", "_left", "_part", "_at", "_n"))
                rows = []
                while 0 <= at < block:
                    end, after = _next(part, at, left, most, overlap)
                    if said := part[at:end].strip(P.BLANKS):
                        rows.append((n + len(rows), said, b * block + at, b * block + end))
                    at = after
                yield rows_of(batch.column("_of"), k, rows)

    found = pieces.join(entered, ["_row", "_block"]).select("_of", "_block", "_left", "_part", "_at", "_n").mapInArrow(chunks, result)
    return short.unionByName(found).select(*(F.col("_of")[c].alias(c) for c in others), "chunk_index", text, "start_char", "end_char")


def _fitting(most: int, overlap: int) -> None:
    if not 0 <= overlap < min(most, LEAST):
        raise ValueError("overlap must be below the chunk size and 1000, or a chunk might not advance")


def with_chunks(df: DataFrame, text: str = "text", most: int = 8000, overlap: int = 600) -> DataFrame:
    """All columns with `chunks`, cut row by row in Arrow batches; `long_chunks` is for texts that are too long for that."""
    _fitting(most, overlap)
    df = df.drop("chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())]))
        names = ("chunk_index", "text", "start_char", "end_char")
        for batch in batches:
            made = [[dict(zip(names, x, strict=True)) for x in chunked(t.as_py(), most, overlap)] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, "chunks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, chunks {CHUNKS}")


def priority(chunks: Column, limit: int = 2) -> Column:
    """The most suspicious chunks, worst first, of equal ones the first: array<struct<chunk_index,text,suspicion_score>>."""
    scored = F.transform(chunks, lambda c, k: F.struct((-suspicion(c["text"])).alias("minus"), k.alias("place"), c["chunk_index"].alias("chunk_index"), c["text"].alias("text")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["minus"] < 0)), 1, limit)
    return F.transform(best, lambda x: F.struct(x["chunk_index"].alias("chunk_index"), x["text"].alias("text"), (-x["minus"]).alias("suspicion_score")))
