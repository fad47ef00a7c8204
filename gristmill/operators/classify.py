"""The contextual classifier: providers, replies, and what is made of them.

A provider is asked for a document's candidates one after the other, only for rows that need it. Everything else, the reading of replies,
time-outs and early exits, is done on columns and the same for replies asked now or recorded before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.arrays import let
from gristmill.functions.text import is_blank, trimmed
from gristmill.operators.risk import ANSWER, CHUNKS
from gristmill.operators.windows import priority

TIMEOUT_MS, SURE = 7000, 0.85
REPLIES = "array<struct<chunk_index:int,reply:string,delay_ms:long>>"

#: Phrases of replies that aren't JSON.
SAFE = ("does not contain any sensitive", "not considered to contain", "not sensitive", "no sensitive data", "low-risk")
RISKY = ("contains sensitive information", "contains an api key", "security risk", "confidential")


#: What a provider can say of itself; only the first two can be asked.
STATES = ("readily", "after-download", "no", "unavailable")


class Provider(Protocol):
    """A classifier session, closed at its partition's end. `state()`, where there is one, gives one of STATES."""

    def ask(self, text: str) -> str: ...

    def close(self) -> None: ...


class Asker:
    """A partition's session: made when it is first needed, replaced after a call that hangs, so that no other row waits for that one."""

    def __init__(self, provider: Callable[[], Provider], limit_ms: int = TIMEOUT_MS) -> None:
        self.provider, self.limit = provider, limit_ms
        self.session: Provider | None = None
        self.pool: ThreadPoolExecutor | None = None

    def within_limit(self, call: Callable, *given: str) -> object:
        self.pool = self.pool or ThreadPoolExecutor(1)
        try:
            return self.pool.submit(call, *given).result(self.limit / 1000)
        except Late:
            self.pool.shutdown(wait=False, cancel_futures=True)
            self.pool = self.session = None
            raise

    def away(self) -> str | None:
        """Why the provider can't be asked; None if it can."""
        try:
            self.session = self.session or self.within_limit(self.provider)
            state = getattr(self.session, "state", lambda: STATES[0])()
        except Late:
            return P.LATE
        except Exception as e:  # the classifier never fails a decision
            return str(e) or P.FAILED
        return None if state in STATES[:2] else P.AWAY.format(state)

    def ask(self, text: str) -> tuple[str | None, int]:
        """(reply, milliseconds); a call that is late or fails counts as late: no reply, and one millisecond more than TIMEOUT_MS."""
        began = time.monotonic()
        try:
            return self.within_limit(self.session.ask, f'Analyze prompt: "{text}"'), round((time.monotonic() - began) * 1000)
        except Exception:
            return None, TIMEOUT_MS + 1

    def close(self) -> None:
        if self.session is not None:
            try:
                self.session.close()
            except Exception:
                pass
        if self.pool is not None:
            self.pool.shutdown(wait=False, cancel_futures=True)


def parsed(reply: Column, unsure: float = SURE) -> Column:
    """struct<sensitive,category,confidence> of a reply: JSON, then the first {...}, then phrases. `unsure`: where a sensitive one gives no number."""
    clean = trimmed(F.regexp_replace(reply, "(?i)```json|```", ""))
    whole, part = F.try_parse_json(clean), F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*?\}", 0), F.lit("")))
    json = F.coalesce(whole, part)
    low = F.lower(reply)
    says = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    risky = ~says(SAFE) & says(RISKY)
    sensitive = F.coalesce(F.try_variant_get(json, "$.sensitive", "boolean"), F.lit(False))
    category = F.coalesce(F.nullif(F.try_variant_get(json, "$.category", "string"), F.lit("")), F.when(sensitive, "confidential_context"))
    number = F.coalesce(F.try_variant_get(json, "$.confidence", "double"), F.when(sensitive, unsure).otherwise(0.0))
    guess = F.struct(risky.alias("sensitive"), F.when(risky, "confidential_context").alias("category"), F.when(risky, 0.85).otherwise(0.0).alias("confidence"))
    read = F.struct(sensitive.alias("sensitive"), category.alias("category"), number.alias("confidence"))
    return F.when(json.isNotNull(), read).otherwise(F.when(F.coalesce(reply, F.lit("")) == "", F.struct(F.lit(False).alias("sensitive"), F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("confidence"))).otherwise(guess))


def _row(k: Column, skipped: bool, late: bool = False, why: Column | None = None, got: Column | None = None, ms: Column | None = None) -> Column:
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        k.cast("int").alias("chunk_index"), (F.lit(False) if got is None else got["sensitive"]).alias("sensitive"), (none("string") if got is None else got["category"]).alias("category"),
        (F.lit(0.0) if got is None else got["confidence"]).alias("confidence"), F.lit(skipped).alias("skipped"), F.lit(late).alias("timed_out"), (none("string") if why is None else why).alias("reason"), (none("long") if ms is None else ms.cast("long")).alias("latency_ms"),
    )


def single(text: Column, reply: Column, delay_ms: Column, away: Column | None = None) -> Column:
    """The answer about a whole text; skipped if it is blank, unavailable (no reply, no delay; `away` says why) or late."""
    got = parsed(reply, 0.8)
    pick = lambda row: F.struct(*(row[c].alias(c) for c in ("sensitive", "category", "confidence", "skipped", "timed_out", "reason", "latency_ms"))).cast(ANSWER)
    zero = F.lit(0)
    return (
        F.when(is_blank(text), pick(_row(zero, True, why=F.lit("Empty prompt"))))
        .when(delay_ms > TIMEOUT_MS, pick(_row(zero, True, True, F.lit(P.LATE))))
        .when(reply.isNull(), pick(_row(zero, True, why=F.coalesce(F.lit(None).cast("string") if away is None else away, F.lit(P.AWAY.format("unavailable"))))))
        .otherwise(pick(_row(zero, False, got=got, ms=delay_ms)))
    )


def clean_chunks(chunks: Column, candidates: Column) -> Column:
    """Rows of the chunks that aren't candidates."""
    def rows(best: Column) -> Column:
        rest = F.filter(chunks, lambda c: ~F.exists(best, lambda x: x["chunk_index"] == c["chunk_index"]))
        return F.transform(rest, lambda c: _row(c["chunk_index"], True, why=F.lit(P.TRIAGED_CLEAN))).cast(CHUNKS)

    return let(candidates, rows)


def unavailable(candidates: Column, why: Column | None = None) -> Column:
    """Rows of candidates that nobody was asked about; the session itself may have been late."""
    said = F.lit(P.AWAY.format("unavailable")) if why is None else why
    row = lambda c, late: _row(c["chunk_index"], True, late, said)
    return F.transform(candidates, lambda c: F.when(said == P.LATE, row(c, True)).otherwise(row(c, False))).cast(CHUNKS)


def judged(candidates: Column, replies: Column) -> Column:
    """Rows of the candidates, in order, up to the first that is late, or sensitive and sure. Those after it get none."""
    start = F.struct(F.lit(False).alias("done"), F.array().cast(CHUNKS).alias("out"))

    def step(acc: Column, c: Column) -> Column:
        got = F.get(F.filter(replies, lambda r: r["chunk_index"] == c["chunk_index"]), F.lit(0))
        late, read = got["delay_ms"] > TIMEOUT_MS, parsed(got["reply"])
        row = F.when(got.isNull(), _row(c["chunk_index"], True, why=F.lit(P.FAILED))).when(late, _row(c["chunk_index"], True, True, F.lit(P.LATE))).otherwise(_row(c["chunk_index"], False, got=read, ms=got["delay_ms"]))
        stop = F.coalesce(late, F.lit(False)) | F.coalesce(read["sensitive"] & (read["confidence"] >= SURE), F.lit(False))
        return F.struct((acc["done"] | stop).alias("done"), F.when(acc["done"], acc["out"]).otherwise(F.concat(acc["out"], F.array(row).cast(CHUNKS))).alias("out"))

    return F.aggregate(candidates, start, step, lambda acc: acc["out"])


def chunk_results(chunks: Column, replies: Column | None = None, limit: int = 2, away: Column | None = None) -> Column:
    """All chunks' rows: first those passed over, then the candidates'. Without replies, or where `away` says why, the classifier is unavailable."""

    def rows(best: Column) -> Column:
        if replies is None:
            return unavailable(best)
        return judged(best, replies) if away is None else F.when(away.isNotNull(), unavailable(best, away)).otherwise(judged(best, replies))

    return let(priority(chunks, limit), lambda best: F.concat(clean_chunks(chunks, best), rows(best)))


def _fields(df: DataFrame, but: str = "") -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != but)


def with_reply(df: DataFrame, provider: Callable[[], Provider], text: str = "prompt_text", limit_ms: int = TIMEOUT_MS) -> DataFrame:
    """All columns with reply, delay_ms and classifier_away of one question about the whole text. Blank texts pass through without being asked about."""
    df = df.drop("reply", "delay_ms", "classifier_away", "_ask").withColumn("_ask", ~is_blank(F.col(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(provider, limit_ms)
        try:
            for batch in batches:
                out: list[tuple[str | None, int | None, str | None]] = []
                for t, asked in zip(batch.column(text), batch.column("_ask").to_pylist(), strict=True):
                    why = asker.away() if asked else None
                    out.append((*asker.ask(t.as_py()), None) if asked and why is None else (None, None, why))
                kept = batch.drop_columns(["_ask"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string())))], [*kept.schema.names, "reply", "delay_ms", "classifier_away"])
        finally:
            asker.close()

    return df.mapInArrow(run, f"{_fields(df, '_ask')}, reply string, delay_ms long, classifier_away string")


def with_replies(df: DataFrame, provider: Callable[[], Provider], chunks: str = "chunks", limit: int = 2, limit_ms: int = TIMEOUT_MS) -> DataFrame:
    """All columns with `replies` of the candidates of `chunks` and classifier_away. Rows without candidates pass through without being asked about.

    A candidate whose call is late or fails is the last one of its row. Nobody is asked where the provider is away.
    """
    df = df.drop("replies", "classifier_away", "_ask").withColumn("_ask", priority(F.col(chunks), limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(provider, limit_ms)
        kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("reply", pa.string()), ("delay_ms", pa.int64())]))
        try:
            for batch in batches:
                out, away = [], []
                for candidates in batch.column("_ask").to_pylist():
                    got: list[dict] = []
                    why = asker.away() if candidates else None
                    for c in candidates if why is None else ():
                        reply, ms = asker.ask(c["text"])
                        got.append({"chunk_index": c["chunk_index"], "reply": reply, "delay_ms": ms})
                        if reply is None:
                            break
                    out.append(got)
                    away.append(why)
                kept = batch.drop_columns(["_ask"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, kind), pa.array(away, pa.string())], [*kept.schema.names, "replies", "classifier_away"])
        finally:
            asker.close()

    return df.mapInArrow(run, f"{_fields(df, '_ask')}, replies {REPLIES}, classifier_away string")
