"""Streams: submissions without repeats, decisions batch by batch, audit and cache as sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators.pipelines import analyze_prompts
from gristmill.operators.risk import Settings
from gristmill.sources.store import audit_rows, cache_rows, newest_by_hash

WITHIN_MS = 1500


def read_submissions(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Submissions from a folder that files arrive in; the rate limit is the stream's back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Parts that sessions are dealt to by hash; a part is one call of Python and one state a micro-batch, which costs some 15 ms whatever it holds.
PARTS = 2048


def accepted_stream(df: DataFrame, by: str = "user_id", at: str = "ts", text: str = "prompt_text", within_ms: int = WITHIN_MS, idle_ms: int = 3_600_000, tie: str | None = None, parts: int = PARTS) -> DataFrame:
    """(by, at, text, and tie if one is named) of submissions that don't repeat the last accepted one of their session within `within_ms`.

    The state is the last accepted text and time of each session, kept by part: sessions (by their key as a string) are dealt to `parts` by hash, and a task holds one part's rows of a micro-batch
    at a time. A dropped row leaves a session's state as it is. Inside a micro-batch rows are taken by time, of equal times by `tie`; rows without time come first and are accepted.
    A session's state goes when nothing has come of it for `idle_ms` of the clock, at the next rows of its part; no rows are left out.
    """
    named = [by, at, text, *([tie] if tie else [])]
    idle = max(within_ms, idle_ms)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        known = {who: (said, last, seen) for who, said, last, seen in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["_ms", *([tie] if tie else [])], kind="stable", na_position="first")
        kept = []
        for k, (who, t, ms) in enumerate(zip(*(rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in ("_who", text, "_ms")), strict=True)):
            ms = None if ms is None else int(ms)
            said, last, _ = known.get(who, (None, None, None))
            if last is None or ms is None or t != said or ms - last >= within_ms:
                said, last = t, ms
                kept.append(k)
            known[who] = (said, last, now)
        state.update((json.dumps([(who, *entry) for who, entry in known.items() if now - entry[2] < idle]),))
        state.setTimeoutDuration(idle)
        yield rows.iloc[kept][named]

    kinds = dict(df.dtypes)
    who = F.col(by).cast("string")
    rows = df.select(*named, F.unix_millis(F.col(at).cast("timestamp")).alias("_ms"), who.alias("_who"), F.pmod(F.xxhash64(who), F.lit(parts)).alias("_part"))
    return rows.groupBy("_part").applyInPandasWithState(step, ", ".join(f"`{c}` {kinds[c]}" for c in named), "sessions string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def started(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes a stream of accepted rows to a folder and ends when all that is there was read.

    A state with time-outs asks for another micro-batch without data for ever, so that a query of this kind wouldn't end. This one has none: states time out in the next micro-batch that has data.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # the query takes its settings with it when it starts
    try:
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def written_once(rows: DataFrame, path: str, epoch: int) -> None:
    """The rows of a micro-batch, in a folder of their own: a batch that is run again replaces what it has written."""
    rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def decide_stream(submissions: DataFrame, audit: str, checkpoint: str, settings: Settings = Settings(), repair: str = "full"):
    """Starts a query that decides each micro-batch as a batch would and adds it to the audit table."""

    def write(batch: DataFrame, epoch: int) -> None:
        done = analyze_prompts(batch, settings, repair).withColumn("decision", F.col("action"))
        written_once(audit_rows(done), audit, epoch)

    return submissions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_stream(decisions: DataFrame, cache: str, checkpoint: str):
    """Starts a query that adds decisions to the cache table. Readers take the last entry of each hash (newest_by_hash)."""

    def write(batch: DataFrame, epoch: int) -> None:
        written_once(newest_by_hash(cache_rows(batch)), cache, epoch)

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
