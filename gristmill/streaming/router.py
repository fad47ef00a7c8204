"""One stream of messages, dispatched by kind: prompts, files, batches and images are decided, the audit log is asked and cleared, the cache cleared.

A micro-batch is decided once. Its answers are stored under its number, and the audit log and the cache are made from what is stored: a micro-batch that runs again finds its answers,
also if its own decisions are in the cache by then, and leaves the stores as they were.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.ocr import OCR
from gristmill.operators.pipelines import analyze_files, analyze_images, analyze_prompts, categories, rollup
from gristmill.operators.policy import REASONS
from gristmill.operators.risk import Settings
from gristmill.plans.ship import ship
from gristmill.sources import store
from gristmill.sources.files import extract_files
from gristmill.streaming.governance import written_once

#: Names of the kinds of messages, and other names of theirs.
KINDS = ("ANALYZE_PROMPT", "ANALYZE_FILE", "ANALYZE_BATCH_FILES", "ANALYZE_IMAGE_TEXT", "PERFORM_IMAGE_OCR", "ANALYZE_IMAGE_FILE", "GET_AUDIT_LOGS", "CLEAR_AUDIT_LOGS", "CLEAR_HASH_CACHE")
ALIASES = {"CLEAR_FILE_HASH_CACHE": "CLEAR_HASH_CACHE"}

FILES, IMAGES = ("ANALYZE_FILE", "ANALYZE_BATCH_FILES"), ("ANALYZE_IMAGE_TEXT", "ANALYZE_IMAGE_FILE")
DECIDED = ("ANALYZE_PROMPT", *FILES, *IMAGES, "PERFORM_IMAGE_OCR")

MESSAGES = (
    "id long, type string, ts timestamp, prompt_text string, destination_domain string, user_role string, file_name string, mime string, file_size long, content binary, batch_id string, pos long, "
    f"ocr {OCR}, ocr_error string"
)
ANSWERS = (
    "id long, type string, ts timestamp, answered boolean, destination_domain string, user_role string, batch_id string, pos long, file_name string, file_type string, file_size long, said string, hash string, action string, "
    f"risk_score int, explanation string, reasons {REASONS}, categories array<string>, fixed_floor_triggered boolean, unscannable boolean, is_directory boolean, cached boolean, audited boolean, source_type string"
)


@dataclass(frozen=True)
class Stores:
    """Folders: answers, audit log and answers to those who ask for it, by micro-batch; the cache, by parts."""

    answers: str
    audit: str
    logs: str
    cache: str


def kind() -> Column:
    """The kind that a message's type names."""
    out = F.col("type")
    for alias, name in ALIASES.items():
        out = F.when(F.col("type") == alias, name).otherwise(out)
    return out


def of_kind(messages: DataFrame, *kinds: str) -> DataFrame:
    """Messages (type, ...) of these kinds, aliases among them."""
    if odd := set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds of messages: {sorted(odd)}")
    return messages.filter(kind().isin(*kinds))


def place() -> Column:
    """Where a message stands: by time, of equal times by id."""
    return F.struct("ts", "id")


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of `schema`, null where `df` has none."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in store.fields(schema)))


def answered(messages: DataFrame, cache: DataFrame, settings: Settings = Settings(), repair: str = "full") -> DataFrame:
    """ANSWERS: a row a message (MESSAGES; what is missing is null), for files of a batch a row a file.

    Files use the cache as it was before these messages, up to the first message that clears it; from there on there is none. Settings give the role where a message has none. Messages that ask or clear are
    answered without a decision; those of unknown kinds get no answer (`answered` is false) and are kept.
    """
    rows = shaped(messages, MESSAGES).withColumns({"destination_domain": F.coalesce(F.nullif("destination_domain", F.lit("")), F.lit("unknown")), "user_role": F.coalesce(F.nullif("user_role", F.lit("")), F.lit(settings.user_role))})
    rows = rows.withColumn("answered", F.lit(True))
    by_message = replace(settings, user_role=F.col("user_role"))
    # a row a kind: what isn't there needs no plan
    there = {r.kind: r.at for r in rows.groupBy(kind().alias("kind")).agg(F.min(place()).alias("at")).filter(F.col("kind").isin(*KINDS)).collect()}
    out = [rows.filter(~F.coalesce(kind().isin(*DECIDED), F.lit(False))).withColumn("answered", F.coalesce(kind().isin(*KINDS), F.lit(False)))]

    if "ANALYZE_PROMPT" in there:
        prompts = analyze_prompts(of_kind(rows, "ANALYZE_PROMPT"), settings, repair)
        out.append(prompts.withColumns({"said": F.col("prompt_text"), "audited": F.lit(True), "source_type": F.lit("prompt_submission")}))
    if there.keys() & set(FILES):
        files, cleared = of_kind(rows, *FILES), there.get("CLEAR_HASH_CACHE")
        if cleared is not None:
            # by what is known before the lookup: rows behind the first clearing message have no cache
            before = F.coalesce(place() < F.struct(F.lit(cleared.ts).alias("ts"), F.lit(cleared.id).alias("id")), F.lit(True))
            files = files.withColumn("may_look_up", before)
        out.append(_files(files, cache, by_message, repair))
    if there.keys() & set(IMAGES):
        images = analyze_images(of_kind(rows, *IMAGES), by_message, F.col("destination_domain"))
        failed = F.col("source_type") == "file_attachment"
        text = F.when(failed, store.file_audit_text(F.col("file_name"), F.lit(""), F.lit(True), F.col("ocr_error"))).otherwise(store.image_audit_text(F.col("file_name"), F.col("ocr.text")))
        out.append(images.withColumns({"said": text, "unscannable": failed, "categories": categories(F.col("matches"))}))
    if "PERFORM_IMAGE_OCR" in there:
        out.append(of_kind(rows, "PERFORM_IMAGE_OCR").withColumns({"said": F.col("ocr.text"), "unscannable": F.col("ocr_error").isNotNull()}))
    return reduce(DataFrame.unionByName, (shaped(x, ANSWERS) for x in out))


def _files(files: DataFrame, cache: DataFrame, settings: Settings, repair: str) -> DataFrame:
    got = analyze_files(extract_files(files), settings, F.col("destination_domain"), cache, repair)
    said = store.file_audit_text(F.col("file_name"), F.col("text"), F.col("unscannable"), F.col("reason"))
    return got.withColumns({"said": said, "source_type": F.lit("file_attachment"), "categories": categories(F.col("matches"))})


def dispatch(messages: DataFrame, stores: Stores, checkpoint: str, settings: Settings = Settings(), repair: str = "full"):
    """Starts a query that answers messages and keeps the stores. Those that ask for the audit log get its newest rows as they are after their micro-batch.

    What is cleared is deleted: earlier micro-batches' folders, and of the clearing one the rows up to the message that clears.
    """
    ship(messages.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        folder = f"{stores.answers}/epoch={epoch}"
        if not store.exists(spark, f"{folder}/_SUCCESS"):
            written_once(answered(batch, store.stored_cache(spark, stores.cache), settings, repair), stores.answers, epoch)
        done = spark.read.schema(ANSWERS).parquet(folder)
        marks = done.agg(*(F.max(F.when(kind() == k, place())).alias(k) for k in ("CLEAR_AUDIT_LOGS", "CLEAR_HASH_CACHE")), F.max(kind() == "GET_AUDIT_LOGS").alias("asked")).first()
        after = lambda mark: F.lit(True) if mark is None else place() > F.struct(F.lit(mark.ts).alias("ts"), F.lit(mark.id).alias("id"))

        rows = done.filter(F.col("audited") & F.col("action").isNotNull() & after(marks.CLEAR_AUDIT_LOGS))
        rows = rows.select("*", F.col("ts").alias("timestamp"), F.col("said").alias("prompt_text"), F.col("action").alias("decision"))
        written_once(store.audit_rows(rows), stores.audit, epoch)
        if marks.CLEAR_AUDIT_LOGS is not None:
            store.drop(spark, *(f"{stores.audit}/{p}" for p in store.partitions(spark, stores.audit) if int(p.removeprefix("epoch=")) < epoch))
        if marks.CLEAR_HASH_CACHE is not None:
            store.drop(spark, stores.cache)
        new = done.filter(kind().isin(*FILES) & F.col("audited") & after(marks.CLEAR_HASH_CACHE))
        store.upsert(store.cache_rows(new).withColumn("timestamp", F.lit(epoch).cast("timestamp")), stores.cache)
        if marks.asked:
            written_once(store.latest(audit_log(spark, stores)), stores.logs, epoch)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_log(spark: SparkSession, stores: Stores) -> DataFrame:
    """The audit log as it stands; empty if nothing was written."""
    return _stored(spark, stores.audit, store.AUDIT)


def answers(spark: SparkSession, stores: Stores) -> DataFrame:
    """All answers so far."""
    return _stored(spark, stores.answers, ANSWERS)


def batch_answers(spark: SparkSession, stores: Stores) -> DataFrame:
    """A row a batch of all files of it that have come so far."""
    return rollup(of_kind(answers(spark, stores), "ANALYZE_BATCH_FILES"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path) if store.partitions(spark, path) else spark.createDataFrame([], schema)
    return rows.select(*(c for c, _ in store.fields(schema)))
