"""Audit log and decision cache: what is written, and how it is read again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.policy import REASONS

AUDIT = (
    "id long, timestamp timestamp, prompt_text string, destination_domain string, user_role string, risk_score int, decision string, explanation string, "
    f"reasons {REASONS}, categories array<string>, file_name string, file_type string, file_size long, unscannable boolean, fixed_floor_triggered boolean, source_type string, latency_ms long"
)
CACHE = f"hash string, decision string, risk_score int, timestamp timestamp, explanation string, reasons {REASONS}, categories array<string>, file_name string, unscannable boolean, fixed_floor_triggered boolean, cached boolean"
LATEST = 100


def fields(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]


def file_audit_text(name: Column, text: Column, unscannable: Column, why: Column) -> Column:
    """What an audit row says of a file: why it is closed, or the start of its text."""
    opened = F.concat(F.lit("[FILE ATTACHMENT: "), name, F.lit('] Extracted Text Snippet: "'), F.substring(F.coalesce(text, F.lit("")), 1, 150), F.lit('..."'))
    closed = F.concat(F.lit("[FILE ATTACHMENT: "), name, F.lit("] (Unscannable: "), F.coalesce(why, F.lit("")), F.lit(")"))
    return F.when(unscannable, closed).otherwise(opened)


def image_audit_text(name: Column, text: Column) -> Column:
    return F.concat(F.lit("[IMAGE OCR: "), name, F.lit("] "), F.substring(F.coalesce(text, F.lit("")), 1, 300))


def audit_rows(df: DataFrame, hash_prompts: bool = False) -> DataFrame:
    """Rows of the audit table; what is missing, null, empty or 0 gets its default. With hash_prompts texts are stored as digests."""
    has = set(df.columns)
    given = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    default = {
        "timestamp": F.current_timestamp(), "prompt_text": F.lit(""), "destination_domain": F.lit("unknown"), "user_role": F.lit("default"), "risk_score": F.lit(0), "decision": F.lit("allow"),
        "explanation": F.lit(""), "reasons": F.array().cast(REASONS), "categories": F.array().cast("array<string>"), "unscannable": F.lit(False), "fixed_floor_triggered": F.lit(False), "latency_ms": F.lit(0).cast("long"),
    }
    out = {c: F.coalesce(F.nullif(given(c, kind), F.lit("")) if kind == "string" else given(c, kind), default.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in fields(AUDIT)}
    named = F.nullif(given("file_name", "string"), F.lit("")).isNotNull()
    out["source_type"] = F.coalesce(F.nullif(given("source_type", "string"), F.lit("")), F.when(named, "file_attachment").otherwise("prompt_submission")).alias("source_type")
    if hash_prompts:
        out["prompt_text"] = F.sha2(F.coalesce(given("prompt_text", "string"), F.lit("")), 256).alias("prompt_text")
    return df.select(*out.values())


def append_audit(df: DataFrame, path: str, hash_prompts: bool = False, period: str = "day") -> None:
    """Adds rows to the audit table, partitioned by day; newest rows can then be found without reading the others.

    `period` may be month or year where days hold few rows: each is a folder with its files, which cost more than their rows. A table keeps one period: folders are named by it.
    """
    audit_rows(df, hash_prompts).withColumn(period, F.to_date(F.date_trunc(period, "timestamp"))).write.mode("append").partitionBy(period).parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(audit: DataFrame, n: int = LATEST) -> DataFrame:
    """The newest n rows, newest first; of equal times the larger id first."""
    return audit.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def newest(spark: SparkSession, path: str, n: int = LATEST) -> DataFrame:
    """`latest` of an audit table that `append_audit` has written, without reading all of it: days (or other periods) are counted from the last one back until n rows are there.

    Counting reads no column. A day more is read than needed, as sessions may have written in different time zones.
    """
    days = sorted((d for d in partitions(spark, path) if "=" in d), reverse=True)
    period = days[0].split("=")[0] if days else "day"
    rows, since, step, at = read_audit(spark, path), None, 1, 0
    of_day = lambda d: d.removeprefix(f"{period}=")
    while at < len(days):
        some = [of_day(d) for d in days[at : at + step]]
        at, step = at + step, 2 * step  # twice as many days each time, so that sparse tables take few looks
        since = some[-1]
        if rows.filter(F.col(period) >= F.lit(since).cast("date")).count() >= n:
            break
    if at < len(days):
        since = of_day(days[min(at, len(days) - 1)])
    return latest(rows if since is None else rows.filter(F.col(period) >= F.lit(since).cast("date")), n)


def _at(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a place, whichever system it lies in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a table's folder; none if it isn't there."""
    fs, folder = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()] if fs.exists(folder) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables or parts of tables; those that aren't there are left."""
    for path in paths:
        fs, where = _at(spark, path)
        fs.delete(where, True)


def search(audit: DataFrame, words: str, n: int = LATEST) -> DataFrame:
    """Those of the newest n rows that hold `words`, in any case, in text, decision, destination or a category."""
    low = F.lit(words.lower())
    within = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), low)
    return latest(audit, n).filter(within("prompt_text") | within("decision") | within("destination_domain") | F.exists("categories", lambda c: F.contains(F.lower(c), low)))


def reason_rollup(df: DataFrame) -> DataFrame:
    """(description, n): how often each reason was given."""
    return df.select(F.explode("reasons").alias("r")).groupBy(F.col("r.description").alias("description")).agg(F.count("*").alias("n"))


def metadata(audit: DataFrame) -> DataFrame:
    """What may be shared: everything but texts and explanations."""
    return audit.drop("prompt_text", "explanation", "reasons", "file_name")


def newest_by_hash(cache: DataFrame) -> DataFrame:
    """The last entry of each hash. max_by keeps one row a hash on the map side, however often a hash is written."""
    row = F.struct(*cache.columns)
    return cache.groupBy("hash").agg(F.max_by(row, F.col("timestamp")).alias("r")).select("r.*")


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    return newest_by_hash(cache.unionByName(new, allowMissingColumns=True))


#: Hex digits of a hash that name its part of a stored cache.
BUCKET = 2


def upsert(new: DataFrame, path: str) -> None:
    """Entries into a stored cache: only the parts that they fall in are read and written again, so a small batch costs little however large the cache is.

    The last entry of a hash stays; doing it again changes nothing. Parts are replaced when all are written. One writer at a time.
    """
    spark = new.sparkSession
    part = F.substring("hash", 1, BUCKET)
    new = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(kind).alias(c) for c, kind in fields(CACHE))).filter(F.col("hash").isNotNull()).withColumn("bucket", part)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # 16 ** BUCKET at most
    there = {p.removeprefix("bucket=") for p in partitions(spark, path)}
    if both := sorted(there & set(touched)):
        old = stored_cache(spark, path, keep_bucket=True).filter(F.col("bucket").isin(*both))
        new = old.unionByName(new)
    merged = newest_by_hash(new.select("bucket", *(c for c, _ in fields(CACHE))))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored_cache(spark: SparkSession, path: str, keep_bucket: bool = False) -> DataFrame:
    """A stored cache; empty if nothing was stored."""
    if not partitions(spark, path):
        return spark.createDataFrame([], CACHE + (", bucket string" if keep_bucket else ""))
    rows = spark.read.schema(CACHE + ", bucket string").parquet(path)
    return rows if keep_bucket else rows.drop("bucket")


def cache_rows(decisions: DataFrame) -> DataFrame:
    """What the cache keeps of decisions; categories stay empty, and cached is set."""
    return decisions.filter(F.col("hash").isNotNull()).select(
        "hash", F.col("action").alias("decision"), "risk_score", F.current_timestamp().alias("timestamp"), "explanation", "reasons",
        F.array().cast("array<string>").alias("categories"), "file_name", "unscannable", "fixed_floor_triggered", F.lit(True).alias("cached"),
    )


def looked_up(df: DataFrame, cache: DataFrame) -> DataFrame:
    """All columns of `df` with `entry`, the cache's last one of the row's `hash`; null where there is none. The cache is the one before this batch: rows of the batch don't see each other."""
    entries = newest_by_hash(cache).select(F.col("hash").alias("_key"), F.struct(*cache.columns).alias("entry"))
    # rows without a hash would be one key
    keyed = df.withColumn("_key", F.coalesce("hash", F.concat(F.lit("none "), F.monotonically_increasing_id())))
    return keyed.join(entries, "_key", "left").drop("_key")


def emptied(table: DataFrame) -> DataFrame:
    """What clearing a table leaves."""
    return table.limit(0)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def accepted(df: DataFrame, by: str = "user_id", at: str = "ts", text: str = "prompt_text", within_ms: int = 1500) -> DataFrame:
    """Rows that aren't repeats: the same text within `within_ms` of the last accepted row of the same session.

    A dropped row doesn't move the time on. A session's rows stream by in order; what is held of it is the last accepted text and time, and
    the rows of one Arrow batch. Of equal times the other columns decide.
    """
    ms = (F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("long")
    tie = [c for c in df.columns if c not in (by, at, text)]
    rows = df.withColumn("_ms", ms).repartition(by).sortWithinPartitions(by, "_ms", *tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last_text, last_ms = None, None, None
        for batch in batches:
            keep = []
            for who, when, said in zip(batch.column(by).to_pylist(), batch.column("_ms").to_pylist(), batch.column(text).to_pylist(), strict=True):
                if who != session:
                    session, last_text, last_ms = who, None, None
                fresh = last_ms is None or when is None or said != last_text or when - last_ms >= within_ms
                if fresh:
                    last_text, last_ms = said, when
                keep.append(fresh)
            yield batch.drop_columns(["_ms"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, df.schema)
