"""Settings as a table with versions: each submission is decided under those that held for its tenant at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.risk import Settings

#: Versions that may be sent to every executor.
FEW = 100_000
DEFAULT = Settings()


def versions(changes: DataFrame) -> DataFrame:
    """Changes (tenant, valid_from; any of block_threshold, redact_threshold, user_role) -> what held from when to when, one row a change.

    A null keeps what was set before, or the default where nothing was. Redaction never starts above blocking: the threshold that a change moves takes the other one with it, as the
    last of both that was set. Of changes at the same time the last by value counts. Null tenants are a tenant.
    """
    has = set(changes.columns)
    given = {"block_threshold": "int", "redact_threshold": "int", "user_role": "string"}
    rows = changes.select("tenant", "valid_from", *((F.col(c) if c in has else F.lit(None)).cast(kind).alias(c) for c, kind in given.items()))
    rows = rows.groupBy("tenant", "valid_from").agg(*(F.max(c).alias(c) for c in given))
    upto = Window.partitionBy("tenant").orderBy("valid_from").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_time = Window.partitionBy("tenant").orderBy("valid_from")
    defaults = {"block_threshold": DEFAULT.block_threshold, "redact_threshold": DEFAULT.redact_threshold, "user_role": DEFAULT.user_role}
    held = rows.select("tenant", "valid_from", F.lead("valid_from").over(by_time).alias("valid_to"), F.col("block_threshold").isNotNull().alias("_moved"), *(F.coalesce(F.last(c, True).over(upto), F.lit(defaults[c])).alias(c) for c in given))
    block, redact = F.col("block_threshold"), F.col("redact_threshold")
    over = redact > block
    fixed = held.withColumns({"redact_threshold": F.when(over & F.col("_moved"), block).otherwise(redact), "block_threshold": F.when(over & ~F.col("_moved"), redact).otherwise(block)})
    return fixed.drop("_moved")


def as_of(submissions: DataFrame, changes: DataFrame, at: str = "ts", few: int = FEW) -> DataFrame:
    """All columns of `submissions` (tenant, `at`, ...) with block_threshold, redact_threshold and user_role as they held; defaults before a tenant's first change.

    Every submission meets its tenant's versions and keeps the one of its time: an equal join, never a cross one. Versions are counted; few are sent everywhere, so that submissions aren't shuffled, more are
    joined by tenant, where a tenant with very many submissions is split by the engine.
    """
    names = ("block_threshold", "redact_threshold", "user_role")
    held = versions(changes).withColumnRenamed("tenant", "_tenant")
    held = F.broadcast(held) if held.count() <= few else held
    rows = submissions.drop(*names)
    fits = rows["tenant"].eqNullSafe(held["_tenant"]) & (rows[at] >= held["valid_from"]) & (held["valid_to"].isNull() | (rows[at] < held["valid_to"]))
    joined = rows.join(held, fits, "left").drop("_tenant", "valid_from", "valid_to")
    return joined.withColumns({c: F.coalesce(c, F.lit(getattr(DEFAULT, c))) for c in names})


def by_row() -> Settings:
    """Settings whose thresholds are the columns of `as_of`; the role goes with the row as user_role."""
    return Settings(block_threshold=F.col("block_threshold"), redact_threshold=F.col("redact_threshold"))
