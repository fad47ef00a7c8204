"""Risk score: the worst finding, weighed by who sends it and where to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.arrays import constant

CHUNKS = "array<struct<chunk_index:int,sensitive:boolean,category:string,confidence:double,skipped:boolean,timed_out:boolean,reason:string,latency_ms:long>>"
ANSWER = "struct<sensitive:boolean,category:string,confidence:double,skipped:boolean,timed_out:boolean,reason:string,latency_ms:long>"


@dataclass(frozen=True)
class Settings:
    """What an administrator sets. Maps are laid over the defaults; destinations added come after the known ones."""

    enable_regex: bool = True
    enable_llm: bool = True
    user_role: str = "engineering"
    block_threshold: int = 75
    redact_threshold: int = 45
    enable_metadata_sync: bool = False
    base_scores: dict[str, float] = field(default_factory=dict)
    role_weights: dict[str, float] = field(default_factory=dict)
    destination_trust: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, stored: dict) -> "Settings":
        """Stored values over the defaults, by the names they are stored under. Weights are never stored: they are given in code."""
        names = {"enableRegex": "enable_regex", "enableLLM": "enable_llm", "userRole": "user_role", "blockThreshold": "block_threshold", "redactThreshold": "redact_threshold", "enableMetadataSync": "enable_metadata_sync"}
        return cls(**{names[k]: v for k, v in stored.items() if k in names and v is not None})

    def constrained(self, moved: str = "block") -> "Settings":
        """With redact at most block: the other threshold follows the one that moved."""
        from dataclasses import replace

        if self.redact_threshold <= self.block_threshold:
            return self
        return replace(self, redact_threshold=self.block_threshold) if moved == "block" else replace(self, block_threshold=self.redact_threshold)


def rounded(x: Column) -> Column:
    """Half up, as whole number."""
    return F.floor(x + 0.5).cast("int")


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    """The entry of `key`; the default if there is none or it is 0."""
    entries = constant({k: float(v) for k, v in table.items()}, "map<string,double>")
    return F.coalesce(F.nullif(F.try_element_at(entries, key), F.lit(0.0)), F.lit(float(default)))


def regex_score(matches: Column, settings: Settings) -> Column:
    base = P.BASE | settings.base_scores
    worst = F.coalesce(F.array_max(F.transform(matches, lambda m: lookup(base, m["category"], 50))), F.lit(0.0))
    emails = F.size(F.filter(matches, lambda m: m["category"] == "email"))
    return F.when(emails >= 2, F.greatest(worst, F.lit(float(base.get("pii") or 70)))).otherwise(worst)


def answer_score(x: Column, settings: Settings) -> Column:
    base = P.BASE | settings.base_scores
    counts = F.coalesce(x["sensitive"], F.lit(False)) & ~F.coalesce(x["skipped"], F.lit(False))
    return F.when(counts, rounded(lookup(base, F.coalesce(x["category"], F.lit("")), 75) * F.coalesce(x["confidence"], F.lit(0.8)))).otherwise(0)


def llm_score(answer: Column, chunks: Column, settings: Settings) -> Column:
    """The worst chunk's; a single answer counts only where there are no chunks."""
    worst = F.coalesce(F.array_max(F.transform(chunks, lambda c: answer_score(c, settings))), F.lit(0))
    return F.when(F.size(chunks) > 0, worst).otherwise(answer_score(answer, settings))


def role_weight(role: Column, settings: Settings) -> Column:
    table = P.ROLES | settings.role_weights
    name = F.lower(F.trim(F.coalesce(F.nullif(role, F.lit("")), F.lit("default"))))
    return lookup(table, name, table.get("default") or 1.0)


def destination_weight(domain: Column, settings: Settings) -> Column:
    """Of the first known destination that the domain contains; of the unknown one if none."""
    table = dict(P.DESTINATIONS) | settings.destination_trust
    name = F.lower(F.trim(F.coalesce(F.nullif(domain, F.lit("")), F.lit("unknown"))))
    out = F.lit(float(table["unknown"]))
    for key, weight in reversed(table.items()):
        out = F.when(F.contains(name, F.lit(key)), F.lit(float(weight))).otherwise(out)
    return out


def no_answer() -> Column:
    return F.lit(None).cast(ANSWER)


def no_chunks() -> Column:
    return F.array().cast(CHUNKS)


def timed_out(answer: Column, chunks: Column) -> Column:
    return F.coalesce(answer["timed_out"], F.lit(False)) | F.exists(chunks, lambda c: F.coalesce(c["timed_out"], F.lit(False)))


def risk(matches: Column, role: Column, domain: Column, answer: Column | None = None, chunks: Column | None = None, unscannable: Column | None = None, settings: Settings = Settings()) -> Column:
    """struct<score, timed_out, breakdown>."""
    answer, chunks = no_answer() if answer is None else answer, no_chunks() if chunks is None else chunks
    unscannable = F.lit(False) if unscannable is None else unscannable
    by_rule, by_model = regex_score(matches, settings), llm_score(answer, chunks, settings)
    raw = F.greatest(by_rule, by_model.cast("double"))
    raw = F.when(unscannable & (raw < 80), F.lit(80.0)).otherwise(raw)
    who, where = role_weight(role, settings), destination_weight(domain, settings)
    critical = F.exists(matches, lambda m: m["category"].isin(*P.SCORE_FLOOR))
    score = rounded(raw * who * where)
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.when(critical, F.greatest(score, F.lit(95))).otherwise(score)))
    late = timed_out(answer, chunks)
    parts = F.struct(by_rule.cast("int").alias("regex_score"), by_model.alias("llm_score"), raw.cast("int").alias("raw_content_score"), who.alias("role_multiplier"), where.alias("destination_multiplier"), critical.alias("has_critical_hit"), late.alias("timed_out"))
    return F.struct(score.alias("score"), late.alias("timed_out"), parts.alias("breakdown"))
