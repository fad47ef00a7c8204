"""Policy in two layers: a floor that nothing loosens, then the administrator's thresholds. Redaction and explanation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.arrays import constant, let
from gristmill.operators.risk import Settings, no_answer, no_chunks, rounded, timed_out

REASONS = "array<struct<type:string,category:string,description:string>>"


def reason(kind: str, category: Column, description: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), category.alias("category"), description.alias("description"))


def filled(template: str, *values: Column) -> Column:
    """The template with its {} replaced, as a column."""
    parts = template.split("{}")
    pieces = [x for k, part in enumerate(parts) for x in ([F.lit(part)] if part else []) + ([values[k].cast("string")] if k < len(values) else [])]
    return F.concat(*pieces)


def _those(*candidates: Column) -> Column:
    return F.filter(F.array(*candidates), lambda r: r.isNotNull()).cast(REASONS)


def floor_reasons(matches: Column, score: Column, unscannable: Column, file_name: Column, why: Column) -> Column:
    """One reason a category, not a match; the score's own only if there is no other."""
    rules = constant([{"category": c, "description": text} for c, text in P.FLOOR], "array<struct<category:string,description:string>>")
    seen = F.transform(matches, lambda m: m["category"])
    named = F.transform(F.filter(rules, lambda r: F.array_contains(seen, r["category"])), lambda r: reason("fixed_floor_violation", r["category"], r["description"]))
    or_else = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text))
    said = filled(P.UNSCANNABLE_REASON, or_else(file_name, P.UNSCANNABLE_NAME), or_else(why, P.UNSCANNABLE_WHY))
    closed = F.when(unscannable, reason("fixed_floor_violation", F.lit("unscannable_file"), said))
    found = F.concat(named.cast(REASONS), _those(closed))
    rated = filled(P.CRITICAL_REASON, score)
    critical = _those(F.when(score >= 90, reason("fixed_floor_violation", F.lit("critical_risk"), rated)))
    return F.when(F.size(found) > 0, found).otherwise(critical)


def admin_reasons(matches: Column, answer: Column, late: Column) -> Column:
    """One a match, then the classifier's, then the time-out's."""
    structured = F.transform(matches, lambda m: reason("structured_pattern", m["category"], filled(P.PATTERN_REASON, F.coalesce(m["label"], m["category"]))))
    sure = rounded(F.coalesce(F.nullif(answer["confidence"], F.lit(0.0)), F.lit(0.8)) * 100)
    category = F.coalesce(F.nullif(answer["category"], F.lit("")), F.lit("confidential"))
    said = filled(P.CONTEXT_REASON, category, sure)
    counts = F.coalesce(answer["sensitive"], F.lit(False)) & ~F.coalesce(answer["skipped"], F.lit(False))
    timeout = F.lit(P.TIMEOUT_REASON)
    more = _those(F.when(counts, reason("contextual_sensitivity", category, said)), F.when(late, reason("llm_timeout_failsafe", F.lit("timeout_failsafe"), timeout)))
    return F.concat(structured.cast(REASONS), more)


def redacted(text: Column, matches: Column, answer: Column | None = None) -> Column:
    """Each match's text, wherever it stands in the original, by its category's mark; then what a sensitive answer asks for.

    Matches come from the repaired text: one that the original doesn't hold leaves it as it is. A match that repeats is looked for once: the first time replaces all of it.
    """
    mark = lambda m: F.concat(F.lit("[REDACTED_"), F.upper(m["category"]), F.lit("]"))
    unlike = F.array_distinct(F.transform(matches, lambda m: F.struct(m["match"].alias("match"), m["category"].alias("category"))))
    out = F.aggregate(unlike, F.coalesce(text, F.lit("")), lambda a, m: F.replace(a, m["match"], mark(m)))
    if answer is None:
        return out
    category = F.lower(F.coalesce(answer["category"], F.lit("")))
    # a digit first, then what stands before it: boundaries looked for at every character took most of the time
    pins = F.regexp_replace(out, P.java(f"[0-9](?<!{P._WORD}[0-9])[0-9]{{3,7}}{{R}}"), "[REDACTED_PIN]")
    out2 = F.when(F.contains(category, F.lit("financial")) | F.contains(category, F.lit("proprietary")), pins).otherwise(out)
    pairs = lambda t: F.regexp_replace(t, P.java("(?=[pskt])(pin|password|passcode|secret|key|token)[{S}]*[:=][{S}]*([^{S}]+)", True), "$1: [REDACTED_SECRET]")
    paired = let(out2, lambda t: F.when(F.contains(t, F.lit(":")) | F.contains(t, F.lit("=")), pairs(t)).otherwise(t))
    return F.when(F.coalesce(answer["sensitive"], F.lit(False)), paired).otherwise(out)


def unredacted(text: Column, matches: Column) -> Column:
    """Matches that redaction can't find in the original text."""
    return F.size(F.filter(matches, lambda m: ~F.contains(F.coalesce(text, F.lit("")), m["match"])))


def policy(matches: Column, risk: Column, text: Column | None = None, answer: Column | None = None, chunks: Column | None = None, unscannable: Column | None = None, file_name: Column | None = None, why: Column | None = None, settings: Settings = Settings()) -> Column:
    """struct<action, risk_score, reasons, fixed_floor_triggered, redacted_text>. Settings can tighten, never loosen."""
    text, answer = F.lit("") if text is None else text, no_answer() if answer is None else answer
    chunks, unscannable = no_chunks() if chunks is None else chunks, F.lit(False) if unscannable is None else unscannable
    score = risk["score"]
    floor = floor_reasons(matches, score, unscannable, F.lit("") if file_name is None else file_name, F.lit("") if why is None else why)
    block, redact = F.least(F.lit(89), F.lit(settings.block_threshold)), F.least(F.lit(settings.block_threshold), F.lit(settings.redact_threshold))  # numbers or columns
    serious = F.exists(matches, lambda m: m["severity"].isNotNull() & (m["severity"] != "low"))
    hit = F.size(floor) > 0
    action = F.when(hit | (score >= block), "block").when((score >= redact) | serious, "redact").otherwise("allow")
    late = risk["timed_out"] | timed_out(answer, chunks)
    return F.struct(
        action.alias("action"),
        F.when(hit, F.greatest(score, F.lit(95))).otherwise(score).alias("risk_score"),
        F.when(hit, floor).otherwise(admin_reasons(matches, answer, late)).alias("reasons"),
        hit.alias("fixed_floor_triggered"),
        redacted(text, matches, answer).alias("redacted_text"),
    )


def explanation(action: Column, score: Column, reasons: Column, floor: Column, file_name: Column | None = None) -> Column:
    """What was decided, why and what to do next, in a sentence or two."""
    name = F.nullif(F.lit(None).cast("string") if file_name is None else file_name, F.lit(""))
    filed = name.isNotNull()
    subject = F.when(filed, filled(P.SAID_FILE, name)).otherwise(P.SAID_MESSAGE)
    n = F.size(reasons)
    unlike = F.array_distinct(F.transform(reasons, lambda r: r["description"]))
    first = F.get(unlike, F.lit(0))
    others = filled(P.SAID_OTHERS, first, n - 1, F.when(n > 2, "s").otherwise(""))
    why = F.when(F.size(unlike) == 1, first).when(F.size(unlike) > 1, others).otherwise(filled(P.SAID_LIMIT, score))
    step = F.lit(None).cast("string")
    for (of, by_floor, of_file), text in P.STEPS.items():
        fits = action == of
        for wanted, holds in ((by_floor, floor), (of_file, filed)):
            fits = fits if wanted is None else fits & (holds if wanted else ~holds)
        step = F.when(fits, text).otherwise(step)
    said = filled(P.SAID, subject, F.upper(action), score, why, step)
    return F.when((action == "allow") & (n == 0), filled(P.SAID_FINE, subject, score)).otherwise(said)
