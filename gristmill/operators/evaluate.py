"""Evaluation of decisions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.pipelines import analyze_prompts
from gristmill.operators.risk import Settings
from gristmill.operators.scan import once

ROLE, DOMAIN = "engineering", "chatgpt.com"


def stamped(df: DataFrame, name: str) -> DataFrame:
    """All columns with a row's own time, in nanoseconds, when it passes here. Rows go through a stage one by one, so two stamps around an analysis are the item's own time."""
    return once(df, name, F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long"))


def evaluate(items: DataFrame, settings: Settings = Settings(), repair: str = "minimal") -> DataFrame:
    """(id, text, is_sensitive, category; reply, delay_ms) -> a row of results for each item, at the evaluation's role and destination.

    total_latency_ms is the item's own time from text to decision, its classifier's included, rounded up; llm_latency_ms is the classifier's alone.
    """
    rows = stamped(items, "_began").withColumns({"prompt_text": F.col("text"), "user_role": F.lit(ROLE), "destination_domain": F.lit(DOMAIN)})
    done = stamped(analyze_prompts(rows, settings, repair), "_ended")
    a = F.col("answer")
    late = F.coalesce(a["latency_ms"], F.lit(0))
    return done.select(
        "id", "text", F.col("is_sensitive").alias("ground_truth_sensitive"), F.col("category").alias("ground_truth_category"),
        F.col("action").alias("predicted_action"), "risk_score", F.size("matches").alias("regex_hits_count"), F.coalesce(a["sensitive"], F.lit(False)).alias("llm_sensitive"),
        F.coalesce(a["confidence"], F.lit(0.0)).alias("llm_confidence"), a["category"].alias("llm_category"), F.coalesce(a["skipped"], F.lit(True)).alias("llm_skipped"),
        late.cast("double").alias("llm_latency_ms"), F.ceil((F.col("_ended") - F.col("_began")) / 1_000_000 + late).cast("int").alias("total_latency_ms"),
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def _counts() -> list[Column]:
    flagged, truth = F.col("predicted_action").isin("block", "redact"), F.coalesce(F.col("ground_truth_sensitive"), F.lit(False))
    n = lambda c, name: F.count_if(c).alias(name)
    return [F.count("*").alias("total"), n(flagged & truth, "tp"), n(flagged & ~truth, "fp"), n(~flagged & ~truth, "tn"), n(~flagged & truth, "fn")]


def confusion(results: DataFrame) -> DataFrame:
    return results.agg(*_counts())


def by_latency(results: DataFrame, column: str, counts: list[Column]) -> tuple[DataFrame, list[Column]]:
    """A row for each different latency, with `counts`; and what gives (avg_latency_ms, median_latency_ms) of those above 0 when it is aggregated.

    The median is the upper one, the place floor(n / 2) in the sorted list: only different latencies are ranked, nothing is gathered.
    """
    from pyspark.sql import Window

    each = results.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"), *counts)
    n = F.when(F.col("v") > 0, F.col("n")).otherwise(0)
    ranked = each.withColumns({"_n": n, "_upto": F.sum(n).over(Window.orderBy("v")), "_all": F.sum(n).over(Window.partitionBy())})
    middle = F.min(F.when((F.col("v") > 0) & (F.col("_upto") > F.floor(F.col("_all") / 2)), F.col("v")))
    mean = F.try_divide(F.sum(F.col("v") * F.col("_n")), F.sum("_n"))
    return ranked, [F.coalesce(mean, F.lit(0.0)).alias("avg_latency_ms"), F.coalesce(middle, F.lit(0)).alias("median_latency_ms")]


def metrics(results: DataFrame) -> DataFrame:
    """One row: the confusion matrix, precision, recall, F1 and accuracy in percent, and latencies of those above 0. The results are read once."""
    names = ("total", "tp", "fp", "tn", "fn")
    each, late = by_latency(results, "total_latency_ms", _counts())
    c = each.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names), *late)
    p, r = percent(F.col("tp"), F.col("tp") + F.col("fp")), percent(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumns({"precision": p, "recall": r}).withColumns({"f1": F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)), "accuracy": percent(F.col("tp") + F.col("tn"), F.col("total"))})
    text = {x: F.format_string("%.2f%%", x) for x in ("precision", "recall", "f1", "accuracy")}
    order = [*names, *text, "avg_latency_ms", "median_latency_ms"]
    return c.withColumns(text).select(*order)


def latency(results: DataFrame, column: str = "total_latency_ms") -> DataFrame:
    """(avg_latency_ms, median_latency_ms) in one row."""
    each, late = by_latency(results, column, [])
    return each.agg(*late)


def side_by_side(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """(metric, regex_only, hybrid) of one or two passes' metrics; N/A where there is no second."""
    names = ("total", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy", "avg_latency_ms", "median_latency_ms")
    long = lambda df, name: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("string") for c in names)))).alias("metric", name))
    out = long(first, "regex_only")
    return out.join(long(second, "hybrid"), "metric") if second is not None else out.withColumn("hybrid", F.lit("N/A"))


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_items(spark, path: str) -> DataFrame:
    return spark.read.schema("id string, text string, is_sensitive boolean, category string").option("multiLine", True).json(path)
