"""Mixing sources to target weights. DataFrame operations only.

Each source gets a budget of words. Its documents stand in the order of a hash key; the key space is cut into ranges,
word counts are summed by source and range before anything is shuffled by key, and the offsets of the ranges turn the
running sums inside a range into running sums over the whole source. No task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.shared import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents of a source's range, about: as many leading hex digits of the key name a range as keep it there, three at least.
RANGE = 50_000
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """Of the id; rows without one go by their size, so that they don't lie in one range."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("size "), size.cast("string")))))


def range_digits(rows: int) -> int:
    digits = 3
    while rows > RANGE * 16**digits:
        digits += 1
    return digits


def source_targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with one row a source -> also target, double.

    Weights go to the sources by code point, null last, and repeat. A target stops at `most` times its source's size;
    sorted by the level at which they stop, sources before some place are full, and the rest share what they leave by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sums.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - (F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cap"))
    heavy = F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumns({"_left": left, "_heavy": heavy, "_place": F.row_number().over(by_level)})
    fits = F.col("_left") * F.col("_w") / F.col("_heavy") <= F.col("_cap")
    first = lambda c: F.first(F.when(fits, F.col(c)), ignorenulls=True).over(everything)
    ranked = ranked.withColumns({"_at": first("_place"), "_l": first("_left"), "_h": first("_heavy")})
    target = F.when(F.col("_place") >= F.col("_at"), F.col("_l") * F.col("_w") / F.col("_h")).otherwise(F.col("_cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, digits: int | None = None) -> DataFrame:
    """All rows and columns of `docs` (doc_id, source, size, ...) with source_size, target and taken.

    `taken` counts the words that the mix takes from the document: whole epochs over its source, then once more the
    documents in the order of their keys until the source's budget, the target rounded to a word, is used up exactly; the
    last one counts in part. Columns of `docs` named like a result are replaced.

    Nulls: a null source is a source of its own, the last; rows without doc_id have one key a size; a null size is 0. Rows are counted for the number of ranges, unless `digits` says it.
    Rows that repeat a doc_id share a key and stand by size; equal rows are interchangeable. Sources without words have
    target 0. An empty table gives an empty result.
    """
    docs = docs.drop("source_size", "target", "taken", "_key", "_range", "_name", "_nameless")
    digits = range_digits(docs.count()) if digits is None else digits
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    docs = docs.withColumns({"size": size, "_key": random_key(F.col("doc_id"), size, seed), "_name": F.coalesce("source", F.lit("")), "_nameless": F.col("source").isNull()}).withColumn("_range", F.substring("_key", 1, digits))
    of = ["_name", "_nameless"]  # without nulls, so that the join and the running sums below are dealt by the same columns, once
    sums = docs.groupBy(*of, "_range").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy(*of).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.withColumn("_before", F.sum("_sum").over(ahead) - F.col("_sum"))
    totals = sums.groupBy(*of).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(totals.select(F.when(~F.col("_nameless"), F.col("_name")).alias("source"), "source_size"), weights, share, most)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_nameless"), "source_size", "target")
    places = offsets.join(targets, of).select(*of, "_range", "_before", "source_size", "target")
    dealt = docs.join(places, [*of, "_range"])
    inside = Window.partitionBy(*of, "_range").orderBy("_key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_before") + F.sum("size").over(inside) - F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return dealt.withColumn("taken", taken.cast("long")).drop("_key", "_range", "_name", "_nameless", "_before")


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as the mix takes it; the last of a source stays whole, as texts are never cut."""
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return mixed.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")
