"""Pattern scan: every rule's matches in a text, checked, in rule order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.arrays import constant, let, placed, proposed
from gristmill.functions.text import repaired
from gristmill.functions.validators import CHECKS

MATCHES = "array<struct<category:string,label:string,match:string,index:int,severity:string>>"


def _proposed(text: Column, digits: Column, rule: P.Rule, name: int) -> Column:
    """Of one rule, without checks; texts without its signs, digits or hint aren't searched. `digits`: whether the text has two in a row."""
    found = proposed(text, P.searched(rule), name)
    needed = [reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in rule.signs))] if rule.signs else []
    needed += ([digits] if rule.digits else []) + ([text.rlike(P.java(rule.hint, rule.fold))] if rule.hint else [])
    return F.when(reduce(Column.__and__, needed), found) if needed else found


def scan(text: Column, rules: Sequence[P.Rule] = P.RULES) -> Column:
    """All rules' matches in a repaired text, by rule, then by place. A match that fails its check is dropped with the text that it took.

    All rules' proposals are one array: they are placed, checked and named together.
    """
    if not rules:
        return F.array().cast(MATCHES)
    seen = F.struct(text.alias("text"), text.rlike("[0-9]{2}").alias("digits"))
    hits = placed(let(seen, lambda s: F.array(*(_proposed(s["text"], s["digits"], r, k) for k, r in enumerate(rules)))))
    checks = [(k, CHECKS[r.category]) for k, r in enumerate(rules) if r.category in CHECKS]

    def holds(m: Column) -> Column:
        out = F.lit(True)
        for k, check in checks:
            out = F.when(m["name"] == k, check(m["match"])).otherwise(out)
        return out

    told = constant([{"category": r.category, "label": r.label, "severity": r.severity} for r in rules], "array<struct<category:string,label:string,severity:string>>")

    def full(m: Column) -> Column:
        rule = F.get(told, m["name"])
        return F.struct(rule["category"].alias("category"), rule["label"].alias("label"), m["match"].alias("match"), m["index"].alias("index"), rule["severity"].alias("severity"))

    return F.transform(F.filter(hits, holds) if checks else hits, full).cast(MATCHES)


def rule_matches(text: Column, rule: P.Rule) -> Column:
    """Of one rule."""
    return scan(text, (rule,))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once a row, however often and wherever it is used.

    Filters and projections above would else be given copies of the whole expression. A generator of one row is what the optimiser
    doesn't look through.
    """
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def with_matches(df: DataFrame, text: str = "text", repair: str = "full", enabled: bool = True) -> DataFrame:
    """All columns of `df` with repaired_text and matches; with enabled=False nothing is looked for."""
    df = df.withColumn("repaired_text", repaired(F.col(text), repair))
    return once(df, "matches", scan(F.col("repaired_text"))) if enabled else df.withColumn("matches", F.array().cast(MATCHES))


def exploded(df: DataFrame) -> DataFrame:
    """A row for each match: ord, category, label, match, index, severity instead of matches."""
    kept = [c for c in df.columns if c not in ("matches", "repaired_text")]
    return df.select(*kept, F.posexplode("matches").alias("ord", "m")).select(*kept, "ord", "m.*")
