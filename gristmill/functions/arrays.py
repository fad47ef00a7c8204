"""Array functions, Column -> Column, whose time grows with the array and not with its square."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are gone through by themselves; a running value is built by copying what is there, so long arrays go block by block.
BLOCK = 64


def constant(value: object, kind: str) -> Column:
    """A literal of a type with parts, folded when the plan is made; put together from parts it would be a call to the JVM for each."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once, however often `use` has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column], block: int = BLOCK) -> Column:
    """For each element of array<long> what those before it come to: array<long>. `combine` is associative, `zero` changes nothing."""

    def scan(some: Column) -> Column:
        start = F.struct(zero.cast("long").alias("acc"), F.array().cast("array<long>").alias("out"))
        step = lambda a, x: F.struct(combine(a["acc"], x).cast("long").alias("acc"), F.concat(a["out"], F.array(a["acc"])).alias("out"))
        return F.aggregate(some, start, step)

    def joined(parts: Column) -> Column:
        tops = scan(F.transform(parts, lambda p: p["acc"]))["out"]
        return F.flatten(F.zip_with(parts, tops, lambda p, t: F.transform(p["out"], lambda o: combine(t, o).cast("long"))))

    def over(v: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block))
        return let(F.transform(firsts, lambda k: scan(F.slice(v, k, F.lit(block)))), joined)

    # most arrays are short: a single fold, without the machinery of blocks
    return let(values, lambda v: F.when(F.size(v) <= block, scan(v)["out"]).otherwise(over(v)))


def proposed(text: Column, pattern: str, name: int = 0) -> Column:
    """Matches without overlap, left to right, and the gaps around them: struct<name,hits,gaps>; null if there are none."""
    split = lambda hits: F.struct(F.lit(name).alias("name"), hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, split(hits)))


#: Where a running value holds the name of what it belongs to; offsets lie below.
NAME_BITS = 40


def placed(patterns: Column) -> Column:
    """What patterns of ascending names propose (array of `proposed`, nulls for none), one match behind the other, with offsets in code points: array<struct<name,match,index>>.

    Sums begin anew with each name: a value whose name is a later one has seen nothing of the earlier ones.
    """
    name = lambda v: F.shiftright(v, NAME_BITS)
    within = lambda v: v.bitwiseAND(F.lit((1 << NAME_BITS) - 1))
    # 0 is what has been seen before the first value, of no name: a block of values begins with it
    joined = lambda a, b: F.when(b == 0, a).when(name(a) == name(b), a + within(b)).otherwise(b)

    def over(some: Column) -> Column:
        before = running(F.transform(some, lambda m: F.shiftleft(m["name"].cast("long"), NAME_BITS) + m["gap"] + F.length(m["match"])), F.lit(0), joined)
        at = lambda m, b: F.when(name(b) == m["name"], within(b)).otherwise(0) + m["gap"]
        return F.zip_with(some, before, lambda m, b: F.struct(m["name"].alias("name"), m["match"].alias("match"), at(m, b).cast("int").alias("index")))

    # each match with the gap before it; the last gap has no match. Arrays made inside a lambda would be made anew for every element
    of = lambda p: F.filter(F.zip_with(p["hits"], p["gaps"], lambda m, g: F.struct(p["name"].alias("name"), m.alias("match"), F.length(g).alias("gap"))), lambda x: x["match"].isNotNull())
    return let(F.flatten(F.transform(F.filter(patterns, lambda p: p.isNotNull()), of)), over)


def found(text: Column, pattern: str) -> Column:
    """Matches without overlap, left to right, with their offsets in code points: array<struct<name,match,index>>, all of name 0."""
    return placed(F.array(proposed(text, pattern)))
