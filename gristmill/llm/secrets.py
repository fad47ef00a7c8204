r"""Secret scans. DataFrame operations only.

Base spans come from three patterns. The method adds spans: in every candidate string, a run of 20 or more characters of
the base64 alphabet that holds a digit and a letter, a window of 20 characters slides along; the counts of its
characters change by one that enters and one that leaves, and with them the sum of n log2 n from which Shannon's
entropy follows. Hexadecimal strings and others have thresholds of their own. Windows that reach the threshold make
the span. Strings on the allow list (UUIDs, runs of the alphabet, placeholders) are passed over, as are strings that
touch a base span. With parts=True, which the pipeline uses and the query's SQL doesn't, base spans and the allow list's words are cut
out of a string instead, and windows slide along each part that remains.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrays import found, let, running

#: Fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character in a window, by class.
HEX_BITS, MIXED_BITS = 2.8, 3.6
#: A candidate starts where its run starts and holds a digit.
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)(abcdefghij|0123456789abcdef|example|placeholder|changeme|your[_-])",
    r"^[0-9+/_=-]+$",
)
#: Those of the allow list that speak of a whole string, and the words.
WHOLE, WORDS = (ALLOW[0], ALLOW[2]), ALLOW[1]
MICRO = 1_000_000
#: Counts of a window's characters: bits of a count, counts in a long.
BITS, PACK = 5, 12
#: Above every offset.
LAST = 2**40
#: n log2 n in millionths of a bit for n = 0 .. WINDOW: whole numbers, so that sums are exact and the same everywhere.
WEIGHT = [round(n * math.log2(n) * MICRO) if n else 0 for n in range(WINDOW + 1)]


def most_sum(bits: float) -> int:
    """The largest sum of n log2 n of a window whose entropy is at least `bits`."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * MICRO)


def pieces(text: Column, pattern: str) -> Column:
    """Matches of `pattern`, left to right without overlap: array<struct<s,e,m>>, code points, end exclusive."""
    spelt = F.transform(found(text, pattern), lambda x: F.struct(x["index"].alias("s"), (x["index"] + F.length(x["match"])).alias("e"), x["match"].alias("m")))
    return F.when(text.rlike(pattern), spelt).otherwise(none())


def none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string>>")


def spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def value_length(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2))


def noisy_span(run: Column) -> Column:
    """The part of a candidate that windows of high entropy cover, as struct<s,e>, null if none.

    One pass: a character enters, the one WINDOW before it leaves, each changes its count by one. A count has BITS bits, PACK counts lie in
    a long, so that few numbers hold the alphabet's.
    """
    text = run["m"]
    limit = F.when(text.rlike("^[0-9a-f]+$") | text.rlike("^[0-9A-F]+$"), F.lit(most_sum(HEX_BITS))).otherwise(F.lit(most_sum(MIXED_BITS)))
    more = F.array(*(F.lit(WEIGHT[n + 1] - WEIGHT[n]).cast("long") for n in range(WINDOW)))  # what the n + 1st of a character adds
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    place = lambda n: F.struct(F.floor(n / PACK).cast("int").alias("slot"), (n % PACK * BITS).alias("bit"))
    held = lambda counts, p: F.call_function("shiftright", F.get(counts, p["slot"]), p["bit"]).bitwiseAND(2**BITS - 1).cast("int")
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p["bit"])
    changed = lambda counts, p, by: F.transform(counts, lambda n, k: F.when(k == p["slot"], n + by).otherwise(n))

    def step(acc: Column, x: Column, limit: Column) -> Column:
        new, old = x["new"], x["old"]
        gone = F.when(old.isNull(), acc["n"]).otherwise(changed(acc["n"], old, -one(old)))

        def entered(counts: Column) -> Column:
            total = acc["sum"] - F.when(old.isNull(), F.lit(0)).otherwise(F.get(more, held(counts, old))) + F.get(more, held(counts, new))
            high = (x["i"] >= WINDOW) & (total <= limit)
            first = F.when(high & (acc["first"] < 0), x["i"] - WINDOW).otherwise(acc["first"])
            return F.struct(changed(counts, new, one(new)).alias("n"), total.alias("sum"), first.cast("int").alias("first"), F.when(high, x["i"]).otherwise(acc["last"]).cast("int").alias("last"))

        return let(gone, entered)

    def counted(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.struct((k + 1).alias("i"), p.alias("new"), F.get(places, k - WINDOW).alias("old")))
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACK)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        # named once: inside the lambda the limit would be made anew for every character
        return let(limit, lambda most: F.aggregate(steps, start, lambda acc, x: step(acc, x, most), lambda acc: F.when(acc["first"] >= 0, F.struct((run["s"] + acc["first"]).alias("s"), (run["s"] + acc["last"]).alias("e")))))

    return let(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: place(code(c))), counted)


def listed(x: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | x["m"].rlike(pattern)
    return out


def furthest(values: Column) -> Column:
    """For each element the largest of those before it, -1 if none."""
    return running(values, F.lit(-1), F.greatest)


def untouched(runs: Column, cuts: Column) -> Column:
    """Those of `runs` that overlap none of `cuts` (struct<s,e>): sorted together, the cuts before a run don't reach it and the next one starts behind it."""

    def swept(rows: Column) -> Column:
        reach = furthest(F.transform(rows, lambda x: F.when(x["side"] == 0, x["e"]).otherwise(F.lit(-1)).cast("long")))
        # the nearest start ahead, as the largest negative one from the other end
        ahead = F.reverse(furthest(F.transform(F.reverse(rows), lambda x: F.when(x["side"] == 0, LAST - x["s"]).otherwise(F.lit(-1)).cast("long"))))
        sides = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("r"), (LAST - a).alias("a")))
        free = F.zip_with(rows, sides, lambda x, y: F.when((x["side"] == 1) & (y["r"] <= x["s"]) & (y["a"] >= x["e"]), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))))
        return F.filter(free, lambda x: x.isNotNull())

    return F.when(F.size(cuts) == 0, runs).otherwise(let(together(runs, cuts), swept))


def together(runs: Column, cuts: Column) -> Column:
    """Cuts (side 0) and runs (side 1) by their starts: array<struct<s,side,e,m>>."""
    row = lambda x, side, m: F.struct(x["s"].cast("int").alias("s"), F.lit(side).alias("side"), x["e"].cast("int").alias("e"), m.alias("m"))
    return F.array_sort(F.concat(F.transform(cuts, lambda x: row(x, 0, F.lit(None).cast("string"))), F.transform(runs, lambda x: row(x, 1, x["m"]))))


def remains(runs: Column, cuts: Column) -> Column:
    """The parts of `runs`, WINDOW long at least, beside `cuts`: array<struct<s,e,m>>.

    Sorted together, each start opens a part where the cuts so far end, up to the next start or the run's end.
    """

    def swept(rows: Column) -> Column:
        ends = furthest(F.transform(rows, lambda x: F.when(x["side"] == 0, x["e"]).otherwise(F.lit(-1)).cast("long")))
        last = furthest(F.transform(rows, lambda x, k: F.when(x["side"] == 1, k).otherwise(F.lit(-1)).cast("long")))
        pairs = F.zip_with(ends, last, lambda r, k: F.struct(r.alias("r"), k.alias("k")))

        def cut(places: Column) -> Column:
            def one(p: Column, k: Column) -> Column:
                x = F.get(rows, k)
                run = F.get(rows, F.when(x["side"] == 1, k).otherwise(p["k"]).cast("int"))
                s = F.greatest(p["r"], x["s"], F.when(x["side"] == 0, x["e"]), run["s"]).cast("int")
                e = F.least(F.get(rows, k + 1)["s"], run["e"]).cast("int")
                return F.when(e - s >= WINDOW, F.struct(s.alias("s"), e.alias("e"), F.substring(run["m"], s - run["s"] + 1, e - s).alias("m")))

            return F.filter(F.transform(places, one), lambda x: x.isNotNull())

        return let(pairs, cut)

    return let(together(runs, cuts), swept)


def entropy_spans(text: Column, base: Column, parts: bool = False) -> Column:
    runs = pieces(text, CANDIDATE)
    if parts:
        words = lambda rs: F.flatten(F.transform(rs, lambda x: F.transform(pieces(x["m"], WORDS), lambda w: F.struct((x["s"] + w["s"]).alias("s"), (x["s"] + w["e"]).alias("e")))))
        cuts = lambda rs: F.concat(F.transform(base, lambda b: F.struct(b["s"].cast("int").alias("s"), b["e"].cast("int").alias("e"))), words(rs))
        left = let(F.filter(runs, lambda x: ~listed(x, WHOLE)), lambda rs: remains(rs, cuts(rs)))
        wanted = F.filter(left, lambda x: x["m"].rlike("[0-9]") & ~listed(x, WHOLE))
    else:
        wanted = untouched(F.filter(runs, lambda x: ~listed(x, ALLOW)), base)
    noisy = F.filter(F.transform(wanted, noisy_span), lambda x: x.isNotNull())
    return F.when(text.rlike(CANDIDATE), F.transform(noisy, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def named(array: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def scan_secrets(docs: DataFrame, text: str = "text", parts: bool = False) -> DataFrame:
    """All columns of `docs` with base and spans: array<struct<s,k,e>> by start, then kind (place in KINDS).

    Nulls and empty texts have empty arrays. Offsets are code points, ends exclusive. Columns named base or spans are
    replaced. Rows are independent: ties, repeated rows and empty tables need nothing special, and long texts are read whole.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(pieces(whole, ASSIGN), lambda x: value_length(x["m"]) >= ASSIGN_LEAST)
    access = F.filter(pieces(whole, ACCESS), lambda x: F.length(x["m"]) >= ACCESS_LEAST)
    hexed = pieces(whole, HEX)
    out = docs.withColumn("base", F.array_sort(F.concat(spans(assign, 0), spans(access, 1), spans(hexed, 2))))
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base"), entropy_spans(whole, F.col("base"), parts))))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All columns of `docs` (after scan_secrets) with every span in `text` replaced by `mark`; spans that touch get marks of their own, those that overlap one."""
    whole, spans_ = F.col(text), F.col("spans")

    def kept(rows: Column) -> Column:
        chars = F.filter(F.split(whole, ""), lambda c: c != "")
        stops = F.concat(F.transform(rows, lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))), F.array(F.struct(F.length(whole).alias("s"), F.length(whole).alias("e"))))
        ends = running(F.transform(stops, lambda x: x["e"].cast("long")), F.lit(0), F.greatest)
        gaps = F.zip_with(stops, ends, lambda x, at: F.struct(at.cast("int").alias("at"), x["s"].alias("s")))
        parts = lambda cs: F.transform(gaps, lambda g, k: F.when(g["s"] >= g["at"], F.concat(F.array_join(F.slice(cs, g["at"] + 1, g["s"] - g["at"]), ""), F.when(k < F.size(rows), F.lit(mark)).otherwise(F.lit("")))).otherwise(F.lit("")))
        return F.array_join(let(chars, parts), "")

    return docs.withColumn(text, F.when(F.size(spans_) > 0, let(spans_, kept)).otherwise(whole))
