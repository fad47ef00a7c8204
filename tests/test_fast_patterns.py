"""Patterns that begin where little can match say the same as those that say it plainly, and take a fraction of their time."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions import text as T
from gristmill.operators.policy import redacted
from gristmill.operators.scan import MATCHES, scan

PARTS = ("a", "b.c", "@", " ", "  ", "\t", " ", "　", "(", ")", "[", "]", "at", "AT", "(a)", "©", "®", ".", "com", " . de", "x_1", "%", "\r\n", "\n", "é", "1234", "12345678", "123456789", "1", "pin", "Key", "TOKEN", ":", "=", "-", "😀", "_")


def texts(spark, parts, n=4000, seed=3):
    r = random.Random(seed)
    return spark.createDataFrame([(k, "".join(r.choice(parts) for _ in range(r.randrange(14)))) for k in range(n)] + [(n, None), (n + 1, "")], "id long, text string")


def old_minimal(c):
    out = F.regexp_replace(c, rf"(?:\G|(?<![a-zA-Z0-9._%+-]))([a-zA-Z0-9._%+-]+)[{P.WS}]*@[{P.WS}]*([a-zA-Z0-9.-]+)", "$1@$2")
    out = F.regexp_replace(out, rf"@([a-zA-Z0-9.-]+)[{P.WS}]*\.[{P.WS}]*([a-zA-Z]{{2,}})", "@$1.$2")
    return F.when(F.contains(c, F.lit("@")), out).otherwise(c)


def old_full(c):
    c = F.regexp_replace(c, r"\r\n", "\n")
    open_ = rf"[{P.WS}(\[]"
    c = F.regexp_replace(c, rf"(?i){open_}(?:(?<=\G{open_})|(?<!{open_}{open_})){open_}*(?:@|©|®|at|\(a\))[{P.WS})\]]+", "@")
    c = F.regexp_replace(old_minimal(c), P.java(r"\.[{S}]*(com|edu|org|gov|net|io|ai|in|ac|uk|de|ca){B}", True), ".$1")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def test_repair_says_the_same(spark):
    empty = F.coalesce("text", F.lit(""))
    for parts in (PARTS, [x for x in PARTS if x.isascii()], ("a", "b", "@", " ", "_", ".", "at"), (" ", "@", "a", "(", "at")):
        df = texts(spark, parts).select("text", T.repair_minimal(F.col("text")).alias("m"), old_minimal(empty).alias("om"), T.repair_full(F.col("text")).alias("f"), old_full(empty).alias("of"))
        assert df.filter("m <> om OR f <> of OR m IS NULL OR f IS NULL").limit(3).collect() == []
        assert df.filter("text <> m").count() > 20 and df.filter("text <> f").count() > 100


def test_redaction_asked_for_says_the_same(spark):
    out = F.regexp_replace(F.coalesce("text", F.lit("")), P.java("{B}[0-9]{4,8}{B}"), "[REDACTED_PIN]")
    old = F.regexp_replace(out, P.java("(pin|password|passcode|secret|key|token)[{S}]*[:=][{S}]*([^{S}]+)", True), "$1: [REDACTED_SECRET]")
    said = F.struct(F.lit(True).alias("sensitive"), F.lit("financial").alias("category"))
    df = texts(spark, PARTS).select("text", redacted(F.col("text"), F.array().cast(MATCHES), said).alias("new"), old.alias("old"))
    assert df.filter("new <> old OR new IS NULL").limit(3).collect() == []
    assert df.filter("contains(new, 'REDACTED_PIN')").count() > 50 and df.filter("contains(new, 'REDACTED_SECRET')").count() > 50


def test_hints_lose_no_match(spark):
    """Against rules without signs, digits and hints, on pieces of what they look for."""
    from dataclasses import replace

    key = "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8v"
    parts = ("sk-proj-", "AKIA", "aiza", "GHp_", "xoxb-", "YA29.", "Aq", key, key.upper(), key * 2, "4111 1111 1111 1111", "CVV", "cid", "Security Code", " is ", ": ", "=", "123", "a@b.com", "ABCPE1234F", "GB82WEST12345698765432", "eyJ" + key + ".", "-----BEGIN PRIVATE KEY-----", "postgres://", "123-45-6789",
             "+1 415 555 2671", "Author", "passcode", "my pin", "password", "api_key", "SECRET", "access code", "token", " ", "\n", "é")
    bare = [replace(r, hint="", signs=(), digits=False, begins="") for r in P.RULES]
    df = texts(spark, parts, 3000).withColumn("text", F.coalesce("text", F.lit(""))).select("text", scan(F.col("text")).alias("new"), scan(F.col("text"), bare).alias("old"))
    assert df.filter("new <> old").limit(3).collect() == []
    assert df.select(F.explode("old.category").alias("c")).distinct().count() == len(P.RULES)


def took(df, value):
    best = []
    for _ in range(3):
        began = time.time()
        df.agg(F.sum(F.length(value))).collect()
        best.append(time.time() - began)
    return min(best)


def plain_words(spark):
    """Words that hold nothing of what is looked for: they mustn't be gone through for it character by character."""
    df = spark.range(8).select(F.concat(F.lit("x@y "), F.repeat(F.lit("some plain words without any number "), 60_000)).alias("text")).cache()
    df.count()
    return df


def test_time_of_redaction(spark):
    said = F.struct(F.lit(True).alias("sensitive"), F.lit("financial").alias("category"))
    pins = F.regexp_replace("text", P.java("{B}[0-9]{4,8}{B}"), "[REDACTED_PIN]")
    old = F.regexp_replace(pins, P.java("(pin|password|passcode|secret|key|token)[{S}]*[:=][{S}]*([^{S}]+)", True), "$1: [REDACTED_SECRET]")
    df = plain_words(spark)
    assert took(df, redacted(F.col("text"), F.array().cast(MATCHES), said)) < 0.5 * took(df, old)


def test_time_of_repair(spark):
    df = plain_words(spark)
    assert took(df, T.repair_full(F.col("text"))) < 0.7 * took(df, old_full(F.col("text")))
