"""What went wrong on larger tables and odd texts."""

from __future__ import annotations

import math
import time
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions import validators as V
from gristmill.operators import ocr
from gristmill.operators.scan import MATCHES, scan
from gristmill.sources import files, store


def test_offsets_of_many_matches_of_several_rules(spark):
    text = "".join(f"mail u{k}@site.org, call +1 (368) 555-{k:04d}, Aadhaar 1234 5678 {k:04d}. " for k in range(150))
    for cut in (text, text[7:], "x" * 70 + text):
        (got,) = spark.createDataFrame([(cut,)], "text string").select(scan(F.col("text")).alias("m")).first()
        assert len(got) > 400 and {m["category"] for m in got} >= {"email", "phone", "national_id"}
        assert [m for m in got if cut[m["index"] : m["index"] + len(m["match"])] != m["match"]] == []


def test_pan_is_written_in_capitals(spark):
    rows = spark.createDataFrame([("ABCPE1234F",), ("aabfb7744b",), ("ABCpE1234F",), ("ABCZE1234F",)], "m string")
    assert [r.ok for r in rows.select(V.pan(F.col("m")).alias("ok")).collect()] == [True, False, False, False]


def test_entropy_goes_through_the_alphabet(spark):
    texts = [None, "", "a", "a" * 300_000, "ab\n\n\r\u2028\u20ac\U0001d49c\U0001d49c\0" * 7, "".join(chr(0x4E00 + k % 5000) for k in range(20_000))]
    got = [r.e for r in spark.createDataFrame([*enumerate(texts)], "k int, t string").orderBy("k").select(T.shannon_entropy(F.col("t")).alias("e")).collect()]
    for t, e in zip(texts, got, strict=True):
        assert abs(e + sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else e) < 1e-9

    def fold(c):  # a step for each character
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.when(x == a["last"], 1).otherwise(0)).alias("n"))
        return F.aggregate(F.array_sort(F.split(c, "")), F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), step)["n"]

    rows = spark.range(8).select(F.concat(F.repeat(F.lit("some text of 26 characters"), 20_000), F.col("id")).alias("t")).localCheckpoint()
    took = []
    for f in (T.shannon_entropy, fold) * 2:
        began = time.time()
        rows.select(f(F.col("t")).alias("x")).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[2] < 0.7 * took[3]


def test_parts_of_one_piece_are_not_copied_over_and_over():
    began = time.process_time()
    assert sum(1 for _ in files.xml_texts(["<t>some words in a node</t>" * 60_000], "t")) == 60_000
    assert time.process_time() - began < 2


def test_containers_are_given_on_in_pieces():
    data = b"%PDF-1.4 /Type /Page BT (" + b"word " * 200_000 + b") Tj ET"
    batch = pa.RecordBatch.from_pydict({"n": [*range(12)], "route": ["pdf"] * 12, "content": [data] * 12})
    got = [*files._containers(iter([batch]))]
    assert len(got) > 3 and "content" not in got[0].schema.names
    assert [n for b in got for n in b.column("n").to_pylist()] == [*range(12)]
    assert {t for b in got for t in b.column("raw_text").to_pylist()} == {("word " * 200_000).strip()}


def test_sparse_audit_tables_have_few_folders(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.range(3000).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 25_200).alias("timestamp"))
    store.append_audit(rows, path, period="year")
    assert sorted(p.name for p in (tmp_path / "audit").glob("*=*")) == ["year=2024-01-01", "year=2025-01-01", "year=2026-01-01"]
    for n in (1, 100, 1000, 4000):
        assert [r.id for r in store.newest(spark, path, n).collect()] == [*range(2999, max(-1, 2999 - n), -1)]


def test_images_without_matches_are_not_laid_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ocr, "stored", lambda df, name: seen.append(df.localCheckpoint()) or seen[-1])
    word = F.struct(F.lit("ann@site.org").alias("text"), F.struct(*(F.lit(float(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1")))).alias("bbox"))
    match = F.struct(F.lit("email"), F.lit("Email"), F.lit("ann@site.org"), F.lit(0), F.lit("medium"))
    none = F.array().cast(MATCHES)
    rows = spark.range(12).select("id", F.when(F.col("id") % 3 == 0, F.array(match).cast(MATCHES)).when(F.col("id") % 3 == 1, none).alias("matches"), F.array(word).alias("words"), F.array(word).alias("lines"))
    assert sorted(r.id for r in ocr.box_rows(rows).collect()) == [0, 3, 6, 9]
    assert seen[0].count() == 4
