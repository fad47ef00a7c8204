"""Stored audit and cache tables, rows that break, roll-ups in pieces, item latencies, whole-text containers."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.operators import evaluate, pipelines
from gristmill.operators.risk import Settings
from gristmill.sources import store


def audit(spark, n, hours):
    rows = spark.range(n).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("id") * hours * 3600).cast("long")).alias("timestamp"), F.lit("x").alias("prompt_text"))
    return rows


@pytest.mark.parametrize("n, hours, limit", [(300, 6, 10), (300, 0.01, 10), (7, 30, 10), (0, 1, 10), (50, 24 * 9, 3)])
def test_newest_reads_days_backwards(spark, tmp_path, n, hours, limit):
    path = str(tmp_path / "audit")
    rows = audit(spark, n, hours)
    if n:
        store.append_audit(rows, path)
        got = store.newest(spark, path, limit)
        assert [r.id for r in got.collect()] == [r.id for r in rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).collect()]
        if n == 300 and hours == 6:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]
    else:
        store.append_audit(audit(spark, 1, 1), path)
        assert store.newest(spark, path, limit).count() == 1


def entries(spark, rows):
    return spark.createDataFrame(rows, "hash string, decision string, day int").select("hash", "decision", F.timestamp_seconds(F.col("day") * 86400).alias("timestamp"))


def test_upsert_touches_only_its_parts(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert store.stored_cache(spark, path).count() == 0
    first = [(f"{k:02x}{k:030x}", "allow", 1) for k in range(64)]
    store.upsert(entries(spark, first), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    late = [(first[3][0], "block", 2), (first[4][0], "block", 0), ("03" + "f" * 30, "redact", 2), (None, "block", 3)]
    for _ in range(2):
        store.upsert(entries(spark, late), path)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    assert {p.parent.name for p, _ in set(before.items()) - set(after.items())} == {"bucket=03", "bucket=04"}
    got = {r.hash: r.decision for r in store.stored_cache(spark, path).collect()}
    assert got == {h: d for h, d, _ in first} | {first[3][0]: "block", "03" + "f" * 30: "redact"}


def test_rows_without_hash_find_nothing_and_are_spread(spark):
    cache = spark.createDataFrame([("a", "block")], "hash string, decision string").select("hash", "decision", F.current_timestamp().alias("timestamp"))
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "id long, hash string")
    got = {r.id: r.entry and r.entry.decision for r in store.looked_up(df, cache).collect()}
    assert got == {1: "block", 2: None, 3: None, 4: None} and store.looked_up(df, cache).columns == ["id", "hash", "entry"]


def test_rows_that_break_leave_the_others_alone(spark):
    def breaking(batches):
        for batch in batches:
            if any(x and "bad" in x for x in batch.column("text").to_pylist()):
                raise ValueError("bad text")
            yield pa.RecordBatch.from_arrays([pa.array([len(x or "") for x in batch.column("text").to_pylist()]), pa.array([["w"]] * batch.num_rows)], ["n", "words"])

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None), (4, ""), (2, "bad")], "id long, text string").coalesce(1)
    got = pipelines.attempted(df, breaking, "n int, words array<string>")
    assert got.columns == ["id", "text", "n", "words", "failure"]
    assert sorted((r.id, r.n, r.failure) for r in got.filter("id <> 2").collect()) == [(1, 4, None), (3, 0, None), (4, 0, None)]
    assert [(r.n, r.words, r.failure) for r in got.filter("id = 2").collect()] == [(None, None, "bad text")] * 2
    assert pipelines.attempted(df.limit(0), breaking, "n int, words array<string>").collect() == []


def test_failures_by_path(spark):
    df = spark.createDataFrame([(1, "token = sk-abc12345678901234567890123456789", None), (2, "token = sk-abc12345678901234567890123456789", "late")], "id long, prompt_text string, failure string")
    got = {r.id: r for r in pipelines.analyze_prompts(df).collect()}
    assert got[1].action == "block" and got[2].action == "allow" and got[2].risk_score == 0 and not got[2].fixed_floor_triggered and "late" in got[2].explanation and got[2].categories == []


def decisions(spark, rows):
    return spark.createDataFrame(rows, "batch_id string, pos int, file_name string, action string, risk_score int, explanation string, is_directory boolean").withColumn("reasons", F.array(F.struct(F.lit("t").alias("type"), F.lit("c").alias("category"), F.col("file_name").alias("description"))))


def test_rollup_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pipelines, "PIECE", 3)
    calm = [("a", k, f"f{k}", "redact" if k == 5 else "allow", k, f"said {k}", False) for k in range(11)]
    stop = [("b", k, f"f{k}", "block" if k in (7, 9) else "allow", k, f"said {k}", False) for k in range(11)]
    other = [("c", 0, "d", "allow", 0, "dir", True), (None, 4, "n", "allow", 9, "null", False), ("d", None, "p", "allow", 1, "no place", False)]
    got = {r.batch_id: r for r in pipelines.rollup(decisions(spark, calm + stop + other).repartition(4)).collect()}
    assert got["a"].explanation == " | ".join(f"f{k}: said {k}" for k in range(11)) and [r.description for r in got["a"].reasons] == [f"f{k}" for k in range(11)]
    assert (got["a"].action, got["a"].risk_score, got["a"].n_files) == ("redact", 10, 11)
    assert (got["b"].action, got["b"].explanation, [r.description for r in got["b"].reasons], got["b"].n_files) == ("block", "said 7", ["f7"], 11)
    assert (got["c"].explanation, got["c"].n_files, got["c"].action) == ("No files to scan.", 0, "allow")
    assert got[None].explanation == "n: null" and got["d"].explanation == "p: no place"


def test_item_latency_is_the_items_own(spark):
    long = "plain words without an end, " * 60_000 + "a@b.com"
    items = [("short", "hello", False, None, None, None), ("asked", "hello there", False, None, '{"sensitive": false}', 250), ("long", long, True, None, None, None)]
    df = spark.createDataFrame(items, "id string, text string, is_sensitive boolean, category string, reply string, delay_ms long").coalesce(1)
    began = time.time()
    got = {r.id: r for r in evaluate.evaluate(df, Settings()).collect()}
    took = (time.time() - began) * 1000
    assert got["asked"].llm_latency_ms == 250 and 250 < got["asked"].total_latency_ms < took + 250
    assert got["short"].llm_latency_ms == 0 and 0 < got["short"].total_latency_ms <= took
    assert got["long"].total_latency_ms > got["short"].total_latency_ms


def test_box_rows_equal_the_nested_loop(spark):
    import random

    from gristmill.operators import ocr

    r = random.Random(7)
    token = lambda: "".join(r.choice(["a", "B", "ab", "c@d", " ", "é", ""]) for _ in range(r.randrange(5)))
    rows = []
    for k in range(60):
        matches = [(token(),) for _ in range(r.randrange(4))] or None
        words = [(token() if r.random() < 0.9 else None, (float(n), 1.0, 9.0, 9.0) if r.random() < 0.9 else (None, 1.0, 9.0, 9.0)) for n in range(r.randrange(7))] or None
        lines = [(token() + token() + token(), (float(100 + n), 1.0, 9.0, 9.0)) for n in range(r.randrange(4))]
        rows.append((k % 50, matches, words, lines))
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame(rows, f"id long, matches array<struct<match:string>>, words array<struct<text:string,bbox:{box}>>, lines array<struct<text:string,bbox:{box}>>").repartition(3)
    matches = F.coalesce("matches", F.array())
    want = sorted((x.id, x.b.x0) for x in df.select("id", F.explode(ocr.redaction_boxes(matches, F.col("words"), F.col("lines"))).alias("b")).collect())
    got = sorted((x.id, x.bbox.x0) for x in ocr.box_rows(df).collect())
    assert got == want and len(got) > 30 and any(x >= 100 for _, x in got)
    assert ocr.box_rows(df.limit(0)).columns == ["id", "match", "box", "by_line", "bbox"]


def test_files_of_a_folder_in_listing_order(spark, tmp_path):
    from gristmill.sources.files import extract_files, read_files

    for batch, names in (("one", ("b.txt", "a.txt", "c.txt", "d.png")), ("two/deep", ("z.txt",)), ("two", ("y.txt", "x.txt"))):
        (tmp_path / batch).mkdir(parents=True, exist_ok=True)
        for name in names:
            (tmp_path / batch / name).write_text("api_key = sk-abc12345678901234567890123456789" if name in ("b.txt", "c.txt") else f"text of {name}")
    for few in (100, 0):
        got = {(r.batch_id, r.file_name): (r.pos, r.file_size) for r in read_files(spark, str(tmp_path), few).collect()}
        assert {k: v[0] for k, v in got.items()} == {("one", "a.txt"): 0, ("one", "b.txt"): 1, ("one", "c.txt"): 2, ("one", "d.png"): 3, ("deep", "z.txt"): 0, ("two", "x.txt"): 0, ("two", "y.txt"): 1}
        assert got["two", "x.txt"][1] == len("text of x.txt")
    rows = pipelines.rollup(pipelines.analyze_files(extract_files(read_files(spark, str(tmp_path))), Settings(enable_llm=False), "chatgpt.com")).collect()
    one = {r.batch_id: r for r in rows}["one"]
    assert one.action == "block" and one.explanation.startswith("File 'b.txt'") and one.n_files == 4


def test_failed_scans_reads_once(spark):
    """The stage that breaks runs before the three paths, not in each of them."""
    from pathlib import Path

    from gristmill.plans.catalogue import failed_scans

    df = failed_scans(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet(str(Path("/root/testdata/sf0.001/documents.parquet"))).filter("doc_id % 10 = 3").count()
    assert df.filter("failure IS NOT NULL").count() == 3 * n and df.filter("how = 'image'").count() == n
