"""Files, batches, images, audit, cache, submissions, evaluation, streams."""

import json
import struct
import time
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.operators import evaluate, ocr, pipelines
from gristmill.operators.risk import Settings
from gristmill.sources import files, store
from gristmill.streaming import governance

KEY = "sk-abc12345678901234567890123456789"


def local_entry(name, xml):
    c = zlib.compressobj(wbits=-15)
    body = c.compress(xml.encode()) + c.flush()
    return struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, 0, 8, 0, 0, 0, len(body), len(xml), len(name), 0) + name.encode() + body + b"\0\0"


def flate_pdf(text, space=True):
    body = zlib.compress(f"BT ({text}) Tj <48656c6c6f> ET".encode())
    return b"%PDF-1.4\n\x00\xff" + (b"<< >> stream\n" if space else b"<< >>\nstream\n") + body + b"\nendstream"


FILES = {
    "employee_records.txt": (b"Employee SSN 123-45-6789", ""),
    "medical_scan.png": (b"\x89PNG", ""),
    "corporate_valuation.docx": (b"plain bytes without any NUL", ""),
    "test1doc.docx": (local_entry("word/document.xml", f"<w:t>api_key: {KEY}</w:t><w:t>a &amp; b</w:t>"), ""),
    "financial_report.xlsx": (local_entry("xl/sharedStrings.xml", f"<t>{KEY}</t><t>x</t><t>x</t>"), ""),
    "q4_presentation.pptx": (local_entry("ppt/slides/slide1.xml", f"<a:t>{KEY}</a:t>"), ""),
    "flate.pdf": (flate_pdf("secret plan"), ""),
    "newline.pdf": (flate_pdf("secret plan", False), ""),
    "intro.pdf": (b"%PDF\x00 BT (" + bytes(range(0xA0, 0xFF)) * 3 + b") ET", ""),
    ".env": (f"API_KEY={KEY}\nDB=1".encode(), "application/octet-stream"),
    "secret_notebook.ipynb": (json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": f"k = '{KEY}'", "outputs": [{"text": ["o"]}]}]}).encode(), ""),
    "Downloads": (b"", ""),
    "bad.weird": (b"\x00\x01\x02", ""),
    "empty.txt": (None, ""),
}


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(n, m, len(b or b""), bytearray(b) if b is not None else None, "b", k) for k, (n, (b, m)) in enumerate(FILES.items())]
    df = spark.createDataFrame(rows, "file_name string, mime string, file_size long, content binary, batch_id string, pos int")
    return files.extract_files(df).cache()


def test_extraction(extracted):
    got = {r.file_name: r for r in extracted.collect()}
    assert "123-45-6789" in got["employee_records.txt"].text and not got["employee_records.txt"].unscannable
    assert got["medical_scan.png"].unscannable and "Fail-Closed" in got["medical_scan.png"].reason
    assert got["corporate_valuation.docx"].text == "plain bytes without any NUL"
    assert got["test1doc.docx"].text == f"api_key: {KEY} a & b"
    assert got["financial_report.xlsx"].text == f"{KEY} | x" and KEY in got["q4_presentation.pptx"].text
    assert got["flate.pdf"].text == "secret plan Hello" and got["flate.pdf"].pages[0].page == 1
    assert got["newline.pdf"].unscannable and got["intro.pdf"].unscannable and got["bad.weird"].unscannable
    assert "[NOTEBOOK_MARKDOWN_CELL]\n# T\nx" in got["secret_notebook.ipynb"].text and "[CELL_OUTPUT]\no" in got["secret_notebook.ipynb"].text
    assert got["Downloads"].is_directory and not got["Downloads"].unscannable and got["empty.txt"].text == ""


def test_file_decisions_and_cache(spark, extracted):
    first = pipelines.analyze_files(extracted, domain="chatgpt.com")
    got = {r.file_name: r for r in first.collect()}
    assert got[".env"].action == got["secret_notebook.ipynb"].action == got["test1doc.docx"].action == "block"
    assert got["medical_scan.png"].action == "block" and got["medical_scan.png"].fixed_floor_triggered
    assert got["Downloads"].action == "allow" and got["Downloads"].risk_score == 0 and not got["Downloads"].audited
    assert got["medical_scan.png"].reasons[0].description.startswith("File 'medical_scan.png' cannot be text-verified")
    cache = store.upserted(spark.createDataFrame([], store.CACHE), store.cache_rows(first))
    again = {r.file_name: r for r in pipelines.analyze_files(extracted, domain="elsewhere", cache=cache).collect()}
    assert again[".env"].cached and again[".env"].explanation.startswith("[CACHED RESULT] ") and not again[".env"].audited
    assert not again["medical_scan.png"].cached and len(again) == len(FILES)


def test_rollup(spark, extracted):
    rows = pipelines.analyze_files(extracted, domain="chatgpt.com")
    one = pipelines.rollup(rows).collect()[0]
    assert one.action == "block" and one.risk_score >= 95 and "employee_records.txt" in one.explanation
    calm = rows.filter(F.col("file_name").isin("Downloads", "corporate_valuation.docx"))
    r = pipelines.rollup(calm).collect()[0]
    assert r.action == "allow" and r.risk_score == 0 and r.explanation.startswith("corporate_valuation.docx: ")


def test_images(spark):
    box = lambda x: (x, 40.0, x + 90, 52.0)
    words = [("ann@vit.edu", box(100.0), 90.0), ("and", box(200.0), 90.0), ("bob@vit.edu", box(300.0), 90.0)]
    rows = [
        ("photo.png", ("", 0.0, [], []), None),
        ("keys.png", (f"AWS_SECRET_KEY = abcdefgh12345 and {KEY}", 90.0, [], []), None),
        ("paper_authors.png", ("ann@vit.edu and bob@vit.edu", 90.0, words, []), None),
        ("broken.png", None, "no engine"),
    ]
    df = spark.createDataFrame(rows, f"file_name string, ocr {ocr.OCR}, ocr_error string")
    got = {r.file_name: r for r in pipelines.analyze_images(df, domain="chatgpt.com").collect()}
    assert got["photo.png"].action == "allow" and got["photo.png"].risk_score == 0 and not got["photo.png"].audited
    assert got["keys.png"].action == "block" and got["keys.png"].fixed_floor_triggered and got["keys.png"].risk_score >= 95
    paper = got["paper_authors.png"]
    assert paper.action == "redact" and paper.risk_score >= 70 and [b.x0 for b in paper.boxes] == [100.0, 300.0]
    assert got["broken.png"].action == "block" and got["broken.png"].fixed_floor_triggered
    name = spark.createDataFrame([("paper_authors.png",)], "n string").select(ocr.redacted_name(F.col("n"))).collect()[0][0]
    assert name == "redacted_paper_authors.png"


def test_line_fallback_and_rectangles(spark):
    df = spark.createDataFrame([([("secret words",)], [("other", (0.0, 0.0, 1.0, 1.0), 1.0)], [("some secret words here", (2.0, 1.0, 70.0, 20.0))])], f"m array<struct<match:string>>, w array<struct<text:string,bbox:{ocr.BOX},confidence:double>>, l array<struct<text:string,bbox:{ocr.BOX}>>")
    r = df.select(ocr.rectangles(ocr.redaction_boxes(F.col("m"), F.col("w"), F.col("l")), F.lit(60), F.lit(50))).collect()[0][0]
    assert [tuple(x) for x in r] == [(0, 0, 60, 23, True, 13)]


def test_engines(spark):
    class Engine:
        def read(self, image):
            if image == b"bad":
                raise RuntimeError("no engine")
            return {"text": image.decode(), "confidence": 90.0, "words": [], "lines": []}

        def close(self):
            pass

    rows = [("a.png", bytearray(b"mail a@b.com and c@d.org")), ("b.png", bytearray(b"bad")), ("c.png", None)]
    df = ocr.with_ocr(spark.createDataFrame(rows, "file_name string, content binary"), Engine)
    got = {r.file_name: r for r in pipelines.analyze_images(df, domain="chatgpt.com").collect()}
    assert [got[k].action for k in ("a.png", "b.png", "c.png")] == ["redact", "block", "allow"]
    filed = {r.file_name: r for r in pipelines.analyze_files(ocr.images_as_files(df), domain="chatgpt.com").collect()}
    assert [filed[k].action for k in ("a.png", "b.png", "c.png")] == ["redact", "block", "allow"] and filed["b.png"].fixed_floor_triggered
    names = spark.createDataFrame([("image/gif", "x"), (None, "a.JPEG"), ("", "a.txt")], "m string, n string")
    assert [r[0] for r in names.select(ocr.is_image(F.col("m"), F.col("n"))).collect()] == [True, True, False]


def test_settings_of_stored():
    assert Settings.of({"blockThreshold": 60, "roleWeights": {"x": 2}, "userRole": None}) == Settings(block_threshold=60)


def test_audit(spark, tmp_path):
    rows = spark.createDataFrame([(k, "p" if k else None, "block" if k % 2 else "allow", ["email"] if k == 3 else []) for k in range(5)], "id long, prompt_text string, decision string, categories array<string>")
    path = str(tmp_path / "audit")
    store.append_audit(rows.withColumn("timestamp", F.timestamp_seconds(F.col("id") / 2).cast("timestamp")), path)
    audit = store.read_audit(spark, path)
    assert [r.id for r in store.latest(audit, 3).collect()] == [4, 3, 2]
    assert {r.id for r in store.search(audit, "EMAIL").collect()} == {3}
    first = audit.filter("id = 0").collect()[0]
    assert (first.prompt_text, first.destination_domain, first.source_type, first.risk_score) == ("", "unknown", "prompt_submission", 0)
    assert store.emptied(audit).count() == 0 and "prompt_text" not in store.metadata(audit).columns
    hashed = store.audit_rows(rows, hash_prompts=True).collect()[1]
    assert len(hashed.prompt_text) == 64


def plain_accepted(rows, within):
    kept, last = [], {}
    for user, ms, text in rows:
        t, at = last.get(user, (None, None))
        if at is None or text != t or ms - at >= within:
            last[user] = (text, ms)
            kept.append((user, ms, text))
    return kept


ROWS = [(1, 0, "a"), (1, 1000, "a"), (1, 1600, "a"), (1, 1700, "b"), (1, 1800, "a"), (2, 0, "a"), (2, 1499, "a"), (2, 1500, "a"), (3, 5, None), (3, 6, None)]


def test_submissions(spark):
    df = spark.createDataFrame(ROWS, "user_id long, ms long, prompt_text string").withColumn("ts", F.timestamp_millis("ms"))
    got = sorted((r.user_id, r.ms, r.prompt_text or "") for r in store.accepted(df).collect())
    assert got == sorted((u, m, t or "") for u, m, t in plain_accepted(ROWS, 1500))


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:8], "user_id long, ms long, prompt_text string").select("user_id", F.timestamp_millis("ms").alias("ts"), "prompt_text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = governance.read_submissions(spark, str(tmp_path / "in"), "user_id long, ts timestamp, prompt_text string")
    q = governance.started(governance.accepted_stream(stream), str(tmp_path / "kept"), str(tmp_path / "c1"))
    assert q.awaitTermination(100)  # it ends by itself
    got = sorted((r.user_id, round(r.ts.timestamp() * 1000), r.prompt_text) for r in spark.read.parquet(str(tmp_path / "kept")).collect())
    assert got == sorted(plain_accepted(ROWS[:8], 1500))
    q = governance.decide_stream(governance.read_submissions(spark, str(tmp_path / "in"), "user_id long, ts timestamp, prompt_text string"), str(tmp_path / "audit"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert store.read_audit(spark, str(tmp_path / "audit")).count() == 8
    governance.written_once(store.read_audit(spark, str(tmp_path / "audit")).drop("epoch").cache(), str(tmp_path / "again"), 3)
    governance.written_once(store.read_audit(spark, str(tmp_path / "audit")).drop("epoch"), str(tmp_path / "again"), 3)
    assert spark.read.parquet(str(tmp_path / "again")).count() == 8


def test_inflating_is_bounded():
    # as large as it may be, a stream is never held as a whole
    data = zlib.compress(b"x " * (40 << 20) + b"BT (at the end) Tj ET")
    tracemalloc.start()
    assert files.pdf_operators(files.decoded_pieces(files.inflated(data))) == "at the end"
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    assert files.inflated(b"no stream") is None and b"".join(files.inflated(zlib.compress(b"abc"))) == b"abc"


@pytest.mark.parametrize("seed", range(4))
def test_parts_in_pieces_equal_the_whole(seed):
    import random
    import re

    r = random.Random(seed)
    for _ in range(400):
        text = "".join(r.choice(["<w:t>", "<w:t a='1'>", "<w:tab/>", "</w:t>", "<", ">", "x", "<w:", "BT", "B", "T", "ET", "E", "é"]) for _ in range(r.randrange(30)))
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(6)))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert [x for _, x in files.between(pieces, re.compile("<w:t[^>]*>"), "</w:t>", 0)] == re.findall("(?s)<w:t[^>]*>(.*?)</w:t>", text)
        assert ["BT" + x + "ET" for _, x in files.between(pieces, re.compile("BT"), "ET", 1)] == re.findall("(?s)BT.*?ET", text)


def test_messages(spark):
    df = spark.createDataFrame([("CLEAR_HASH_CACHE",), ("CLEAR_CACHE",), ("ANALYZE_PROMPT",)], "type string")
    assert governance.of_kind(df, "CLEAR_CACHE").count() == 2
    with pytest.raises(ValueError):
        governance.of_kind(df, "NOTHING")


def test_evaluation(spark, tmp_path):
    items = [("1", f"key {KEY}", True, "api_key"), ("2", "hello", False, None), ("3", "the merger is secret", True, "proprietary"), ("4", "write to a@b.com", False, None)]
    path = tmp_path / "items.json"
    path.write_text(json.dumps([dict(zip(("id", "text", "is_sensitive", "category"), x, strict=True)) for x in items]))
    results = evaluate.evaluate(evaluate.read_items(spark, str(path)))
    m = evaluate.metrics(results).collect()[0]
    assert (m.total, m.tp, m.fp, m.tn, m.fn) == (4, 1, 1, 1, 1) and (m.precision, m.recall, m.f1, m.accuracy) == ("50.00%",) * 4
    table = {r.metric: (r.regex_only, r.hybrid) for r in evaluate.side_by_side(evaluate.metrics(results)).collect()}
    assert table["precision"] == ("50.00%", "N/A")
    lat = spark.createDataFrame([(v,) for v in (0, 1, 5, 7, 9)], "total_latency_ms int")
    assert tuple(evaluate.latency(lat).collect()[0]) == (5.5, 7)


def test_large_document_in_time(spark):
    para = "The quick brown fox jumps over the lazy dog near the river bank. " * 30
    text = "\n\n".join([para] * 4200 + [f"api_key = {KEY}"] + [para] * 1300)
    assert len(text) > 10_000_000
    df = spark.createDataFrame([("big.txt", "", len(text), bytearray(text.encode()), "b", 0)], "file_name string, mime string, file_size long, content binary, batch_id string, pos int")
    began = time.time()
    r = pipelines.analyze_files(files.extract_files(df), Settings(enable_llm=False)).collect()[0]
    assert r.action == "block" and time.time() - began < 60
