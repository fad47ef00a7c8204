"""Messages through one stream: kinds, clears, replays."""

import datetime as dt

import pytest

from gristmill.operators.risk import Settings
from gristmill.sources import store
from gristmill.streaming import governance, router

KEY = "sk-proj-" + "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8v"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def message(k, kind, text=None, name=None, **more):
    content = None if name is None else bytearray((text or "").encode())
    row = {"id": k, "type": kind, "ts": None if k is None else START + dt.timedelta(seconds=k), "prompt_text": text if name is None else None, "destination_domain": "chatgpt.com", "user_role": None, "file_name": name, "mime": "", "file_size": len(content or b""), "content": content, "batch_id": None, "pos": k, "ocr": None, "ocr_error": None}
    return row | more


def test_kinds(spark):
    rows = spark.createDataFrame([(k,) for k in (*router.KINDS, "CLEAR_FILE_HASH_CACHE", "OTHER", None)], "type string")
    assert {r.type for r in router.of_kind(rows, "CLEAR_HASH_CACHE").collect()} == {"CLEAR_HASH_CACHE", "CLEAR_FILE_HASH_CACHE"}
    assert sum(router.of_kind(rows, k).count() for k in router.KINDS) == len(router.KINDS) + 1
    with pytest.raises(ValueError):
        router.of_kind(rows, "OTHER")


def test_one_stream_many_stores(spark, tmp_path):
    seen = {"text": "the quarterly note", "confidence": 90.0, "words": [], "lines": []}
    parts = [
        [message(1, "ANALYZE_PROMPT", f"api_key = {KEY}"), message(2, "ANALYZE_FILE", "a plain note", "a.txt"), message(3, "ANALYZE_PROMPT", None), message(4, "OTHER", "x"), message(5, None, "x")],
        [message(6, "ANALYZE_FILE", "a plain note", "b.txt"), message(7, "ANALYZE_IMAGE_FILE", name="i.png", ocr=seen), message(8, "ANALYZE_IMAGE_TEXT", name="j.png", ocr_error="no engine"), message(9, "PERFORM_IMAGE_OCR", name="k.png", ocr=seen), message(10, "CLEAR_AUDIT_LOGS"),
         message(11, "CLEAR_FILE_HASH_CACHE"), message(12, "ANALYZE_BATCH_FILES", "a plain note", "c.txt", batch_id="b"), message(13, "ANALYZE_BATCH_FILES", f"api_key = {KEY}", "d.txt", batch_id="b"), message(14, "GET_AUDIT_LOGS")],
    ]
    stores = router.Stores(*(str(tmp_path / k) for k in ("answers", "audit", "logs", "cache")))
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, router.MESSAGES).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
        stream = governance.read_submissions(spark, str(tmp_path / "in/part=*"), router.MESSAGES)
        router.dispatch(stream, stores, str(tmp_path / "checkpoint"), Settings(enable_llm=False)).awaitTermination()
        if k == 0:
            assert sorted(r.id for r in router.audit_log(spark, stores).collect()) == [1, 2, 3]
            assert store.stored_cache(spark, stores.cache).count() == 1
    said = {r.id: r for r in router.answers(spark, stores).collect()}
    assert sorted(said) == list(range(1, 15))
    assert [said[k].answered for k in (4, 5, 10, 14)] == [False, False, True, True]
    assert said[1].action == "block" and said[3].action == "allow" and said[4].action is None
    assert said[6].cached and not said[12].cached and said[12].action == "allow"  # cleared between them
    assert said[7].action == "allow" and said[8].action == "block" and said[9].said == "the quarterly note"
    assert sorted(r.id for r in router.audit_log(spark, stores).collect()) == [12, 13]
    assert sorted(r.id for r in spark.read.parquet(f"{stores.logs}/epoch=1").collect()) == [12, 13]
    assert sorted(r.file_name for r in store.stored_cache(spark, stores.cache).collect()) == ["c.txt", "d.txt"]
    (batch,) = router.batch_answers(spark, stores).collect()
    assert batch.action == "block" and batch.n_files == 2 and batch.reasons == said[13].reasons


def test_a_batch_that_runs_again_keeps_its_answers(spark, tmp_path):
    rows = [message(1, "ANALYZE_FILE", "a plain note", "a.txt"), message(2, "ANALYZE_PROMPT", "hello")]
    spark.createDataFrame(rows, router.MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stores = router.Stores(*(str(tmp_path / k) for k in ("answers", "audit", "logs", "cache")))
    for attempt in ("c1", "c2"):  # a new checkpoint: the same micro-batch, number 0, once more
        router.dispatch(governance.read_submissions(spark, str(tmp_path / "in"), router.MESSAGES), stores, str(tmp_path / attempt), Settings(enable_llm=False)).awaitTermination()
        assert sorted((r.id, r.cached) for r in router.answers(spark, stores).select("id", "cached").collect()) == [(1, False), (2, None)]
        assert sorted(r.id for r in router.audit_log(spark, stores).collect()) == [1, 2]
        assert store.stored_cache(spark, stores.cache).count() == 1


def test_sessions_share_states_by_part(spark, tmp_path):
    """Many sessions, few states: each keeps its own last text and time, over micro-batches and beside others of its part, one without a key among them."""
    at = lambda s: START + dt.timedelta(seconds=s)
    users = [*range(400), None]
    parts = [
        [(u, at(0), "a") for u in users] + [(u, at(1), "a") for u in users] + [(7, None, "a"), (9, at(1), None), (9, at(1.2), None)],
        [(u, at(2), "a") for u in users] + [(u, at(2.4), "b") for u in users if u is None or u % 2] + [(1000, at(0), "b")],
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame([(10_000 * k + n, *r) for n, r in enumerate(rows)], "event_id long, user_id long, ts timestamp, prompt_text string").repartition(3).write.parquet(str(tmp_path / f"in/part={k}"))
        stream = governance.read_submissions(spark, str(tmp_path / "in/part=*"), "event_id long, user_id long, ts timestamp, prompt_text string")
        query = governance.started(governance.accepted_stream(stream, tie="event_id", parts=16), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    ids = sorted(r.event_id for r in got)
    want, last = [], {}
    for k, rows in enumerate(parts):
        for n, u, t, said in sorted(((10_000 * k + n, *r) for n, r in enumerate(rows)), key=lambda r: (r[2] is not None, r[2] or START, r[0])):
            before = last.get(u)
            if before is None or before[1] is None or t is None or said != before[0] or (t - before[1]).total_seconds() >= 1.5:
                last[u] = (said, t)
                want.append(n)
    assert ids == sorted(want) and {r.user_id for r in got} == {*users, 1000}


def test_arrivals_keep_all_cores_busy(spark):
    from gristmill.plans.catalogue import arrivals

    parts = arrivals(spark.range(0, 9000, 1, 12), "id", 3)
    assert [p.count() for p in parts] == [3000] * 3 and sorted(r.id for p in parts for r in p.collect()) == list(range(9000))
    for p in parts:
        assert max(len(x) for x in p.rdd.glom().collect()) < 500  # of 1,000 in a stretch of what comes in order
