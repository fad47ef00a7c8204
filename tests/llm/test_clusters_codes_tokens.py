"""Centroids, vector codes and token counts against plain versions, odd rows among them."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gristmill.llm import clustering as C
from gristmill.llm.bpe import public_path
from gristmill.llm.token_counts import Counter, Merges, count_tokens

LARGEST = 2**63 - 1


def whole(v, factor):
    return [math.floor(factor * x) if abs(x) < 2.0**900 else factor * int(x) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(xs, book, rounds):
    """Every distance of every round, in whole numbers."""
    for left in range(rounds, -1, -1):
        mine = [min(range(len(book)), key=lambda e: (square(x, book[e]), e)) for x in xs]
        if left:
            groups = [[x for x, m in zip(xs, mine, strict=True) if m == e] for e in range(len(book))]
            book = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups, book, strict=True)]
    return mine, book


def kept(rows):
    return [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_clusters(rows, k, rounds, width):
    rows = [r for r in kept(rows) if len(r[1]) == width]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    xs = [whole(v, 256) for _, v in rows]
    mine, book = lloyd(xs, [whole(v, 256) for _, v in order[:k]], rounds)
    d = [min(LARGEST, square(x, book[m])) for x, m in zip(xs, mine, strict=True)]
    of = lambda m: min(LARGEST, sum(y for y, n in zip(d, mine, strict=True) if n == m))
    total = min(LARGEST, sum(of(m) for m in set(mine)))
    return [(r[0], m, y, of(m), total, hashlib.sha256(",".join(map(str, book[m])).encode()).hexdigest()) for r, m, y in zip(rows, mine, d, strict=True)]


def plain_codes(rows, entries, rounds):
    labels = [r[2] for r in rows if kept([r])]
    rows = kept(rows)
    w = max(1, -(-max(len(v) for _, v in rows) // 4))
    padded = lambda v: whole(v, 1024) + [0] * (4 * w - len(v))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books, codes, errors = [], [], []
    for p in range(4):
        cut = lambda v: padded(v)[p * w : (p + 1) * w]  # noqa: B023, E731
        xs = [cut(v) for _, v in rows]
        mine, book = lloyd(xs, [cut(v) for _, v in order], rounds)
        books += book
        codes.append(mine)
        errors.append([square(x, book[m]) for x, m in zip(xs, mine, strict=True)])
    error = [min(LARGEST, sum(e)) for e in zip(*errors, strict=True)]
    said = hashlib.sha256(",".join(str(v) for b in books for v in b).encode()).hexdigest()
    of = {x: min(LARGEST, sum(e for e, y in zip(error, labels, strict=True) if x == y)) for x in set(labels)}
    return [(r[0], "".join(f"{c[n]:02x}" for c in codes), error[n], of[labels[n]], said) for n, r in enumerate(rows)]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def vectors(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    m = np.float32(rng.normal(size=(n, width)) * scale)
    return [(k * 3 + 1, [float(x) for x in m[k]], k % 5 if k % 7 else None) for k in range(n)]


ODD = [
    (None, [0.5] * 64, 1), (None, [0.25] * 64, None), (7, None, 2), (8, [0.1, None] * 32, 2), (9, [math.nan] * 64, 2), (10, [math.inf] + [0.0] * 63, 2), (11, [], 3), (12, [1.0] * 3, 3),
    (13, [0.0] * 64, None), (13, [0.0] * 64, None), (13, [1.0] * 64, 4), (-5, [-0.001] * 64, 4),
]
SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 0.01), (3, 40.0)])
def test_clusters_equal_every_distance(spark, seed, scale):
    rows = vectors(150, 64, seed, scale) + ODD
    got = C.cluster(frame(spark, rows), k=12, rounds=4, group=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert in_order(got.collect()) == in_order(plain_clusters(rows, 12, 4, 64))


def test_huge_components_are_exact(spark):
    rows = vectors(30, 64, 5) + [(500 + k, [(-1.0) ** k * 1e30 * (k + 1)] + [0.5] * 63, k) for k in range(6)] + [(600, [1.7e308] * 64, 1), (601, [-1.7e308] * 64, 1)]
    assert in_order(C.cluster(frame(spark, rows), k=6, rounds=3).collect()) == in_order(plain_clusters(rows, 6, 3, 64))
    assert in_order(C.vector_codes(frame(spark, rows), entries=9, rounds=2).collect()) == in_order(plain_codes(rows, 9, 2))


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 0.002), (3, 30.0)])
def test_codes_equal_every_distance(spark, seed, scale):
    rows = vectors(120, 64, seed, scale) + ODD
    got = C.vector_codes(frame(spark, rows), entries=20, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert in_order(got.collect()) == in_order(plain_codes(rows, 20, 3))


def test_widths_that_four_does_not_divide_and_few_vectors(spark):
    rows = vectors(9, 6, 4) + [(1000, [0.5] * 5, 1), (1001, [], 1)]
    assert in_order(C.vector_codes(frame(spark, rows)).collect()) == in_order(plain_codes(rows, 256, 4))
    rows = vectors(5, 64, 4)
    assert in_order(C.cluster(frame(spark, rows)).collect()) == in_order(plain_clusters(rows, 40, 5, 64))


def test_no_vectors_no_rows(spark):
    for df in (frame(spark, []), frame(spark, [(1, None, 1), (2, [math.nan], 2)])):
        assert C.cluster(df).collect() == [] and C.vector_codes(df).collect() == []
    assert C.vector_codes(frame(spark, []).drop("label")).collect() == []


def test_many_labels_are_joined_in_salts(spark, monkeypatch):
    monkeypatch.setattr(C, "by_size", lambda ids: ids)
    rows = vectors(60, 8, 6)
    assert in_order(C.vector_codes(frame(spark, rows), entries=8, rounds=1).collect()) == in_order(plain_codes(rows, 8, 1))


def rounds_of(step, m, books, rounds):
    """Without Spark: the state after each round goes to the next."""
    state, moved, k = None, None, len(books[0])
    for left in range(rounds, -1, -1):
        how = step(books, moved)
        x, found, state = how.block(m, state)
        if left:
            new = [[*b] for b in books]
            for p, (y, _) in enumerate(how.cut(x)):
                n, s = C.added(y, found[p], k)
                for e in np.flatnonzero(n):
                    new[p][e] = [int(v) // int(n[e]) for v in s[e]]
            moved, books = [C.drifts(a, b) for a, b in zip(books, new, strict=True)], new
    return found, books, how


def test_bounds_prune_and_change_nothing(monkeypatch):
    """Well separated vectors: later rounds compute few of all distances, with the same result."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16)) * 4
    m = np.float64(np.float32(middles[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.05))
    made = []
    plain = C.pair_squares
    monkeypatch.setattr(C, "pair_squares", lambda x, rows, c, at: made.append(len(rows)) or plain(x, rows, c, at))
    start = [[int(v) for v in r] for r in C.numbers(middles, 256)]
    groups = C.in_groups(start, 4)
    assert len(set(groups.tolist())) > 1
    for step, books in ((lambda b, d: C.Yinyang(b, d, groups, 256), [start]), (lambda b, d: C.Elkan(b, d, 256), [[r[:8] for r in start], [r[8:] for r in start]])):
        made.clear()
        found, last, _ = rounds_of(step, m, books, 4)
        assert sum(made) < 0.25 * 4 * 2000 * 40 * len(books)
        xs, w = C.numbers(m, 256).astype(int).tolist(), 16 // len(books)
        for p, book in enumerate(books):
            mine, after = lloyd([x[p * w : (p + 1) * w] for x in xs], book, 4)
            assert found[p].tolist() == mine and last[p] == after


# --- token counts ------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_path("byte_bpe_50k.json"))


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    r = random.Random(3)
    signs = "aAbe's tdl'mrv  \n\t 　́é中文字1२,.!😀՘\x00\x1c "
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += ["x<|endoftext|><|endoftext|> y", "<|endoftext|>", " <|endoftext|> ", "<|endoftext", "'s'll'x''s 's we're", "\n \n  a", "", None, " ", "a" * 511, "a" * 512, "a" * 513, "ab" * 2000]
    texts += ["".join(r.choice("abcdefghijkl") for _ in range(n)) for n in (500, 513, 4000)] + [" " * 3000, "é" * 1500, "word " * 300_000, "\n".join(["== == =="] * 2000)]
    return texts


def test_counts_equal_the_library(library):
    texts = odd_texts()
    assert [*Counter(public_path("byte_bpe_50k.json")).counts(texts)] == counted(library, texts)


def test_small_stores_and_pieces_change_nothing(library, monkeypatch):
    from gristmill.llm import token_counts

    for name, n in (("PIECE", 64), ("WORDS", 20), ("STORE", 30), ("STORED", 3), ("LONG", 4)):
        monkeypatch.setattr(token_counts, name, n)
    texts = odd_texts()[:-4]
    assert [*Counter(public_path("byte_bpe_50k.json")).counts(texts)] == counted(library, texts)


def test_long_sequences_take_time_that_grows_with_them():
    import time

    merges = Counter(public_path("byte_bpe_50k.json")).merges
    r = random.Random(1)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()
    began = time.time()
    assert merges.counts([word])[0] > 400_000 and time.time() - began < 30


def test_merge_lists_out_of_order_are_refused():
    with pytest.raises(ValueError):
        Merges([("ab", "c"), ("a", "b")])


def test_rows_of_token_counts(spark, library):
    texts = ["hello world", None, "", "x " * 3000, "hello world", "<|endoftext|>"]
    df = spark.createDataFrame([(k if k != 4 else None, t, 5, True) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, over_limit boolean").repartition(2)
    got = {(r.doc_id, r.text): (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df).collect()}
    n = counted(library, texts)
    assert got == {(k if k != 4 else None, t): (len((t or "").encode()), c, c > 1024) for k, (t, c) in enumerate(zip(texts, n, strict=True))}
    assert count_tokens(df.limit(0)).collect() == []


def test_queries_over_the_small_tables(spark, library):
    from gristmill.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    n = dict(zip(docs, counted(library, docs.values()), strict=True))
    got = QUERIES["op13_token_counts"](spark, d).collect()
    assert {r.doc_id: r.n_tokens for r in got} == n and got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert in_order(QUERIES["op11_centroid_clusters"](spark, d).collect()) == in_order(plain_clusters(rows, 40, 5, 64))


# --- bounds of older operators ------------------------------------------------------------------------------------------------------------


def test_near_duplicate_tables_miss_little_and_tell_much():
    import corpus_pipeline
    from gristmill.llm import near_dup as N

    assert N.miss(0.85) < 5e-7 and N.miss(0.80, N.ROWS, corpus_pipeline.SUB_KEYS, corpus_pipeline.RING) < 5e-7
    # the bound holds where it can be counted: parameters under which pairs are missed
    r = random.Random(1)
    rows, m, ring, s = 1, 6, 3, 0.4
    missed = 0
    for _ in range(20_000):
        a, b = ([r.random() < s**rows for _ in range(m)] for _ in range(2))
        missed += not any(a[i] and b[(i + k) % m] for i in range(m) for k in range(ring))
    assert missed / 20_000 <= N.miss(s, rows, m, ring) * 1.1
    # unlike documents rarely share a table
    assert 1 - (1 - 0.3 ** (2 * N.ROWS)) ** (N.M * N.RING) < 0.12


def test_near_duplicates_leave_only_what_the_result_reads(spark, tmp_path, monkeypatch):
    from gristmill.llm import near_dup as N
    from gristmill.llm import shared

    left = []
    write, drop = shared.written, shared.forget
    monkeypatch.setattr(N, "written", lambda df, label, **o: (t := write(df, label, **o), left.append(t.written_to), t)[2])
    monkeypatch.setattr(N, "forget", lambda *ts: ([left.remove(t.written_to) for t in ts if getattr(t, "written_to", None) in left], drop(*ts))[1])
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:55], f"x{k}", *words[55:]])) for k in range(30)] + [(100 + k, f"text {k} alone " * 9) for k in range(9)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 100} == {0} or len(got) == 39
    assert sorted(p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in left) == ["found", "signatures"]


def test_training_sample_is_bounded_by_rows(spark):
    from gristmill.llm.lang_id import training_sample

    rows = [(7, "en", f"some text {k}") for k in range(3000)] + [(k, "de", f"ein Text {k}") for k in range(100, 200)]
    n = training_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 50).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in n if r.lang == "de"} == {"de": 50} and all(r["count"] <= 50 for r in n)


def test_mix_spreads_rows_without_id(spark):
    from pyspark.sql import functions as F

    from gristmill.llm import mixing

    rows = [(None, "s", k % 500 + 1) for k in range(3000)] + [(k, "t", 5) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    assert df.select(F.substring(mixing.random_key(F.col("doc_id"), F.col("size")), 1, 3)).filter("doc_id IS NULL").distinct().count() > 400
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 1 for r in got)
    assert mixing.range_digits(10**12) == 7 and mixing.range_digits(10) == 3
    plain, more = (sorted(map(repr, mixing.mix(df, digits=d).collect())) for d in (1, 5))
    assert plain == more


def test_a_repeated_id_asks_with_a_vector_that_takes_part(spark):
    from gristmill.llm.vectors import nearest, top_scores

    rows = [(50, [None, 1.0]), (50, [2.0, 0.0]), (50, None), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for f in (nearest, top_scores):
        got = f(df, df.filter("vec_id = 50"), 2).collect()
        assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 1), (50, 2, 2)]


def test_wide_vectors_and_small_queries_lose_nothing(spark):
    from gristmill.llm.vectors import top_scores

    rng = np.random.default_rng(4)
    m = np.float32(rng.normal(size=(300, 900)) * np.where(np.arange(300) % 50 == 0, 0.02, 3.0)[:, None])
    df = spark.createDataFrame([(k, [float(x) for x in m[k]]) for k in range(300)], "vec_id long, embedding array<float>")
    q = np.floor(256 * m.astype(np.float64)).astype(np.int64)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_scores(df, df.filter("vec_id % 50 = 0"), 5).collect()}
    for k in range(0, 300, 50):
        best = sorted(((-int(q[k] @ q[c]), c) for c in range(300) if c != k))[:5]
        assert [got[k, n + 1] for n in range(5)] == [(c, -s) for s, c in best]


def test_unknown_events_are_counted_not_fatal(spark):
    from gristmill.llm.chat import format_chat, unknown_events

    df = spark.createDataFrame([(1, 0, 0, "message", "user", "hi"), (1, 0, 1, "reaction", "user", "x"), (1, 1, 0, None, "assistant", "yo"), (2, 0, 0, "reaction", "user", "z")], "conv_id long, turn long, seq long, kind string, role string, text string")
    assert [(r.conv_id, r.turn) for r in format_chat(df).orderBy("turn").collect()] == [(1, 0), (1, 1)]
    assert sorted(map(tuple, unknown_events(df).collect())) == [(1, "reaction", 1), (2, "reaction", 1)]
    assert unknown_events(df.drop("kind")).count() == 0
