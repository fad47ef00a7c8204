"""Chat, BPE, HTML, language ID, vector searches, pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import bpe, chat, html_text, lang_id, vectors
from gristmill.llm.oracle import ORACLE_SQL
from gristmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


# --- chat


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\a\nim_startend>%0A", max_size=60), st.text(alphabet="<|\\user\n%0A", max_size=12))
def test_template_round_trip(text, role):
    piece, s, e = chat.render(role, text)
    reader = chat.Reader()
    reader.feed(piece, [(s, e)] if s < e else [])
    assert chat.unescape(chat.escape(text)) == text and reader.n_turns == 1
    assert reader.turns.hexdigest() == hashlib.sha256(f"{role}\n{text}\n".encode()).hexdigest()
    assert chat.escape(text).count("<|") == 0


def test_chat_equals_sql(spark, tmp_path):
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "b\\<\\|c"), (1, 2, "user", "tie"), (2, None, None, "é😀"), (2, 5, "assistant", "x" * 100_000), (None, 0, "user", "q")]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["op2_chat_format"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(db.execute(ORACLE_SQL["op2_chat_format"]).fetchall(), key=str)
    assert got == want and any(r[0] == -1 and r[1] == 2 for r in got)


def plain_fold(events):
    """By turn: what a message comes to, with regenerations taking back later turns."""
    final = {}
    restarts = defaultdict(int)
    for turn, seq, kind, role, text in sorted(events, key=lambda x: (x[0], x[1])):
        if kind == "regenerate":
            restarts[turn] = max(restarts[turn], seq)
    for turn, seq, kind, role, text in sorted(events, key=lambda x: (x[0], x[1])):
        if any(t < turn and s > seq for t, s in restarts.items()):
            continue
        old = final.get(turn)
        final[turn] = (role or (old or ("",))[0], (old[1] if old and kind == "delta" else "") + text)
    return [(t, *final[t]) for t in sorted(final)]


def test_events(spark):
    events = [
        (0, 0, "message", "user", "hi"), (1, 1, "delta", "assistant", "He"), (1, 2, "delta", None, "llo"), (2, 3, "message", "user", "more"), (3, 4, "delta", "assistant", "old"),
        (1, 5, "regenerate", None, "Good "), (1, 6, "delta", None, "day"), (2, 7, "message", "user", "again"), (3, 8, "delta", "assistant", "new"), (0, 9, "edit", None, "hello"),
    ]
    random.Random(1).shuffle(events)
    df = spark.createDataFrame([(7, *e) for e in events], "conv_id long, turn long, seq long, kind string, role string, text string")
    got = [(r.turn, r.role, r.formatted) for r in chat.format_chat(df).collect()]
    want = plain_fold(events)
    assert want == [(0, "user", "hello"), (1, "assistant", "Good day"), (2, "user", "again"), (3, "assistant", "new")]
    assert got == [(t, r, chat.render(r, x)[0]) for t, r, x in want]


def test_chat_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op2_chat_format"](spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(-1, 2)]


# --- BPE


@pytest.fixture(scope="module")
def both():
    theirs = Tokenizer.from_file(bpe.public_path())
    theirs.no_truncation()
    theirs.no_padding()
    return bpe.Tokenizer(bpe.public_path()), theirs


def same(both, text):
    ours, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    ids = [*ours.encode(text)]
    assert ids == want, text[:80]
    d = ours.decoder()
    assert "".join(map(d.feed, ids)) == ours.decoder().feed_all(ids) == theirs.decode(ids, skip_special_tokens=False)


ODD = ["", " ", "Hello world's  café 123 <|endoftext|> x<|startoftext|>y", "日本語 é́ ΣΑΣ", "a\x00b\x1c\x1dx  c İ", "it's DON'T 'Re !!!?? ...", "é ́x", "<|endoftext|><|ENDOFTEXT|>", "a" * 9000, "the" * 20_000, "ﬀ ² Ⅷ ½ ​ x _a_b", " a　b"]


def test_bpe_odd_texts(both):
    for t in ODD:
        same(both, t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(both, text):
    same(both, text)


def test_bpe_emits_before_words_end(both):
    """Long words come out while they are read, a bounded number of symbols behind, and as the library says."""
    ours, theirs = both
    r = random.Random(3)
    for n in (400, 1500, 6000):
        word = "".join(r.choice(["th", "in", "er", "the", "ing", "a", "tion", "an", "re"]) for _ in range(n))
        read = 0

        def symbols(raw=word.encode()):
            nonlocal read
            for b in raw:
                read += 1
                yield ours.symbol[b]

        ids, said, behind = [], 0, 0
        for t in ours.transducer.encode(symbols()):
            behind = max(behind, read - said)
            said += ours.transducer.length[t]
            ids.append(t)
        assert ids == theirs.encode(word, add_special_tokens=False).ids
        assert behind <= 4 * ours.transducer.lookahead + 2 * bpe.READ


@pytest.mark.parametrize("read", [1, 3, 16])
def test_bpe_needs_are_sufficient(monkeypatch, read):
    """A small merge list with short lookaheads: tokens come out early, and are those of the whole word."""
    monkeypatch.setattr(bpe, "READ", read)
    r = random.Random(read)
    early = 0
    for _ in range(200):
        vocab = {c: k for k, c in enumerate("abc")} | {c + "/": k + 3 for k, c in enumerate("abc")}
        merges = []
        for _ in range(r.randrange(1, 9)):
            left, right = r.choice([t for t in vocab if "/" not in t]), r.choice([*vocab])
            if left + right not in vocab:
                vocab[left + right] = len(vocab)
                merges.append((left, right))
        t = bpe.Transducer(vocab, merges, "/")
        word = "".join(r.choice("abc") for _ in range(r.randrange(1, 60)))
        read_so_far = 0

        def symbols(text=word):
            nonlocal read_so_far
            for c in text:
                read_so_far += 1
                yield vocab[c]

        got = []
        for x in t.encode(symbols()):
            early += read_so_far < len(word)
            got.append(x)
        whole = [vocab[c] for c in word]
        whole[-1] = t.closed.get(whole[-1], whole[-1])
        assert got == t.tokens(whole)
    assert early > 50


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "Hello café, 日本!"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(df)).collect()}
    assert rows[1].decoded.replace(" ", "") == "hellocafé,日本!" and rows[2].ids == [] and rows[2].decoded == ""


# --- HTML


def page(article, nav="Home About", foot="Imprint", extra=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>{nav}</li></ul></nav>{extra}<article>{article}</article><footer>{foot}</footer></body></html>"


def test_lines():
    text = html_text.main_text(html_text.lines_of(page("<h1>T &amp; x</h1><p><b>a\n  b<br>c<p>d<!-- no --><div class='ad'>buy</div><form><input>go</form><section class='comments'><article>reader</article></section><p>e &lt;f&gt; &eacute;")), set())
    assert text == "T & x\na b c\nd\ne <f> é"
    assert html_text.main_text(html_text.lines_of(""), set()) == ""
    assert html_text.lines_of("a <b>c</b> < d <script>x") == [(1, "a c < d")]
    assert html_text.lines_of("x<!-- never ends") == [(1, "x")]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div class='layout has-sidebar'><div class='sidebar'>side</div><article>a<p>b</article></div>", "a\nb"),
        ("<div class='site no-sidebar'>a</div>", "a"),
        ("<div class='page sidebar-left'><nav>n</nav><article>a</article><div class='comments'><article>reader</article></div></div>", "a"),
        ("<form id='aspnetForm'><div class='menu'>m</div><article>a</article></form>", "a"),
        ("<html><body><form id='aspnetForm'><label>l</label><div>a</div></form></body></html>", "a"),
        ("<body><form id='aspnetForm'><form class='search'><div>s</div></form><nav>n</nav><div>a</div></form>", "a"),
        ("<div id='search'><main>a<article>b</article></main></div>", "a\nb"),
        ("<div>a</div><form><div>f</div></form><div>b</div>", "a\nb"),
        ("<article><h2 id='related-work'>a</h2><section id='social-policy'>b</section><p id='search'>c</p><div class='social-policy'>d</div></article>", "a\nb\nc\nd"),
        ("<article>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math></article>", "a x=2"),
        ("<article>a<div class='ad-slot box'>x</div><div class='related-posts'>x</div><div hidden>x</div></article>", "a"),
        ("<article>a<p class='notice'>b</p><label>c</label><div class='share-bar'><div class='comments'>x</div>d</div></article>", "a\nb\nc\nd"),
        ("<article>a</article><div class='comments'><article>reader</article></div>", "a"),
        ("<main>a<div class='sidebar-left'><article>b</article>x</div></main><div class='promo'><article>x</article></div>", "a\nb"),
        ("<nav><article>x</article></nav><div hidden><article>x</article></div><div>a</div>", "a"),
    ],
)
def test_exclusion_leaves_articles(html, text):
    assert html_text.main_text(html_text.lines_of(html), set()) == text


def test_differencing(spark):
    menu, notice = "<div>Home | About | Shop</div>", "<div>Read our terms</div>"
    body = lambda t: f"<html><body>{menu}<div>{t}</div>{notice}<div>{t} again</div></body></html>"
    rows = [(1, "https://a.org/x/1", body("one"), 0), (2, "https://A.org/x/2?q", body("two"), 0), (3, "https://b.org/x", body("alone"), 0), (4, "https://a.org/x/1#top", body("one"), 0), (5, None, None, 0), (6, "https://a.org/y", page("<p>kept</p>" + menu), 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == got[4] == "one\none again" and got[2] == "two\ntwo again"
    assert got[3].startswith("Home | About") and got[5] == "" and got[6] == "kept\nHome | About | Shop"


def plain_extract(rows):
    """Text by page: pages of a host are sorted by path, the partner is the different neighbour whose path agrees the longest."""
    parsed = [(p, *html_text.host_and_path(u), html_text.lines_of(h or "")) for p, u, h in rows]
    hosts = defaultdict(dict)
    for _, host, path, lines in parsed:
        key = html_text.digest(lines)
        hosts[host][key] = min(hosts[host].get(key, (path, key, lines)), (path, key, lines), key=lambda x: x[:2])
    out = {}
    for p, host, _, lines in parsed:
        order = sorted(hosts[host].values(), key=lambda x: x[:2])
        at = next(k for k, x in enumerate(order) if x[1] == html_text.digest(lines))
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        partner = max(near, key=lambda x: html_text.agree(order[at][0], x[0]), default=None)
        shared = html_text.shared_places(html_text.hashes(lines), html_text.hashes(partner[2])) if partner else []
        out[p] = html_text.main_text(lines, set(shared))
    return out


def test_extraction_equals_plain_and_hangs_on_differencing(spark):
    r = random.Random(4)
    rows = []
    for k in range(160):
        own = "".join(f"<p>own {k} {r.random()}</p>" for _ in range(r.randrange(1, 4)))
        box = f"<div class='{r.choice(['notice', 'share', 'banner'])}'>{r.choice(['Read our terms', 'Share this', f'only on {k}'])}</div>"
        body = own + box if r.random() < 0.5 else box + own + "<p>shared passage of the articles</p>"
        html = r.choice([f"<div>Menu</div><article>{body}</article>", f"<div>Menu | Home</div><div>{body}</div><div>Imprint</div>", f"<main><div>Start</div>{body}</main>", "<p>Not found</p>"])
        rows.append((k, f"http://{r.choice(['a', 'b', 'c'])}.org/{r.choice('xyz')}/{r.choice('pqrs')}{r.randrange(30)}", html))
    rows += [(1000, "http://a.org/x", None), (1001, "http://a.org/x", ""), (1002, None, "<p>alone"), (1003, "http://c.org/long", "<article>" + "<p>x" * 100_000), (1003, "http://c.org/long", "<article>y")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, lines string").repartition(7)
    got = html_text.extract(df).collect()
    want = plain_extract([x for x in rows if x[0] != 1003])
    assert {x.page_id: x.text for x in got if x.page_id != 1003} == want and sorted(x.n_chars for x in got if x.page_id == 1003) == [1, 199_999]
    alone = {p: html_text.main_text(html_text.lines_of(h or ""), set()) for p, _, h in rows}
    assert sum(alone[p] != t for p, t in want.items()) > 40 and any("shared passage" in t for t in want.values())
    assert html_text.extract(df.limit(0)).count() == 0


def test_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 60, 2500):
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, max(n - 3, 0))
        places = html_text.common(a, b)
        if n <= 60:
            assert len(places) == plain(a, b)
        it = iter(b.tolist())
        assert places == sorted(places) and all(x in it for x in a[places])


def test_pages_of_the_smallest_table(spark):
    got = QUERIES["op8_html_extraction"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/pages.parquet").count() and all(r.n_chars == len(r.text) and r.text for r in got)


# --- language ID


def test_gradients():
    net = lang_id.Network(["a", "b", "c"], hidden=5)
    for d in (net.ahead, net.back):
        d.p = {k: v.astype(np.float64) for k, v in d.p.items()}
    net.v, net.c = net.v.astype(np.float64), net.c.astype(np.float64)
    x, y = lang_id.padded([b"abc", b"d e", b"f"], 3), np.array([0, 1, 2])
    _, grads = net.gradients(x, y)
    for name, p in net.parameters().items():
        at = np.unravel_index(np.argmax(np.abs(grads[name])), p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = net.gradients(x, y)[0]
        p[at] = old - 1e-5
        down = net.gradients(x, y)[0]
        p[at] = old
        assert abs(grads[name][at] - (up - down) / 2e-5) < 1e-4


def test_stretches_cover_texts_once():
    lengths = [0, 1, lang_id.CORE, lang_id.CORE + 1, 5 * lang_id.CORE + 7, 0, 3]
    of, begin, end, low, high = lang_id.stretches(lengths)
    assert [int((high - low)[of == k].sum()) for k in range(len(lengths))] == lengths
    assert (begin <= low).all() and (high <= end).all() and (end - begin <= lang_id.CORE + 2 * lang_id.CONTEXT).all()


def test_what_stands_beside_a_text_is_not_seen():
    net = lang_id.Network(["a", "b"], hidden=4)
    alone, long = net.pooled([b"some words"]), net.pooled([b"some words", b"x " * 400, b"yz"])
    assert np.allclose(alone[0], long[0], atol=1e-4)
    whole = net.positions(np.frombuffer(b"x yz" * 100, np.uint8)[:, None], None)  # in one stretch
    assert np.abs(whole[:, 200:300, 0].mean(1) - net.positions(np.frombuffer(b"x yz" * 40, np.uint8)[:, None], None)[:, 40:140, 0].mean(1)).max() < 0.05


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = [(k, t, lang, "x") for k, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de"), (None, "en"), ("12 34", "de"), ("", None), ("the " * 5000, None), ("日本", None), ("x" * 100_000, None)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in lang_id.identify(df, lang_id.train(df)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4)) and got[0].lang_pred == "en" and got[5].lang_pred == "en"
    none = lang_id.identify(df, lang_id.train(df.filter("lang = 'none'"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


# --- vectors


def plain_top(rows, mod, k, prepare):
    use = {i: prepare(v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    use = {i: v for i, v in use.items() if v is not None}
    out = []
    for q, x in use.items():
        if q % mod == 0:
            scored = []
            for c, y in use.items():
                if c != q:
                    total = 0
                    for a, b in zip(x, y, strict=True):
                        total += a * b
                    scored.append((-total, c))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 8).astype(np.float32)]) for k in range(260)]
    rows[40] = (40, rows[20][1])
    rows[41] = (41, rows[20][1])
    return rows + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [1.0, float("inf")] + [0.0] * 6), (None, rows[0][1])]


@pytest.mark.parametrize("how", [{}, {"group_bytes": 300, "slice_bytes": 2000}])
def test_searches_equal_plain(spark, monkeypatch, how):
    monkeypatch.setattr(vectors, "ROWS", 40)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, bar int").repartition(5)
    near = vectors.nearest(df, df.filter("vec_id % 20 = 0"), 20, **how)
    assert sorted(map(tuple, near.collect())) == plain_top(rows, 20, 20, lambda v: v if any(v) else None)
    top = vectors.top_scores(df, df.filter("vec_id % 50 = 0"), 5, **how)
    assert sorted(map(tuple, top.collect())) == plain_top(rows, 50, 5, lambda v: [int(np.floor(256 * x)) for x in v])


def searched(task, ids, m, mod, block):
    q = np.flatnonzero(ids % mod == 0)
    task.add(ids[q], np.full(len(q), -np.inf), m[q])
    for k in range(0, len(ids), block):
        task.candidates(ids[k : k + block], m[k : k + block])
    out = defaultdict(list)
    for query, vec, score in task.rows():
        out[query].append((vec, score))
    return out


def plain_search(ids, m, mod, k, score):
    best = lambda q, at: sorted(((score(m[at].tolist(), y), -c) for y, c in zip(m.tolist(), ids.tolist(), strict=True) if c != q), reverse=True)[:k]
    return {int(q): [(-c, s) for s, c in best(q, at)] for at, q in enumerate(ids) if q % mod == 0}


def test_lists_of_the_table_stop_early():
    got = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.01/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, m = np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)
    task = vectors.TopScores(5)
    whole = lambda x, y: sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(x, y, strict=True))
    assert searched(task, ids, m, 50, 4096) == plain_search(ids, m, 50, 5, whole)
    assert 0 < task.read < 0.9 * task.held  # lists are read, and not to their ends


KINDS = {
    "unit": lambda r: r.normal(0, 0.1, (500, 33)).astype(np.float32).astype(float), "scales": lambda r: r.normal(0, 1, (400, 9)) * 10.0 ** r.integers(-6, 6, (400, 1)),
    "huge": lambda r: r.normal(0, 1, (150, 9)) * 10.0 ** r.integers(150, 200, (150, 1)), "largest": lambda r: r.normal(0, 1, (150, 5)) * 1e300, "tiny": lambda r: r.normal(0, 1, (150, 5)) * 1e-200,
    "ties": lambda r: r.integers(-1, 2, (400, 4)).astype(float), "millions": lambda r: r.normal(0, 1e6, (200, 6)), "billions": lambda r: r.normal(0, 3e9, (200, 6)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_tasks_equal_plain(kind):
    def product(x, y):
        total = 0.0
        for a, b in zip(x, y, strict=True):
            total += a * b
        return vectors.order_of(total)

    m = KINDS[kind](np.random.default_rng(4))
    ids = np.arange(len(m))
    near = {q: [(c, vectors.order_of(s)) for c, s in found] for q, found in searched(vectors.Nearest(20), ids, m, 20, 97).items()}
    assert near == plain_search(ids, m, 20, 20, product)
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = lambda x, y: held(sum(vectors.exact(a, 256) * vectors.exact(b, 256) for a, b in zip(x, y, strict=True)))
    assert searched(vectors.TopScores(5), ids, m, 20, 97) == plain_search(ids, m, 20, 5, whole)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, c = np.floor(256 * rng.normal(0, 1, (5, 16))), np.floor(256 * rng.normal(0, 1, (800, 16)))
    for depth in (1, 100, 400, 700, 800):
        low, high = vectors.bounds(q, vectors.Lists(c), depth)
        assert ((low <= q @ c.T + 1e-6) & (high >= q @ c.T - 1e-6)).all()
    assert (low == high).all()


def test_bounds_of_int8_tiles():
    rng = np.random.default_rng(5)
    q, c = rng.normal(0, 1, (10, 33)), rng.normal(0, 3, (50, 33))
    q8, qs, qe, qn = vectors.quantised(q)
    c8, cs, ce, _ = vectors.quantised(c)
    about = vectors.products(q8, c8) * qs[:, None] * cs[None]
    assert (np.abs(about - q @ c.T) <= qe[:, None] * np.linalg.norm(c, axis=1)[None] + qn[:, None] * ce[None] + 1e-12).all()


def test_searches_of_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.nearest(empty, empty).count() == 0 and vectors.top_scores(empty, empty).count() == 0
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, []), (0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vectors.nearest(odd, odd.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 3.0)]
    big = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e300, 1e300]), (2, [-1e300, -1e300]), (3, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert [r.score for r in vectors.top_scores(big, big.filter("vec_id = 0")).orderBy("rank").collect()] == [2**63 - 1, 0, -(2**63)]
    near = [(r.vec_id, str(r.score)) for r in vectors.nearest(big, big.filter("vec_id = 0")).orderBy("rank").collect()]
    assert near == [(3, "nan"), (1, "inf"), (2, "-inf")]


# --- pipeline


def plain_mix(rows):
    """Copies by (doc_id, text) of (doc_id, text, source) rows, word for word after the contract of the mix."""
    sized = [(d, t, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    sources = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, s))
    size = {s: sum(n for _, _, x, n in sized if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
    target |= share
    copies = defaultdict(int)
    for s in sources:
        budget = math.floor(target[s] + 0.5)
        epochs, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        own = sorted(((hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest(), n, d, t) for d, t, x, n in sized if x == s), key=lambda r: (r[0], r[1]))
        for _, n, d, t in own:
            taken = epochs * n + max(0, min(n, rest))
            rest -= n
            copies[d, t] += -(-taken // n) if n else 0
    return {k: n for k, n in copies.items() if n}


def test_pipeline(spark):
    """Stage by stage on the smallest table; the mix and the tokens of all rows against plain versions."""
    import corpus_pipeline as p
    from gristmill.llm.shared import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    theirs = Tokenizer.from_file(bpe.public_path())
    theirs.no_truncation()
    theirs.no_padding()
    for name, stage in p.STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, SMALL), name)
        assert docs.columns == before.columns, name
    given = [(r.doc_id, r.text, r.source) for r in last.collect()]
    left = Counter((r.doc_id, r.text) for r in docs.collect())
    assert left == plain_mix(given)
    rows = p.run(spark, SMALL).collect()
    said = defaultdict(int)
    for r in rows:
        said[r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256] += 1
    want = defaultdict(int)
    for (d, text), n in left.items():
        ids = theirs.encode(text, add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    assert said == want


def test_pipeline_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, and tables without rows."""
    import corpus_pipeline as p

    long = "die Häuser und the houses et les maisons " * 3000
    rows = [(1, "the house and the tree are old", "en", "web", 30), (1, "the house and the tree are old", "en", "web", 30), (2, None, None, None, None), (3, "", "de", "web", 0), (None, "das Haus und der Baum sind alt", "de", None, 30)]
    rows += [(None, None, None, None, None), (4, long, None, "books", len(long)), (5, "token=abcdefghijk and the tree of the garden", None, "web", 40), (6, "12 34", "en", "web", 5)]
    docs = spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, spans string, _row long")
    for name, stage in p.STAGES:
        got, none = stage(spark, docs, SMALL), stage(spark, docs.limit(0), SMALL)
        kept = got.collect()
        assert none.count() == 0 and none.columns == got.columns, name
        if name != "tokens":
            assert got.columns == [*p.COLUMNS], name
        ids = Counter(r.doc_id for r in kept)
        if name == "language_id":
            assert ids == {1: 2, None: 1, 4: 1, 5: 1}
        elif name == "near_duplicates":
            assert ids == {1: 1, 2: 1, 3: 1, None: 2, 4: 1, 5: 1, 6: 1}
        elif name == "secret_scan":
            assert len(kept) == len(rows) and {r.text for r in kept if r.doc_id == 5} == {"[SECRET] and the tree of the garden"} and sum(r.text is None for r in kept) == 2
        elif name == "mix_sources":
            assert ids and not ids.keys() & {2, 3}
        else:
            assert len(kept) == len(rows) and sum(r.n_tokens == 0 for r in kept) == 3


def stage_rows(spark, stage, rows):
    """What a stage keeps of (doc_id, text, ...) rows, as sorted (doc_id, text)."""
    docs = spark.createDataFrame([(*r, *(None, "web", len(r[1] or ""))[len(r) - 2 :]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SMALL).collect()), key=str)


def test_pipeline_links_from_four_fifths(spark):
    import corpus_pipeline as p

    rows, keep = [], []
    for g, (n, changed) in enumerate([(55, (20,)), (44, (20,)), (200, (20, 60, 100, 140)), (49, (20,)), (48, (20,)), (40, (20,))] * 20):
        words = [f"g{g}w{k}" for k in range(n)]
        other = [w + "x" if k in changed else w for k, w in enumerate(words)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        same, shingles = n - 4 - 5 * len(changed), n - 4 + 5 * len(changed)
        keep += [rows[-2]] + [rows[-1]] * (same / shingles < 0.8)
    assert stage_rows(spark, p.near_duplicates, rows) == sorted(keep, key=str)


def test_pipeline_keeps_mixed_languages(spark):
    import corpus_pipeline as p

    texts = {}
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")
    for r in given.orderBy("doc_id").collect():
        if len(r.text.split()) >= 60:
            texts.setdefault(r.lang, []).append(r.text.split()[:60])
    mixed = [(10**9 + k, " ".join(w for part in parts for w in part)) for k, parts in enumerate(zip(*(texts[k][:40] for k in sorted(texts)), strict=False))]
    odd = [(2 * 10**9, None), (2 * 10**9 + 1, "12 34 --")]
    docs = given.unionByName(spark.createDataFrame([(*r, None, "web", 0) for r in mixed + odd], given.schema))
    kept = {r.doc_id for r in p.language_id(spark, docs, SMALL).collect() if r.doc_id >= 10**9}
    assert len(texts) == 4 and len(mixed) > 10 and kept == {k for k, _ in mixed}


def test_pipeline_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline as p

    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(1, text(1)), (1, None), (1, text(2)), (2, text(2) + " more"), (3, text(3)), (3, text(3)), (None, text(4)), (None, text(4)), (None, text(4) + " more"), (None, text(5)), (None, text(1)), (4, None), (4, ""), (5, text(6))]
    got = stage_rows(spark, p.near_duplicates, rows)
    assert [r for r in got if r[0] in (1, 2, 3, 5)] == sorted([(1, text(1)), (1, None), (1, text(2)), (3, text(3)), (5, text(6))], key=str)
    assert sorted(r[1][:3] for r in got if r[0] is None) == ["t4w", "t5w"] and sum(r[0] == 4 for r in got) == 1 and len(got) == 8
