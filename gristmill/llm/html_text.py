r"""HTML extraction by nearest-URL page differencing.

Pages become lines, a line for each block of text. Within a host, different pages are sorted by URL path; a page is paired with the
neighbour whose path agrees with its own the longest. The two pages' lines are aligned by longest common subsequence, and what
both share is deleted: menus, notices, footers. Markup is asked first where it speaks: lines of `<article>` are the text and are not
deleted, as articles share passages; lines of menus, forms, adverts, comments and the like never are the text. Names of classes and ids are a weak sign: an article or
main part inside an element that only they exclude is the text too, unless the page has an article elsewhere. Inside an article ids say
nothing, and of what a class calls a notice, a banner, a share bar and so on only lines that the partner has too are deleted. A form that wraps a page is no form.

Pairing sorts only URLs and hashes of lines. The sort is by range over all hosts, so that no host is one task; neighbours across
the borders of ranges come from the ranges' first and last rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.shared import written

#: Kinds of lines. SHUT: excluded by the names of a class or id alone; HELD: of an article or main part inside that. _MAIN: inside a main part.
#: WEAK: in an article, but in an element whose class speaks against it.
ARTICLE, MAIN, OPEN, NEVER, SHUT, SHUT_MAIN, HELD, HELD_MAIN, WEAK = 3, 2, 1, 0, 4, 5, 6, 7, 8

#: Names from the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
REMOVED = frozenset("nav header footer aside form menu dialog search button select option datalist fieldset label head svg object audio video canvas map".split())
ENDED_BY_BLOCK = frozenset("p".split())
#: Words of class names and ids. A name excludes only if all its words are marked or filling: "ad-slot", but not "social-policy" or "no-sidebar".
FOREIGN = r"ad|ads|advert\w*|sponsor\w*|promo\w*|comments?|disqus|repl(?:y|ies)|respond|related|recommend\w*"
MARKED = rf"{FOREIGN}|banner|cookies?|consent|gdpr|notice|newsletter|subscri\w*|signup|popup|modal|overlay|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|share|sharing|social|login|pagination|pager|toolbar|search|widgets?|skip"
FILLING = r"area|bar|block|bottom|box|btn|buttons?|col|column|container|content|desktop|div|entry|form|global|google|group|header|holder|icons?|inner|item|items|js|left|link|links|list|main|mobile|outer|page|panel|post|posts|primary|right|row|secondary|section|site|slot|stories|thread|to|top|unit|wp|wrap|wrapper|\d+(?:x\d+)?"


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s)[_-]*(?:(?:{FILLING})[_-]+)*(?:{words})(?:[_-]+(?:{MARKED}|{FILLING}))*[_-]*(?:$|\s)", re.I)


_FOREIGN, _MARKED = _names(FOREIGN), _names(MARKED)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORTH = re.compile("class|id|role|style|hidden", re.I)
_PARTS = re.compile(r"<(/?)(form|article|main|nav|footer)(?=[\s/>])[^<>]*>?", re.I)
_BODY_START = re.compile(r"<body(?=[\s/>])[^<>]*>(?:\s|<div(?=[\s>])[^<>]*>)*", re.I)
_BODY_END = re.compile(r"(?:\s|</div\s*>|<script(?=[\s>]).*?</script\s*>|<!--.*?-->)*(?:</body|</html|$)", re.I | re.S)
TEXTS = (ARTICLE, HELD, HELD_MAIN, WEAK)


def excluded(name: str, attributes: str, kind: int) -> int | None:
    """NEVER, SHUT or WEAK where attributes speak against an element that stands in text of `kind`, None where they don't."""
    if name in ("html", "body", "main", "article") or not _WORTH.search(attributes):
        return None
    found = None
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = k.lower(), html.unescape(a or b or c)
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return NEVER
        if key == "class" or key == "id" and kind not in TEXTS:
            # what is shut already stays so, but articles among comments, adverts and the like in it aren't held
            if kind in TEXTS and not _FOREIGN.search(value):
                found = found if found is not None or not _MARKED.search(value) else WEAK
            elif (_FOREIGN if kind in (SHUT, SHUT_MAIN) else _MARKED).search(value):
                found = NEVER if kind not in (OPEN, MAIN) else SHUT
    return found


def wrapping_forms(page: str) -> set[int]:
    """Where those forms begin that wrap the page or hold its main parts."""
    found: set[int] = set()
    body, opened, part = _BODY_START.search(page), [], -1
    ends = [(m.group(1), m.group(2).lower(), m.start(), m.end()) for m in _PARTS.finditer(page)]
    for slash, name, start, end in [*ends, *[("/", "form", len(page), len(page))] * len(ends)]:
        if name != "form":
            part = part if slash else start
        elif not slash:
            opened.append(start)
        elif opened:
            first = opened.pop()
            if part > first or body and body.end() == first and _BODY_END.match(page, end):
                found.add(first)
    return found


def tag_end(page: str, at: int) -> int:
    """The place behind the tag's `>`, which quotes can hide; the page's end if there is none."""
    quote = ""
    while True:
        k = page.find(">", at)
        if k < 0:
            return len(page)
        part = page[at:k]
        for m in re.finditer(r"""["']""", part):
            quote = "" if quote == m.group() else quote or (m.group() if re.search(r"=\s*$", part[: m.start()]) else "")
        at = k + 1
        if not quote:
            return at


def lines_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order, white space turned into single spaces, without empty ones."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    regions: list[tuple[str, int, dict[str, int]]] = []  # element, kind, open elements in it
    kind, at, end = OPEN, 0, len(page)
    forms: set[int] | None = None
    last_close = page.rfind(">")

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts.clear()

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            parts.append(page[at:lt])
        if lt >= end:
            break
        if page.startswith("<!--", lt):
            k = page.find("-->", lt + 4)
            at = k + 3 if k >= 0 else end
            continue
        if page.startswith(("<!", "<?"), lt):
            k = page.find(">", lt)
            at = k + 1 if k >= 0 else end
            continue
        closing = page.startswith("</", lt)
        m = _NAME.match(page, lt + 1 + closing)
        if not m or lt > last_close:
            parts.append("<")
            at = lt + 1
            continue
        name, at = m.group().lower(), tag_end(page, m.end())
        if closing:
            if name in BLOCKS:
                flush()
            while regions:
                of, _, inside = regions[-1]
                if inside.get(name, 0) > 0:
                    inside[name] -= 1
                    break
                if of == name or any(r[0] == name for r in regions[:-1]):
                    flush()
                    regions.pop()
                    kind = regions[-1][1] if regions else OPEN
                    if of == name:
                        break
                    continue
                break
            continue
        attributes = page[m.end() : at - 1]
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
            while regions and regions[-1][0] in ENDED_BY_BLOCK or name == "li" and regions and regions[-1][0] == "li":
                regions.pop()
                kind = regions[-1][1] if regions else OPEN
        if name in RAW:
            k = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = tag_end(page, k.end()) if k else end
            continue
        if name in VOID:
            continue
        new = None
        if kind != NEVER:
            new = excluded(name, attributes, kind)
            form = name == "form" and kind not in TEXTS and new != NEVER
            if form and forms is None:
                forms = wrapping_forms(page)
            if form and lt in forms:
                new = None
            elif name in REMOVED and not (name in ("header", "label") and kind in TEXTS):
                new = NEVER
            elif new == SHUT:
                new = SHUT_MAIN if kind == MAIN else SHUT
            elif name == "article" or name == "main" and kind == SHUT:
                new = {SHUT: HELD, SHUT_MAIN: HELD_MAIN, HELD: HELD, HELD_MAIN: HELD_MAIN}.get(kind, ARTICLE)
            elif name == "main" and kind == OPEN:
                new = MAIN
        if new is not None:
            flush()
            regions.append((name, new, {}))
            kind = new
        elif regions:
            regions[-1][2][name] = regions[-1][2].get(name, 0) + 1
    flush()
    return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-case host and the path without query, fragment or a slash at its end."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].lower(), "/" + path.rstrip("/")


def table_of_lengths(a: np.ndarray, b: np.ndarray, keep: bool) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int32)
    rows = [row]
    for x in a:
        row = np.concatenate([[0], np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))]).astype(np.int32)
        if keep:
            rows.append(row)
    return np.array(rows) if keep else row


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in `a` of a longest common subsequence; halves large tables, so that memory grows with a row."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        return [0] if (b == a[0]).any() else []
    if len(a) * len(b) > 4_000_000:
        half = len(a) // 2
        k = int(np.argmax(table_of_lengths(a[:half], b, False) + table_of_lengths(a[half:][::-1], b[::-1], False)[::-1]))
        return common(a[:half], b[:k]) + [half + x for x in common(a[half:], b[k:])]
    t = table_of_lengths(a, b, True)
    out, i, j = [], len(a), len(b)
    while i and j:
        if t[i, j] == t[i - 1, j]:
            i -= 1
        elif t[i, j] == t[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def shared_places(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Places of the lines that both pages share, aligned; lines that only one page has don't matter for it."""
    here, there = np.flatnonzero(np.isin(own, other)), other[np.isin(other, own)]
    return [int(here[k]) for k in common(own[here], there)]


def agree(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def hashes(lines: list[tuple[int, str]]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for _, t in lines], np.uint64).view(np.int64)


def digest(lines: list[tuple[int, str]]) -> bytes:
    h = xxhash.xxh3_128()
    for k, t in lines:
        h.update(f"{k}{len(t)}:{t}")
    return h.digest()


PARSED = "page_id long, url string, host string, path string, digest binary, lines array<long>, kinds binary, texts array<string>, open boolean"


def parse(pages: DataFrame) -> DataFrame:
    """The pages' lines, with what pairing needs of them; `open` says whether differencing can change a page's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, found = [host_and_path(u) for u in batch.column(1).to_pylist()], [lines_of(h.as_py() or "") for h in batch.column(2)]
            # lines that can't be part of the text keep their place alone
            bare = [["" if k in (NEVER, SHUT, SHUT_MAIN) else t for k, t in x] for x in found]
            columns = (
                (batch.column(0), pa.int64()), (batch.column(1), pa.string()), ([u[0] for u in urls], pa.string()), ([u[1] for u in urls], pa.string()), ([digest(x) for x in found], pa.binary()),
                ([hashes(x) for x in found], pa.list_(pa.int64())), ([bytes(k for k, _ in x) for x in found], pa.binary()), (bare, pa.list_(pa.string())), ([is_open({k for k, _ in x}) for x in found], pa.bool_()),
            )
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in columns], [x.split()[0] for x in PARSED.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, PARSED)


def is_open(kinds: set[int]) -> bool:
    return WEAK in kinds or ARTICLE not in kinds and bool(kinds & {OPEN, MAIN})


def neighbours(outline: DataFrame) -> DataFrame:
    """(host, digest, path, lines, before, after): each different page of a host with those before and after it by path."""
    each = outline.groupBy("host", "digest").agg(F.min("path").alias("path"), F.any_value("lines").alias("lines"))
    key = ["host", "path", "digest"]
    ranged = written(each.repartitionByRange(*key).withColumn("range", F.spark_partition_id()), "ranges")
    row = F.struct("host", "path", "digest", "lines")
    ends = ranged.groupBy("range").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    by_range = Window.orderBy("range")
    ends = ends.select("range", F.lag("last").over(by_range).alias("behind"), F.lead("first").over(by_range).alias("ahead"))
    inside = Window.partitionBy("range").orderBy(*key)
    near = ranged.select("range", *key, "lines", F.lag(row).over(inside).alias("before"), F.lead(row).over(inside).alias("after")).join(ends, "range")
    own = lambda c: F.when(c["host"] == F.col("host"), F.struct(c["path"].alias("path"), c["lines"].alias("lines")))
    return near.select("host", "digest", "path", "lines", own(F.coalesce("before", "behind")).alias("before"), own(F.coalesce("after", "ahead")).alias("after"))


def differences(near: DataFrame) -> DataFrame:
    """(host, digest, shared): the places of the lines that a page shares with its partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, lines, before, after in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                other = max((x for x in (before, after) if x), key=lambda x: agree(path, x["path"]), default=None)
                out.append(shared_places(np.array(lines, np.int64), np.array(other["lines"], np.int64)) if other else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["host", "digest", "shared"])

    return near.select("host", "digest", "path", "lines", "before", "after").mapInArrow(run, "host string, digest binary, shared array<int>")


def main_text(lines: list[tuple[int, str]], shared: set[int]) -> str:
    kinds = {k for k, _ in lines}
    if ARTICLE in kinds:
        sure, unlike = (ARTICLE,), (WEAK,)
    elif kinds & {MAIN, HELD_MAIN}:
        sure, unlike = (HELD_MAIN,), (MAIN, WEAK)
    else:
        sure, unlike = (HELD,), (OPEN, WEAK)
    return "\n".join(t for n, (k, t) in enumerate(lines) if k in sure or k in unlike and n not in shared)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    A null html is empty and gives an empty text. A page that has no other page on its host, or only copies of itself, has nothing deleted by
    differencing. A null url is a host of its own without a name. Rows that repeat a page_id stay; long pages are read whole; extra columns are left out; an
    empty table gives an empty result.
    """
    parsed = written(parse(pages), "lines", compression="zstd")
    shared = differences(neighbours(parsed.select("host", "path", "digest", "lines")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text([*zip(k, t, strict=True)], set(s or ())) for k, t, s in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    # texts are dealt out only where what a partner shares can change them
    decided = parsed.filter(~F.col("open")).withColumn("shared", F.lit(None).cast("array<int>"))
    undecided = parsed.filter("open").join(shared, ["host", "digest"], "left")
    columns = ["page_id", "url", "kinds", "texts", "shared"]
    return decided.select(*columns).unionByName(undecided.select(*columns)).mapInArrow(choose, "page_id long, url string, text string, n_chars long")
