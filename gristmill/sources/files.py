"""Text of files: routing by name and type on columns; PDF and ZIP containers in Arrow batches, only for the rows that need them."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.text import extension, normalize_text, text_or_empty, trimmed
from gristmill.operators.policy import filled
from gristmill.operators.scan import once
from gristmill.operators.windows import windows

#: Fixed values.
UNSCANNABLE = (
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "zip", "tar", "gz", "7z", "rar", "bz2", "exe", "bin", "dll", "so", "dylib", "iso", "mp3", "mp4",
    "wav", "ogg", "mov", "avi", "woff", "woff2", "ttf", "eot",
)
TEXTUAL = (
    "txt", "text", "env", "csv", "tsv", "json", "json5", "jsonc", "ipynb", "md", "markdown", "log", "out", "xml", "js", "mjs", "cjs", "jsx", "ts",
    "mts", "cts", "tsx", "html", "htm", "xhtml", "svg", "css", "scss", "sass", "less", "py", "pyw", "yaml", "yml", "toml", "ini", "conf", "cfg",
    "config", "properties", "sh", "bash", "zsh", "fish", "bat", "cmd", "ps1", "psm1", "c", "h", "cpp", "hpp", "cc", "cxx", "cs", "java", "kt", "kts",
    "scala", "go", "rs", "swift", "rb", "php", "lua", "r", "dart", "pl", "pm", "sql", "prisma", "graphql", "gql", "proto", "dockerfile", "makefile",
    "cmake", "vagrantfile", "gemfile", "pipfile", "lock", "pem", "key", "cer", "crt", "pub",
)
SAMPLE = 2048
NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:variant,outputs:array<struct<text:variant,data:map<string,variant>>>>>>"


#: Files whose names may be sent to every executor.
FEW_NAMES = 500_000


def read_files(spark: SparkSession, path: str, few: int = FEW_NAMES) -> DataFrame:
    """(file_name, mime, file_size, content, batch_id, pos) of all files below a folder; the batch is the folder a file lies in, pos its place there by path.

    Places follow from a listing that reads no contents. Names are counted; few are sent to where the contents are read, of more contents are dealt by path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    names = raw.select("path").withColumn("pos", F.row_number().over(Window.partitionBy(folder).orderBy("path")) - 1)
    names = F.broadcast(names) if raw.select("path").count() <= few else names
    return raw.join(names, "path").select(F.element_at(parts, -1).alias("file_name"), F.lit("").alias("mime"), F.col("length").alias("file_size"), "content", F.element_at(parts, -2).alias("batch_id"), "pos")


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters for what isn't, without a mark at its start."""
    return F.regexp_replace(F.make_valid_utf8(F.coalesce(content, F.lit(b"")).cast("string")), r"\A\x{FEFF}", "")


def looks_textual(content: Column) -> Column:
    """Whether the first bytes hold no NUL and are UTF-8."""
    head = F.substring(F.coalesce(content, F.lit(b"")), 1, SAMPLE).cast("string")
    return F.is_valid_utf8(head) & (F.instr(head, "\0") == 0)


def route(df: DataFrame) -> DataFrame:
    """All columns with file_type (the extension) and route: directory, unscannable, notebook, text, pdf, docx, xlsx, pptx, unknown."""
    name, mime, ext = text_or_empty(F.col("file_name")), F.lower(text_or_empty(F.col("mime"))), extension(F.col("file_name"))
    size = F.coalesce(F.col("file_size"), F.lit(0))
    has = lambda s: F.contains(mime, F.lit(s))
    starts = lambda s: F.startswith(mime, F.lit(s))
    directory = (~F.contains(name, F.lit(".")) & (size == 0)) | (F.lower(name) == "downloads")
    closed = ext.isin(*UNSCANNABLE) | starts("image/") | starts("audio/") | starts("video/")
    env = F.startswith(name, F.lit(".env")) | F.startswith(ext, F.lit("env")) | F.endswith(name, F.lit(".env"))
    known = env | ext.isin(*TEXTUAL) | F.endswith(name, F.lit(".ipynb"))
    typed = starts("text/") | has("json") | has("javascript") | (mime == "application/xml") | F.endswith(mime, F.lit("/xml"))
    notebook = (ext == "ipynb") | F.endswith(name, F.lit(".ipynb"))
    kind = (
        F.when(directory, "directory").when(closed, "unscannable").when(notebook, "notebook").when(known | typed | looks_textual(F.col("content")), "text")
        .when((ext == "pdf") | has("pdf"), "pdf").when((ext == "docx") | has("wordprocessingml"), "docx")
        .when(ext.isin("xlsx", "xls") | has("spreadsheetml"), "xlsx").when(ext.isin("pptx", "ppt") | has("presentationml"), "pptx").otherwise("unknown")
    )
    return once(df.withColumn("file_type", ext), "route", kind)


def _joined(v: Column) -> Column:
    """A string, or an array of strings put together."""
    return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"), F.lit(""))


def notebook_text(raw: Column) -> Column:
    """Cells and their outputs, marked, with an empty line between; the raw text if it is no notebook."""
    cells = F.from_json(F.when(F.try_parse_json(raw).isNotNull(), raw), NOTEBOOK)["cells"]
    full = lambda s: s.rlike(f"[^{P.WS}]")

    def output(o: Column) -> Column:
        said = F.coalesce(F.nullif(_joined(o["text"]), F.lit("")), _joined(F.try_element_at(o["data"], F.lit("text/plain"))))
        return F.when(full(said), F.concat(F.lit("[CELL_OUTPUT]\n"), said))

    def cell(c: Column) -> Column:
        source = _joined(c["source"])
        head = F.when(full(source), F.concat(F.lit("[NOTEBOOK_"), F.upper(F.coalesce(F.nullif(c["cell_type"], F.lit("")), F.lit("code"))), F.lit("_CELL]\n"), source))
        return F.concat(F.array(head), F.transform(F.coalesce(c["outputs"], F.array()), output))

    parts = F.filter(F.flatten(F.transform(cells, cell)), lambda p: p.isNotNull())
    return F.when(cells.isNotNull(), F.array_join(parts, "\n\n")).otherwise(raw)


_BLANKS, _CONTROL = re.compile(f"[{P.BLANKS}]+"), re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def printable(s: str) -> str:
    """White space in single spaces; nothing if less than 70 % is printable ASCII."""
    # without control characters, what Python splits at are the blanks but one; of what is left all ASCII is printable
    s = " ".join(_CONTROL.sub(" ", s).replace("\ufeff", " ").split())
    return s if s.isascii() or len(s.encode("ascii", "ignore")) / len(s) >= 0.70 else ""


#: Bytes that are inflated at once.
PIECE = 1 << 20


def _inflating(data: bytes, bits: int) -> Iterator[bytes]:
    stream, rest = zlib.decompressobj(bits), data
    while rest and not stream.eof:
        if out := stream.decompress(rest, PIECE):
            yield out
        rest = stream.unconsumed_tail
    if not stream.eof and (out := stream.flush()):
        yield out


def inflated(data: bytes, raw: bool = False) -> Iterator[bytes] | None:
    """What a zlib or bare deflate stream holds, piece by piece, however much it is; None if it is neither. It is read through once before anything is given."""
    for bits in (-15, 15) if raw else (15, -15):
        try:
            for _ in _inflating(data, bits):
                pass
        except zlib.error:
            continue
        return _inflating(data, bits)
    return None


def decoded_pieces(pieces: Iterator[bytes]) -> Iterator[str]:
    """UTF-8 with replacement characters; a character may lie in two pieces."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        if text := machine.decode(piece):
            yield text
    if text := machine.decode(b"", True):
        yield text


def between(pieces: Iterable[str], opening: re.Pattern, closing: str, kept: int) -> Iterator[tuple[str, str]]:
    """(opening, what follows it up to the first `closing`) of each part of a text that comes in pieces.

    Held is the part that is open, or what may be the beginning of an opening: the last `kept` characters, or with 0 what stands behind the last >.
    """
    held, opened, at, done = "", None, 0, 0
    for piece in pieces:
        held += piece
        while True:
            if opened is None:
                opened = opening.search(held, at)
                if opened is None:
                    start = held.find("<", max(done, held.rfind(">", done) + 1)) if kept == 0 else max(done, len(held) - kept)
                    held, at, done = held[start:] if start >= 0 else "", 0, 0
                    break
                at = opened.end()
            stop = held.find(closing, at)
            if stop < 0:
                held, done = held[opened.start() :], 0
                at = max(len(opened[0]), len(held) - len(closing) + 1)
                opened = opening.match(held)
                break
            yield opened[0], held[opened.end() : stop]
            at = done = stop + len(closing)  # what is read is cut off with the piece, not with each part
            opened = None


_LITERAL, _HEX = re.compile(r"\((?:[^()\\]++|\\[^\n\r])*+\)"), re.compile(r"<[0-9a-fA-F]+>")
_ESCAPES = (("\\(", "("), ("\\)", ")"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"))


_BEGIN = re.compile("BT")


def pdf_operators(pieces: Iterable[str]) -> str:
    """Texts between BT and ET: literals first, then hexadecimal strings of even length."""
    found = []
    for _, block in between(pieces, _BEGIN, "ET", 1):
        for literal in _LITERAL.findall(block):
            text = literal[1:-1]
            for escaped, plain in _ESCAPES:
                text = text.replace(escaped, plain)
            found.append(printable(text))
        found += [printable(bytes.fromhex(h[1:-1]).decode("latin-1")) for h in _HEX.findall(block) if len(h) % 2 == 0]
    return printable(" ".join(filter(None, found)))


def pdf_pages(data: bytes) -> list[tuple[int, str]]:
    """(page, text): from compressed streams; else from page objects; else from the whole file. A stream counts only behind a space."""
    raw = data.decode("latin-1")
    pages = []
    for m in re.finditer(r"(?s) stream[\r\n]+(.*?)[\r\n]+endstream", raw):
        body = inflated(data[m.start(1) : m.end(1)])
        if body and (text := pdf_operators(decoded_pieces(body))):
            pages.append((len(pages) + 1, text))
    if not pages:
        parts = re.split(r"(?i)/Type\s*/Page\b", raw)[1:]
        pages = [(k, t) for k, p in enumerate(parts, 1) if (t := pdf_operators([p]))]
    if not pages and (text := pdf_operators([raw])):
        pages = [(1, text)]
    return pages


def zip_entries(data: bytes, wanted: tuple[str, ...]) -> Iterator[Callable[[], Iterator[str]]]:
    """The entries whose names hold one of `wanted`, by local headers: archives need no directory. Each can be read any number of times, piece by piece."""
    at = data.find(b"PK\x03\x04")
    while 0 <= at < len(data) - 30:
        field = lambda k, n: int.from_bytes(data[at + k : at + k + n], "little")  # noqa: B023, E731
        method, size, name_size, extra = field(8, 2), field(18, 4), field(26, 2), field(28, 2)
        name, start = data[at + 30 : at + 30 + name_size].decode("utf-8", "replace"), at + 30 + name_size + extra
        if any(w in name for w in wanted):
            end = start + size
            if size == 0 or end > len(data):
                end = data.find(b"PK", start + 1)
                end = end if 0 <= end < len(data) - 4 else len(data)
            part = data[start:end]
            read = (lambda part=part: iter([part])) if method == 0 else (lambda part=part: inflated(part, raw=True))
            if method in (0, 8) and (some := read()) is not None and next(some, b""):
                yield lambda read=read: decoded_pieces(read())
        at = data.find(b"PK\x03\x04", max(start + size, at + 4))


#: Fixed values, in the order in which they are replaced.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"))


def _plain(s: str) -> str:
    for entity, sign in ENTITIES:
        s = s.replace(entity, sign)
    return s


def xml_texts(xml: Iterable[str], tag: str) -> Iterator[str]:
    return (t for _, x in between(xml, re.compile(f"<{tag}[^>]*>"), f"</{tag}>", 0) if (t := _plain(x).strip(P.BLANKS)))


def xml_nodes(df: DataFrame, column: str, tag: str) -> DataFrame:
    """All columns with `nodes`: the texts of the elements called `tag`, without entities and blanks at their ends; empty ones go."""
    found = F.regexp_extract_all(text_or_empty(F.col(column)), F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))

    def plain(x: Column) -> Column:
        for entity, sign in ENTITIES:
            x = F.replace(x, F.lit(entity), F.lit(sign))
        return trimmed(x)

    return df.withColumn("nodes", F.filter(F.transform(found, plain), lambda x: x != ""))


def sheet_texts(read: Callable[[], Iterable[str]]) -> list[str]:
    """Shared strings, then values that aren't among them."""
    found = [*xml_texts(read(), "t")]
    known = set(found)
    for v in (x.strip(P.BLANKS) for _, x in between(read(), re.compile("<v[^>]*>"), "</v>", 0)):
        if v and v not in known:
            known.add(v)
            found.append(v)
    return found


#: Entries that hold text, the element around it, what goes between.
OFFICE = {
    "docx": (("word/document.xml", "word/header", "word/footer"), lambda read: xml_texts(read(), "w:t"), " "),
    "xlsx": (("xl/sharedStrings.xml", "xl/worksheets/", "xl/workbook.xml"), sheet_texts, " | "),
    "pptx": (("ppt/slides/", "ppt/notesSlides/", "ppt/presentation.xml"), lambda read: xml_texts(read(), "a:t"), " "),
}


def container_text(kind: str, data: bytes | None) -> tuple[str, list[tuple[int, str]], str | None]:
    """(text, pages, reason) of a container; a reason is there only if it has no text."""
    if kind == "pdf":
        pages = pdf_pages(data) if data else []
        text = printable("\n\n".join(t for _, t in pages))
        why = P.EMPTY_PDF if data else P.EMPTY_FILE.format("PDF")
        return text, pages if text else [], None if text else why
    wanted, texts, sign = OFFICE[kind]
    found = [t for read in zip_entries(data or b"", wanted) for t in texts(read)] or [*texts(lambda: [(data or b"").decode("latin-1")])]
    text = _BLANKS.sub(" ", sign.join(dict.fromkeys(found) if kind == "xlsx" else found)).strip(P.BLANKS)
    return text, [(1, text)], None if text else P.EMPTY_FILE.format(kind.upper())


#: Bytes of contents and texts after which rows are given on.
HELD = 4 << 20


def in_pieces(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch, int], tuple], size: Callable[[tuple], int], done: Callable[[pa.RecordBatch, list[tuple]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`done` of as many rows at once as come to HELD by `size`: what `make` gives is never held of a whole batch."""
    for batch in batches:
        begin, held, got = 0, 0, []
        for k in range(batch.num_rows):
            got.append(make(batch, k))
            held += size(got[-1])
            if held >= HELD or k == batch.num_rows - 1:
                yield done(batch.slice(begin, len(got)), got)
                begin, held, got = k + 1, 0, []


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))

    def read(batch: pa.RecordBatch, k: int) -> tuple:
        data = batch.column("content")[k].as_py()
        try:
            return (*container_text(batch.column("route")[k].as_py(), data), len(data or b""))
        except Exception as e:  # any broken file is closed, never fatal
            return "", [], P.BROKEN_FILE.format(e), len(data or b"")

    def done(batch: pa.RecordBatch, got: list[tuple]) -> pa.RecordBatch:
        pages = [[{"page": k, "text": t} for k, t in x[1]] for x in got]
        kept = batch.drop_columns(["content"])
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[0] for x in got], pa.string()), pa.array(pages, page), pa.array([x[2] for x in got], pa.string())], [*kept.schema.names, "raw_text", "pages", "reason"])

    return in_pieces(batches, read, lambda x: x[3] + 2 * len(x[0]), done)


PAGES = "array<struct<page:int,text:string>>"


def extract_files(files: DataFrame) -> DataFrame:
    """All columns but content, with file_type, text (normalised), pages, chunks (windows), unscannable, reason, is_directory.

    What can't be read is unscannable, with a reason. Null contents are empty.
    """
    routed = route(files)
    boxed = F.col("route").isin("pdf", *OFFICE)
    raw = decoded(F.col("content"))
    text = F.when(F.col("route") == "notebook", notebook_text(raw)).when(F.col("route") == "text", raw).otherwise("")
    why = F.when(F.col("route") == "unscannable", filled(P.CLOSED_FORMAT, F.col("file_type"))).when(F.col("route") == "unknown", filled(P.UNKNOWN_FORMAT, F.col("file_type")))
    plain = routed.filter(~boxed).withColumn("raw_text", text).drop("content")
    plain = plain.withColumns({"pages": F.when(F.col("route").isin("text", "notebook"), F.array(F.struct(F.lit(1).alias("page"), F.col("raw_text").alias("text")))).otherwise(F.array()).cast(PAGES), "reason": why})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in routed.schema if f.name != "content")
    inside = routed.filter(boxed).mapInArrow(_containers, f"{fields}, raw_text string, pages {PAGES}, reason string")
    both = once(plain.unionByName(inside), "text", normalize_text(F.col("raw_text")))
    readable = F.col("route").isin("text", "notebook", "directory")
    closed = (F.col("reason").isNotNull()) | (~readable & (trimmed(F.col("text")) == ""))
    both = both.withColumns({"unscannable": closed, "is_directory": F.col("route") == "directory", "chunks": windows(F.col("text"))})
    both = both.withColumn("file_type", F.when(F.col("is_directory"), "directory").when((F.col("route") == "unscannable") & (F.col("file_type") == ""), "unscannable").otherwise(F.col("file_type")))
    both = both.withColumn("reason", F.coalesce("reason", F.when(closed, P.EMPTY_BINARY)))
    return both.drop("raw_text", "route")
