"""Boxes to black out in images, from recognised words and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import text_or_empty, trimmed
from gristmill.sources.tables import stored

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
OCR = f"struct<text:string,confidence:double,words:array<struct<text:string,bbox:{BOX},confidence:double>>,lines:array<struct<text:string,bbox:{BOX}>>>"
PAD_X, PAD_Y = 4, 2


class Recogniser(Protocol):
    """An OCR engine: one a partition, closed at its end. `read` gives text, confidence, words and lines as in OCR, or raises."""

    def read(self, image: bytes) -> dict: ...

    def close(self) -> None: ...


def is_image(mime: Column, name: Column) -> Column:
    return F.startswith(F.coalesce(mime, F.lit("")), F.lit("image/")) | F.coalesce(name, F.lit("")).rlike(r"(?i)\.(png|jpe?g|webp)\z")


def with_ocr(images: DataFrame, engine: Callable[[], Recogniser]) -> DataFrame:
    """All columns but content, with ocr and ocr_error. A failure is one image's, and closes it later on."""
    kept = images.drop("ocr", "ocr_error")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "content")
    box = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
    word, line = [("text", pa.string()), ("bbox", box), ("confidence", pa.float64())], [("text", pa.string()), ("bbox", box)]
    kind = pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("words", pa.list_(pa.struct(word))), ("lines", pa.list_(pa.struct(line)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = engine()
        try:
            for batch in batches:
                got, errors = [], []
                for image in batch.column("content"):
                    try:
                        got.append(session.read(image.as_py() or b""))
                        errors.append(None)
                    except Exception as e:
                        got.append(None)
                        errors.append(str(e) or type(e).__name__)
                names = [n for n in batch.schema.names if n != "content"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(got, kind), pa.array(errors, pa.string())], [*names, "ocr", "ocr_error"])
        finally:
            session.close()

    return kept.mapInArrow(run, f"{fields}, ocr {OCR}, ocr_error string")


def images_as_files(images: DataFrame) -> DataFrame:
    """Images (file_name, ocr, ocr_error, ...) as rows of extract_files: the text is one chunk; a failed one is unscannable."""
    text = text_or_empty(F.col("ocr")["text"])
    failed = F.col("ocr_error").isNotNull()
    chunk = F.struct(F.lit(0).alias("chunk_index"), text.alias("text"), F.lit("FULL").alias("window_type"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"), F.lit(None).cast("int").alias("anchor_center"))
    return images.withColumns({
        "file_type": F.lower(F.element_at(F.split("file_name", r"\."), -1)), "text": F.when(failed, "").otherwise(text),
        "pages": F.when(failed, F.array()).otherwise(F.array(F.struct(F.lit(1).alias("page"), text.alias("text")))),
        "chunks": F.when(failed | (text == ""), F.array()).otherwise(F.array(chunk)), "unscannable": failed, "reason": F.col("ocr_error"), "is_directory": F.lit(False),
    }).drop("ocr", "ocr_error")


def _low(c: Column) -> Column:
    return F.lower(trimmed(text_or_empty(c)))


def redaction_boxes(matches: Column, words: Column, lines: Column) -> Column:
    """For each match the boxes of words that hold it or are part of it; where no word is, those of lines that hold it. Repeats stay."""
    words, lines = (F.coalesce(x, F.array()) for x in (words, lines))

    def boxes(target: Column) -> Column:
        fits = lambda w: (_low(w["text"]) != "") & w["bbox"]["x0"].isNotNull() & (F.contains(target, _low(w["text"])) | F.contains(_low(w["text"]), target))
        by_word = F.transform(F.filter(words, fits), lambda w: w["bbox"])
        by_line = F.transform(F.filter(lines, lambda x: (_low(x["text"]) != "") & F.contains(_low(x["text"]), target) & x["bbox"]["x0"].isNotNull()), lambda x: x["bbox"])
        return F.when(F.size(by_word) > 0, by_word).otherwise(by_line)

    targets = F.filter(F.transform(matches, lambda m: _low(m["match"])), lambda t: t != "")
    return F.flatten(F.transform(targets, boxes))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(_row, part, whole): which texts of `parts` (_row, part, text) stand in which of `wholes` (_row, whole, text) of the same row.

    Of the wholes all stretches are taken that are as long as some part of the row, and joined with the parts by equality: work grows with the texts and the different
    lengths of parts, not with parts times wholes, and no row's pairs meet in one task. A text counts once, however often it stands there.
    """
    sizes = parts.groupBy("_row").agg(F.collect_set(F.length("text")).alias("sizes"))  # as many as there are lengths of words
    able = wholes.join(sizes, "_row").withColumn("sizes", F.filter("sizes", lambda n: n <= F.length("text")))
    cut = F.array_distinct(F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda k: F.substring("text", k, n)))))
    stretches = able.filter(F.size("sizes") > 0).select("_row", "whole", F.explode(cut).alias("text"))
    return stretches.join(parts, ["_row", "text"]).select("_row", "part", "whole")


def box_rows(images: DataFrame) -> DataFrame:
    """A row for each box of each match, instead of `matches`, `words` and `lines`: all other columns, match (its place), box (the word's or line's place), by_line, bbox.

    The same boxes as `redaction_boxes`: words that hold the match or are part of it, else lines that hold it; found by joins of stretches instead of by
    looking at every word for every match. Rows may repeat; null and empty lists have no boxes. Images without matches are left out before anything is stored or joined.
    """
    others = [c for c in images.columns if c not in ("matches", "words", "lines", "match", "box", "by_line", "bbox")]
    rows = stored(images.filter(F.size("matches") > 0).select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_of"), "matches", "words", "lines"), "boxes")
    targets = rows.select("_row", F.posexplode("matches").alias("match", "m")).select("_row", "match", _low(F.col("m.match")).alias("text")).filter("text <> ''")

    def boxed(column: str) -> DataFrame:
        each = rows.select("_row", F.posexplode(column).alias("box", "b")).select("_row", "box", _low(F.col("b.text")).alias("text"), F.col("b.bbox").alias("bbox"))
        return each.filter((F.col("text") != "") & F.col("bbox.x0").isNotNull())

    words, lines = boxed("words"), boxed("lines")
    as_part, as_whole = (lambda df, name: df.select("_row", F.col(name).alias("part"), "text")), (lambda df, name: df.select("_row", F.col(name).alias("whole"), "text"))
    in_match = contained(as_part(words, "box"), as_whole(targets, "match")).select("_row", F.col("whole").alias("match"), F.col("part").alias("box"))
    in_word = contained(as_part(targets, "match"), as_whole(words, "box")).select("_row", F.col("part").alias("match"), F.col("whole").alias("box"))
    by_word = in_match.unionByName(in_word).distinct()
    left = targets.join(by_word.select("_row", "match").distinct(), ["_row", "match"], "left_anti")
    by_line = contained(as_part(left, "match"), as_whole(lines, "box")).select("_row", F.col("part").alias("match"), F.col("whole").alias("box")).distinct()
    found = by_word.join(words, ["_row", "box"]).select("_row", "match", "box", F.lit(False).alias("by_line"), "bbox")
    found = found.unionByName(by_line.join(lines, ["_row", "box"]).select("_row", "match", "box", F.lit(True).alias("by_line"), "bbox"))
    return found.join(rows.select("_row", "_of"), "_row").select(*(F.col("_of")[c].alias(c) for c in others), "match", "box", "by_line", "bbox")


def rectangles(boxes: Column, width: Column, height: Column) -> Column:
    """Padded and clamped to the image; empty ones go: array<struct<x,y,w,h,labelled,font_size>>."""

    def one(b: Column) -> Column:
        x, y = F.greatest(F.lit(0), F.floor(b["x0"] - PAD_X)), F.greatest(F.lit(0), F.floor(b["y0"] - PAD_Y))
        w, h = F.least(width - x, F.ceil(b["x1"] - b["x0"] + 2 * PAD_X)), F.least(height - y, F.ceil(b["y1"] - b["y0"] + 2 * PAD_Y))
        labelled = (h >= 12) & (w >= 55)
        font = F.when(labelled, F.greatest(F.lit(9), F.least(F.lit(13), F.floor(h * 0.65))))
        return F.struct(*(v.cast("int").alias(n) for n, v in (("x", x), ("y", y), ("w", w), ("h", h))), labelled.alias("labelled"), font.cast("int").alias("font_size"))

    return F.filter(F.transform(boxes, one), lambda r: (r["w"] > 0) & (r["h"] > 0))


def redacted_name(name: Column) -> Column:
    name = F.coalesce(F.nullif(name, F.lit("")), F.lit("image.png"))
    return F.when(F.startswith(name, F.lit("redacted_")), name).otherwise(F.concat(F.lit("redacted_"), name))
