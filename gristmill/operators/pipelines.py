"""Whole decisions: prompts, files, batches, images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gristmill.functions import patterns as P
from gristmill.functions.text import is_blank, sha256_or_null, text_or_empty
from gristmill.operators.classify import chunk_results, single
from gristmill.operators.ocr import redaction_boxes
from gristmill.operators.policy import REASONS, explanation, policy, unredacted
from gristmill.operators.risk import Settings, no_answer, no_chunks, risk
from gristmill.operators.scan import MATCHES, once, with_matches
from gristmill.sources.store import looked_up


def categories(matches: Column, answer: Column | None = None) -> Column:
    """Different categories, the first seen first; a sensitive answer's is the last."""
    found = F.transform(matches, lambda m: m["category"])
    if answer is not None:
        found = F.concat(found, F.array(F.when(F.coalesce(answer["sensitive"], F.lit(False)), answer["category"])))
    return F.array_distinct(F.filter(found, lambda c: c.isNotNull() & (c != "")))


def decided(df: DataFrame, settings: Settings, *, text: Column | None, role: Column, domain: Column, answer: Column | None = None, chunks: Column | None = None, unscannable: Column | None = None, file_name: Column | None = None, why: Column | None = None) -> DataFrame:
    """All columns (matches among them) with risk, policy and what follows from them."""
    df = once(df, "risk", risk(F.col("matches"), role, domain, answer, chunks, unscannable, settings))
    df = once(df, "_p", policy(F.col("matches"), F.col("risk"), text, answer, chunks, unscannable, file_name, why, settings))
    df = df.select(*[c for c in df.columns if c != "_p"], "_p.action", "_p.risk_score", "_p.reasons", "_p.fixed_floor_triggered", "_p.redacted_text")
    return df.withColumn("explanation", explanation(F.col("action"), F.col("risk_score"), F.col("reasons"), F.col("fixed_floor_triggered"), file_name))


def analyze_prompts(df: DataFrame, settings: Settings = Settings(), repair: str = "full") -> DataFrame:
    """Prompts (prompt_text, destination_domain, user_role; reply and delay_ms where a classifier was asked) -> decisions.

    A null text is empty. The classifier's answer counts even where the floor holds. Prompts with a `failure` are decided as `on_error` says: open.
    """
    has = set(df.columns)
    role = F.col("user_role") if "user_role" in has else F.lit(settings.user_role)
    domain = F.col("destination_domain") if "destination_domain" in has else F.lit("unknown")
    text = text_or_empty(F.col("prompt_text"))
    df = with_matches(df, "prompt_text", repair, settings.enable_regex)
    asked = settings.enable_llm and {"reply", "delay_ms"} <= has
    df = once(df, "answer", single(text, F.col("reply"), F.col("delay_ms"), F.col("classifier_away") if "classifier_away" in has else None)) if asked else df.withColumn("answer", no_answer())
    out = decided(df, settings, text=text, role=role, domain=domain, answer=F.col("answer"))
    if "failure" in has:
        out = on_error(out, closed=False)
    return out.withColumns({"categories": categories(F.col("matches"), F.col("answer")), "unredacted_matches": unredacted(text, F.col("matches"))})


def analyze_files(files: DataFrame, settings: Settings = Settings(), domain: str = "unknown", cache: DataFrame | None = None, repair: str = "full") -> DataFrame:
    """Extracted files (extract_files' columns, and replies where a classifier was asked) -> decisions.

    Directories are allowed. Texts met before get the cached decision, whoever sends them; they aren't scanned. Rows whose `may_look_up` (where there is one) is false are decided anew. A file with a hit that decides alone
    is not given to the classifier. Results carry `cached` and `audited`: cache hits and directories write no audit row. Files with a `failure` are decided as `on_error` says of batches.
    """
    has = set(files.columns)
    files = files.withColumn("hash", F.when(~F.col("unscannable") & ~F.col("is_directory"), sha256_or_null(F.col("text"))))
    kept = [c for c in files.columns if c not in ("chunks", "pages", "replies", "classifier_away", "entry", "may_look_up")]
    if cache is not None:
        files = looked_up(files, cache)
        if "may_look_up" in has:
            files = files.withColumn("entry", F.when(F.col("may_look_up"), F.col("entry")))
    known = F.col("entry").isNotNull() if cache is not None else F.lit(False)
    role, where, name = F.lit(settings.user_role), F.lit(domain), text_or_empty(F.col("file_name"))
    plain = F.col("is_directory")
    open_text = F.when(F.col("unscannable") | plain | known, "").otherwise(F.col("text"))
    df = with_matches(files.withColumn("_text", open_text), "_text", repair, settings.enable_regex).drop("_text")
    alone = F.exists("matches", lambda m: m["category"].isin(*P.SKIP_CLASSIFIER_FILE))
    replies = F.col("replies") if settings.enable_llm and "replies" in has else None
    away = F.col("classifier_away") if "classifier_away" in has else None
    chunks = F.when(alone | F.col("unscannable") | plain | known, no_chunks()).otherwise(chunk_results(F.col("chunks"), replies, away=away) if settings.enable_llm else no_chunks())
    df = once(df, "chunk_results", chunks)
    out = decided(df, settings, text=None, role=role, domain=where, chunks=F.col("chunk_results"), unscannable=F.col("unscannable") & ~plain, file_name=name, why=F.col("reason"))
    out = out.withColumns({
        "action": F.when(plain, "allow").otherwise(F.col("action")),
        "risk_score": F.when(plain, 0).otherwise(F.col("risk_score")),
        "explanation": F.when(plain, F.concat(F.lit("Directory '"), name, F.lit("' was skipped."))).otherwise(F.col("explanation")),
        "cached": known,
        "audited": ~plain & ~known,
    })
    if cache is not None:
        e = F.col("entry")
        old = {"action": e["decision"], "risk_score": e["risk_score"], "explanation": F.concat(F.lit("[CACHED RESULT] "), e["explanation"]), "reasons": e["reasons"], "fixed_floor_triggered": e["fixed_floor_triggered"]}
        out = out.withColumns({c: F.when(known, v).otherwise(F.col(c)) for c, v in old.items()})
    if "failure" in has:
        out = on_error(out, closed=False)
    return out.select(*kept, "action", "risk_score", "explanation", "reasons", "fixed_floor_triggered", "matches", "chunk_results", "cached", "audited")


#: Files of a batch that are put together first, by place.
PIECE = 1000


def rollup(decisions: DataFrame, batch: str = "batch_id", position: str = "pos") -> DataFrame:
    """A row for each batch of file decisions: blocked if any file is, with the first blocked file's words; else redacted if any is; else allowed.

    Files are put together in pieces of PIECE places. A piece with a blocked file keeps no words but that file's, and pieces of blocked batches lose theirs as they stream by, before
    a batch's words are joined; what is gathered of the others is their explanation itself. Reasons are put together without taking repeats out.
    """
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "redact", 1).otherwise(0)
    first = F.struct(position, "file_name")
    row = F.struct("explanation", "reasons")
    real = decisions.filter(~F.col("is_directory")) if "is_directory" in decisions.columns else decisions
    batches = decisions.select(batch).distinct() if "is_directory" in decisions.columns else None
    said = F.struct(F.col(position).alias("p"), F.col("file_name").alias("f"), F.concat("file_name", F.lit(": "), "explanation").alias("said"), F.col("reasons").alias("reasons"))
    piece = F.floor(F.coalesce(F.col(position).cast("long"), F.lit(0)) / PIECE)
    pieces = real.groupBy(batch, piece.alias("_piece")).agg(
        F.max(rank).alias("_worst"),
        F.max("risk_score").alias("risk_score"),
        F.min(F.when(F.col("action") == "block", first)).alias("_place"),
        F.min_by(row, F.when(F.col("action") == "block", first)).alias("_first"),
        F.array_sort(F.collect_list(F.when(F.col("action") != "block", said))).alias("_said"),
        F.count("*").alias("n_files"),
    )
    pieces = pieces.withColumn("_said", F.when(F.col("_worst") < 2, F.struct("_piece", F.array_join(F.transform("_said", lambda x: x["said"]), " | ").alias("said"), F.flatten(F.transform("_said", lambda x: x["reasons"])).alias("reasons"))))
    # pieces of a batch lie together from here on; a window over them, unlike a join, doesn't decide the files twice
    known = pieces.withColumn("_all", F.max("_worst").over(Window.partitionBy(batch))).withColumn("_said", F.when(F.col("_all") < 2, F.col("_said")))
    out = known.groupBy(batch).agg(
        F.max("_worst").alias("_worst"), F.max("risk_score").alias("risk_score"), F.min_by("_first", "_place").alias("_first"),
        F.array_sort(F.collect_list("_said")).alias("_said"), F.sum("n_files").alias("n_files"),
    )
    if batches is not None:  # batches of directories alone have a row too
        every = batches.withColumnRenamed(batch, "_batch")
        out = every.join(out, every["_batch"].eqNullSafe(out[batch]), "left").drop(batch).withColumnRenamed("_batch", batch)
        out = out.withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "risk_score": F.coalesce("risk_score", F.lit(0)), "_said": F.coalesce("_said", F.array())})
    action = F.when(F.col("_worst") == 2, "block").when(F.col("_worst") == 1, "redact").otherwise("allow")
    joined = F.when(F.col("n_files") == 0, "No files to scan.").otherwise(F.array_join(F.transform("_said", lambda x: x["said"]), " | "))
    return out.select(
        batch, action.alias("action"), "risk_score",
        F.when(F.col("_worst") == 2, F.col("_first.explanation")).otherwise(joined).alias("explanation"),
        F.when(F.col("_worst") == 2, F.col("_first.reasons")).otherwise(F.flatten(F.transform("_said", lambda x: x["reasons"]))).alias("reasons"), "n_files",
    )


def analyze_images(images: DataFrame, settings: Settings = Settings(), domain: str = "unknown") -> DataFrame:
    """Images (file_name, ocr as operators.ocr.OCR, ocr_error; reply and delay_ms where asked) -> decisions and boxes.

    A failed recognition or a `failure` closes the image; one without text is allowed. Matches are looked for in the repaired text, redaction works on the
    recognised one. The classifier sees the first 1500 characters, unless a hit decides alone.
    """
    from gristmill.functions.text import repair_full

    has = set(images.columns)
    broken = [F.col(c) for c in ("ocr_error", "failure") if c in has]
    failed = F.coalesce(*broken).isNotNull() if broken else F.lit(False)
    text = text_or_empty(F.col("ocr")["text"])
    visual = ~failed & is_blank(text)
    df = with_matches(images.withColumn("_clean", repair_full(text)), "_clean", "full", settings.enable_regex).drop("_clean")
    alone = F.exists("matches", lambda m: m["category"].isin(*P.SKIP_CLASSIFIER_IMAGE))
    asked = settings.enable_llm and {"reply", "delay_ms"} <= has
    answer = F.when(~alone, single(F.substring(text, 1, 1500), F.col("reply"), F.col("delay_ms"))) if asked else no_answer()
    df = once(df, "answer", answer)
    name = text_or_empty(F.col("file_name"))
    why = F.coalesce(*broken) if broken else F.lit("")
    out = decided(df, settings, text=text, role=F.lit(settings.user_role), domain=F.lit(domain), answer=F.col("answer"), unscannable=failed, file_name=name, why=why)
    return out.withColumns({
        "action": F.when(visual, "allow").otherwise(F.col("action")),
        "risk_score": F.when(visual, 0).otherwise(F.col("risk_score")),
        "explanation": F.when(visual, F.concat(F.lit("Visual image '"), name, F.lit("' contains no text."))).otherwise(F.col("explanation")),
        "boxes": redaction_boxes(F.col("matches"), F.col("ocr")["words"], F.col("ocr")["lines"]),
        "source_type": F.when(failed, "file_attachment").otherwise("image_ocr"),
        "audited": ~visual,
    })


def attempted(df: DataFrame, stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """All columns of `df` with those that `stage` gives for each row (schema), and `failure`: why a row has none, null if it has.

    `stage` gets batches and gives batches of as many rows. Where it raises, the batch is done again row by row, so that only the rows that break are without; the job goes on.
    """
    given = to_arrow_schema(StructType.fromDDL(schema))
    names = given.names
    df = df.drop(*names, "failure")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(batch: pa.RecordBatch, got: list[pa.Array], why: list[str | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, *got, pa.array(why, pa.string())], [*batch.schema.names, *names, "failure"])

        def tried(batch: pa.RecordBatch) -> pa.RecordBatch:
            (got,) = stage(iter([batch]))
            return done(batch, [got.column(f.name).cast(f.type) for f in given], [None] * batch.num_rows)

        for batch in batches:
            try:
                yield tried(batch)
            except Exception:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    try:
                        yield tried(one)
                    except Exception as e:
                        yield done(one, [pa.nulls(1, f.type) for f in given], [str(e) or type(e).__name__])

    return df.mapInArrow(run, f"{fields}, {schema}, failure string")


def on_error(df: DataFrame, closed: bool) -> DataFrame:
    """Rows with a `failure` are decided without a scan: closed (block) for single images, open (allow) for prompts and batches. Others stay as they are."""
    failed = F.col("failure").isNotNull()
    said = F.concat(F.lit(f"Scan failed, {'blocked' if closed else 'allowed'}: "), F.col("failure"))
    new = {"action": F.lit("block" if closed else "allow"), "risk_score": F.lit(95 if closed else 0), "fixed_floor_triggered": F.lit(closed), "explanation": said, "reasons": F.array().cast(REASONS), "matches": F.array().cast(MATCHES)}
    return df.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in new.items() if c in df.columns})
