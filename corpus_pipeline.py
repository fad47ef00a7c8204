"""Corpus pipeline: language ID, near-duplicates, secrets, mixing, tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and is the next one's docs. All but the last return
the columns of documents, and leave out others that they are given. Texts are read whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, lang_id, mixing, near_dup, secrets
from gristmill.llm.shared import written
from gristmill.plans.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Mean entropy of a document's positions, as a share of the largest possible, from which on no language fits it.
DOUBT = 0.98
#: Near copies share so many hundredths of their shingles. With 36 sub-keys and 6 partners of each a pair at 0.8 is missed with probability 4.9e-7 at most.
SIMILAR, SUB_KEYS, RING = 80, 36, 6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or where no position speaks for a language, go; those that mix languages stay; `lang` is the predicted one where none is given.

    Null and empty texts have no letters and go. Rows are independent: rows that repeat an id or are equal all stay, null ids and sources too. Where nothing can be
    learned, as no row has a language, all documents go.
    """
    ship(spark)
    found = lang_id.identify(docs, lang_id.train(docs), keep=True)
    kept = found.filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("doubt") < DOUBT))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; documents are linked from a similarity of 0.8 of their sets of five-word shingles on, whatever their ids.

    The least id stays, of equal ids the first by a hash of the text, null ids come last. Null and empty texts are linked with nothing; of those that
    repeat an id one stays.
    """
    ship(spark)
    return near_dup.one_of_each_text(docs, percent=SIMILAR, m=SUB_KEYS, ring=RING).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay, and n_chars counts anew. Null texts stay null, with 0 characters; repeated rows stay."""
    clean = secrets.redacted(secrets.scan_secrets(docs, parts=True))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as its source's budget takes it; those beyond the budget and those without words (null and empty texts) go.

    A null source is a source of its own. Ties: rows that repeat an id share a key and go by size. Rows without id share a key a size.
    """
    return mixing.repeated(mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text"))))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, in digests, with the digest of what they decode to; a row for each row, null texts as empty ones."""
    ship(spark)
    return bpe.bpe_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: SQL can't express the first stage: the trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
