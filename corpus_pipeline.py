"""A document corpus made ready for training, stage by stage; each stage is written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcewell.llm import bpe_codec, decontam, language_id, near_copies, secrets
from sourcewell.llm.common import bitmap, learns, maybe_in, shared_dir, stored, table
from sourcewell.llm.queries import tokenizer_path

#: What goes to a Python worker at once, in rows and bytes: a batch is held by the JVM and by the worker, outside of the heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage with BATCHES in its session. They stay set, as Spark reads them when the stage's rows are made."""

    @wraps(stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return wrapped


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, all columns unchanged.

    Null, empty and letterless texts go, as do those of which two languages are nearly as likely (ties among them). Rows
    are decided each, so repeated rows stay or go together; labels of held-out documents are not learned from. Texts of
    any length are read whole; an empty table, or one without labels, gives no rows.
    """
    return language_id.keep_identified(docs, language_id.train(docs.where(learns())))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, all columns unchanged: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays. Null, empty and wordless texts are copies of each other; rows that repeat an id
    and its text stay once; rows without an id stay. Texts of any length are compared whole. Pairs come from the SimHash
    operator's links of prints with up to three differing bits, and an exact check follows; pairs of that similarity that
    such prints miss come from an exact prefix filter.
    """
    return near_copies.drop_copies(docs)


@small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other numbers and names, all columns unchanged.

    Null, empty and wordless texts and items match nothing, so such documents stay, as do rows without an id; repeated
    rows stay or go together. Whole texts are searched; an empty benchmark lets all documents stay.
    """
    found = stored(decontam.leaks(docs, table(spark, sf_dir, "benchmark"), keep_words=False).select("doc_id").distinct())
    bits = bitmap(found)
    few = maybe_in(docs, found, bits).join(found, "doc_id", "left_anti").select(*docs.columns)
    return maybe_in(docs, found, bits, False).unionByName(few)


@small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text, the other columns are unchanged.

    Null texts stay null with their n_chars; overlapping secrets are one mark; repeated rows are worked on each.
    """
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(docs.select("doc_id", "text"))))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document. Null and empty texts have no ids; repeated rows are encoded each."""
    encoded = bpe_codec.encode(docs, tokenizer_path(), memo=bpe_codec.PIPELINE_MEMO_WORDS)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("encode", encode),
]

#: Compression sizes and merges can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table of a data folder."""
    df = table(spark, sf_dir, "documents")
    before = {name: spark.conf.get(name) for name in BATCHES}
    try:
        for name, stage in STAGES:
            path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
            stage(spark, df, sf_dir).write.parquet(path)
            df = spark.read.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return df
