"""Documents from raw to mixed: five stages, each a step of barloom.llm, written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, langid, mixing, neardup, toxicity
from barloom.llm.common import beside, filtered, scratch_dir, table

MIN_LANGUAGE_SCORE = 0.5
TARGETS = {"source": 0.5, "lang": 0.5, "topic": 0.8}
KEEP = 0.8
BATCH_ROWS = 1000
"""Texts go to Python in batches of so many: executor and worker hold a batch each, and Spark's 10000 make hundreds of MB of long texts."""


# Cases that all stages treat alike: an empty table gives an empty one, a null text counts as an empty one, texts are taken whole however long,
# and columns of any other names pass through, whatever they are called. The docstrings say the rest.


def in_small_batches(spark: SparkSession) -> None:
    """The session's setting, as a stage is run when its table is written. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, empty, without a letter), or with a posterior below MIN_LANGUAGE_SCORE.

    The model is learned from rows whose lang isn't null; where there are none, all rows go. Repeated rows stay or go together.
    """
    in_small_batches(spark)
    return filtered(docs, lambda df, at: langid.language_of(df, docs, at("text")), ~langid.rejected(F.col("lang_pred"), F.col("score"), MIN_LANGUAGE_SCORE))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts scored as toxic; a text without words has the lowest score and stays. Without toxic labels all rows stay. Repeated rows stay or go together."""
    in_small_batches(spark)
    model = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))
    return filtered(docs, lambda df, at: toxicity.score(df, model, at("text")), "predicted = 0")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the least doc_id; one of repeated rows, and of copies without a doc_id. Texts without words all stay."""
    in_small_batches(spark)
    return neardup.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; texts without words stay. Repeated rows stay or go together, and an empty benchmark drops none."""
    in_small_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with target weights of sources, languages and topics; adds topic, n_tokens and probability (columns of these names, in any case, give way).

    Texts without words have no tokens and go where their cell has none. A null source or language is a value of its own. Rows with one doc_id,
    null among them, stay or go together within a cell.
    """

    def counted(df: DataFrame, at: Callable[[str], str]) -> DataFrame:
        return df.withColumns({"topic": mixing.topic_of(F.col(at("text"))), "n_tokens": mixing.word_count(F.col(at("text")))})

    return mixing.mix(beside(docs, ["topic", "n_tokens"], counted), TARGETS, tokens="n_tokens", keep=KEEP, detail=True, fit_full=True).withColumn("probability", F.round("probability", 6))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("toxicity", clean), ("near_dedup", unique), ("decontamination", unseen), ("mixing", mixed),
]

ORACLE_SQL: str | None = None
"""Two stages are trained models, which SQL can't express; the tests hold the pipeline against its operators and brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = scratch_dir(spark)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
