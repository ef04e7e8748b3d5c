"""The corpus pipeline: each stage reads what its predecessor kept, and run() applies all to the documents.

All stages but the last return the columns they get. Rejected documents go, one document of each near-duplicate class
stays, repeated spans are cut from the texts (with the number of characters brought up to date), documents are dropped
or repeated by their mixing rates, and the last stage returns the ids of the texts that are left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacegauge.llm import cascade, debruijn, jaccard, mixing, pieces
from spacegauge.llm.queries import DOMAIN
from spacegauge.llm.tables import ship, staged, table

#: Shares of fit, poor and toxic text that the mixing stage aims at. The quality rules have left hardly any poor text, so
#: its share is to go on falling; asking for more of it would drop fit documents.
TARGETS = (0.97, 0.0, 0.03)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    ship(spark)
    return cascade.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id, and all others."""
    ship(spark)
    return jaccard.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the spans that occur elsewhere too; those that consist of such spans go."""
    ship(spark)
    kept = debruijn.removed(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as its mixing rate asks for."""
    return mixing.resampled(docs, table(spark, sf_dir, "labels"), F.expr(DOMAIN), TARGETS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text."""
    ship(spark)
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("mixing to target weights", mixing_weights),
    ("SentencePiece ids", piece_ids),
]

#: Fitted rates and Viterbi ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
