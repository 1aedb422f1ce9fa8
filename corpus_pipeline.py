"""From raw documents to token counts: toxicity, quality, near-duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns the documents it keeps, with
the columns of documents; the last returns the encoded documents. Null columns, empty texts, repeated rows and
empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm import bpe, dedup, mixing, quality, toxicity
from docassay.llm.common import materialise, table, whole_row
from docassay.llm.queries import label_weights, learnable_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model of the labelled documents in the whole table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), learnable_labels(table(spark, sf_dir, "labels")))
    row = whole_row(docs).alias("_row")
    return toxicity.score(docs.select(row, F.col("text").alias("text")), model).where("score < 0.5").select("_row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null, empty and short texts fail them; each row is judged by itself, repeated ones alike."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows with one doc_id one stays, rows with a null doc_id all stay."""
    return dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none of those without words; a null source is a source of its own."""
    return mixing.mix_documents(docs, label_weights(table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token counts and digests per document; a null or empty text has no tokens."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_copies), ("source_mix", mix_sources), ("byte_bpe", encode)]

#: A trained model, signatures and BPE are beyond SQL; tests/llm test the operators one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
