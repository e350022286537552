"""A training corpus from documents: stages that each take the last one's rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanwood.llm import lines, minhash, packing, secrets, toxicity
from spanwood.llm.common import materialise, table
from spanwood.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go.

    Null texts stay; repeated rows are judged alike; without labels of both classes, or in an empty table, nothing goes.
    """
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template a document of smaller id has go, and so do documents that this leaves without any.

    Documents that were blank before stay, null texts stay null; repeated rows are treated alike.
    """
    return lines.dedup_lines(docs, emptied=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard index 0.8 or more.

    Texts without words stay; of repeated rows (one id and text) one stays; an empty table stays empty.
    """
    ship(spark)
    return minhash.keep_one(docs, threshold=(80, 100))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays, repeated rows alike; null and empty texts stay as they are."""
    ship(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequence and place; null and empty texts have one piece of one token."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("minhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer. tests/llm checks each stage's decisions on its own input:
#: line dedup against its SQL, near copies against all pairs, secrets against a recipe, pieces against the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
