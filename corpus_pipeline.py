"""A training-data pipeline over ``documents``, in stages that are written and read again.

In every stage, rows are judged by their own text: repeated rows meet the same decision, a null ``doc_id`` is no id (such a row
is a copy of nobody's smallest id, and shares its passages with no one), null text is empty, an empty table gives an empty
one, and further columns, whatever their names, go through unchanged up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evisift.llm import bpe, decontamination, jaccard_join, quality_classifier, substring_dedup
from evisift.llm.common import table
from evisift.llm.queries import TOKENIZER
from evisift.session import shared_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that are not toxic.

    Empty and null texts go as low quality. Without any labels the heuristics decide; several labels of a document count as bad if
    one is.
    """
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that similar ones link: the one with the smallest doc_id.

    Texts without words are in no group and stay. Where an id has several texts, each is judged for itself; a row without an id goes
    if its text's shingles are those of a document with one.
    """
    return jaccard_join.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each passage that documents share stays in the first of them only.

    A text that was a repeat from end to end goes; ``n_chars``, where it exists, follows the text. Rows without an id keep theirs.
    """
    return substring_dedup.cut(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. An empty benchmark takes none; items without an id count like others."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and proof that they decode to it: a row for every row, an empty text has no ids."""
    return bpe.encode(docs, TOKENIZER).drop("decoded")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: No SQL: the classifier is trained, and tokenizers are not SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
