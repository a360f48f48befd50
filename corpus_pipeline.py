"""A training corpus from documents: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again before the next one. All but the last return the
columns of documents.

In every stage a null text is a document without words: language drops it. Rows
without an id are documents of their own in all stages. Repeated rows are near
copies of each other, of which one id stays. Other columns than those of
documents aren't looked at. An empty table gives an empty one, with the same
columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import langid, packing, pii, simhash, suffixes
from clickloom.llm.common import shared_dir, staged, table
from clickloom.llm.registry import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; null texts and those without a letter go. lang becomes the prediction."""
    found = langid.identify(docs, *langid.trained(docs), keep=("doc_id", "text", "source"))
    return _columns(found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; all rows of that id, and documents without an id, stay."""
    kept = simhash.near_copies_left(docs)
    with_id = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    return with_id.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents with nothing left go."""
    cut = suffixes.cut_repeats(docs, keep=("lang", "source"))
    return _columns(cut.filter("n_removed = 0 or trim(text) <> ''"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what gives it away are replaced."""
    return _columns(pii.find(docs, keep=("lang", "source")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("private_data", private_data),
    ("packing", packed),
]

#: Fingerprints, suffix sorting and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Stages are written to two folders in turn, of which a stage reads one and
    overwrites the other, so that no more than two stages are kept.
    """
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    own = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"{own}-{n % 2}")
    return docs
