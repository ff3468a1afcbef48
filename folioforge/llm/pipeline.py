"""A corpus pipeline of five stages over the documents table.

Each stage works on all that the stage before it kept. Between stages the documents are
written as Parquet and read again, so that a lost executor costs part of one stage.

All stages take null texts as empty ones, keep other columns whatever their names, and give an
empty table for an empty one; rows that repeat and null ids are treated as each stage's
operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from folioforge.llm.common import new_table, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier of operator 6 rejects; it learns from labels that aren't held out.

    Rows that repeat stay or go together; null ids are scored like others but not learnt from;
    without labels of both kinds all documents have the share of toxic labels as their score.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share are gone; the text is what stays, and n_chars, where docs has it, its length.

    No row goes. Rows of one id count as one document, and so do all rows with a null id.
    """
    out = line_dedup.drop_shared_lines(docs, least_docs=10, least_chars=1)
    return out.select(*(F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else c for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: five words a shingle, similarity 0.8.

    Empty texts are one group, and rows that repeat are one row. Rows with a null id stay only where their group has no id.
    """
    return near_copies.drop_near_copies(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item. Rows that share an id, null ids among them, stay or go together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded bytes: a row for each row of docs, null ids among them."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can't train the classifier, nor compute the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
