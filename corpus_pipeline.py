"""From documents to token ids in five stages, each over all rows that the one before it kept.

Every stage is written as Parquet in the shared folder and read again as the next one's documents,
so a lost executor costs no more than a part of one stage. Every stage but the last returns the
columns of documents.

A null text is judged and compared as an empty one, and the mix never takes a text without words. A
null doc_id is a document like others, after all that have one. Of rows equal in doc_id and text one
stays; of texts alike, that with the least doc_id. Texts are read whole, however long. Other columns
may have any name and are passed on up to the mix. An empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtline.llm import bagminhash, bpe, mixing, quality, substring
from courtline.llm.common import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id."""
    return bagminhash.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that a document with a smaller doc_id has too."""
    return substring.deduplicated(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and pass over its source, with the words taken."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("mixing", mixed_to_weights),
    ("byte-level BPE", token_ids),
]

#: The classifier, the signatures and the encoder are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
