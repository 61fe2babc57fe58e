"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bagminhash, bond, bpe, merkle, mixing, mpegts, quality, simhash, substring, token_counts, topk, toxicity, warc
from .common import table
from .sql import SQL


def op1_mixing(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op3_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mpegts(spark, sf_dir):
    return mpegts.media_digests(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring(spark, sf_dir):
    return substring.removed_digests(table(spark, sf_dir, "documents"))


def op9_bagminhash(spark, sf_dir):
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_merkle(spark, sf_dir):
    cut = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=cut, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


QUERIES = {"op1_mixing": op1_mixing, "op2_warc": op2_warc, "op3_topk": op3_topk, "op4_token_counts": op4_token_counts, "op5_quality": op5_quality, "op6_mpegts": op6_mpegts, "op7_toxicity": op7_toxicity, "op8_substring": op8_substring, "op9_bagminhash": op9_bagminhash, "op10_bpe": op10_bpe, "op11_simhash": op11_simhash, "op12_hard_negatives": op12_hard_negatives, "op13_merkle": op13_merkle}

__all__ = ["QUERIES", "SQL"]
