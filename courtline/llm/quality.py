"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed
block by block with each, and the difference of the two sizes over the block's own size tells which
it resembles. The mean, the largest and the smallest difference of a text's blocks and its two
normalised sizes become a probability by logistic calibration, fitted on labelled documents outside
fold 0 that the dictionaries were not built from.

What is fitted comes from the whole texts of at most SAMPLE documents of each label; scores are of
whole texts. Texts go to no driver: a task for each label builds its dictionary, from blocks of about LEARNT_BYTES at
most, drawn by their hash over the whole of every text, so that neither very long texts nor repeated rows fill a task. Null and empty
texts are one empty block. Without labels of both kinds every score is the share of label 1, or 0.5
without any. Of several labels of a document the largest counts; repeated rows get equal scores. An
empty table gives an empty result. Other columns may have any name; one with the name of the score's
column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import in_slices
from .common import free, in_tasks, put, with_field
from .labelled import fold, logistic, probability, sample

SAMPLE = 2500
BLOCK = 1024
DICTIONARY = 64 * 1024
#: Bytes of blocks of each label that a dictionary is built from, about.
LEARNT_BYTES = 32_000_000
LEVEL = 3
INPUTS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    share: float


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


@lru_cache(maxsize=4)
def compressors(good: bytes, bad: bytes) -> list:
    import zstandard

    made = []
    for raw in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(raw)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def differences(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Mean, largest and smallest of (size with good - size with bad) / own size over the blocks of each text, and both sizes over the text's."""
    with_good, with_bad = compressors(good, bad)
    out = np.empty((len(texts), INPUTS))
    for i, text in enumerate(texts):
        own = blocks(text)
        g, b = (np.array([len(c.compress(x)) for x in own], dtype=float) for c in (with_good, with_bad))
        n = np.array([max(1, len(x)) for x in own], dtype=float)
        rates = (g - b) / n
        out[i] = (g - b).sum() / n.sum(), rates.max(), rates.min(), g.sum() / n.sum(), b.sum() / n.sum()
    return out


def dictionary(texts: list[list[bytes]]) -> bytes:
    """A dictionary from blocks of texts; the last of them as they are, if they are too few to train one."""
    import zstandard

    some = [b for own in texts for b in own]
    try:
        return zstandard.train_dictionary(DICTIONARY, some).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(some)[-DICTIONARY:].ljust(8)


def drawn_blocks(text: bytes, share: float) -> list[bytes]:
    """The blocks of a text that are drawn: a share of them, by their hash."""
    import xxhash

    own = blocks(text)
    return own if share >= 1 else [b for b in own if xxhash.xxh64_intdigest(b) < share * 2.0**64]


def dictionaries(rows: DataFrame, most: int = LEARNT_BYTES) -> dict[int, bytes]:
    """The dictionary of each label, built in a task from the blocks drawn of its texts; rows equal in doc_id and text count once."""
    rows = rows.dropDuplicates(["y", "doc_id", "text"]).select("y", "text")
    sizes = {r["y"]: r["bytes"] for r in rows.groupBy("y").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    shares = {y: min(1.0, most / max(1, n)) for y, n in sizes.items()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            y = batch.column("y").to_pylist()
            drawn = [drawn_blocks(t.encode(), shares[k]) for k, t in zip(y, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(drawn, pa.list_(pa.binary()))], names=["y", "blocks"])

    def build(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(table.column("y").to_pylist()[:1], pa.int32()), pa.array([dictionary(sorted(table.column("blocks").to_pylist(), key=b"".join))], pa.binary())], names=["y", "dictionary"])

    drawn = in_tasks(rows, draw, "y int, blocks array<binary>")
    return {r["y"]: bytes(r["dictionary"]) for r in drawn.groupBy("y").applyInArrow(build, "y int, dictionary binary").collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Dictionaries from folds 1 and 2, calibration on folds 3 and 4 of the sample."""
    rows = sample(docs, labels, label, {0: SAMPLE, 1: SAMPLE})
    # The share of label 1 sets the calibration's level, as the sample holds both labels alike.
    counts = {r["y"]: r["n"] for r in labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    share = ones / (ones + zeros) if ones + zeros else 0.5
    built = dictionaries(rows.where("fold in (1, 2)"))
    if not ones or not zeros or built.keys() != {0, 1}:
        return Model(b"", b"", (), share)
    good, bad = built[1], built[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            x = differences([t.encode() for t in batch.column("text").to_pylist()], good, bad)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, x.T)], names=["y", *map(str, range(INPUTS))])

    seen = np.array([tuple(r) for r in in_tasks(rows.where("fold in (3, 4)").select("y", "text"), run, ", ".join(["y int", *(f"`{i}` double" for i in range(INPUTS))])).collect()], dtype=float).reshape(-1, 1 + INPUTS)
    y = seen[:, 0]
    if set(y) != {0.0, 1.0}:
        return Model(b"", b"", (), share)
    weights = logistic(seen[:, 1:], y, ridge=1e-3)
    weights[0] += np.log(ones / zeros) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, tuple(weights), share)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            p = probability(np.array(model.weights), differences(texts, model.good, model.bad)) if model.weights else np.full(len(texts), model.share)
            yield put(batch, column, pa.array(p, pa.float64()))

    return in_tasks(docs, run, with_field(docs.schema, column, T.DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to have label 0."""
    score = free(docs, "_score")
    return scored(docs, fit(docs, labels), score).where(F.col(score) >= THRESHOLD).drop(score)
