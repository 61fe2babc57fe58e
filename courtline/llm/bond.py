"""Hard negatives by vertical scans of branch and bound (BOND).

Vectors are quantised to integers. An anchor's positives are its best rows of the same label; its hard
negatives are the best rows of other labels whose score lies in a window that each positive sets:
low <= negative / positive <= high, as whole numbers of hundredths.

Blocks of rows store their vectors by dimension, with each dimension's least and largest component.
An anchor reads the dimensions in the order of its components' magnitudes, largest first. What the
unread dimensions can still add lies between sums of the products with these extremes, so each row's
score has a lower and an upper bound. A bitmap of candidates starts with the rows of the right labels
and loses those whose bounds rule them out: for positives, rows that as many others are sure to beat;
for negatives, rows outside all windows, and rows that enough others inside a window are sure to beat.
What is left has exact scores when all dimensions are read, and the windows are resolved on these.

Positives are found first, in all blocks, and merged; then their windows are taken to all blocks. Every
block of anchors meets every block of rows once in each pass, in a task of its own (see topk), which
answers with a few rows for each anchor. Nothing is collected or broadcast but a row for each vector
length. Sums are exact: in doubles while they stay below 2^53, in 64-bit integers below 2^62, and
in integers of any size beyond; only components of 2^62 or more, and results beyond 64 bits, are
refused.

Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no
part. Rows are told apart by their place: rows that share a vec_id are anchors and candidates each for
itself. Vectors are scored against those of the same length. Ties go to the smaller vec_id. Anchors
without positives, and empty tables, give no rows. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_tasks, saved
from .topk import LARGEST, meetings, quantised, unpacked, with_rows

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: Hundredths of the positive's score between which a hard negative's lies.
LOW, HIGH = 50, 95
BLOCK_ROWS, ANCHOR_ROWS = 16384, 512
#: Dimensions read before bounds are looked at again, and candidates so few that they are read to the end.
STEP, FEW = 8, 64


class VerticalBlock:
    """Vectors of a block of rows by dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, np.ascontiguousarray(vectors.T)
        self.least, self.largest = self.vectors.min(axis=1), self.vectors.max(axis=1)
        self.most = max(abs(int(self.least.min())), abs(int(self.largest.max())))
        self.kinds: dict[type, tuple[np.ndarray, ...]] = {}

    def of_kind(self, anchors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Dimensions, least and largest components, and the anchors, as numbers in which their scores are exact."""
        bound = 2 * len(self.vectors) * max(1, self.most) * max(1, abs(int(anchors.min())), abs(int(anchors.max())))
        kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
        if kind not in self.kinds:
            self.kinds[kind] = tuple(x.astype(kind) for x in (self.vectors, self.least, self.largest))
        return *self.kinds[kind], anchors.astype(kind)


def scanned(columns: np.ndarray, least: np.ndarray, largest: np.ndarray, anchor: np.ndarray, candidates: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that are left of a bitmap of rows, as places, and their exact scores; shrink(lower, upper) tells which of them stay."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    weights = anchor[order]
    ends = np.stack([weights * least[order], weights * largest[order]])
    # What dimensions from a place on can add at least and at most.
    rest_low, rest_high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (ends.min(axis=0), ends.max(axis=0)))
    at = np.flatnonzero(candidates)
    score = np.zeros(len(at), dtype=columns.dtype)
    read = 0
    while read < len(order) and len(at):
        to = len(order) if len(at) <= FEW else min(len(order), read + STEP)
        dims = columns[order[read:to]]
        score = score + weights[read:to] @ (dims if len(at) == dims.shape[1] else dims[:, at])
        read = to
        stay = shrink(score + rest_low[read], score + rest_high[read])
        if not stay.all():
            at, score = at[stay], score[stay]
    return at, score


def kth(values: np.ndarray, k: int):
    """The k-th largest value."""
    return np.partition(values, len(values) - k)[len(values) - k] if values.dtype != object else np.sort(values)[-k]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by id."""
    if len(ids) > k:
        some = np.flatnonzero(scores >= kth(scores, k))
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores)) if len(ids) else np.zeros(0, dtype=np.int64)


def positives_in(block: VerticalBlock, of_kind: tuple[np.ndarray, ...], i: int, row: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best rows of the anchor's label in a block."""
    *numbers, anchors = of_kind

    def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= kth(lower, k) if len(lower) > k else np.ones(len(lower), dtype=bool)

    at, score = scanned(*numbers, anchors[i], (block.labels == label) & (block.rows != row), shrink)
    top = best(block.ids[at], score, k)
    return block.ids[at[top]], score[top]


def negatives_in(block: VerticalBlock, of_kind: tuple[np.ndarray, ...], i: int, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores, ids and scores of the k best rows of other labels in it."""
    *numbers, anchors = of_kind

    def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lower), dtype=bool)
        for low, high in windows:
            sure = lower[(lower >= low) & (upper <= high)]
            stay |= (upper >= (max(low, kth(sure, k)) if len(sure) >= k else low)) & (lower <= high)
        return stay

    at, score = scanned(*numbers, anchors[i], block.labels != label, shrink)
    out = []
    for low, high in windows:
        inside = np.flatnonzero((score >= low) & (score <= high))
        top = inside[best(block.ids[at[inside]], score[inside], k)]
        out.append((block.ids[at[top]], score[top]))
    return out


def bounded(rows: DataFrame) -> None:
    """Fails if a component is beyond the integers that are handled."""
    most = rows.agg(F.max(F.array_max(F.transform("q", F.abs)))).first()[0]
    if most is not None and most >= LARGEST:
        raise ValueError("components of vectors are too large")


def longs(x: np.ndarray) -> pa.Array:
    return pa.array([int(v) for v in x], pa.int64()) if x.dtype == object else pa.array(x.astype(np.int64))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """For each anchor and positive its hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    known = vectors.withColumn("label", F.col(label).cast("long")).where("vec_id is not null and label is not null")
    rows = with_rows(quantised(known, scale, "label").withColumn("vec_id", F.col("vec_id").cast("long")), "bond-rows")
    bounded(rows)
    anchors = rows.where(is_anchor)
    columns = ("row", "vec_id", "label")

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, VerticalBlock] | None = None
        for part, kind, dim, (numbers, ids, labels), q in unpacked(batches, columns):
            if not kind:
                held = (part, dim, VerticalBlock(numbers, ids, labels, q))
            elif held and held[:2] == (part, dim):
                of_kind = held[2].of_kind(q)
                found = [positives_in(held[2], of_kind, i, row, of, positives) for i, (row, of) in enumerate(zip(numbers.tolist(), labels.tolist(), strict=True))]
                sizes = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, sizes)), *(longs(np.concatenate([x[j] for x in found])) for j in (0, 1))], names=["row", "positive_id", "positive_score"])

    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    found = in_tasks(meetings(rows, anchors, columns, block_rows, anchor_rows), find_positives, "row long, positive_id long, positive_score long")
    pairs = saved(found.withColumn("place", place).where(F.col("place") <= positives), "positives")

    # An anchor carries the scores of its positives in order; the last of fewer is repeated and not asked for.
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"])
    known = pairs.groupBy("row").agg(scores.alias("scores"), F.count(F.lit(1)).alias("n"))
    carried = [f"score{i}" for i in range(positives)]
    asking = anchors.join(known, "row").select(*columns, "n", "q", *[F.get("scores", F.least(F.lit(i), F.size("scores") - 1)).alias(c) for i, c in enumerate(carried)])
    asked = (*columns, "n", *carried)

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, VerticalBlock] | None = None
        for part, kind, dim, (numbers, ids, labels, sizes, *marks), q in unpacked(batches, asked):
            if not kind:
                held = (part, dim, VerticalBlock(numbers, ids, labels, q))
            elif held and held[:2] == (part, dim):
                of_kind = held[2].of_kind(q)
                out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
                for i, row in enumerate(numbers.tolist()):
                    # Whole scores with low * positive <= 100 * score <= high * positive.
                    windows = [(-(-low * s // 100), high * s // 100) for s in (int(m[i]) for m in marks[: sizes[i]])]
                    asks = [j for j, (a, b) in enumerate(windows) if a <= b]
                    for j, (i_ids, i_scores) in zip(asks, negatives_in(held[2], of_kind, i, int(labels[i]), [windows[j] for j in asks], negatives) if asks else [], strict=True):
                        out.append((row, j + 1, i_ids, i_scores))
                lengths = [len(x[2]) for x in out]
                both = [longs(np.concatenate([x[j] for x in out])) if out else pa.array([], pa.int64()) for j in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in out], dtype=np.int64), lengths)), pa.array(np.repeat(np.array([x[1] for x in out], dtype=np.int32), lengths)), *both], names=["row", "place", "negative_id", "negative_score"])

    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    mined = in_tasks(meetings(rows, asking, asked, block_rows, anchor_rows), find_negatives, "row long, place int, negative_id long, negative_score long")
    mined = mined.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = pairs.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return mined.join(named, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
