"""Exact top-k search by a bit-sliced index.

Vectors are quantised to integers. Rows lie in blocks; each attribute of a block is stored as bit
slices: bitmaps over the rows, one for each bit of the attribute's coarse value (its lowest
drop_bits bits left out). For a query, the slices of its positive weights and the complements of
those of its negative weights are added with carry-save bitmap arithmetic into slices of a coarse
score. Rows are selected from the most significant slice downward: first the k-th coarse score,
then all rows that can still reach it, as the coarse score lacks at most a known amount. These
boundary rows are scored exactly from the integers, so the result is exact, ties included.

Queries are dealt in blocks of query_rows and every query block meets every row block once, in a
task of its own: blocks are numbered, and a pair of numbers names the task. A block's answer is k
rows for each query, and the answers are merged by a window. Neither side is collected or broadcast.

Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
without a vec_id. Vectors are scored against those of the same length. A score must be a 64-bit
integer: if the largest component of the rows and that of the queries could make a larger one in
that many dimensions, the search fails and says so, and never wraps. Rows are told apart by their
place, not by vec_id: each row that is a query has its own answer, and only the row itself is barred
from it, not others of its vec_id. An empty table or query set gives an empty result. Other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_tasks, saved

K = 20
SCALE = 64
BLOCK_ROWS = 16384
QUERY_ROWS = 512
DROP_BITS = 1
LARGEST = 1 << 62
MOST_PARTS = 100_000


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def add_bitmaps(columns: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum of bitmaps of weight 2^e, given by e: the slices of the sum by e. Three of one weight become one of it and one of the next."""
    out, e = {}, 0
    while columns:
        bits = columns.pop(e, [])
        while len(bits) > 2:
            a, b, c = bits.pop(), bits.pop(), bits.pop()
            half = a ^ b
            bits.insert(0, half ^ c)
            columns.setdefault(e + 1, []).append((a & b) | (half & c))
        if len(bits) == 2:
            columns.setdefault(e + 1, []).append(bits[0] & bits[1])
            bits = [bits[0] ^ bits[1]]
        if bits:
            out[e] = bits[0]
        e += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_value(slices: dict[int, np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest value among rows (the least if they are fewer), from the most significant slice downward."""
    value, k = 0, min(k, count(rows))
    for e in sorted(slices, reverse=True):
        ones = rows & slices[e]
        if (n := count(ones)) >= k:
            rows, value = ones, value | 1 << e
        else:
            rows, k = rows & ~slices[e], k - n
    return value


def at_least(slices: dict[int, np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """The rows whose value is at least value."""
    if value <= 0:
        return rows
    above, equal = np.zeros_like(rows), rows
    for e in range(max(max(slices, default=0), value.bit_length() - 1), -1, -1):
        bits = slices.get(e)
        if value >> e & 1:
            equal = equal & bits if bits is not None else np.zeros_like(rows)
        elif bits is not None:
            above = above | (equal & bits)
            equal = equal & ~bits
    return above | equal


class SlicedBlock:
    """Bit slices of the attributes of a block of integer vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, drop_bits: int = DROP_BITS):
        self.numbers, self.ids, self.vectors, self.drop = rows, ids, vectors, drop_bits
        n = len(ids)
        self.low = vectors.min(axis=0)
        coarse = (vectors - self.low) >> drop_bits
        self.bits = [int(m).bit_length() for m in coarse.max(axis=0)]
        words = -(-n // 64) * 64
        self.rows = self.packed(np.ones(n, dtype=bool), words)
        self.slices = [[self.packed(coarse[:, d] >> b & 1 == 1, words) for b in range(bits)] for d, bits in enumerate(self.bits)]
        self.order = np.argsort(rows, kind="stable")

    @staticmethod
    def packed(flags: np.ndarray, words: int) -> np.ndarray:
        full = np.zeros(words, dtype=bool)
        full[: len(flags)] = flags
        return np.packbits(full, bitorder="little").view(np.uint64)

    def top(self, own_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows other than own_row, best first, ties by id."""
        columns: dict[int, list[np.ndarray]] = {}
        slack = 0
        for weight, slices in zip(query.tolist(), self.slices, strict=True):
            size = abs(weight)
            slack += size * ((1 << self.drop) - 1)
            for b, bitmap in enumerate(slices):
                bitmap = bitmap if weight > 0 else ~bitmap
                for j in range(size.bit_length()):
                    if size >> j & 1:
                        columns.setdefault(b + j, []).append(bitmap)
        total = add_bitmaps(columns)
        rows = self.rows.copy()
        own = self.order[np.searchsorted(self.numbers, own_row, "left", self.order) : np.searchsorted(self.numbers, own_row, "right", self.order)]
        for r in own.tolist():
            rows[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        # In coarse units a score lacks less than slack / 2^drop, so whoever reaches the k-th has at least this.
        least = kth_value(total, rows, k) - -(-slack >> self.drop)
        near = at_least(total, rows, least)
        found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        scores = self.vectors[found] @ query
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found][best], scores[best]


def quantised(vectors: DataFrame, scale: int, *more: str) -> DataFrame:
    """vec_id, columns of more, and q, the integers floor(scale * x), of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # The least and the largest long have no mirror or product; whatever lies beyond is refused below as too large.
    whole = F.transform(x, lambda v: F.least(F.lit(float(LARGEST)), F.greatest(F.lit(-float(LARGEST)), F.floor(v * scale).cast("double"))).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", *more, whole.alias("q"))


def with_rows(rows: DataFrame, label: str) -> DataFrame:
    """rows, written and read again, with row: a number that tells each from all others."""
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), label)


def fits(rows: DataFrame, queries: DataFrame) -> None:
    """Fails if a score, or a step towards it, could exceed 64 bits."""
    most = lambda df: {r["dim"]: r["most"] for r in df.groupBy(F.size("q").alias("dim")).agg(F.max(F.array_max(F.transform("q", F.abs))).alias("most")).collect()}
    of_rows, of_queries = most(rows), most(queries)
    for dim, x in of_queries.items():
        if dim * x * (2 * of_rows.get(dim, 0) + 1) >= 1 << 62:
            raise ValueError(f"components of {dim}-dimensional vectors are too large for 64-bit scores")


def in_blocks(rows: DataFrame, most: int, columns: Sequence[str]) -> DataFrame:
    """Rows of up to most vectors of one length: dim, and as bytes the long columns and the vectors q of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            parts = [np.concatenate(x).tobytes() for x in zip(*held.pop(dim), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], names=["dim", *columns, "vectors"])

        for batch in batches:
            longs = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            q = batch.column("q")
            sizes = pc.list_value_length(q).to_numpy(zero_copy_only=False)
            flat, starts = q.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                vectors = flat[starts[at][:, None] + np.arange(dim)]
                for k in range(0, len(at), most):
                    held.setdefault(dim, []).append((*(x[at[k : k + most]] for x in longs), vectors[k : k + most]))
                    if sum(len(x[0]) for x in held[dim]) >= most:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return in_tasks(rows, run, "dim int, " + ", ".join(f"{c} binary" for c in (*columns, "vectors")))


def numbered(blocks: DataFrame, label: str) -> DataFrame:
    """blocks, written and read again, with no: 0 and on. Numbers follow from those within partitions and the partitions' counts."""
    placed = saved(blocks.withColumn("of", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(long((1 << 33) - 1))), label)
    counts = placed.groupBy("of").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), long(0)).alias("before"))  # a row for each partition
    return placed.join(F.broadcast(before), "of").withColumn("no", F.col("before") + F.col("at")).drop("of", "at", "before")


def meetings(rows: DataFrame, queries: DataFrame, columns: Sequence[str], block_rows: int, query_rows: int) -> DataFrame:
    """Every block of rows with every block of queries: part, kind (0: a block of rows, which the queries of its part follow), dim, columns and vectors.

    columns: long columns of rows and queries; rows need not have those that they lack.
    """
    blocks = numbered(in_blocks(rows.withColumns({c: long(0) for c in columns if c not in rows.columns}), block_rows, columns), "row-blocks")
    asked = numbered(in_blocks(queries, query_rows, columns), "query-blocks")
    n_blocks, n_asked = blocks.count(), asked.count()
    # A row block goes to as many tasks as there are parts of the query blocks; there are several parts only while tasks are few.
    splits = max(1, min(n_asked, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // max(1, n_blocks))))
    number = lambda n: F.explode(F.sequence(long(0), long(max(0, n - 1))))
    carried = ["dim", *columns, "vectors"]
    left = blocks.select(F.col("no").alias("row_no"), number(splits).alias("split"), F.lit(0).alias("kind"), *carried)
    right = asked.select(number(n_blocks).alias("row_no"), (F.col("no") % splits).alias("split"), F.lit(1).alias("kind"), *carried)
    part = F.col("row_no") * splits + F.col("split")
    both = left.unionByName(right).select(part.alias("part"), "kind", *carried)
    parts = max(1, min(MOST_PARTS, n_blocks * splits))
    return both.repartitionById(parts, (F.col("part") % parts).cast("int")).sortWithinPartitions("part", "kind")


def unpacked(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[int, int, int, list[np.ndarray], np.ndarray]]:
    """part, kind, dim, columns and vectors of each block that a task gets from meetings."""
    for batch in batches:
        for part, kind, dim, *longs, vectors in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "dim", *columns, "vectors")), strict=True):
            yield part, kind, dim, [np.frombuffer(x, dtype=np.int64) for x in longs], np.frombuffer(vectors, dtype=np.int64).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, drop_bits: int = DROP_BITS) -> DataFrame:
    """The k best rows of every query: query_id, rank, vec_id, score."""
    rows = with_rows(quantised(vectors, scale).where("vec_id is not null"), "quantised")
    queries = rows.where(is_query)
    fits(rows, queries)
    columns = ("row", "vec_id")
    dealt = meetings(rows, queries, columns, block_rows, query_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, SlicedBlock] | None = None
        for part, kind, dim, (numbers, ids), vectors in unpacked(batches, columns):
            if not kind:
                held = (part, dim, SlicedBlock(numbers, ids, vectors, drop_bits))
            elif held and held[:2] == (part, dim):
                found = [held[2].top(n, v, k) for n, v in zip(numbers.tolist(), vectors, strict=True)]
                sizes = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, sizes)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["row", "query_id", "vec_id", "score"])

    best = in_tasks(dealt, run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
