"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits; bit b is set if more than half of a text's shingles of four words
(lower-cased A to Z, repeats included) have it set in their 64-bit hash. Two fingerprints link if
they differ in at most `radius` bits, and classes are the connected components of links.

Fingerprints that differ in at most `radius` bits agree in all of m - radius blocks of some choice of
that many out of m disjoint blocks of bits. So they are dealt to buckets by the leading bits of the
chosen blocks, once for each choice: m and the number of bits follow from how many different
fingerprints there are, so that a bucket holds about a thousand of them, and no link is lost
whichever they are. A bucket that is larger, as its fingerprints are alike, is cut into parts of about
`part_rows`, and every two of its parts meet in a group of their own, so no task gathers a bucket.

Within a group bits are stored vertically: bit plane b has bit b of 64 fingerprints in a word. The
planes in which a probe differs from them are added, 64 distances at a time, by carry-save counters of
bit slices, eight planes a step. A word is abandoned as soon as all of its 64 distances exceed the
radius. What leaves a group is not its pairs but a link from each of its linked fingerprints to the
least of its component there, and a task sends links only that join what it has not joined.

Equal fingerprints are one node from the start, so copies of a text are never compared. Nothing is
collected or broadcast by this code; steps are written to the shared folder.

Nulls: a null text has no words. A text without words has fingerprint 0 and is linked like any other;
one of fewer than four words has the hash of all of them. A null doc_id is left out of a class's
least doc_id, which is null where all are null. Rows may repeat; each gets its own row. Texts are read
whole, however long. Empty tables give empty results. Only doc_id and text are read; other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import components
from .common import in_tasks, saved

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Different fingerprints of a bucket, about, where they are spread evenly; and those of a part of a larger one.
BUCKET_ROWS, PART_ROWS = 1024, 4096
#: Shingles whose bits are counted at once, and probes that are compared at once.
AT_ONCE, PROBES = 1 << 14, 256

U = np.uint64


def fingerprint(text: bytes) -> int:
    import xxhash

    words = text.lower().split()  # of bytes: lower-cases A to Z only, and splits at space and 9 to 13
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    n = len(words) - SHINGLE + 1
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[SHINGLE - 1 :], strict=True)), dtype=U, count=n)
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        set_in += np.unpackbits(h[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts), dtype=U, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_tasks(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def masks(n: int, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Masks of the bits by which n fingerprints are dealt, one for each choice of blocks: any two within the radius agree in all bits of one of them."""
    bits = max(0, (max(1, n) // bucket_rows).bit_length())
    m = next((m for m in range(radius + 1, 2 * radius + 1) if (m - radius) * (64 // m) >= bits), 2 * radius)
    of_block = min(64 // m, -(-bits // (m - radius)))
    block = [((1 << of_block) - 1) << (i * (64 // m)) for i in range(m)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(m), m - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b has bit b of all fingerprints, 64 of them in a word; the last word is filled up with the last fingerprint."""
    full = np.concatenate([fps, np.repeat(fps[-1:], -len(fps) % 64)])
    bits = np.unpackbits(full.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U)


class Counters:
    """Distances of units of 64 fingerprints, as bit slices: ones, twos, fours, and whether 8 was reached."""

    def __init__(self, shape: tuple[int, ...]):
        self.slices = [np.zeros(shape, dtype=U) for _ in range(4)]

    def carry(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Adds two bitmaps to slice k; what carries over."""
        s = self.slices[k]
        half = s ^ a
        out = (s & a) | (half & b)
        self.slices[k] = half ^ b
        return out

    def add(self, d: list[np.ndarray]) -> None:
        """Adds eight planes of differing bits."""
        twos = [self.carry(0, d[i], d[i + 1]) for i in (0, 2, 4, 6)]
        fours = [self.carry(1, twos[i], twos[i + 1]) for i in (0, 2)]
        self.slices[3] |= self.carry(2, *fours)

    def within(self, radius: int) -> np.ndarray:
        """Bitmaps of the distances up to radius, which is at most 7."""
        below, equal = np.zeros_like(self.slices[0]), ~self.slices[3]
        for k in (2, 1, 0):
            if radius >> k & 1:
                below |= equal & ~self.slices[k]
                equal = equal & self.slices[k]
            else:
                equal = equal & ~self.slices[k]
        return below | equal

    def kept(self, units: np.ndarray) -> Counters:
        out = Counters((0,))
        out.slices = [s[units] for s in self.slices]
        return out


def near(probes: np.ndarray, rows: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places in probes and rows of all pairs that differ in at most radius bits."""
    plane = planes(rows)
    valid = np.full(plane.shape[1], ~U(0))
    if len(rows) % 64:
        valid[-1] = (U(1) << U(len(rows) % 64)) - U(1)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for at in range(0, len(probes), PROBES):
        some = probes[at : at + PROBES]
        flip = [np.where(some >> U(b) & U(1) == 1, ~U(0), U(0)) for b in range(64)]
        count = Counters((len(some), plane.shape[1]))
        for step in (0, 8):
            count.add([plane[b][None, :] ^ flip[b][:, None] for b in range(step, step + 8)])
        probe, word = np.nonzero(count.within(radius) & valid[None, :])
        count = count.kept((probe, word))
        for step in range(16, 64, 8):  # of the units that are left
            count.add([plane[b][word] ^ flip[b][probe] for b in range(step, step + 8)])
            alive = np.flatnonzero(count.within(radius) & valid[word])
            probe, word, count = probe[alive], word[alive], count.kept(alive)
        hits = np.unpackbits((count.within(radius) & valid[word]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        unit, bit = np.nonzero(hits)
        found.append((at + probe[unit], word[unit] * 64 + bit))
    return np.concatenate([p for p, _ in found]), np.concatenate([r for _, r in found])


def least_of_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, by links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(label[a], label[b]):
            return label


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Pairs a, b within the radius: enough of them to connect whatever links connect. fps: different fingerprints, written."""
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks(fps.count(), radius, bucket_rows))])
    dealt = fps.select("fp", F.explode(choices).alias("k")).select("fp", "k.choice", "k.bits")
    buckets = dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("choice", "bits", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = dealt.join(buckets, ["choice", "bits"]).withColumn("part", part).withColumn("other", met)
    groups = ["choice", "bits", "x", "y"]
    rows = rows.select("choice", "bits", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "fp")
    rows = rows.repartition(*groups).sortWithinPartitions(*groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}

        def top(node: int) -> int:
            while (up := joined.get(node, node)) != node:
                joined[node] = node = joined.get(up, up)
            return node

        def of_group(fps: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
            """Links of a group: of its first part with its second one, or of its only part."""
            u = fps.view(U)
            own = first.all()
            p, r = np.arange(len(u)), np.arange(len(u))
            if not own:
                p, r = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(p) or not len(r):
                return []
            i, j = near(u[p], u[r], radius)
            i, j = p[i], r[j]
            if own:
                i, j = i[i < j], j[i < j]
            label = least_of_component(len(u), i, j)
            out = []
            for node in np.flatnonzero(label != np.arange(len(u))):
                a, b = int(fps[label[node]]), int(fps[node])
                if (x := top(a)) != (y := top(b)):
                    joined[max(x, y)] = min(x, y)
                    out.append((a, b))
            return out

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*groups, "part", "fp")]
            if held:
                columns = [np.concatenate(c) for c in zip(*held, columns, strict=True)]
            *keys, part, fp = columns
            new = np.zeros(len(fp), dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            found = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for x in of_group(fp[lo:hi], part[lo:hi] == keys[2][lo])]
            held = [tuple(c[cuts[-1] :] for c in columns)]  # the last group may go on
            yield pair_batch(found)
        if held:
            *keys, part, fp = held[0]
            yield pair_batch(of_group(fp, part == keys[2][0]) if len(fp) else [])

    return in_tasks(rows, run, "a long, b long").distinct()


def pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the least doc_id of its component)."""
    own = saved(fingerprints(docs), "fingerprints")
    different = saved(own.select("fp").distinct(), "different-fingerprints")
    labels = components(saved(links(different, radius, bucket_rows, part_rows), "simhash-links")).withColumnRenamed("node", "fp")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    classes = saved(classes, "fingerprint-classes")
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of = saved(classes.join(least, "label").select("fp", "component_id"), "simhash-components")
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
