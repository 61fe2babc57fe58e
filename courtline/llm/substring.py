"""Substring dedup by fixed-block anchors.

A word sequence of `window` words that stands in two documents contains, in each of them, a whole
block of window / 2 words that begins at a multiple of window / 2. Such reference blocks of all
documents are indexed in a filter of bounded size, which is built in slices by Spark tasks. Every
document probes it with each of its rolling windows of window / 2 words (where the document has a
reference block itself, the block must have been indexed twice). Hits are extended to all windows
of `window` words that contain one; these candidates, and no others, are dealt by their hash to
groups that find the smallest doc_id of each window, and the windows that have a smaller one than
their own form maximal repeats.

The filter only spares work: a false hit makes a candidate that no group confirms. Where blocks
outnumber a quarter of its bits it would let most windows through, so it is left out and all windows
are candidates; results are the same. Before candidates are dealt, those of a batch with the same
words are put together, and a task remembers windows that it has sent: one that it has sent for a
smaller doc_id is a repeat and is not sent again. So a passage that a third of all documents share
makes about one candidate for each task. Repeats that a task knows by itself are dealt by batch,
never by their words.

Hashes of words add independent random values for each byte and place, so words have no algebra in
which they could collide by their form; windows are compared by 96 bits, 64 of one such hash of
words and 32 of another.

Nulls: a null text has no words; a null doc_id is larger than all others. Rows equal in doc_id and
text are cut alike. Texts are read whole, however long. Empty tables give empty results. Only doc_id
and text are read; other columns may have any name and are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .bpe import in_slices
from .common import free, in_tasks, saved

WINDOW = 50
#: Bits of the filter for each reference block, and its bound.
BITS_PER_BLOCK = 16
MOST_FILTER_BITS = 1 << 30
SLICES = 64
#: A task remembers up to 2^SLOT_BITS windows.
SLOT_BITS = 20
#: Windows of the input for each group that candidates are dealt to.
GROUP_WINDOWS = 2_000_000
LAST = np.int64(2**63 - 1)

U = np.uint64
#: Factors of the rolling hashes of windows, and what tells the two hashes of words apart.
BASES = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SEEDS = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, dtype=U)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sums_of(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values times powers of base."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the stretches from starts to ends."""
    _, down = powers(base, len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


@lru_cache(maxsize=4)
def byte_values(seed: int, places: int = 64) -> np.ndarray:
    """The random values of all bytes at the first places of a word."""
    return mixed(np.arange(places * 256, dtype=U) + U(seed))


class Words:
    """The words of some texts: hashes of words, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], SEPARATOR[self.data]])))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = self.word_hashes(SEEDS[0])
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, text_ends)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.position = np.arange(len(self.starts)) - self.bounds[:-1][self.text]
        self.sums = sums_of(self.hashes, BASES[0])

    def word_hashes(self, seed: int) -> np.ndarray:
        """A hash of each word: the sum, over its bytes, of a random value for the byte and its place in the word."""
        if not len(self.starts):
            return np.zeros(0, dtype=U)
        sizes = (self.ends - self.starts).astype(np.int32)
        last = np.cumsum(sizes, dtype=np.int32)
        place = np.arange(last[-1], dtype=np.int32) - np.repeat(last - sizes, sizes)
        code = place << 8 | self.data[np.repeat(self.starts.astype(np.int32), sizes) + place]
        table = byte_values(seed)
        values = table[np.minimum(code, len(table) - 1)]
        beyond = np.flatnonzero(code >= len(table))
        values[beyond] = mixed(code[beyond].astype(U) + U(seed))
        return mixed(np.add.reduceat(values, last - sizes))

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words at which a window of size words within one text begins."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        return at[self.text[at] == self.text[at + size - 1]] if len(at) else at

    def window_hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return hashes(self.sums, at, at + size, BASES[0])


class Filter:
    """Reference blocks seen once and seen twice, as two bitmaps of SLICES slices each."""

    def __init__(self, once: np.ndarray, twice: np.ndarray, slice_bits: int):
        self.once, self.twice, self.slice_bits = once, twice, slice_bits

    @staticmethod
    def places(h: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of a hash within its slice."""
        mask = U(slice_bits - 1)
        return h & mask, (h >> U(29)) & mask

    @staticmethod
    def has(bitmap: np.ndarray, places: tuple[np.ndarray, ...]) -> np.ndarray:
        out = True
        for p in places:
            out = out & (bitmap[(p >> U(3)).astype(np.int64)] >> (p & U(7)).astype(np.uint8) & 1 == 1)
        return out

    @staticmethod
    def put(bitmap: np.ndarray, places: tuple[np.ndarray, ...]) -> None:
        for p in places:
            np.bitwise_or.at(bitmap, (p >> U(3)).astype(np.int64), np.left_shift(1, (p & U(7)).astype(np.uint8)).astype(np.uint8))

    def hits(self, h: np.ndarray, own_block: np.ndarray) -> np.ndarray:
        """Whether each hash was indexed, other than by the block at its own place."""
        first = (h >> U(58)) * U(self.slice_bits)
        places = tuple(p + first for p in self.places(h, self.slice_bits))
        found = self.has(self.once, places)
        at = np.flatnonzero(found & own_block)
        found[at] = self.has(self.twice, tuple(p[at] for p in places))
        return found


def batches_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in in_slices(batches, "text", 1_000_000):
        yield batch, [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def reference_blocks(docs: DataFrame, block: int) -> DataFrame:
    """Hashes of the reference blocks, as bytes by slice of the filter: slice, n, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches_of_texts(batches):
            words = Words(texts)
            at = words.windows(block)
            h = np.sort(words.window_hashes(at[words.position[at] % block == 0], block))
            if len(h):
                cuts = np.searchsorted(h, np.arange(SLICES + 1, dtype=U)[:-1] << U(58))
                parts = np.split(h, cuts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(map(len, parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "n", "hashes"])

    return in_tasks(docs.select("text"), run, "slice int, n long, hashes binary")


def filter_of(blocks: DataFrame, n_blocks: int, most_bits: int) -> Filter | None:
    """The filter over all reference blocks, None where it would let most windows through; its bits follow their number up to most_bits. Each slice is built by one task, block by block."""
    if 4 * n_blocks > most_bits:
        return None
    bits = min(most_bits, 1 << max(16, (n_blocks * BITS_PER_BLOCK - 1).bit_length()))
    slice_bits = bits // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                once, twice = maps.setdefault(number, (np.zeros(slice_bits // 8, np.uint8), np.zeros(slice_bits // 8, np.uint8)))
                h, counts = np.unique(np.frombuffer(data, dtype=U), return_counts=True)
                places = Filter.places(h, slice_bits)
                again = Filter.has(once, places) | (counts > 1)
                Filter.put(once, places)
                Filter.put(twice, tuple(p[again] for p in places))
        for number, (once, twice) in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], names=["slice", "once", "twice"])

    made = saved(in_tasks(blocks.select("slice", "hashes").repartition(SLICES, "slice"), run, "slice int, once binary, twice binary"), "filter")
    once, twice = (np.zeros(bits // 8, dtype=np.uint8) for _ in range(2))
    for r in made.toLocalIterator():  # at most SLICES rows, most_bits / 4 bytes in all
        own = slice(r["slice"] * slice_bits // 8, (r["slice"] + 1) * slice_bits // 8)
        once[own], twice[own] = (np.frombuffer(r[c], dtype=np.uint8) for c in ("once", "twice"))
    return Filter(once, twice, slice_bits)


CANDIDATES = "group_no int, batch long, docs binary, counts binary, hashes binary, checks binary, positions binary, repeats binary"
CONFIRMED = "batch long, docs binary, counts binary, positions binary"
REMOVED = "doc_id long, text_key long, stretches binary"


class Sent:
    """Some of the windows that a task has sent, with the least doc_id: one for each slot, where those met again stay."""

    def __init__(self, slot_bits: int = SLOT_BITS):
        self.shift, n = U(64 - slot_bits), 1 << slot_bits
        self.hashes, self.checks, self.ids, self.again = np.zeros(n, dtype=U), np.zeros(n, dtype=np.uint32), np.full(n, LAST), np.zeros(n, dtype=bool)

    def least(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The least doc_id that each window was sent for, LAST if that is not known."""
        slot = (h >> self.shift).astype(np.int64)
        same = (self.hashes[slot] == h) & (self.checks[slot] == check)
        self.again[slot[same]] = True
        return np.where(same, self.ids[slot], LAST)

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray) -> None:
        """Remembers different windows, where their slots are free for them."""
        slot = (h >> self.shift).astype(np.int64)
        put = ~self.again[slot] | (self.hashes[slot] == h)
        slot, n = slot[put], len(self.again)
        # Of several for one slot the last is kept whole.
        where = np.zeros(n, dtype=np.int32)
        where[slot] = np.arange(len(slot))
        kept = where[slot] == np.arange(len(slot))
        slot = slot[kept]
        self.hashes[slot], self.checks[slot], self.ids[slot] = h[put][kept], check[put][kept], ids[put][kept]
        if np.count_nonzero(self.again) > n // 2:
            self.again[:] = False


def candidates(docs: DataFrame, found, groups: int, window: int) -> DataFrame:
    """Windows that may stand in several documents, in rows by group.

    batch: names the batch of documents that a row comes from; docs: their doc_id and text_key; counts: how many of its windows, then of
    its repeats, each has; hashes, checks and positions of the windows; positions of the repeats,
    which are windows that the task has met in another document with a smaller doc_id. Repeats are
    in a row of their own, in a group that follows from the batch.
    """
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sent = found and found.value, Sent()
        for batch, texts in batches_of_texts(batches):
            words = Words(texts)
            whole = words.windows(window)
            if index is not None:
                at = words.windows(block)
                hit = np.zeros(len(words.hashes) + block + 2, dtype=np.int64)
                hit[at + 1] = index.hits(words.window_hashes(at, block), words.position[at] % block == 0)
                np.cumsum(hit, out=hit)
                whole = whole[hit[whole + window - block + 1] > hit[whole]]
            if not len(whole):
                continue
            doc = words.text[whole]
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False).astype(np.int64)
            h = words.window_hashes(whole, window)
            check = (hashes(sums_of(words.word_hashes(SEEDS[1]), BASES[1]), whole, whole + window, BASES[1]) >> U(32)).astype(np.uint32)
            order = np.lexsort((ids[doc], h))
            sorted_h, sorted_ids, sorted_check = h[order], ids[doc][order], check[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]]))
            run_of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
            before = sent.least(sorted_h[first], sorted_check[first])
            least = np.minimum(sorted_ids[first], before)
            repeat = np.empty(len(order), dtype=bool)
            repeat[order] = (sorted_ids > least[run_of]) & (sorted_check == sorted_check[first][run_of])
            new = sorted_ids[first] < before
            sent.add(sorted_h[first][new], sorted_check[first][new], sorted_ids[first][new])
            batch_no = int.from_bytes(hashlib.blake2b(ids.tobytes() + keys.tobytes(), digest_size=8).digest(), "little", signed=True)
            group = np.where(repeat, groups + batch_no % groups, (h % U(groups)).astype(np.int64))
            by = np.lexsort((whole, doc, group))
            group, doc, repeat, h, check, position = group[by], doc[by], repeat[by], h[by], check[by], words.position[whole][by].astype(np.uint32)
            rows = []
            for lo, hi in zip(cuts := np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]), [*cuts[1:], len(group)], strict=True):
                own, r = doc[lo:hi], repeat[lo:hi]
                used = np.unique(own)
                local = np.searchsorted(used, own)
                counts = np.stack([np.bincount(local[~r], minlength=len(used)), np.bincount(local[r], minlength=len(used))]).astype(np.int32)
                rows.append((int(group[lo]), batch_no, np.stack([ids[used], keys[used]]).tobytes(), counts.tobytes(), h[lo:hi][~r].tobytes(), check[lo:hi][~r].tobytes(), position[lo:hi][~r].tobytes(), position[lo:hi][r].tobytes()))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CANDIDATES.split(", ")])

    return in_tasks(docs.select("doc_id", "text_key", "text"), run, CANDIDATES)


def confirmed(rows: DataFrame) -> DataFrame:
    """Of each row of candidates, the windows that a document with a smaller doc_id has too: batch, docs, counts, positions."""

    def run(table: pa.Table) -> pa.Table:
        def column(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]

        docs, counts = [x.reshape(2, -1) for x in column("docs", np.int64)], [x.reshape(2, -1) for x in column("counts", np.int32)]
        ids, asked, repeats = np.concatenate([d[0] for d in docs]), np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts])
        doc = np.repeat(np.arange(len(ids)), asked)
        h, check, position = (np.concatenate(column(c, k)) for c, k in (("hashes", U), ("checks", np.uint32), ("positions", np.uint32)))
        order = np.lexsort((ids[doc], check, h))
        sh, sc, sid = h[order], check[order], ids[doc][order]
        first = np.concatenate([[True], (sh[1:] != sh[:-1]) | (sc[1:] != sc[:-1])])[: len(order)]  # of the entries with the same words
        later = order[sid > sid[np.flatnonzero(first)][np.cumsum(first) - 1]] if len(order) else order
        doc = np.concatenate([doc[later], np.repeat(np.arange(len(ids)), repeats)])
        position = np.concatenate([position[later], np.concatenate(column("repeats", np.uint32))])
        by = np.argsort(doc, kind="stable")
        position, found = position[by], np.bincount(doc, minlength=len(ids)).astype(np.int32)
        out, at, start = [], 0, 0
        for batch, own in zip(table.column("batch").to_pylist(), docs, strict=True):
            n = found[at : at + own.shape[1]]
            if size := int(n.sum()):
                out.append((batch, own[:, n > 0].tobytes(), n[n > 0].tobytes(), position[start : start + size].tobytes()))
            at, start = at + own.shape[1], start + size
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["batch", "docs", "counts", "positions"])

    ship(rows.sparkSession)
    return rows.groupBy("group_no").applyInArrow(run, CONFIRMED)


def stretches_of(positions: np.ndarray, window: int) -> np.ndarray:
    """First word and end of the stretches that windows at sorted positions cover, in turn."""
    new = np.flatnonzero(np.diff(positions) > window) + 1
    return np.stack([positions[np.concatenate([[0], new])], positions[np.concatenate([new - 1, [len(positions) - 1]])] + window], axis=1).astype(np.int32).ravel()


def per_document(rows: DataFrame, window: int) -> DataFrame:
    """Confirmed windows as stretches of words, one row per document of each batch: doc_id, text_key, stretches."""

    def run(table: pa.Table) -> pa.Table:
        docs = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in table.column("docs").to_pylist()], axis=1)
        counts = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in table.column("counts").to_pylist()])
        positions = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("positions").to_pylist()]).astype(np.int64)
        each = np.repeat(np.arange(len(counts)), counts)
        by = np.lexsort((positions, docs[1][each], docs[0][each]))
        ids, keys, positions = docs[0][each][by], docs[1][each][by], positions[by]
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(keys) != 0)) + 1])
        out = [stretches_of(positions[lo:hi], window).tobytes() for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        return pa.table([pa.array(ids[cuts]), pa.array(keys[cuts]), pa.array(out, pa.binary())], names=["doc_id", "text_key", "stretches"])

    return rows.groupBy("batch").applyInArrow(run, REMOVED)


def with_repeats(docs: DataFrame, column: str, window: int = WINDOW, most_filter_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """docs with a further column: first words and ends of the stretches to remove, as 32-bit integers in turn; null if none."""
    spark = docs.sparkSession
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    read = docs.select("doc_id", "text", key.alias("text_key"))
    blocks = saved(reference_blocks(read, window // 2), "reference-blocks")
    n_blocks = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    index = filter_of(blocks, n_blocks, most_filter_bits)
    found = index and spark.sparkContext.broadcast(index)  # at most most_filter_bits / 4 bytes
    groups = max(16, -(-n_blocks * (window // 2) // GROUP_WINDOWS))
    removed = per_document(confirmed(candidates(read, found, groups, window)), window)
    own_doc, own_key = free(docs, "_doc"), free(docs, "_key")
    per_doc = removed.groupBy(F.col("doc_id").alias(own_doc), F.col("text_key").alias(own_key)).agg(F.first("stretches").alias(column))  # equal rows have equal stretches
    return docs.join(per_doc, (F.coalesce("doc_id", F.lit(int(LAST))) == F.col(own_doc)) & (key == F.col(own_key)), "left").drop(own_doc, own_key)


def kept_words(text: bytes, found: bytes | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not found:
        return words, len(words)
    edges = [0, *np.frombuffer(found, dtype=np.int32).tolist(), len(words)]
    return [w for lo, hi in zip(edges[::2], edges[1::2], strict=True) for w in words[lo:hi]], len(words)


def removed_digests(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t or b"", f) for t, f in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in rows], pa.int64()), pa.array([n - len(w) for w, n in rows], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in rows])],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return in_tasks(with_repeats(docs.select("doc_id", "text"), "found", window, **options), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """docs without the repeats. A text that loses words is its other words joined by one space; others stay as they are. n_chars, if there, follows the text."""
    columns, own_found = docs.columns, free(docs, "_found")
    found = with_repeats(docs, own_found, window, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or not f else b" ".join(kept_words(t, f)[0]) for t, f in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(own_found).to_pylist(), strict=True)]
            own = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([own.get(c, batch.column(c)) for c in columns], names=columns)

    kept = in_tasks(found, run, T.StructType([docs.schema[c] for c in columns]))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else kept
