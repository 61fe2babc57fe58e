"""Near-duplicate classes by BagMinHash signatures.

A document is the multiset of its shingles of five words (all its words, if fewer). Its signature
has one value for each of `components`: the least point, in that component, of Poisson processes
over the levels of its shingles' counts; points above a count are left out. Two documents agree in a
component with probability equal to the sum of the smaller counts over that of the larger ones.
The processes are hierarchical: level 1 of a shingle is a process of its own, and all levels above
it, up to 2^31, are one process. A process is split in halves at its first point, if that point can
still matter: one half keeps the point, the other draws its own, and halves above the count go. A
single level is not split; its points come in rising order until one exceeds all values of the
document's signature. The points depend on the shingle alone, so documents share them.

Signatures are cut into bands. Documents that share a band are compared: each with the band's first
one, and then, in bands that still hold several classes, those outside its largest class with all
of another class, in blocks. A pair is a link if its multisets overlap to `threshold` or more,
checked on the shingles themselves; classes are the connected components of links. So a band of n
similar texts takes about n comparisons, and no link that would join two classes is missed; what
grows faster is only the comparison of a band's stragglers with its members, inside tasks. Equal
texts are one node from the start.

Nothing is collected or broadcast by this code; steps are written to the shared folder. Copies of a
text are put together within tasks before texts are dealt, and joins on a band, a class or a hub of
links have plain tables on both sides, so that Spark's adaptive skew join deals a large one to many
tasks.

Nulls: a null text is an empty one. Texts without words are alike only if equal. Texts are read
whole, however long. Rows may repeat, and a doc_id may come with several texts: each row gets its
text's class. Empty tables give empty results. Only doc_id and text are read; other columns may have
any name and are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import free, in_tasks, saved
from .substring import Words, batches_of_texts, mixed

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
#: Texts of a block: of those outside their band's largest class, and of all that they are compared with.
OTHERS, MEMBERS = 256, 512

U = np.uint64
STEP, PLACE, FIRST, SPLIT = U(0x9E3779B97F4A7C15), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)
#: So few running processes make several points at once.
FEW, AT_ONCE = 30_000, 24


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the different shingles of each text, ordered by text and hash."""
    words = Words(texts)
    at = words.windows(SHINGLE)
    sizes = np.diff(words.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    hashes = [words.window_hashes(at, SHINGLE), *(words.window_hashes(words.bounds[i : i + 1], int(sizes[i])) for i in short)]
    text, h = np.concatenate([words.text[at], short]), np.concatenate(hashes)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])[: len(h)])
    return text[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def uniform(bits: np.ndarray) -> np.ndarray:
    return ((mixed(bits) >> U(11)).astype(np.float64) + 0.5) / 2.0**53


class Signatures:
    """The signatures of n texts while points come; infinite where a text has none yet."""

    def __init__(self, n: int, components: int):
        self.n, self.components, self.values = n, components, np.full(n * components, np.inf)

    def matter(self, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether points can still be the least of a component."""
        return x < self.values.reshape(self.n, self.components).max(axis=1)[doc]

    def levels(self, doc: np.ndarray, state: np.ndarray, x: np.ndarray) -> None:
        """Takes the points of processes of one level, of which x is the first."""
        while len(doc):
            k = AT_ONCE if len(doc) < FEW else 1
            steps = state[:, None] + STEP * np.arange(1, k + 1, dtype=U)
            gaps = -np.log(uniform(steps)) / self.components
            points = np.cumsum(np.concatenate([x[:, None], gaps], axis=1), axis=1)
            component = ((mixed(steps ^ PLACE) >> U(32)) * U(self.components) >> U(32)).astype(np.int64)
            np.minimum.at(self.values, (doc[:, None] * self.components + component).ravel(), points[:, :-1].ravel())
            x, state = points[:, -1], steps[:, -1]
            running = self.matter(doc, x)
            doc, state, x = doc[running], state[running], x[running]


def process_state(h: np.ndarray, low: np.ndarray | int, width: int) -> np.ndarray:
    """What the draws of the process over levels low + 1 to low + width of a shingle follow from."""
    return mixed(h ^ mixed(np.atleast_1d(low).astype(U) * PLACE + U(width)))


def first_gap(state: np.ndarray, components: int, width: int) -> np.ndarray:
    return -np.log(uniform(state ^ FIRST)) / (components * float(width))


def signatures(n: int, text: np.ndarray, h: np.ndarray, count: np.ndarray, components: int = BANDS * ROWS) -> np.ndarray:
    """The signatures of n texts; infinite where a text has no shingle."""
    out = Signatures(n, components)
    state = process_state(h, 0, 1)
    out.levels(text, state, first_gap(state, components, 1))
    several = np.flatnonzero(count > 1)
    doc, h, count, low, width = text[several], h[several], count[several], np.ones(len(several), dtype=np.int64), 1 << 31
    x = first_gap(process_state(h, low, width), components, width)
    while width > 1 and len(doc):
        alive = out.matter(doc, x)
        doc, h, count, low, x = doc[alive], h[alive], count[alive], low[alive], x[alive]
        right = mixed(process_state(h, low, width) ^ SPLIT) >> U(63) == 1
        width //= 2
        holder, other = np.where(right, low + width, low), np.where(right, low, low + width)
        later = x + first_gap(process_state(h, other, width), components, width)
        doc, h, count = np.tile(doc, 2), np.tile(h, 2), np.tile(count, 2)
        low, x = np.concatenate([holder, other]), np.concatenate([x, later])
        below = low < count
        doc, h, count, low, x = doc[below], h[below], count[below], low[below], x[below]
    out.levels(doc, process_state(h, low, 1), x)
    return out.values.reshape(n, components)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signature).view(U).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=U)), bits.shape[:2])
    for r in range(ROWS):
        key = mixed(key ^ bits[:, :, r]) + STEP
    return key.view(np.int64)


def node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def bands(docs: DataFrame) -> DataFrame:
    """band and node, once each: the bands of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches):
            text, h, count = shingles(texts)
            some = np.unique(text)
            keys = band_keys(signatures(len(texts), text, h, count)[some])
            nodes = batch.column("node").take(pa.array(np.repeat(some, BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), nodes], names=["band", "node"])

    return in_tasks(docs.select(node(F.col("text")).alias("node"), "text"), run, "band long, node binary").distinct()


def multisets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingles (32-bit hashes and counts, as bytes) of the wanted nodes. Copies of a text become one in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches):
            text, h, count = shingles(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            rows = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = (h[lo:hi] >> U(32)).astype(np.uint32)  # in order, as h is
                more = np.flatnonzero(count[lo:hi] > 1)
                rows.append((own.tobytes(), np.stack([more, count[lo:hi][more]]).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]], names=["node", "hashes", "counts"])

    texts = docs.select(node(F.col("text")).alias("node"), "text").groupBy("node").agg(F.first("text").alias("text"))
    return in_tasks(texts.join(wanted.hint("merge"), "node", "left_semi"), run, "node binary, hashes binary, counts binary")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over that of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=False, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / max(1, int(a[1].sum() + b[1].sum()) - least)


def unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, dtype=np.uint32)
    at, more = np.frombuffer(counts, dtype=np.int32).reshape(2, -1)
    n = np.ones(len(h), dtype=np.int64)
    n[at] = more
    return h, n


def links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose multisets overlap to threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *rest = (batch.column(c).to_pylist() for c in ("a", "b", "a_hashes", "a_counts", "b_hashes", "b_counts"))
            yes = [i for i, (ah, ac, bh, bc) in enumerate(zip(*rest, strict=True)) if overlap(unpacked(ah, ac), unpacked(bh, bc)) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in yes], pa.binary()) for x in (a, b)], names=["a", "b"])

    of = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes"), F.col("counts").alias(f"{c}_counts"))
    return in_tasks(pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a"), run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its connected component) of the nodes in edges a, b.

    Every round points each node to its least neighbour if that is less, follows the pointers once
    more, and contracts the edges; each keeps only edges between different nodes.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(edges.where("a <> b").distinct(), "edges")
    labels = saved(both(edges).select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        near = both(edges).groupBy("a").agg(F.min("b").alias("b"))
        up = saved(near.select(F.col("a").alias("from"), F.least("a", "b").alias("to")), "up")
        twice = up.alias("x").join(up.alias("y"), F.col("x.to") == F.col("y.from")).select(F.col("x.from").alias("from"), F.col("y.to").alias("to"))
        step = saved(twice, "step")
        moved = lambda rows, c, step=step: rows.join(step, rows[c] == step["from"], "left").withColumn(c, F.coalesce("to", c)).drop("from", "to")
        edges = saved(moved(moved(edges, "a"), "b").where("a <> b").distinct(), "edges")
        labels = saved(moved(labels, "label"), "labels")
    return labels


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def extended(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after further links: the links' classes are joined, other classes stay."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    edges = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    step = components(edges).select(F.col("node").alias("old"), F.col("label").alias("new"))
    every = labels.unionByName(new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    return saved(every.join(step, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def further_links(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between members of a band that are in different classes.

    In every band of several classes, those outside its largest class are compared with all of other
    classes. They meet in blocks: at most OTHERS of the ones and MEMBERS of the others a block, so no
    task holds a band. Pairs stay in the task; what leaves it are links that join two classes, fewer
    than the classes that it sees.
    """
    known = labelled(members, labels)
    classes = known.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", "label"))
    mixed_bands = classes.groupBy("band").agg(top["label"].alias("largest"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), (F.sum("n") - top["n"]).alias("others")).where("classes > 1 and n > 2")
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    mixed_bands = saved(mixed_bands.select("band", "largest", parts("others", OTHERS).alias("ys"), parts("n", MEMBERS).alias("xs")), "mixed-bands")
    rows = saved(known.join(mixed_bands, "band"), "open")
    deals = max(256, rows.count() // 1000)
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 20)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ys = rows.where("label <> largest").select("band", "node", "label", F.lit(True).alias("other"), (place % F.col("ys")).alias("y_part"), every("xs").alias("x_part"))
    xs = rows.select("band", "node", "label", F.lit(False).alias("other"), every("ys").alias("y_part"), (place % F.col("xs")).alias("x_part"))
    dealt = ys.unionByName(xs).join(sets, "node").withColumn("deal", F.when((F.col("y_part") == 0) & (F.col("x_part") == 0), F.pmod("band", F.lit(deals))).otherwise(F.xxhash64("band", "y_part", "x_part")))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["band"], r["y_part"], r["x_part"]))
        joined: dict[bytes, bytes] = {}
        found = [x for _, block in groupby(rows, key=lambda r: (r["band"], r["y_part"], r["x_part"])) for x in block_links(list(block), threshold, joined)]
        return pa.table([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    ship(members.sparkSession)
    return dealt.groupBy("deal").applyInArrow(run, "a binary, b binary").distinct()


def block_links(rows: list[dict], threshold: float, joined: dict[bytes, bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Links of the others of a block with its members that join two classes; joined: the classes that this task has joined so far."""

    def top(label: bytes) -> bytes:
        while (up := joined.get(label, label)) != label:
            label = up
        return label

    xs = [r for r in rows if not r["other"]]
    sets = [unpacked(r["hashes"], r["counts"]) for r in xs]
    hashes, counts, owner = np.concatenate([h for h, _ in sets]), np.concatenate([n for _, n in sets]), np.repeat(np.arange(len(xs)), [len(h) for h, _ in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, counts, owner = hashes[order], counts[order], owner[order]
    sizes = np.array([n.sum() for _, n in sets])
    for r in rows:
        if r["other"]:
            h, n = unpacked(r["hashes"], r["counts"])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
            common = np.bincount(owner[at], weights=np.minimum(counts[at], np.repeat(n, hi - lo)), minlength=len(xs))
            linked = np.flatnonzero(common >= threshold * (sizes + n.sum() - common))
            for i in linked:
                if (a := top(r["label"])) != (b := top(xs[i]["label"])):
                    joined[max(a, b)] = min(a, b)
                    yield r["node"], xs[i]["node"]


def class_labels(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node and label of the texts that have a link."""
    every = saved(bands(docs), "bands")
    firsts = every.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "first")
    firsts = saved(firsts, "firsts")
    members = saved(every.join(firsts, "band"), "members")
    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    members = members.select("band", "node")
    sets = saved(multisets(docs, members.select("node").distinct()), "multisets")
    labels = components(links(pairs, sets, threshold))
    return extended(labels, saved(further_links(members, labels, sets, threshold), "links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class, null if all are null), class_size (rows of its class)."""
    rows = docs.select("doc_id", node(F.col("text")).alias("node"))
    own = saved(labelled(rows, class_labels(docs, threshold)).select("doc_id", "label"), "classes")
    classes = saved(own.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class-sizes")
    return own.join(classes, "label").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: of those with the least doc_id (nulls last) that whose text is least."""
    label = labelled(docs.select("doc_id", "text").withColumn("node", node(F.col("text"))), class_labels(docs, threshold)).select("doc_id", "node", "label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    own, own_doc, own_node = free(docs, "_own"), free(docs, "_doc"), free(docs, "_node")
    keep = label.groupBy("label").agg(F.min(order).alias("keep")).select(F.col("keep.doc_id").alias(own_doc), F.col("keep.node").alias(own_node)).distinct()
    kept = docs.withColumn(own, node(F.col("text"))).join(keep, F.col("doc_id").eqNullSafe(F.col(own_doc)) & (F.col(own) == F.col(own_node)), "left_semi")
    # Only rows equal in doc_id and text are left to tell apart.
    return kept.dropDuplicates(["doc_id", own]).drop(own)
