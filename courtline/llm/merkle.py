"""A Merkle manifest of a dataset, and proofs of its rows by descent of the digests' graph.

A row's digest is the leaf. The leaves of a group, in order, make a tree: every `fan` consecutive nodes
become the digest of their concatenation, level by level, until one node remains, the subroot; the
subroots, in order of their groups, make the root's tree in the same way.

Trees are built in passes of `levels` levels. A pass cuts a tree's nodes into segments of
fan ** levels consecutive ones, makes each segment's top, which is a node of the next pass, and
stores what it made as records: a digest and the digests of its children. A proof descends from the
root: in a segment, requests for its nodes start at its top, look up a digest's children, go on with
the one that the next digit of the node's rank names, and collect the others, down to the node; the
path segment is reversed, so that siblings come from the bottom up. The tops of a pass are requests of
the pass above, whose path is appended. So a group in a task holds one segment: at most
fan ** levels nodes, their records and one path from above, however many rows a group has and
however many are equal, and a row's path is made once, in the last step. A request that does not end at
its own digest is an error.

Ranks come from a sort by ranges, in which each range counts its rows of each group; nothing is
numbered in one task, collected or broadcast. Steps are written to the shared folder.

Nulls: a null value is `-` in the leaf; a null group comes first, as does a null doc_id; rows equal in
group and doc_id are in order of their leaves. A row with a null doc_id is not tampered with. Texts are
read whole, however long; a lone leaf is its group's subroot and has no sibling there. An empty table
gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from .common import saved

FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest.
SIZE = 32


def sized_value(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(sized_value, fields)).cast("binary"), 256))


def joined(digests: Sequence[bytes]) -> bytes:
    """The digest of digests, taken as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def split(packed: bytes) -> list[bytes]:
    return [packed[i : i + SIZE] for i in range(0, len(packed), SIZE)]


def height(n: int, fan: int) -> int:
    """Levels above n leaves."""
    levels, width = 0, 1
    while width < n:
        levels, width = levels + 1, width * fan
    return levels


def segment(digests: list[bytes], levels: int, fan: int) -> tuple[bytes, dict[bytes, bytes]]:
    """The top of a segment's nodes that many levels up, and the records of the digests in it."""
    records: dict[bytes, bytes] = {}
    for _ in range(levels):
        runs = [digests[i : i + fan] for i in range(0, len(digests), fan)]
        digests = [joined(r) for r in runs]
        records |= {d: b"".join(r) for d, r in zip(digests, runs, strict=True)}
    return digests[0], records


def descent(top: bytes, node: bytes, place: int, levels: int, fan: int, records: dict[bytes, bytes]) -> bytes:
    """The path segment from a segment's node, at its place, up to its top: for each level how many siblings stand left and right, and these."""
    at, path = top, []
    for level in range(levels - 1, -1, -1):
        children = split(records[at])
        digit = place // fan**level % fan
        path.append(bytes([digit, len(children) - digit - 1]) + b"".join(children[:digit] + children[digit + 1 :]))
        at = children[digit]
    if at != node:
        raise ValueError("the records do not lead to the digest of a requested node")
    return b"".join(reversed(path))


def steps(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Left and right siblings of each level of a path."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        siblings = split(path[at + 2 : at + 2 + SIZE * (left + right)])
        at += 2 + SIZE * (left + right)
        yield siblings[:left], siblings[left:]


def folded(node: bytes, path: bytes) -> bytes:
    """The root that a node and the siblings of a path give."""
    for left, right in steps(path):
        node = joined([*left, node, *right])
    return node


def proof(path: bytes) -> bytes:
    """The digest of all siblings of a path."""
    return joined([d for left, right in steps(path) for d in (*left, *right)])


def ranked(rows: DataFrame, group: str, order: Sequence[Column], label: str) -> DataFrame:
    """rows, written, with rank: 0 and on in order within a group, a column that is never null; and n: the rows of the group.

    Rows that are equal in the order are spread over ranges, as they may be many.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = rows.withColumn("_spread", F.rand(7))
    keys = [F.col(group), *order, F.col("_spread")]
    placed = saved(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_spread").withColumn("_part", part).withColumn("_at", at), label)
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    counts = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    return placed.join(counts, [group, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"), "n")


RECORD = "tree long, seg long, kind int, n long, levels int, digest binary, children binary"
#: What a row of a segment is.
TOP, STORED, ASKED = 0, 1, 2


def one_pass(nodes: DataFrame, levels: int, fan: int) -> DataFrame:
    """The records of a pass: for each segment its top and n, the nodes that its tree has in the next pass, and all digests with their children."""
    width = fan**levels

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, seg = key[0].as_py(), key[1].as_py()
        table = table.sort_by("rank")
        n = table.column("n")[0].as_py()
        high = min(levels, height(n, fan))
        top, records = segment(table.column("digest").to_pylist(), high, fan)
        digests, children = [top, *records], [None, *records.values()]
        k = len(digests)
        return pa.table({
            "tree": pa.array([tree] * k, pa.int64()), "seg": pa.array([seg] * k, pa.int64()), "kind": pa.array([TOP] + [STORED] * (k - 1), pa.int32()), "n": pa.array([-(-n // width)] * k, pa.int64()),
            "levels": pa.array([high] * k, pa.int32()), "digest": pa.array(digests, pa.binary()), "children": pa.array(children, pa.binary()),
        })

    ship(nodes.sparkSession)
    return nodes.withColumn("seg", F.floor(F.col("rank") / width).cast("long")).groupBy("tree", "seg").applyInArrow(run, RECORD)


class Trees:
    """The trees over nodes (tree, n, rank, digest and more), built in passes and stored as records."""

    def __init__(self, nodes: DataFrame, levels: int, fan: int, label: str):
        self.levels, self.fan, self.label = levels, fan, label
        self.nodes, self.records = [nodes], []
        most = nodes.agg(F.max("n")).first()[0] or 1
        while True:
            self.records.append(saved(one_pass(self.nodes[-1], levels, fan), f"{label}-records"))
            most = -(-most // fan**levels)
            if most == 1:
                break
            self.nodes.append(self.tops(-1).select("tree", "n", F.col("seg").alias("rank"), "digest"))

    def tops(self, k: int) -> DataFrame:
        return self.records[k].where(F.col("kind") == TOP).drop("kind", "children")

    def roots(self) -> DataFrame:
        return self.tops(-1).select("tree", "digest")

    def descended(self, above: DataFrame, carried: Sequence[str], finish: Callable[[list[dict]], dict[str, pa.Array]], schema: str) -> DataFrame:
        """What finish makes of the nodes of a segment, each with its path up from it and its tree's head. above: tree, head and path of the roots."""
        tops = self.tops(-1).join(above, "tree")
        for k in range(len(self.nodes) - 1, 0, -1):
            found = saved(self.in_segments(k, tops, (), paths_of, "tree long, rank long, head binary, path binary"), f"{self.label}-paths")
            tops = self.tops(k - 1).join(found.withColumnRenamed("rank", "seg"), ["tree", "seg"])
        return self.in_segments(0, tops, carried, finish, schema)

    def in_segments(self, k: int, tops: DataFrame, carried: Sequence[str], finish: Callable[[list[dict]], dict[str, pa.Array]], schema: str) -> DataFrame:
        """Descents to the nodes of pass k. A group holds a segment's top with its path, its records, and its nodes."""
        levels, fan = self.levels, self.fan
        width = fan**levels
        nodes = self.nodes[k]
        none = lambda kind: F.lit(None).cast(kind)
        columns = ["tree", "seg", "what", "levels", "rank", "digest", "data", "head"]
        stored = {"what": F.lit(STORED), "levels": none("int"), "rank": none("long"), "data": F.col("children"), "head": none("binary")}
        first = {"what": F.lit(TOP), "rank": none("long"), "data": F.col("path")}
        asked = {"seg": F.floor(F.col("rank") / width).cast("long"), "what": F.lit(ASKED), "levels": none("int"), "data": none("binary"), "head": none("binary")}
        more = {c: none(nodes.schema[c].dataType) for c in carried}
        every = nodes.withColumns(asked).select(*columns, *carried)
        every = every.unionByName(self.records[k].where(F.col("kind") == STORED).withColumns(stored | more).select(*columns, *carried))
        every = every.unionByName(tops.withColumns(first | more).select(*columns, *carried))

        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            start = next(r for r in rows if r["what"] == TOP)
            records = {r["digest"]: r["data"] for r in rows if r["what"] == STORED}
            requests = [r for r in rows if r["what"] == ASKED]
            for r in requests:
                r |= {"head": start["head"], "path": descent(start["digest"], r["digest"], r["rank"] % width, start["levels"], fan, records) + start["data"]}
            return pa.table(finish(requests))

        ship(nodes.sparkSession)
        return every.groupBy("tree", "seg").applyInArrow(run, schema)


def paths_of(rows: list[dict]) -> dict[str, pa.Array]:
    column = lambda c, kind: pa.array([r[c] for r in rows], kind)
    return {"tree": column("tree", pa.int64()), "rank": column("rank", pa.int64()), "head": column("head", pa.binary()), "path": column("path", pa.binary())}


def leaves(docs: DataFrame, group: str, fields: Sequence[str], tampered: dict[str, Column], when: Column) -> DataFrame:
    """doc_id, group, digest (the leaf) and other (the leaf with the tampered columns, where that is asked for)."""
    other = leaf([tampered.get(c, F.col(c)) for c in fields])
    return docs.select("doc_id", F.col(group).alias("group"), leaf([F.col(c) for c in fields]).alias("digest"), F.when(when, other).alias("other"))


def manifest(docs: DataFrame, group: str = "source", fields: Sequence[str] = FIELDS, tampered: dict[str, Column] | None = None, when: Column | None = None, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf where `when` holds) and verified."""
    when = F.coalesce(when, F.lit(False)) if when is not None else F.lit(False)
    rows = saved(leaves(docs, group, fields, tampered or {}, when), "leaves")
    # Groups are numbered by their place, null first; strings are in order of their bytes.
    one = F.lit(0).cast("long")
    groups = saved(ranked(rows.select("group").distinct().withColumn("tree", one), "tree", [F.asc_nulls_first("group")], "groups"), "numbered-groups")
    numbers = groups.select(F.col("group").alias("_group"), F.col("rank").alias("tree"))
    numbered = rows.join(numbers, F.col("group").eqNullSafe(F.col("_group"))).drop("group", "_group")
    nodes = saved(ranked(numbered, "tree", [F.asc_nulls_first("doc_id"), F.col("digest")], "ranges"), "ranked-leaves")
    within = Trees(nodes, levels, fan, "leaf")
    subroots = within.roots().join(groups.select(F.col("rank").alias("tree"), "n"), "tree")
    over = Trees(saved(subroots.select(one.alias("tree"), "n", F.col("tree").alias("rank"), "digest"), "subroots"), levels, fan, "group")

    # The root's path is empty; a subroot's path goes on where its group's ends. A head is the root, or the subroot and the root.
    start = over.roots().select("tree", F.col("digest").alias("head"), F.lit(b"").alias("path"))

    def of_subroots(rows: list[dict]) -> dict[str, pa.Array]:
        return paths_of([{"tree": r["rank"], "rank": 0, "head": r["digest"] + r["head"], "path": r["path"]} for r in rows])

    above = saved(over.descended(start, (), of_subroots, "tree long, rank long, head binary, path binary").drop("rank"), "subroot-paths")
    kind = docs.schema["doc_id"].dataType
    digests = ("leaf", "subroot", "root", "proof_sha256", "folded_root")

    def of_leaves(rows: list[dict]) -> dict[str, pa.Array]:
        made = [(r["digest"], r["head"][:SIZE], r["head"][SIZE:], proof(r["path"]), folded(r["other"] or r["digest"], r["path"])) for r in rows]
        return {"doc_id": pa.array([r["doc_id"] for r in rows], to_arrow_type(kind))} | {c: pa.array([m[i].hex() for m in made], pa.string()) for i, c in enumerate(digests)}

    proofs = within.descended(above, ("doc_id", "other"), of_leaves, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} string" for c in digests))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
