"""Fingerprints, hard negatives, manifests and top-k of repeated ids against plain brute force.

Tables have nulls, empty and very long texts, ties, repeated rows and columns with clashing names; empty tables are tried too.
"""

import hashlib
import random
import re
import zlib
from math import floor, isfinite

import pytest
from pyspark.sql import functions as F

from courtline.llm import bond, merkle, simhash, topk
from courtline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, label long, row long, tree long, _part string, digest string"


def doc_rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéßñAZ") for _ in range(r.randint(1, 7))) for _ in range(80)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(300)
    out = [(1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one two three"), (8, "one  two\nthree"), (9, text(20000) + "\n" + "x" * 50000), (None, base), (None, text(40)), (9, base), (12, base), (12, base), (13, "日本語 😀\x0b\x85 \xa0x y z\nw")]
    for k in range(40):  # near copies with ever more changes
        w = base.split()
        for at in r.sample(range(300), k % 8):
            w[at] = "changed"
        out.append((20 + k, " \n".join(w)))
    out += [(100 + k, text(r.randint(1, 60))) for k in range(120)]
    return [(d, t, r.choice(["en", None]), [None, "s1", "S", "é"][(d or 0) % 4] if d != 13 else "alone", r.choice([None, 5]), 1, 2, 3, 4, "a", "b") for d, t in out]


ROWS = doc_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, radius):
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                top[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("bucket_rows", "part_rows"), [(1024, 4096), (1, 4096), (1024, 16), (1, 2)])
def test_simhash(spark, docs, bucket_rows, part_rows):
    """Few and many bits of a bucket, and buckets cut into parts."""
    fps = [plain_fingerprint(r[1]) for r in ROWS]
    label = classes(fps, 4)
    least = {c: min((r[0] for r, x in zip(ROWS, label, strict=True) if x == c and r[0] is not None), default=None) for c in set(label)}
    want = [(r[0], f"{fp:016x}", least[c]) for r, fp, c in zip(ROWS, fps, label, strict=True)]
    assert len(set(label)) < len(set(fps)) < len(ROWS)
    got = simhash.near_duplicates(docs, bucket_rows=bucket_rows, part_rows=part_rows).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got)


def test_simhash_chains_and_empty(spark, docs):
    """A long chain of fingerprints, each four bits from the next, is one component, whatever the choice of blocks."""
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    r, chain = random.Random(5), [r0 := random.Random(4).getrandbits(64)]
    for _ in range(60):
        for b in r.sample(range(64), 4):
            r0 ^= 1 << b
        chain.append(r0)
    others = [r.getrandbits(64) for _ in range(200)]
    df = spark.createDataFrame([(simhash.signed(x),) for x in {*chain, *others}], "fp long")
    for bucket_rows in (1024, 16, 1):
        labels = {x["node"]: x["label"] for x in simhash.components(simhash.links(df, bucket_rows=bucket_rows, part_rows=8)).collect()}
        assert {labels[simhash.signed(x)] for x in chain} == {min(map(simhash.signed, chain))} and len(labels) == len(set(chain))


def test_masks_lose_no_link():
    r = random.Random(6)
    for n in (1, 10**6, 10**8, 10**10, 10**13):
        masks = simhash.masks(n)
        for _ in range(300):
            d = sum(1 << b for b in r.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)


VECTORS = "vec_id long, label int, embedding array<double>, row long, q string, score long"


def vector_rows():
    r = random.Random(8)
    out = [(i, r.randint(0, 3), [r.choice([-1, 1]) * r.random() for _ in range(8)]) for i in range(260)]
    out += [(50, 1, [0.5] * 8), (50, 1, [0.5] * 8), (50, 2, [0.25] * 8), (100, 2, None), (150, None, [1.0] * 8), (200, 1, []), (None, 1, [1.0] * 8), (300, 1, [float("nan")] * 8), (350, 1, [1.0, None]), (400, 1, [1.0, 2.0]), (401, 1, [1.0, 2.0]), (402, 2, [0.9, 1.5]), (403, 2, [float("inf"), 0.0])]
    out += [(500 + i, i % 2, [1.0 + i % 3, 2.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties
    return out


def usable(rows, scale):
    return [(n, i, label, [floor(scale * x) for x in v]) for n, (i, label, v) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and isfinite(x) for x in v)]


def plain_negatives(rows, scale=256):
    v, out = usable(rows, scale), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for n, i, label, q in v:
        if i % 50:
            continue
        scored = [(-dot(q, w), j, other) for m, j, other, w in v if m != n and len(w) == len(q)]
        for s, positive, _ in sorted(x for x in scored if x[2] == label)[:5]:
            found = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, positive, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16384, 37])
@pytest.mark.parametrize("scale", [256, 2**20, 2**26])
def test_hard_negatives(spark, block_rows, scale):
    """Scores in doubles, in 64-bit integers, and bounds beyond these."""
    rows = vector_rows()
    df = spark.createDataFrame([(*x[:2], x[2], 1, "a", 2) for x in rows], VECTORS).repartition(4)
    got = bond.hard_negatives(df, F.col("vec_id") % 50 == 0, scale=scale, block_rows=block_rows, anchor_rows=3)
    want = plain_negatives(rows, scale)
    assert len(want) > 30 and sorted(map(tuple, got.collect())) == want
    assert bond.hard_negatives(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, i % 2, [float(2**28 - i * 2**22), float(2**28 - 3 * i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = bond.hard_negatives(df, F.col("vec_id") % 50 == 0, scale=4)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 4) != []
    with pytest.raises(ValueError, match="too large"):
        bond.hard_negatives(spark.createDataFrame([(0, 0, [1e300])], "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 50 == 0)


def test_top_k_of_repeated_ids(spark):
    """Each row is a query for itself; it alone is barred from its answer."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 2.0]), (None, [9.0, 9.0]), (20, [2.0, 2.0]), (40, None)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3)
    want = []
    v = [(n, i, [floor(64 * x) for x in q]) for n, (i, q) in enumerate(rows) if i is not None and q]
    for n, i, q in v:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for m, j, w in v if m != n)[:3]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 12


def plain_manifest(rows, fan=3):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, lang, s, n: sha("".join(map(part, (d, s, lang, n, t))))

    def tree(nodes):
        """The root, and for each node its levels of (left, right) siblings."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for p, i in zip(paths, at, strict=True):
                run = level[i // fan * fan : i // fan * fan + fan]
                p.append((run[: i % fan], run[i % fan + 1 :]))
            level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
            at = [i // fan for i in at]
        return level[0], paths

    groups = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for g in groups:
        own = sorted((((x[0] is not None, x[0] or 0, leaf(*x[:5])), x) for x in rows if x[3] == g), key=lambda y: y[0])
        root, paths = tree([k[2] for k, _ in own])
        made.append((root, [(k[2], x, p) for (k, x), p in zip(own, paths, strict=True)]))
    root, above = tree([m[0] for m in made])
    out = []
    for (subroot, own), up in zip(made, above, strict=True):
        for digest, x, path in own:
            given = digest
            if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 2 == 0 and x[1] is not None:
                given = leaf(x[0], x[1].replace("\n", ""), x[2], x[3], x[4])
            for left, right in path + up:
                given = sha("".join([*left, given, *right]))
            out.append((x[0], digest, subroot, root, sha("".join(d for left, right in path + up for d in left + right)), given, given == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("levels", [6, 1, 2])
def test_manifest(spark, docs, levels):
    """Trees of one pass and of several, groups of one row, repeated rows."""
    cut = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    got = merkle.manifest(docs, tampered=cut, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, levels=levels)
    want = plain_manifest([x[:5] for x in ROWS])
    assert sorted(str(tuple(x)) for x in got.collect()) == want
    assert {x.endswith("True)") for x in want} == {True, False}


def test_manifest_edges(spark, docs):
    assert merkle.manifest(docs.where("false")).count() == 0
    same = spark.createDataFrame([ROWS[12]] * 900 + [ROWS[0]], DOCS)  # segments with equal digests
    assert sorted(str(tuple(x)) for x in merkle.manifest(same, levels=2).select("doc_id", "leaf", "subroot", "root", "proof_sha256").distinct().collect()) == sorted({str(eval(x)[:5]) for x in plain_manifest([ROWS[12][:5]] * 900 + [ROWS[0][:5]])})
    lone = merkle.manifest(spark.createDataFrame([ROWS[3]], DOCS)).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] == lone["folded_root"] and lone["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_wrong_records_are_an_error():
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(20)]
    top, records = merkle.segment(nodes, 3, 3)
    path = merkle.descent(top, nodes[7], 7, 3, 3, records)
    assert merkle.folded(nodes[7], path) == top != merkle.folded(nodes[8], path)
    with pytest.raises(ValueError, match="do not lead"):
        merkle.descent(top, nodes[8], 7, 3, 3, records)


def test_queries_of_whole_tables(spark):
    """op11 on the smallest tables against brute force over all pairs."""
    at = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    label = classes(fps, 4)
    least = {c: min(r["doc_id"] for r, x in zip(rows, label, strict=True) if x == c) for c in set(label)}
    want = sorted((r["doc_id"], f"{fp:016x}", least[c]) for r, fp, c in zip(rows, fps, label, strict=True))
    assert sorted(map(tuple, QUERIES["op11_simhash"](spark, at).collect())) == want
