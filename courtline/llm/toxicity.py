"""Toxicity by noisy-channel deobfuscation.

A word that may be disguised (digits or signs for letters, signs between letters, letters drawn
out, letters set apart by spaces) is a lattice: at each place the letters that may have been meant,
nothing for a sign put between, one or two letters for a run of two or more. A run of short tokens is
one lattice, in which every space may be one or none, so the words within it are decoded too. Viterbi
decoding finds the likeliest reading under a trigram model of letters, counted over all documents, and
the channel's costs. The
restored words are scored: a word's weight is that of the most telling of itself and its beginnings. A
word's or beginning's weight is its log odds, by how many toxic and
clean labelled documents have it; it counts if it is above 0 by Z standard errors, so that what few
documents have tells nothing and need not be kept. A beginning counts only if at
least SUPPORT different restored words that count share it: one word that begins so
says nothing of others, which the sample may not hold. The two largest weights of a text
become a probability by logistic calibration on labelled documents outside fold 0 that gave no
weights.

Weights come from the whole texts of at most SAMPLE labelled documents, one of each set of near copies; letters are counted over,
and scores are of, all whole texts. Null and empty texts have no words and get the score of such
texts. Without labels of both kinds every score is the share of label 1, or 0. Of several labels of
a document the largest counts; repeated rows get equal scores. An empty table gives an empty result.
Only doc_id and text are read; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memory, in_slices
from .common import in_tasks, saved
from .labelled import fold, logistic, probability, sample

SAMPLE = {1: 3000, 0: 6000}
#: Standard errors by which log odds must be above 0.
Z = 3.0
BEGINNINGS = (4, 5, 6)
#: Log odds beyond which more evidence adds nothing.
ENOUGH = 5.0
#: Different telling words that a beginning must have.
SUPPORT = 3
THRESHOLD = 0.5
#: Bytes that a worker's memories may take, about.
WORD_BYTES = 160_000_000
STRETCH_BYTES = 60_000_000

# Signs that stand for letters.
MEANT = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
BETWEEN = set(".-_*~'`^,:;/\\=#&%")
SUBSTITUTED, DROPPED, KEPT_SIGN, DRAWN, DOUBLED = 1.0, 0.7, 6.0, 0.3, 2.0

#: Letters of the model: 0 is any other byte, 1 to 26 are a to z, 27 is a byte of another letter.
CLASSES = 28
CLASS = np.zeros(256, dtype=np.int64)
CLASS[ord("a") : ord("z") + 1] = CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
CLASS[128:] = 27

EDGE_SIGNS = re.compile(r"^[^\w@$]+|[^\w@$]+$")
PLAIN = re.compile(r"[^\W\d_]*")
REPEATED = re.compile(r"(.)\1")
SET_APART = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
#: Tokens of up to three characters next to each other; what tells that some of them may be parts of one word.
STRETCH = re.compile(r"(?<!\S)\S{1,3}(?!\S)(?:\s+\S{1,3}(?!\S))++")
APART = re.compile(r"(?<!\S)\S(?!\S)|[^\w\s]|\d")
LETTER = re.compile(r"[^\W\d_]")


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents, by class: 28 x 28 x 28. Tasks send one table each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in in_slices(batches, "text"):
            data = CLASS[np.frombuffer(b"\n\n".join(x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()), dtype=np.uint8)]
            if len(data) > 2:
                total += np.bincount((data[:-2] * CLASSES + data[1:-1]) * CLASSES + data[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    rows = in_tasks(docs.select("text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 28^3
    out = np.zeros(CLASSES**3)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(CLASSES, CLASSES, CLASSES)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(letter | two before), smoothed by the bigram and the unigram."""
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + CLASSES)
    two = (counts.sum(axis=0) + 5 * one) / (counts.sum(axis=(0, 2))[:, None] + 5)
    three = (counts + 5 * two[None]) / (counts.sum(axis=2)[:, :, None] + 5)
    return np.log(three)


def letter_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if LETTER.match(c) else 0


#: A reading, its cost, and the classes of its letters.
Place = tuple[tuple[str, float, tuple[int, ...]], ...]


def place_of(c: str, n: int) -> Place:
    """The readings of a run of n times c."""
    if LETTER.match(c):
        one = [(c, 0.0)] if n == 1 else [(c, DOUBLED), (c * 2, 0.0)] if n == 2 else [(c, DRAWN), (c * 2, DRAWN)]
    else:
        one = [(x * k, SUBSTITUTED + (DRAWN if k != n else 0)) for x in MEANT.get(c, "") for k in range(1, min(n, 2) + 1)]
        one += [("", DROPPED)] if c in BETWEEN else []
        one += [(c * n, KEPT_SIGN * min(n, 3))]
    return tuple((x, cost, tuple(map(letter_class, x))) for x, cost in one)


few_of = lru_cache(maxsize=4096)(place_of)
#: A space that was meant, or one that sets letters apart; NOTHING marks where it was.
NOTHING = "\0"
SPACE: Place = ((" ", 0.0, (0,)), (NOTHING, DROPPED, ()))


def lattice(word: str) -> list[Place]:
    """The readings of each place of a word, with their costs; a run of one sign is one place."""
    return [(few_of if len(m[0]) < 9 else place_of)(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", word, re.S)]


def stretch_lattice(tokens: list[str]) -> list[Place]:
    """One lattice for tokens with spaces between; a token of signs may also be nothing."""
    places = []
    for i, token in enumerate(tokens):
        places += [SPACE] if i else []
        word = EDGE_SIGNS.sub("", token)
        if word:
            places += lattice(word)
        elif any(c in MEANT for c in token):
            places += [(*p, ("", DROPPED, ())) for p in lattice(token)]
    return places


def likeliest(places: list[Place], model: list) -> str:
    """Viterbi over a lattice, with the last two letters as state."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for place in places:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        if len(states) == len(place) == 1:  # no choice: the cost is the same for all that follows
            ((x, y), (cost, path)), (reading, _, classes) = next(iter(states.items())), place[0]
            for z in classes:
                x, y = y, z
            states = {(x, y): (cost, (path, reading))}
            continue
        for (a, b), (cost, path) in states.items():
            for reading, extra, classes in place:
                x, y, total = a, b, cost + extra
                for z in classes:
                    total -= model[x][y][z]
                    x, y = y, z
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (path, reading))
        states = new
    best = min(((cost - model[a][b][0], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])[1]
    parts = []
    while best:
        best, reading = best
        parts.append(reading)
    return "".join(reversed(parts))


def restored(word: str, model: list) -> str:
    """The likeliest reading of a word."""
    return likeliest(lattice(word), model)


class Reader:
    """The words of texts as they were meant."""

    def __init__(self, model: list):
        self.model, self.stretches = model, Memory(STRETCH_BYTES)

    def readings(self, token: str) -> list[str]:
        """A token without signs at its edges, and what it may stand for."""
        word = EDGE_SIGNS.sub("", token.lower())
        if not word or (PLAIN.fullmatch(word) and not REPEATED.search(word)):
            return [word] if word else []
        if not LETTER.search(word):
            return [word]
        return list(dict.fromkeys([word, *PLAIN.findall(word), restored(word, self.model)]))

    @staticmethod
    def joined(text: str) -> list[str]:
        """Words whose letters are set apart by spaces."""
        return [m[0].replace(" ", "") for m in SET_APART.finditer(text)]

    def decoded(self, stretch: str) -> tuple[str, ...]:
        """The words of a run of short tokens that are put together from several."""
        words = (w.strip(NOTHING) for w in likeliest(stretch_lattice(stretch.split()), self.model).split(" "))
        return tuple(w.replace(NOTHING, "") for w in words if NOTHING in w)

    def tokens(self, texts: list[str]) -> list[set[str]]:
        """The tokens of each text, and the words that spaces set apart."""
        runs = [[m[0].lower() for m in STRETCH.finditer(t) if APART.search(m[0])] for t in texts]
        asked = list({x for own in runs for x in own})
        known = dict(zip(asked, self.stretches.answers(asked, lambda new: list(map(self.decoded, new))), strict=True))
        return [set(t.split()).union(Reader.joined(t), *map(known.__getitem__, own)) for t, own in zip(texts, runs, strict=True)]


def features(word: str) -> set[str]:
    return {word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)}


@dataclass(frozen=True)
class Model:
    letters: list
    weights: dict
    calibration: tuple[float, ...]
    share: float


class Scorer:
    """The largest weights of texts, with a bounded memory of tokens."""

    def __init__(self, model: Model):
        self.model, self.reader, self.kept = model, Reader(model.letters), Memory(WORD_BYTES)

    def weight(self, token: str) -> float:
        weights = self.model.weights
        return max((weights.get(f, 0.0) for w in self.reader.readings(token) for f in features(w) if w), default=0.0)

    def inputs(self, texts: list[str]) -> np.ndarray:
        """The largest weight and half the second largest, up to ENOUGH: one number, so that more evidence never lowers a score."""
        words = self.reader.tokens(texts)
        asked = list(set().union(*words))
        known = dict(zip(asked, self.kept.answers(asked, lambda new: list(map(self.weight, new))), strict=True))
        top = [[*nlargest(2, map(known.__getitem__, own)), 0.0, 0.0] for own in words]
        return np.array([[min(ENOUGH, a + b / 2)] for a, b, *_ in top], dtype=float).reshape(-1, 1)


def one_of_copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, y, fold) with one of each set of near copies of a label, told by the three words of least hash: copies are no further evidence."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.xxhash64(w)))
    sketch = F.xxhash64(F.slice(F.array_sort(words), 1, 3))
    of = F.struct(F.xxhash64("doc_id"), "doc_id", "text", "fold")
    return saved(rows.groupBy("y", sketch.alias("sketch")).agg(F.min(of).alias("r")).select("r.doc_id", "r.text", "y", "r.fold"), "different-labelled")


def supported(weights: dict[str, float]) -> dict[str, float]:
    """The weights of words, and of the beginnings that enough words with weights share."""
    share = Counter(f for word in weights if not word.endswith("*") for f in features(word) if f.endswith("*"))
    return {f: w for f, w in weights.items() if not f.endswith("*") or share[f] >= SUPPORT}


def feature_counts(rows: DataFrame, letters: list) -> DataFrame:
    """feature, toxic and clean: in how many of the documents it is. Tasks count before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, read = Reader(letters), Memory(STRETCH_BYTES)
        for batch in in_slices(batches, "text"):
            counts = (Counter(), Counter())
            words = reader.tokens(batch.column("text").to_pylist())
            asked = list(set().union(*words))
            known = dict(zip(asked, read.answers(asked, lambda new: list(map(reader.readings, new))), strict=True))
            for y, tokens in zip(batch.column("y").to_pylist(), words, strict=True):
                counts[y].update({f for t in tokens for w in known[t] if w for f in features(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0)]], names=["feature", "toxic", "clean"])

    return in_tasks(rows.select("y", "text"), run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Letters from all documents; weights from folds 1 to 3 and calibration on fold 4 of the sample."""
    letters = log_model(letter_counts(docs)).tolist()
    counts = {r["y"]: r["n"] for r in labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    share = ones / (ones + zeros) if ones + zeros else 0.0
    rows = one_of_copies(sample(docs, labels, label, SAMPLE))
    sizes = {r["y"]: r["n"] for r in rows.where("fold <> 4").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(letters, {}, (), share)
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    bound = odds - Z * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    weighed = feature_counts(rows.where("fold <> 4"), letters).where(bound > 0).select("feature", odds.alias("w"))
    # Bounded by the sample: a weight takes several documents of its toxic part.
    weights = supported({r["feature"]: r["w"] for r in weighed.collect()})
    model = Model(letters, weights, (), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in in_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, scorer.inputs(batch.column("text").to_pylist()).T)], names=["y", "evidence"])

    seen = np.array([tuple(r) for r in in_tasks(rows.where("fold = 4").select("y", "text"), run, "y int, evidence double").collect()], dtype=float).reshape(-1, 2)
    y = seen[:, 0]
    if set(y) != {0.0, 1.0}:
        return model
    w = logistic(seen[:, 1:], y)
    w[0] += np.log(ones / zeros) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(letters, weights, tuple(w), share)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    found = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # 28^3 letters, and weights from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = found.value
        scorer = Scorer(model)
        for batch in in_slices(batches, "text"):
            x = scorer.inputs([t or "" for t in batch.column("text").to_pylist()])
            p = probability(np.array(model.calibration), x) if model.calibration else np.full(len(x), model.share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    out = in_tasks(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
