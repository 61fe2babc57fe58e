"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a .tiktoken file become a tokenizers BPE model over the byte alphabet (every byte has
one printable character). Each batch is split into chunks before every single space that stands
between two other characters; no match of the pattern crosses such a place, so the ids of a text
are those of its chunks in a row. Different chunks of a batch that are not in a worker's bounded
memory are encoded by the library; ids are put in their places by Arrow, without Python objects for
chunks or tokens. Decoding looks ids up in the byte table and joins bytes before it makes
characters, so characters split over tokens come back whole. Offsets follow from the tokens' bytes;
tokens within a character have that character's span.

Null and empty texts have no tokens. Texts are never cut, however long; chunks of more than
LONGEST_KEPT characters are encoded anew each time. Repeated rows are encoded alike, each on its
own. Empty tables give empty results. Other columns may have any name; one with the name of a
result column is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_tasks, put, with_field

#: Bytes that a worker's memory of chunks may take, about; and chunks that the library gets in one call.
MEMORY_BYTES = 64_000_000
AT_ONCE = 8192
LONGEST_KEPT = 64
#: Bytes of a remembered entry besides its key and value.
ENTRY = 200

WHITE = np.zeros(256, dtype=bool)
WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable in Latin-1, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def tokenizer_of_ranks(path: str, pattern: str):
    """A tokenizers Tokenizer that encodes as the ranks do.

    Every way to join two tokens into a third is a merge, in the order of the third's rank. A match
    that is itself a token stays whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, characters = read_ranks(path), byte_characters()
    spelled = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = [(spelled[a], spelled[b]) for token in sorted(ranks, key=ranks.get) for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
    made = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=4)
def byte_table(path: str) -> pa.BinaryArray:
    """The bytes of each id."""
    table = [b""] * (max((ranks := read_ranks(path)).values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and where each entry begins and the last one ends."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, dtype=np.int32)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8), (at - at[0]).astype(np.int64)


def entries(kind: pa.DataType, data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A string or binary array of the stretches of data between the places at."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, dtype=np.int32)), pa.py_buffer(data)])


def chunks_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The chunks of all texts in a row, and the number of the first chunk of each text (and of all chunks).

    A chunk begins with its text or with a single space; a space beside other white space begins none.
    """
    data, at = flat(texts)
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    spaces = np.flatnonzero(data == 0x20)
    before, after = data[spaces - 1], padded[spaces + 1]
    bad = WHITE[before] | WHITE[after]
    # White space of several bytes: U+0085 and U+00A0, U+1680, U+2000 to U+207F and U+3000 to U+303F (with some that is none).
    wide = np.flatnonzero(~bad & ((before >= 0x80) | (after >= 0x80)))
    s = spaces[wide]
    a, b, c, x, y = data[s - 3], data[s - 2], data[s - 1], padded[s + 1], padded[s + 2]
    lead = lambda first, second: ((first == 0xE1) & (second == 0x9A)) | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))
    bad[wide] = lead(a, b) | lead(x, y) | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0)))
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[spaces[~bad]] = True
    begins[at] = True
    cuts = np.flatnonzero(begins)
    return entries(pa.string(), data, cuts), np.searchsorted(cuts, at)


class Memory:
    """What was found out for keys, in two turns of half of most bytes, about: what is not used for a whole turn goes."""

    def __init__(self, most: int):
        self.half, self.used, self.now, self.before = most // 2, 0, {}, {}

    def answers(self, keys: list[str], find: Callable[[list[str]], list]) -> list:
        """The value of each of different keys; find gives those that are not known."""
        if self.used > self.half:
            self.used, self.now, self.before = 0, {}, self.now
        now, before = self.now, self.before
        out = list(map(now.get, keys))
        new = []
        for i, found in enumerate(out):
            if found is None:
                key = keys[i]
                if (found := before.get(key)) is None:
                    new.append(i)
                else:
                    out[i] = now[key] = found
                    self.used += ENTRY + 4 * len(key)
        for i, found in zip(new, find([keys[i] for i in new]) if new else [], strict=True):
            out[i], key = found, keys[i]
            if len(key) <= LONGEST_KEPT:
                now[key] = found
                self.used += ENTRY + 4 * len(key)
        return out


def by_chunk(texts: pa.StringArray, memory: Memory, find: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """What find gives for the chunks of all texts in a row, as bytes, and where each text's begin."""
    chunks, bounds = chunks_of(texts)
    if not len(chunks):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    coded = chunks.dictionary_encode()
    found = pa.array(memory.answers(coded.dictionary.to_pylist(), find), pa.large_binary())
    placed = found.take(coded.indices)
    _, offsets, data = placed.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[placed.offset : placed.offset + len(placed) + 1]
    return np.frombuffer(data, dtype=np.uint8)[: at[-1]], at[bounds]


class Encoder:
    """Ids of texts, from memory or the library."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.memory = tokenizer_of_ranks(path, pattern), Memory(MEMORY_BYTES)

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(chunks), AT_ONCE):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks[k : k + AT_ONCE], add_special_tokens=False)]
        return out

    def ids(self, texts: pa.StringArray) -> pa.BinaryArray:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        data, at = by_chunk(pc.fill_null(texts, ""), self.memory, self.of_chunks)
        return entries(pa.binary(), data, at)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def in_slices(batches: Iterator[pa.RecordBatch], texts: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most_bytes of text, at least one row each."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(texts)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def decoded(ids: pa.BinaryArray, table: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of each entry's ids."""
    data, at = flat(pc.fill_null(ids, b""))
    tokens = np.frombuffer(data.tobytes(), dtype="<u4")
    values, ends = flat(table.take(pa.array(tokens)))
    return entries(pa.binary(), values, ends[at // 4])


def spans(texts: pa.StringArray, ids: pa.BinaryArray, table: pa.BinaryArray) -> pa.ListArray:
    """The first character and the end of each token of each text."""
    (data, text_at), (tokens, at) = flat(pc.fill_null(texts, "")), flat(ids)
    sizes = np.diff(flat(table)[1])[np.frombuffer(tokens.tobytes(), dtype="<u4")]
    ends = np.cumsum(sizes)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    first = np.concatenate([character, [len(character)]])[text_at[:-1]]  # of each text
    own = np.repeat(first, np.diff(at // 4))
    pair = pa.StructArray.from_arrays([pa.array(character[x] - own, pa.int32()) if len(x) else pa.array([], pa.int32()) for x in (ends - sizes, ends - 1)], names=["start", "end"])
    pair = pa.StructArray.from_arrays([pair.field("start"), pc.add(pair.field("end"), pa.scalar(1, pa.int32()))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at // 4, pa.int32()), pair)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """docs with a binary column ids: the token ids of text as little-endian unsigned 32-bit integers.

    If offsets is given, also with a column of that name: the first character and the end of each token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(path, pattern), byte_table(path)
        for batch in in_slices(batches, text):
            found = coder.ids(batch.column(text))
            made = put(batch, ids, found)
            yield put(made, offsets, spans(batch.column(text), found, table)) if offsets else made

    schema = with_field(docs.schema, ids, T.BinaryType())
    return in_tasks(docs, run, with_field(schema, offsets, SPANS) if offsets else schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with a binary column: the bytes of the ids, null where ids is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in in_slices(batches, ids):
            found = decoded(batch.column(ids), table)
            yield put(batch, into, pc.if_else(batch.column(ids).is_valid(), found, pa.scalar(None, pa.binary())))

    return in_tasks(rows, run, with_field(rows.schema, into, T.BinaryType()))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes that the ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(path, pattern), byte_table(path)
        for batch in in_slices(batches, "text"):
            ids = coder.ids(batch.column("text"))
            digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded(ids, table)]
            n = pc.cast(pc.divide(pc.binary_length(ids), pa.scalar(4, pa.int32())), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, ids, pa.array(digests, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return in_tasks(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids binary, decoded_sha256 string")


def encoded_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs, path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
