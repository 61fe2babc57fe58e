"""Token counts by prefix dynamic programming.

For byte-level BPE, the encoding of a prefix of a match ends in the one token whose left neighbour
(the last token of what stands before it) stays apart from it when both are encoded together. So
the last token and the number of tokens of every prefix follow from those of shorter ones, and the
library is asked about pairs of tokens only. The tokens that end at a place come from an
Aho-Corasick automaton over the vocabulary, the longest first. Matches are as in the tokenizers
file's byte-level pre-tokenizer.

Stored are the steps of a text: for each character, by how much the count of the prefix that ends
with it exceeds that of the prefix before it. Their sums are the exact counts of all prefixes; they
answer how many tokens any prefix has and where to cut for a budget of tokens, without encoding
again. The steps of a text are those of its chunks in a row.

Where a cut changes the matches themselves, the count is that of the cut text: in a run of white
space the cut text's last match is the whole run; a cut contraction is a quote and a letter; a cut
special string is ordinary text.

Null and empty texts have 0 tokens and no steps. Texts are never cut, however long; work is linear
in their bytes. Repeated rows are counted alike, each on its own. Empty tables give empty results.
Other columns may have any name; one with the name of the result column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memory, by_chunk, byte_characters, entries, in_slices
from .common import in_tasks, put, saved, with_field

#: Bytes that a worker's memory of chunks may take, about, and entries of its memory of pairs (about 100 bytes each).
MEMORY_BYTES = 64_000_000
KEPT_PAIRS = 400_000
#: Matches of which a proper prefix of two characters is not one match.
CONTRACTIONS = {"'re", "'ve", "'ll"}
LIMIT = 512


class PrefixCounts:
    """Prefix counts under one tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # matches are asked about, never whole texts
        back = {c: b for b, c in enumerate(byte_characters())}
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.names = [t for t in self.tokenizer.get_vocab(with_added_tokens=False) if t not in self.special]
        self.ending = ahocorasick.Automaton()
        for n, name in enumerate(self.names, 1):  # 0: nothing stands before
            token = bytes(back[c] for c in name)
            self.ending.add_word(token.decode("latin-1"), (len(token), n))
        self.ending.make_automaton()
        self.matches, self.space = regex.compile(pattern), regex.compile(r"\s+").fullmatch
        self.apart: dict[int, bool] = {}
        self.memory = Memory(MEMORY_BYTES)

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the library encodes the two tokens together as these two (the right one alone if left is 0)."""
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        pair = [self.names[x - 1] for x in (left, right) if x]
        found = self.apart[left << 32 | right] = [t.value for t in self.tokenizer.model.tokenize("".join(pair))] == pair
        return found

    def of_match(self, match: str) -> list[int]:
        """Tokens of every prefix of a match, by characters."""
        data = match.encode()
        last, counts, apart = [0] * (len(data) + 1), [0] * (len(data) + 1), self.apart.get
        for at, (size, token) in self.ending.iter(data.decode("latin-1")):  # at one place the longest comes first
            if not last[at + 1]:
                left = last[at + 1 - size]
                found = apart(left << 32 | token)
                if found or (found is None and self.stays_apart(left, token)):
                    last[at + 1], counts[at + 1] = token, counts[at + 1 - size] + 1
        if not all(last[1:]):
            raise ValueError("no token ends here; the vocabulary lacks a byte")
        own = counts[1:]
        if len(own) != len(match):
            own = [own[e - 1] for e in accumulate(len(c.encode()) for c in match)]
        if match in CONTRACTIONS:
            own[1] = 2
        return own

    def of_plain(self, text: str) -> list[int]:
        """Tokens of every prefix of a text without special strings, by characters."""
        counts, total, earlier, before = [], 0, "", 0
        for match in self.matches.findall(text):
            own = self.of_match(match)
            at = len(counts)
            counts += [n + total for n in own] if total else own
            if earlier and self.space(earlier) and self.space(match[0]):
                counts[at] = before + self.of_match(earlier + match[0])[-1]
            earlier, before = match, total
            total += own[-1]
        return counts

    def of_text(self, text: str) -> np.ndarray:
        """Tokens of every prefix, by characters."""
        parts, total, at = [], 0, 0
        for m in self.specials.finditer(text) if self.specials else ():
            parts.append(np.array(self.of_plain(text[at : m.end() - 1]), dtype=np.int64) + total)
            total += (self.of_plain(text[at : m.start()]) or [0])[-1] + 1
            parts.append(np.array([total], dtype=np.int64))
            at = m.end()
        parts.append(np.array(self.of_plain(text[at:]), dtype=np.int64) + total)
        return np.concatenate(parts)

    def steps_of_chunks(self, chunks: list[str]) -> list[bytes]:
        counts, ends = [], [0]
        for chunk in chunks:
            matches = self.matches.findall(chunk)
            counts += self.of_match(chunk) if len(matches) == 1 else self.of_plain(chunk)
            ends.append(len(counts))
        totals = np.array(counts, dtype=np.int64)
        steps = np.diff(totals, prepend=0)
        steps[ends[:-1]] = totals[ends[:-1]]
        data = steps.astype("<i2").tobytes()
        return [data[2 * a : 2 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def steps(self, texts: pa.StringArray) -> pa.BinaryArray:
        """The steps of each text as little-endian signed 16-bit integers."""
        texts = pc.fill_null(texts, "")
        marked = pa.array(np.zeros(len(texts), dtype=bool))
        for s in self.special:
            marked = pc.or_(marked, pc.match_substring(texts, s))
        data, at = by_chunk(pc.if_else(marked, "", texts), self.memory, self.steps_of_chunks)
        if not (alone := pc.indices_nonzero(marked).to_pylist()):
            return entries(pa.binary(), data, at)
        parts = [data[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
        for i in alone:
            parts[i] = np.diff(self.of_text(texts[i].as_py()), prepend=0).astype("<i2").tobytes()
        return pa.array(parts, pa.binary())


@lru_cache(maxsize=2)
def prefix_counts(path: str, pattern: str) -> PrefixCounts:
    return PrefixCounts(path, pattern)


def counts_of(steps: bytes) -> np.ndarray:
    """Tokens of every prefix, by characters, from stored steps."""
    return np.cumsum(np.frombuffer(steps, dtype="<i2"), dtype=np.int64)


def tokens_until(counts: np.ndarray, characters: int) -> int:
    """Tokens of the first characters of a text."""
    return int(counts[min(characters, len(counts)) - 1]) if characters > 0 and len(counts) else 0


def characters_within(counts: np.ndarray, budget: int) -> int:
    """The longest prefix of at most budget tokens, in characters."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def with_prefix_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", steps: str = "token_steps") -> DataFrame:
    """docs with a binary column: the steps of text as little-endian signed 16-bit integers, one for each character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(path, pattern)
        for batch in in_slices(batches, text):
            yield put(batch, steps, counter.steps(batch.column(text)))

    return in_tasks(docs, run, with_field(docs.schema, steps, T.BinaryType()))


def answers(stored: DataFrame, limit: int = LIMIT, steps: str = "token_steps") -> DataFrame:
    """stored with n_tokens, over_limit and fits_chars (the longest prefix of at most limit tokens, in characters) in place of the steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, steps):
            counts = [counts_of(x.as_buffer()) for x in batch.column(steps)]
            totals = [tokens_until(c, len(c)) for c in counts]
            for name, column in (("n_tokens", pa.array(totals, pa.int64())), ("over_limit", pa.array([n > limit for n in totals], pa.bool_())), ("fits_chars", pa.array([len(c) if n <= limit else characters_within(c, limit) for c, n in zip(counts, totals, strict=True)], pa.int64()))):
                batch = put(batch, name, column)
            yield batch.select([c for c in batch.schema.names if c != steps])

    schema = with_field(with_field(with_field(stored.schema, "n_tokens", T.LongType()), "over_limit", T.BooleanType()), "fits_chars", T.LongType())
    return in_tasks(stored, run, T.StructType([f for f in schema.fields if f.name != steps]))


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """Per document, from stored steps: doc_id, n_bytes, n_tokens, over_limit, fits_chars."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    stored = saved(with_prefix_counts(docs.select("doc_id", "text"), path, pattern).select("doc_id", size.alias("n_bytes"), "token_steps"), "token-steps")
    return answers(stored, limit).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")
