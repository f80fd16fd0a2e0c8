"""Token counts by a map-side lookup in two tiers.

The first tier is a broadcast: an open hash table from frequent pre-tokens of up
to KEY_BYTES bytes, as two 64-bit words, to the number of their tokens. numpy cuts
whole batches of texts into pre-tokens and looks all of them up at once. What the
table doesn't hold is encoded once by the rank arrays of `bpe`, and its length
stays in a bounded cache of the Python worker. No pre-token is shuffled, and the
counts don't depend on what is in the table or the cache.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafacet.llm.bpe import PairRanks, Vocabulary, merge_words
from terrafacet.llm.shared import map_arrow, slices, texts_of

#: Pre-tokens of the first tier, and the longest of them.
TABLE_ENTRIES, KEY_BYTES = 1 << 16, 16
#: The table is filled from about so many documents, dealt to so many tasks.
FIT_DOCUMENTS, FIT_TASKS = 20_000, 8
#: Pre-tokens in the cache of a worker, and bytes of whole texts that numpy cuts at once.
CACHE_WORDS, CHUNK_BYTES = 100_000, 1 << 22

LETTER, NUMBER, SPACE, OTHER = range(4)
# Contractions that byte-level BPE cuts off at an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    every, kinds = "".join(map(chr, range(0x110000))), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            kinds[run.start() : run.end()] = kind
    return kinds


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = character_classes()
    kinds = table[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    more = 1 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
    point = (raw[lead] & (0x3F >> more)).astype(np.int32)
    for k in (1, 2, 3):
        longer = more >= k
        point[longer] = point[longer] << 6 | raw[lead[longer] + k] & 0x3F
    for k in range(4):
        longer = more >= k
        kinds[lead[longer] + k] = table[point[longer]]
    return kinds


def pre_tokens(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens of byte-level BPE begin in UTF-8. `first` holds the places where texts begin, which nothing crosses.

    A run of one class is a pre-token, with three changes. Of white space before
    something else the last character goes its own way: a blank to what follows,
    another one alone. A contraction ends after its letters.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    kinds = byte_classes(raw)
    begins = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    opens = np.zeros(len(raw) + 1, bool)  # a text begins
    opens[first] = opens[-1] = True
    begins |= opens[:-1]
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(raw))
    kind = kinds[start]

    inner = ~opens[end]  # more of the text follows
    after_space = end[(kind == SPACE) & inner]
    last = after_space - 1
    while (back := raw[last] & 0xC0 == 0x80).any():
        last[back] -= 1
    begins[last] = True
    begins[after_space[raw[last] == 0x20]] = False

    lone = start[(kind == OTHER) & (end - start == 1) & inner]
    lone = lone[(raw[lone] == ord("'")) & begins[lone]]
    for letters in CONTRACTIONS:
        at = lone[lone + len(letters) < len(raw)]
        for k, letter in enumerate(letters, 1):
            at = at[(raw[at + k] == ord(letter)) & ((k == 1) | ~begins[np.minimum(at + k, len(raw) - 1)])]
        begins[at + 1] = False
        past = at + 1 + len(letters)
        begins[past[past < len(raw)]] = True
    return np.flatnonzero(begins)


PADDING = np.array([(1 << 64) - (1 << 8 * k) if k < 8 else 0 for k in range(9)], np.uint64)  # byte 255 isn't in UTF-8


def keys_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first KEY_BYTES bytes of each pre-token as two words, filled up with bytes 255: different pre-tokens of that size differ."""
    padded = np.concatenate([raw, np.full(KEY_BYTES, 255, np.uint8)])
    words = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
    return words[start] | PADDING[np.minimum(size, 8)], words[start + 8] | PADDING[np.clip(size - 8, 0, 8)]


@dataclass
class LengthTable:
    """An open hash table from keys to numbers of tokens, 0 where a slot is free."""

    low: np.ndarray
    high: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], lengths: list[int]) -> LengthTable:
        slots = 1 << max(4, (4 * len(words)).bit_length() - 1)
        table = cls(np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.uint8))
        size = np.array(list(map(len, words)), np.int64)
        low, high = keys_of(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        many = np.array(lengths, np.uint8)  # at most a token a byte
        slot = table.slots(low, high)
        while len(slot):
            free = table.length[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            table.low[slot[put]], table.high[slot[put]], table.length[slot[put]] = low[put], high[put], many[put]
            left = np.ones(len(slot), bool)
            left[put] = False
            low, high, many, slot = low[left], high[left], many[left], (slot[left] + 1) & (slots - 1)
        return table

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(65 - len(self.low).bit_length())).astype(np.int64)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of tokens of each key, 0 where the table doesn't hold it."""
        slot = self.slots(low, high)
        found, open_ = np.zeros(len(slot), np.int64), np.arange(len(slot))
        while len(open_):
            there = self.length[slot]
            same = (self.low[slot] == low[open_]) & (self.high[slot] == high[open_])
            found[open_[same]] = there[same]
            on = ~same & (there > 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.low) - 1)
        return found


class Chunk:
    """Pre-tokens of some whole texts: start and size in `raw`, the text each belongs to, and whether it is a special token."""

    def __init__(self, raw: bytes, ends: np.ndarray, special: re.Pattern | None):
        self.raw = raw
        whole = np.frombuffer(raw, np.uint8)
        begins = ends[:-1]
        marks = [(m.start(), m.end()) for a, b in zip(ends, ends[1:]) for m in special.finditer(raw, a, b)] if special and special.search(raw) else []
        opens = np.concatenate([begins[begins < len(raw)], [a for a, _ in marks], [b for _, b in marks if b < len(raw)]]).astype(np.int64)
        start = pre_tokens(whole, opens)
        self.special = np.isin(start, [a for a, _ in marks])
        for a, b in marks:  # what was cut inside a special token
            inside = (start > a) & (start < b)
            start, self.special = start[~inside], self.special[~inside]
        self.start, self.size = start, np.diff(np.append(start, len(raw)))
        self.text = np.searchsorted(ends, start, "right") - 1
        self.keys = keys_of(whole, start, self.size)

    def words(self, which: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.start[which].tolist(), (self.start + self.size)[which].tolist())]


def chunks(texts: pa.Array, special: re.Pattern | None) -> Iterator[tuple[int, int, Chunk]]:
    """The texts (without nulls) from row a to row b, a few whole ones at a time."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        raw = data.slice(offsets[a], offsets[b] - offsets[a]).to_pybytes() if data else b""
        yield a, b, Chunk(raw, offsets[a : b + 1] - offsets[a], special)
        a = b


class TokenCounter:
    """Both tiers in one Python worker."""

    def __init__(self, vocabulary: Vocabulary, table: LengthTable):
        self.vocabulary, self.table, self.pairs = vocabulary, table, PairRanks(vocabulary)
        self.special = special_pattern(vocabulary)
        self.cache: dict[bytes, int] = {}

    def missed(self, words: list[bytes]) -> list[int]:
        """Numbers of tokens by the cache."""
        need = set(words)
        if len(self.cache) + len(need) > CACHE_WORDS:  # half of it stays, the youngest and those needed now
            now = {word: self.cache[word] for word in need & self.cache.keys()}
            self.cache = dict(islice(reversed(self.cache.items()), CACHE_WORDS // 2)) | now
        for word, ids in merge_words(need.difference(self.cache), self.pairs, self.vocabulary):
            self.cache[word] = len(ids) // 4
        return list(map(self.cache.__getitem__, words))

    def count(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b, chunk in chunks(texts, self.special):
            lengths = self.table(*chunk.keys)
            lengths[(chunk.size > KEY_BYTES) & ~chunk.special] = 0
            lengths[chunk.special] = 1
            missing = np.flatnonzero(lengths == 0)
            lengths[missing] = self.missed(chunk.words(missing))
            out[a:b] = np.bincount(chunk.text, lengths, b - a)
        return out


def special_pattern(vocabulary: Vocabulary) -> re.Pattern | None:
    names = sorted(vocabulary.special, key=len, reverse=True)
    return re.compile(b"|".join(re.escape(x.encode()) for x in names)) if names else None


_COUNTERS: dict[str, TokenCounter] = {}


def frequent_lengths(docs: DataFrame, vocabulary: Vocabulary, documents: int = FIT_DOCUMENTS) -> LengthTable:
    """The table of the pre-tokens that are most frequent in about `documents` of the texts, picked by hash among all.

    A task keeps TABLE_ENTRIES of what it counts and now and then forgets what was
    seen least, so that it holds little of any text; FIT_TASKS times that many rows
    reach the driver. What the table misses costs time, not right counts.
    """
    texts = texts_of(docs)
    one_in = max(1, -(-texts.count() // documents))
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select(F.coalesce("text", F.lit("")).alias("text")).repartition(FIT_TASKS)
    special, shipped = special_pattern(vocabulary), docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches):
            for _, _, chunk in chunks(batch.column(0), special):
                short = np.flatnonzero((chunk.size <= KEY_BYTES) & ~chunk.special)
                low, high = (k[short] for k in chunk.keys)
                _, one, times = np.unique(low * np.uint64(3) ^ high * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
                seen.update(dict(zip(chunk.words(short[one]), times.tolist())))
                if len(seen) > 4 * TABLE_ENTRIES:
                    seen = Counter(dict(seen.most_common(2 * TABLE_ENTRIES)))
        words = [word for word, _ in seen.most_common(TABLE_ENTRIES)]
        found = dict(merge_words(words, PairRanks(shipped.value), shipped.value))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64()), pa.array([len(found[w]) // 4 for w in words], pa.int32())], names=["word", "n", "length"])

    found = sample.mapInArrow(run, "word binary, n long, length int").toArrow().to_pydict()  # FIT_TASKS * TABLE_ENTRIES rows at most
    seen = Counter()
    for word, n in zip(found["word"], found["n"]):
        seen[word] += n
    lengths = dict(zip(found["word"], found["length"]))
    words = [word for word, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]
    return LengthTable.of(words, [lengths[w] for w in words])


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row of `docs` (doc_id, text).

    A null or empty text has no bytes and no tokens. Strings of special tokens
    count as one. Texts are counted whole; repeated rows each give a row, rows
    without a doc_id a row without one; other columns of `docs` aren't read.
    """
    vocabulary = Vocabulary.read(vocabulary_path)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, frequent_lengths(docs, vocabulary)))  # a vocabulary file's size and TABLE_ENTRIES
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = TokenCounter(*shipped.value)
        texts = batch.column("text").fill_null("")
        n_tokens = _COUNTERS[key].count(texts)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(texts_of(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
