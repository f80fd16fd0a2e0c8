"""Byte-level BPE by a contiguous rank array.

Each short word holds its parts, as far as their boundaries stand, and the ranks
of adjacent parts in contiguous arrays. The smallest rank is found by a scan,
its boundary is deleted and the two neighbouring ranks are looked up again;
numpy does this for many words at once, one word per row. A word of more than
`SHORT_WORD` bytes would make the scans quadratic, so it merges from a heap
with the same order of merges and the same result.

A word has the same ids wherever it stands, so it is merged once while a bounded
cache of the Python worker holds it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrafacet.llm.shared import map_arrow, texts_of

SHORT_WORD = 96
CACHE_WORDS = 100_000

# Fixed value: the pre-tokenizer pattern of byte-level BPE, \s as Unicode's White_Space.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NO_RANK = (1 << 31) - 1


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it shows, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a tokenizers JSON file; small, sent to the tasks as it is."""

    ranks: dict[int, int] = field(repr=False)  # left id << 32 | right id -> rank
    merged: list[int] = field(repr=False)  # rank -> id of the joined part
    byte_ids: list[int] = field(repr=False)
    id_bytes: dict[int, bytes] = field(repr=False)
    special: dict[str, int]
    path: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        ids = said["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        id_bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items() if token not in special}
        return cls(
            ranks={ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)},
            merged=[ids[a + b] for a, b in pairs],
            byte_ids=[ids[c] for c in characters],
            id_bytes=id_bytes | {i: text.encode() for text, i in special.items()},
            special=special,
            path=path,
        )


class PairRanks:
    """Ranks of pairs of ids in an open hash table, looked up for whole arrays at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_ids, self.merged = np.array(vocabulary.byte_ids, np.int32), np.array(vocabulary.merged, np.int32)
        self.shift = np.uint64(64 - max(4, (4 * len(vocabulary.ranks)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.found = np.full(len(self.keys), NO_RANK, np.int32)
        left = np.fromiter(vocabulary.ranks, np.int64, len(vocabulary.ranks))
        rank = np.fromiter(vocabulary.ranks.values(), np.int32, len(vocabulary.ranks))
        slot = self.slots(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]  # of several for one slot the last one stays
            here = self.keys[slot] == left
            self.found[slot[here]] = rank[here]
            left, rank, slot = left[~here], rank[~here], self.next(slot[~here])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & (len(self.keys) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NO_RANK for pairs that never merge and where either id is negative (no part)."""
        keys = np.where((left < 0) | (right < 0), np.int64(1) << 62, left.astype(np.int64) << 32 | right)
        slot = self.slots(keys)
        out = self.found[slot]
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        out[there != keys] = NO_RANK
        while len(open_):
            slot[open_] = self.next(slot[open_])
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.found[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def merge_short(words: list[bytes], pairs: PairRanks) -> list[bytes]:
    """Ids of words of about one length, as little-endian uint32: a row of parts and one of adjacent ranks per word."""
    width = max(map(len, words))
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    column = np.arange(width)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    done = np.where(column < sizes[:, None], pairs.byte_ids[raw], -1)
    parts, row = done.copy(), np.arange(len(words))
    ranks = pairs(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), width - 1) if width > 1 else np.zeros((len(words), 0), np.int32)
    while width > 1 and len(row):
        at = ranks.argmin(1)
        best = ranks[np.arange(len(row)), at]
        more = best != NO_RANK
        done[row[~more]] = parts[~more]
        parts, ranks, row, at, best = parts[more], ranks[more], row[more], at[more], best[more]
        every = np.arange(len(row))
        parts[every, at] = pairs.merged[best]
        # delete the boundary after `at`: what follows moves one place to the left
        parts = np.take_along_axis(parts, np.minimum(column + (column > at[:, None]), width - 1), 1)
        parts[:, -1] = -1
        ranks = np.take_along_axis(ranks, np.minimum(column[:-1] + (column[:-1] >= at[:, None]), width - 2), 1)
        ranks[:, -1] = NO_RANK
        # refresh the ranks to both sides of the new part
        ranks[every, np.minimum(at, width - 2)] = pairs(parts[every, at], parts[every, np.minimum(at + 1, width - 1)])
        inner = np.flatnonzero(at)
        ranks[inner, at[inner] - 1] = pairs(parts[inner, at[inner] - 1], parts[inner, at[inner]])
    ends = 4 * np.cumsum((done >= 0).sum(1))
    flat = done[done >= 0].astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def merge_long(word: bytes, vocabulary: Vocabulary) -> bytes:
    """As merge_short for one word, in n log n: a heap of (rank, place) over a linked list of parts."""
    rank_of, merged = vocabulary.ranks.get, vocabulary.merged
    parts = [vocabulary.byte_ids[b] for b in word]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i) for i in range(len(parts) - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= len(parts) or rank_of(parts[i] << 32 | parts[j]) != rank:
            continue
        parts[i], parts[j], after[i] = merged[rank], -1, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(parts) and (r := rank_of(parts[a] << 32 | parts[after[a]])) is not None:
                heapq.heappush(heap, (r, a))
    return np.array([p for p in parts if p >= 0], "<u4").tobytes()


def merge_words(words: Iterable[bytes], pairs: PairRanks, vocabulary: Vocabulary) -> Iterator[tuple[bytes, bytes]]:
    """Each word with its ids; words of similar length are merged together."""
    classes: dict[int, list[bytes]] = {}
    for word in words:
        size = len(word)
        if size > SHORT_WORD:
            yield word, merge_long(word, vocabulary)
        else:
            classes.setdefault(size if size <= 16 else 16 + -(-size // 16), []).append(word)
    for same in classes.values():
        yield from zip(same, merge_short(same, pairs))


class Encoder:
    """Encodes and decodes whole texts in one Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pairs = vocabulary, PairRanks(vocabulary)
        self.words_of = regex.compile(PATTERN).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.words: dict[str, bytes] = {}  # ids by word

    def learn(self, words: set[str]) -> None:
        """Add the ids of new words."""
        self.words.update((word.decode(), ids) for word, ids in merge_words(map(str.encode, words), self.pairs, self.vocabulary))

    def ordinary(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        split = list(map(self.words_of, texts))
        need = set().union(*split)
        if len(self.words) + len(need) > CACHE_WORDS:  # half of it stays, the youngest words and those needed now
            now = {word: self.words[word] for word in need & self.words.keys()}
            self.words = dict(islice(reversed(self.words.items()), CACHE_WORDS // 2)) | now
        self.learn(need.difference(self.words))
        ids = self.words.__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32; strings of special tokens become their ids."""
        if self.special is None:
            return self.ordinary(texts)
        split = [self.special.split(t) for t in texts]
        found = iter(self.ordinary([part for parts in split for part in parts[::2]]))
        special = lambda part: np.array([self.vocabulary.special[part]], "<u4").tobytes()
        return [b"".join(special(p) if i % 2 else next(found) for i, p in enumerate(parts)) for parts in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, specials included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.vocabulary.id_bytes.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder, kept from task to task with its cache."""
    if vocabulary.path not in _ENCODERS:
        _ENCODERS[vocabulary.path] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.path]


def encode_documents(docs: DataFrame, vocabulary_path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, on demand, the text decoded from those ids.

    A null or empty text has no ids and decodes to ''. Texts are encoded whole;
    repeated rows each give a row; other columns of `docs` are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))  # a vocabulary file's size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = worker_encoder(shipped.value)
        found = [np.frombuffer(x, "<u4") for x in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        flat = np.concatenate(found) if found else np.zeros(0, "<u4")
        columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))]
        if decode:
            columns.append(pa.array([encoder.decode(x.tolist()) for x in found], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return map_arrow(texts_of(docs), run, "doc_id long, ids array<int>" + ", decoded string" * decode)
