"""Token ids in Simple-8b blocks.

A block holds the ids of some whole documents as 64-bit little-endian words: 4
bits of selector, 60 bits of ids. Selectors 0 to 13 pack 60 ids of 1 bit down to
1 id of 60 bits. Selector 14 is the escape: its word says how many raw 64-bit
ids follow, for ids that need more than 60 bits. Selector 15 is a run: 8 bits
of length, 52 bits of value. A block's row also keeps where each document's ids
begin, so one document can be cut from a decoded block without scanning.

A table of blocks is a folder of Parquet files: one row per block, in ascending
doc_id order within a part, and parts in ascending order. A row's `first_id` is
the number of ids before it in its part; the totals of the parts (as many rows
as there are parts) give the rest of the position.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.llm.shared import slices, texts_of

# Fixed values: (ids in a word, bits of each) by selector.
PACKED = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE, RUN = 14, 15
MIN_RUN, MAX_RUN, RUN_BITS = 61, 255, 52
HOPS = 4

BLOCK_IDS = 1 << 16
CACHE_CORES, TEXT_WORDS, BATCH_TEXTS = 300_000, 1000, 1024
BLOCKS = "part int, block int, first_id long, doc_ids array<long>, starts array<int>, n_ids int, payload binary"


def widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each uint64, 1 at least."""
    # the exponent of a double is the width of any integer below 2 ** 53
    out = np.maximum((ids.astype(np.float64).view(np.int64) >> 52) - 1022, 1).astype(np.uint8)
    large = np.flatnonzero(ids >> np.uint64(53))
    out[large] = [int(x).bit_length() for x in ids[large]]
    return out


def takes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the selector of a word that begins there, and how many ids it holds."""
    bits = widths(ids)
    n = len(ids)
    selector, count = np.full(n, ESCAPE, np.uint8), np.ones(n, np.uint8)
    most = {1: bits}  # most[k][i]: the widest of ids i to i + k - 1
    for size in sorted({k for k, _ in PACKED}):
        if size > n:
            break
        if size > 1:
            half = max(k for k in most if k < size)
            wide = most[half]
            most[size] = np.maximum(wide[: n - size + 1], wide[size - half : size - half + n - size + 1])
        fits = most[size] <= dict(PACKED)[size]
        if fits.any():
            np.copyto(selector[: n - size + 1], [k for k, _ in PACKED].index(size), where=fits, casting="unsafe")
            np.copyto(count[: n - size + 1], size, where=fits, casting="unsafe")
    # long runs of one id
    edge = np.flatnonzero(np.diff(ids)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    for a, b in zip(begin[long := end - begin >= MIN_RUN], end[long]):
        if int(ids[a]) >> RUN_BITS == 0:
            left = b - np.arange(a, b - MIN_RUN + 1)
            selector[a : b - MIN_RUN + 1], count[a : b - MIN_RUN + 1] = RUN, np.minimum(left, MAX_RUN)
    return selector, count


def reached(count: np.ndarray) -> np.ndarray:
    """The places from 0 on that one gets to by going on by each place's count; 2 ** HOPS of them at once."""
    n = len(count)
    hops = [np.minimum(np.arange(n + 1) + np.append(count, 0), n)]
    for _ in range(HOPS):
        hops.append(hops[-1][hops[-1]])
    far, at, places = hops.pop().tolist(), 0, []
    while at < n:
        places.append(at)
        at = far[at]
    place = np.array(places, np.int64)
    for hop in reversed(hops):
        place = np.stack([place, hop[place]], 1).ravel()
    return place[place < n]


def pack(ids: np.ndarray) -> bytes:
    """Ids (uint64) as Simple-8b words."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return b""
    selector, count = takes(ids)
    place = reached(count)
    chosen, held = selector[place], count[place].astype(np.int64)
    # each escape takes a header word and a raw word
    word_of = np.arange(len(place)) + np.concatenate([[0], np.cumsum(chosen[:-1] == ESCAPE)])
    out = np.zeros(len(place) + int((chosen == ESCAPE).sum()), np.uint64)
    for which, (size, bits) in enumerate(PACKED):
        if len(mine := np.flatnonzero(chosen == which)):
            parts = ids[place[mine][:, None] + np.arange(size)] << (np.uint64(bits) * np.arange(size, dtype=np.uint64))
            out[word_of[mine]] = np.bitwise_or.reduce(parts, 1) << np.uint64(4) | np.uint64(which)
    if len(mine := np.flatnonzero(chosen == RUN)):
        out[word_of[mine]] = (ids[place[mine]] << np.uint64(8) | held[mine].astype(np.uint64)) << np.uint64(4) | np.uint64(RUN)
    if len(mine := np.flatnonzero(chosen == ESCAPE)):
        out[word_of[mine]] = np.uint64(1 << 4 | ESCAPE)
        out[word_of[mine] + 1] = ids[place[mine]]
    return out.astype("<u8").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of Simple-8b words, as uint64; all words of a selector are decoded at once."""
    words = np.frombuffer(payload, "<u8")
    chosen = (words & np.uint64(15)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    if (chosen == ESCAPE).any():  # raw words may look like any selector: find them in order
        at = 0
        for found in np.flatnonzero(chosen == ESCAPE).tolist():
            if found >= at:
                at = found + 1 + int(words[found] >> np.uint64(4))
                raw[found + 1 : at] = True
    held = np.array([k for k, _ in PACKED] + [0, 0])[chosen]
    run = (chosen == RUN) & ~raw
    held[run] = (words[run] >> np.uint64(4) & np.uint64(255)).astype(np.int64)
    held[raw] = 1
    start = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    out[start[raw]] = words[raw]
    for which, (size, bits) in enumerate(PACKED):
        if len(mine := np.flatnonzero((chosen == which) & ~raw)):
            parts = words[mine][:, None] >> (np.uint64(4) + np.uint64(bits) * np.arange(size, dtype=np.uint64))
            out[start[mine][:, None] + np.arange(size)] = parts & np.uint64((1 << bits) - 1)
    if run.any():
        at = np.repeat(start[run], held[run]) + np.arange(held[run].sum()) - np.repeat(np.cumsum(held[run]) - held[run], held[run])
        out[at] = np.repeat(words[run] >> np.uint64(12), held[run])
    return out


class PieceEncoder:
    """Ids by the tokenizers library, asked once for each distinct lower-cased core of a piece while it is cached.

    Pieces stand between plain spaces or line ends; a piece is a core and maybe
    full stops and commas after it. The tokenizer must treat pieces apart, as one
    does that drops white space before its merges and whose patterns and special
    tokens hold none; it must lower-case, cut between a letter and a full stop or
    comma, and end words with a suffix.
    """

    def __init__(self, said: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(said)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        self.cores: dict[str, bytes] = {}
        self.proven: set[str] = set()

    def hold(self, need: set[str]) -> None:
        """Have the ids of some cores in `cores`. When CACHE_CORES are there, those go that one call alone has asked for; most are rare and don't return."""
        new = need.difference(self.cores)
        again = need.difference(new)
        self.proven |= again
        if len(self.cores) + len(new) > CACHE_CORES:
            if len(self.proven) > CACHE_CORES * 4 // 5:
                self.proven = again
            self.cores = {c: self.cores[c] for c in self.proven}
        self.learn(list(new))

    def learn(self, cores: list[str]) -> None:
        """Add the library's ids of new cores; those of letters alone are one word each and go many to a text."""
        words = [c for c in cores if c.isalpha()]
        joined = [words[at : at + TEXT_WORDS] for at in range(0, len(words), TEXT_WORDS)]
        for some, found in zip(joined, self.tokenizer.encode_batch_fast([" ".join(x) for x in joined], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) == len(some):  # else the tokenizer splits some letter otherwise
                raw = ids.tobytes()
                self.cores.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends))))
        rest = [c for c in cores if c not in self.cores]
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        self.cores.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(rest, found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (none of them null), and where each text's ids end."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        piece = coded.dictionary
        core = pc.utf8_rtrim(piece, ".,")
        core = pc.if_else(pc.match_substring_regex(core, "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"), core, piece)
        latin = pc.match_substring_regex(core, r"^[\x{0}-\x{ff}]*$")
        lower = pc.utf8_lower(core)
        for token in self.added:  # matched before the library lower-cases
            latin = pc.and_not(latin, pc.match_substring(lower, token))
        cores = listed(pc.if_else(latin, lower, core))
        sizes = pc.binary_length(core).to_numpy(zero_copy_only=False)
        short = np.flatnonzero(sizes < pc.binary_length(piece).to_numpy(zero_copy_only=False)).tolist()
        cut = pa.array(short, pa.int64())
        tails = [raw[len(kept) :] for raw, kept in zip(listed(piece.take(cut)), listed(core.take(cut)))]
        need = {*cores, *tails}
        self.hold(need)
        found = list(map(self.cores.__getitem__, cores))
        for k, tail in zip(short, tails):
            found[k] += self.cores[tail]
        held = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4")))
        codes = coded.indices
        ends = np.cumsum(held[codes.to_numpy()])[pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py() - 1]
        return ids.take(codes).flatten().to_numpy(), ends


def listed(texts: pa.Array) -> list[str]:
    """As to_pylist, for texts none of which is null; several times as fast."""
    return texts.to_numpy(zero_copy_only=False).tolist()


_ENCODERS: dict[int, PieceEncoder] = {}


def worker_encoder(said: str) -> PieceEncoder:
    """This worker's encoder, kept from task to task with its cache."""
    return _ENCODERS.get(hash(said)) or _ENCODERS.setdefault(hash(said), PieceEncoder(said))


def block_row(part: int, block: int, first_id: int, doc_ids: list, ids: list[np.ndarray]) -> tuple:
    starts = np.cumsum([0] + [len(x) for x in ids[:-1]]).tolist()
    flat = np.concatenate(ids)
    return part, block, first_id, doc_ids, starts, len(flat), pack(flat)


def write_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts, append `end_id` to each, and write blocks in ascending doc_id order to `path`.

    A null or empty text has the end id alone. Equal doc_ids stand in the order
    of their texts' hashes; a null doc_id comes first. One shuffle by ranges of
    (doc_id, hash): no key's rows need to meet in one task.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        said = spark.sparkContext.broadcast(file.read())  # a tokenizer file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(said.value), TaskContext.get().partitionId()
        block = first = held = 0
        doc_ids: list = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, doc_ids, ids
            row = block_row(part, block, first, doc_ids, ids)
            block, first, held, doc_ids, ids = block + 1, first + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary()))], names=["part", "block", "first_id", "doc_ids", "starts", "n_ids", "payload"])

        for batch in slices(batches, BATCH_TEXTS):
            flat, ends = encoder.encode(batch.column("text").fill_null(""))
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), np.split(flat, ends[:-1])):
                doc_ids.append(doc_id)
                ids.append(np.append(found, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= block_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    keyed = texts_of(docs).withColumn("tie", F.xxhash64("text"))
    by = ["doc_id", "tie"]  # what a range is sampled by reaches the driver: no texts
    dealt = (keyed.repartitionByRange(parts, *by) if parts else keyed.repartitionByRange(*by)).sortWithinPartitions(*by, "text")
    dealt.drop("tie").mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with `start`: the number of ids before each in the whole table."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row per task of the writer
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return blocks.join(F.broadcast(before), "part").withColumn("start", F.col("first_id") + F.col("before")).drop("before")


def map_documents(blocks: DataFrame, f: Callable[[int | None, int, np.ndarray], tuple], names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """Decode blocks and give a row f(doc_id, start, ids as uint64) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            block = batch.to_pylist()[0]
            ids, ends = unpack(block["payload"]), [*block["starts"][1:], block["n_ids"]]
            rows = [f(d, block["start"] + a, ids[a:b]) for d, a, b in zip(block["doc_ids"], block["starts"], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return blocks.mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids array<long> of every document of a table of blocks."""
    return map_documents(
        read_blocks(spark, path),
        lambda doc_id, start, ids: (doc_id, start, ids.astype(np.int64)),
        ["doc_id", "start", "ids"], [pa.int64(), pa.int64(), pa.list_(pa.int64())], "doc_id long, start long, ids array<long>",
    )
