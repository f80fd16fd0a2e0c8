"""Ranked lexical search over a bit-sliced impact index.

Documents stand in blocks. For every term of a block the index holds a bitmap of
its documents and, for each bit of the impact, a bitmap of those whose impact has
it, packed over the term's own documents. A query spreads these slices over the
block, multiplies them by the term's weight by shifts and additions, and adds up
the terms of an item, all by bitwise carry arithmetic on 64-bit words, for many
items at once. The best of a block are found from the most significant slice of
the sums down: documents that have the bit go before those that don't.

The impact of a term in a document is (1e9 tf) div (1000 tf + 20 m), with
m = 50 + (50 n N) div L; its weight is floor(1000 ln((2 N + 2) / (2 df + 1))).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.llm.shared import slices, stored, texts_of

#: Documents and bytes of text of a block, as far as one document isn't longer.
BLOCK_DOCS, BLOCK_BYTES = 4096, 1 << 24
#: Pairs of item and term that go out in one broadcast, and distinct terms that are added at once.
PASS_TERMS, TERMS_AT_ONCE, ITEMS_AT_ONCE = 500_000, 512, 64
IMPACT_BITS = 20
# Fixed value: the pattern of a term; letters of ASCII, digits and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "block long, term string, ids array<long>, docs binary, slices binary, df long"


def term_characters() -> np.ndarray:
    """What becomes of each byte of a text: A to Z in lower case, separators a blank, others themselves."""
    found = np.full(256, 0x20, np.uint8)
    kept = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    found[kept] = kept
    found[0x41:0x5B] = np.arange(0x61, 0x7B)
    return found


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of texts (without nulls), and of every occurrence its term's number and the text's."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(term_characters()[raw]))
    split = pc.split_pattern(plain, " ")
    words = split.flatten()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    given = pc.greater(pc.binary_length(words), 0)
    words = words.filter(given).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), text[given.to_numpy(zero_copy_only=False)]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 50 + 50 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def totals(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of their terms with repeats."""
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    found = docs.agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n), F.lit(0))).first()  # one row
    return found[0], found[1]


def index_rows(block: int, ids: pa.Array, texts: pa.Array, documents: int, length: int) -> pa.RecordBatch:
    """The rows of one block: its documents' ids in ascending order (the row without a term), and a row per term."""
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    terms, term, text = terms_of(texts)
    n = np.bincount(text, minlength=len(texts))
    pair, tf = np.unique(term * len(texts) + text, return_counts=True)
    term, text = np.divmod(pair, len(texts))
    impact = impacts(tf, n[text], documents, length).astype(np.uint32) if length else tf
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(begins, len(term)))
    rows = 1 + len(terms)

    def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """A null, then pieces of these sizes."""
        ends = np.concatenate([[0, 0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), rows, [pa.array([False] + [True] * len(sizes)).buffers()[1], pa.py_buffer(ends), pa.py_buffer(flat)])

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, block)),
            pa.concat_arrays([pa.nulls(1, pa.string()), terms]),
            pa.concat_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.nulls(len(terms), pa.list_(pa.int64()))]),
            binaries(text.astype("<u2"), 2 * df),
            binaries(packed_slices(impact, df), IMPACT_BITS * -(-df // 8)),
            pa.array(np.append(0, df)),
        ],
        names=["block", "term", "ids", "docs", "slices", "df"],
    )


def packed_slices(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit slices of the values of each term (`counts` of them), a term after the other: per bit as many bytes as its values need."""
    wide = -(-counts // 8)  # bytes of a slice
    before = np.cumsum(wide) - wide
    place = np.arange(len(values)) + np.repeat(8 * before - (np.cumsum(counts) - counts), counts)
    total = int(wide.sum())
    byte = np.arange(total)
    target = np.repeat(IMPACT_BITS * before - before, wide) + byte
    step, flat = np.repeat(wide, wide), np.zeros(IMPACT_BITS * total, np.uint8)
    for k in range(IMPACT_BITS):
        bits = np.zeros(8 * total, np.uint8)
        bits[place] = values >> k & 1
        flat[target + k * step] = np.packbits(bits, bitorder="little")
    return flat


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored index (INDEX) of all rows of `docs` (doc_id, text), with N and L.

    Every task cuts its rows into blocks, so nothing is shuffled. A null text has
    no terms; rows without a doc_id come last in their block.
    """
    docs = texts_of(docs)
    documents, length = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        rows = 0

        def flush() -> pa.RecordBatch:
            both = pa.Table.from_batches(waiting).combine_chunks()
            return index_rows(block, both.column("doc_id").combine_chunks(), both.column("text").fill_null("").combine_chunks(), documents, length)

        for batch in slices(batches, 64):
            if waiting and (rows + batch.num_rows > BLOCK_DOCS or size + batch.nbytes > BLOCK_BYTES):
                yield flush()
                block, waiting, size, rows = block + 1, [], 0, 0
            waiting.append(batch)
            size, rows = size + batch.nbytes, rows + batch.num_rows
        if waiting:
            yield flush()

    return stored(docs.mapInArrow(run, INDEX), "lexical-index"), documents, length


# -- arithmetic on bit slices: arrays of a row per bit, of 64-bit words over the documents in their last axis


def add(sums: np.ndarray, addend: np.ndarray, shift: int = 0) -> None:
    """Add `addend` times 2 ** shift into `sums`, a carry going from each bit to the next."""
    carry = None
    for k in range(shift, len(sums)):
        bit = sums[k]
        if k - shift < len(addend):
            more = addend[k - shift]
            both = bit ^ more
            if carry is None:
                carry = bit & more
                bit ^= more
            else:
                next_ = (bit & more) | (carry & both)
                np.bitwise_xor(both, carry, out=bit)
                carry = next_
        else:
            if carry is None or not carry.any():
                return
            next_ = bit & carry
            bit ^= carry
            carry = next_


def multiply(slices_: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The slices of values (bit, row, word) times a factor per row, by shifted additions of the rows whose factor has the bit."""
    top = int(factors.max(initial=0)).bit_length()
    out = np.zeros((len(slices_) + top, *slices_.shape[1:]), np.uint64)
    for k in range(top):
        has = np.where(factors >> k & 1, ~np.uint64(0), np.uint64(0))[:, None]
        add(out, slices_ & has, k)
    return out


def top_k(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(surely, maybe): bitmaps by row of what is among the k largest sums above 0, and of what ties for the last places."""
    surely, maybe = np.zeros(sums.shape[1:], np.uint64), np.bitwise_or.reduce(sums, axis=0)
    for bits in sums[::-1]:
        with_it = surely | (maybe & bits)
        many = (np.bitwise_count(with_it).sum(axis=1, dtype=np.int64) > k)[:, None]
        surely = np.where(many, surely, with_it)
        maybe = np.where(many, maybe & bits, maybe & ~bits)
    return surely, maybe


def set_bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def values_at(sums: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sums (bit, word) of some documents as numbers."""
    bits = sums[:, places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)


class Queries:
    """Items as lists of terms with weights, searched block by block; keeps each item's k best of all blocks so far."""

    def __init__(self, rows: list[tuple[int, str, int]], k: int):
        self.k, self.items = k, {}
        for item, term, heavy in rows:
            if heavy > 0:
                self.items.setdefault(item, []).append((term, heavy))
        self.best = {item: (np.zeros(0, np.int64), []) for item in self.items}  # scores in descending order, and ids

    def search(self, ids: list[int | None], postings: dict[str, tuple[bytes, bytes]]) -> None:
        words = -(-len(ids) // 64)
        present = {item: [t for t in terms if t[0] in postings] for item, terms in self.items.items()}
        items = sorted((i for i in present if present[i]), key=lambda i: len(present[i]))
        for at in range(0, len(items), ITEMS_AT_ONCE):
            some = items[at : at + ITEMS_AT_ONCE]
            most = max(sum(heavy for _, heavy in present[i]) for i in some)
            sums = np.zeros((IMPACT_BITS + most.bit_length(), len(some), words), np.uint64)
            for step in range(0, max(len(present[i]) for i in some), max(1, TERMS_AT_ONCE // len(some))):
                mine = [present[i][step : step + max(1, TERMS_AT_ONCE // len(some))] for i in some]
                distinct = sorted({t for terms in mine for t in terms})
                row = {t: n for n, t in enumerate(distinct)}
                spread = multiply(self.spread(distinct, postings, words), np.array([heavy for _, heavy in distinct]))
                for j in range(max(map(len, mine))):
                    has = [n for n, terms in enumerate(mine) if len(terms) > j]
                    part = sums[:, has]
                    add(part, spread[:, [row[mine[n][j]] for n in has]])
                    sums[:, has] = part
            self.keep(some, sums, ids)

    @staticmethod
    def spread(terms: list[tuple[str, int]], postings: dict[str, tuple[bytes, bytes]], words: int) -> np.ndarray:
        """The impact slices of terms over all documents of a block: bit, term, word."""
        out = np.zeros((IMPACT_BITS, len(terms), words), np.uint64)
        wide = np.zeros((IMPACT_BITS, 64 * words), np.uint8)
        for n, (term, _) in enumerate(terms):
            docs = np.frombuffer(postings[term][0], "<u2")
            bits = np.frombuffer(postings[term][1], np.uint8).reshape(IMPACT_BITS, -1)
            wide[:, docs] = np.unpackbits(bits, axis=1, count=len(docs), bitorder="little")
            out[:, n] = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
            wide[:, docs] = 0
        return out

    def keep(self, items: list[int], sums: np.ndarray, ids: list[int | None]) -> None:
        surely, maybe = top_k(sums, self.k)
        for n, item in enumerate(items):
            places = set_bits(surely[n])
            if len(places) < self.k:
                places = np.append(places, set_bits(maybe[n])[: self.k - len(places)])
            scores = values_at(np.ascontiguousarray(sums[:, n]), places)
            old, old_ids = self.best[item]
            if len(old) == self.k:
                places, scores = places[scores >= old[-1]], scores[scores >= old[-1]]
            both, both_ids = np.append(old, scores), old_ids + [ids[p] for p in places.tolist()]
            rank = sorted(range(len(both)), key=lambda r: (-both[r], both_ids[r] is None, both_ids[r] or 0))[: self.k]
            self.best[item] = both[rank], [both_ids[r] for r in rank]

    def found(self) -> Iterator[tuple[int, int | None, int]]:
        for item, (scores, ids) in self.best.items():
            yield from ((item, doc_id, score) for doc_id, score in zip(ids, scores.tolist()))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms; repeated rows count once, and rows that repeat an item_id make one item."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    terms = F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")
    return items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), terms).distinct()


def search(index: DataFrame, documents: int, items: DataFrame, k: int, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0 of each item of `items` (item_id, text).

    Items go out in broadcasts of about `pass_terms` pairs of item and term, and
    each broadcast meets the index rows of its terms, block by block. A task keeps
    the k best of an item over all its blocks.
    """
    asked = stored(item_terms(items), "lexical-items")
    df = index.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = stored(asked.join(df, "term"), "lexical-terms")
    passes = max(1, -(-weighed.count() // pass_terms))
    found = None
    for n in range(passes):
        mine = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n)
        part = _search_pass(index, documents, mine, k)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_pass(index: DataFrame, documents: int, weighed: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    rows = [(r.item_id, r.term, weight(documents, r.df)) for r in weighed.select("item_id", "term", "df").toLocalIterator()]  # about PASS_TERMS
    shipped = spark.sparkContext.broadcast(sorted(rows))
    terms = F.broadcast(weighed.select("term").distinct())  # at most PASS_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(shipped.value, k)
        block, ids, postings = None, [], {}
        for batch in batches:
            for at, term, own, docs, bits in zip(*(batch.column(c).to_pylist() for c in ("block", "term", "ids", "docs", "slices"))):
                if at != block:
                    if postings:
                        queries.search(ids, postings)
                    block, ids, postings = at, [], {}
                if term is None:
                    ids = own
                else:
                    postings[term] = (docs, bits)
        if postings:
            queries.search(ids, postings)
        columns = list(zip(*queries.found())) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    wanted = index.join(terms, "term", "left_semi").select("block", "term", "ids", "docs", "slices")
    heads = index.where("term is null").select("block", "term", "ids", "docs", "slices")
    dealt = wanted.unionByName(heads).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("term"))
    return dealt.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k best rows of `docs` (doc_id, text) for each item of `items` (item_id, text): item_id, rank, doc_id, score.

    Whole texts count; a null one has no terms and is found by nothing. Repeated
    doc_ids are ranked row by row. Equal scores go by ascending doc_id, rows
    without one last. Items without an item_id, or without a term that a document
    holds, find nothing. Other columns of both tables aren't read.
    """
    index, documents, _ = build_index(docs)
    return search(index, documents, items, k)


def oracle(k: int) -> str:
    """DuckDB SQL with the same rows."""
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""WITH d AS (SELECT doc_id, unnest({words}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
    total AS (SELECT count(*) AS docs, cast(sum(n) AS bigint) AS length FROM len),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS bigint) AS w FROM df, total),
    asked AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
    score AS (SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS bigint) AS score
      FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY ALL),
    ranked AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score FROM score WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
