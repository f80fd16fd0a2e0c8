"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

Counting and smoothing are joins and aggregates over n-gram tables, sharded by
n-gram: the counts of the highest order come from all trusted texts, each lower
order counts the distinct characters to the left, and every n-gram's probability
joins its context's totals and its suffix's probability. Texts of unknown
quality are scored against the finished table in broadcast shards of about
`SHARD_ENTRIES` rows, dealt by a hash of the whole context, so that what is
broadcast has a bound whatever the corpus. A probability is a product of steps,
one for each order from the shortest, and a step asks for one context and its
n-gram only; a document's sums of logs over the shards give its perplexity.

A text is read as its characters after ORDER - 1 start marks and before an end
mark. Repeated words look like good text to so short a memory, so a second model
(kind 1) reads how a text's words recur: a word's symbol is the distance
to the same word before it. A language's thresholds, one for each model, are a
quantile of the perplexities of trusted texts that were kept out of the counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from terrafacet.llm.shared import Scratch, map_arrow, slices, stored, stored_and_counted, with_ids

ORDER = 5
START, END = "\x02", "\x03"
MARKS = START * (ORDER - 1)
FLUSH_CHARACTERS, PORTION, GRAM_ROWS = 1 << 19, 1 << 18, 1 << 15
SHARD_ENTRIES = 4_000_000
QUANTILE = 0.99
ACCURACY = 10_000
RECURRENCES = "abcdefgh"
HELD_OUT_FOLDS, LEAST_HELD_OUT = 5, 8

# Odd multipliers by distance from an n-gram's last character.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(columns: list[np.ndarray], n: int, kind: int, context: bool = False) -> np.ndarray:
    """A 64-bit key of each of n runs of symbols of one kind, given by place; contexts have other keys than n-grams."""
    total = np.full(n, (kind * (ORDER + 1) + len(columns)) * 2 + context, np.uint64)
    for column, by in zip(reversed(columns), MULTIPLIERS):
        term = column.astype(np.uint64)
        term += np.uint64(1)
        term *= by
        total += term
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def cleaned(text: str | None) -> str:
    """A text without the characters that serve as marks."""
    return (text or "").replace(START, "").replace(END, "")


def recurrence(text: str | None) -> str:
    """A symbol for each word: z if it is new, else the doublings in its distance from the same word before."""
    last: dict[str, int] = {}
    out = []
    for k, word in enumerate((text or "").casefold().split()):
        before = last.get(word)
        out.append("z" if before is None else RECURRENCES[min((k - before - 1).bit_length(), len(RECURRENCES) - 1)])
        last[word] = k
    return "".join(out)


READ = (cleaned, recurrence)  # the symbols of a text, by kind
ENDS = (True, False)  # whether the end mark counts: few words say nothing by where they end


def codes(texts: list[str]) -> np.ndarray:
    """Code points of texts one after the other, each between its marks."""
    return np.frombuffer("".join(f"{MARKS}{t}{END}" for t in texts).encode("utf-32-le", "replace"), "<u4")


def portions(texts: list[str]) -> Iterator[list[int]]:
    """Places in a list of texts, dealt to portions of about PORTION characters."""
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(k)
        size += len(text) + ORDER
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_ngrams(texts: DataFrame) -> DataFrame:
    """kind, gram and count of every run of ORDER symbols in all texts of column `text`."""

    def count(kind: int, texts: list[str]) -> Iterator[pa.RecordBatch]:
        code = codes(texts)
        n = max(len(code) - ORDER + 1, 0)
        key = mix([code[k : k + n] for k in range(ORDER)], n, kind)
        # runs across two texts would have an end mark before their last place
        place = np.flatnonzero(~np.any([code[k : k + n] == ord(END) for k in range(ORDER - 1)], axis=0))
        _, first, count = np.unique(key[place], return_index=True, return_counts=True)
        for k in range(0, len(first), GRAM_ROWS):
            at = place[first[k : k + GRAM_ROWS]]
            grams = code[at[:, None] + np.arange(ORDER)].view(f"<U{ORDER}").ravel()
            columns = [pa.array(np.full(len(at), kind, np.int32)), pa.array(grams.tolist(), pa.string()), pa.array(count[k : k + GRAM_ROWS].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "gram", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[str], ...] = ([], [])
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for kind, read in enumerate(READ):
                    if symbols := read(text):
                        held[kind].append(symbols)
            for kind, texts in enumerate(held):
                if sum(map(len, texts)) >= FLUSH_CHARACTERS:
                    yield from count(kind, texts)
                    texts.clear()
        for kind, texts in enumerate(held):
            if texts:
                yield from count(kind, texts)

    return texts.select("text").mapInArrow(run, "kind int, gram string, count long").groupBy("kind", "gram").agg(F.sum("count").alias("count"))


def discounts(counts: DataFrame) -> dict[int, Column]:
    """By size, an n-gram's discount of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times; a row for each size and kind reaches the driver."""
    n = [F.sum((F.col("count") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    one = counts.groupBy("size", "kind").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    full = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    found = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(float(k) - 0.1)) for k in (1, 2, 3)]
    # too few n-grams to estimate from: half of each count
    by_size = {size: F.lit(None).cast("double") for size in range(1, ORDER + 1)}
    for row in one.select("size", "kind", *(F.when(full, d).otherwise(k / 2).alias(f"d{k}") for k, d in zip((1, 2, 3), found))).collect():
        d = F.when(F.col("count") == 1, row.d1).when(F.col("count") == 2, row.d2).otherwise(row.d3)
        by_size[row.size] = F.when(F.col("kind") == row.kind, d).otherwise(by_size[row.size])
    return by_size


def train(texts: DataFrame) -> DataFrame:
    """The models of all texts of column `text`: kind, size, gram, context (a flag), value, step.

    value: for an n-gram its log probability after its context, for a context the
    log of the share that it leaves to shorter ones. step: what the order adds to
    the log probability of the shorter n-gram. Null and empty texts count
    for nothing; without any text the model is empty and scores are null.

    Each order is made from the one before. What is asked of all orders reads
    their folder by one scan, and not a scan for each.
    """
    with Scratch(texts.sparkSession) as scratch:
        counted, ordered = scratch.folder("kn-counts"), scratch.folder("kn-orders")
        counts = {ORDER: scratch.part(count_ngrams(texts), counted, "size", ORDER)}
        for size in range(ORDER - 1, 0, -1):
            counts[size] = scratch.part(counts[size + 1].groupBy("kind", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("count")), counted, "size", size)
        symbols = counts[1].groupBy("kind").agg((F.count("*") + 1).cast("double").alias("symbols"))  # one for characters never seen
        lower = symbols.select("kind", F.lit("").alias("gram"), (1 / F.col("symbols")).alias("p"))
        model = lower.select("kind", F.lit(0).alias("size"), "gram", F.lit(False).alias("context"), F.log("p").alias("value"), F.log("p").alias("step"))
        discount = discounts(scratch.parts(counts[1], counted, "size"))
        for size in range(1, ORDER + 1):
            rows = counts[size].select("kind", "gram", "count", discount[size].alias("d"), F.substring("gram", 1, size - 1).alias("context"), F.substring("gram", 2, size - 1).alias("suffix"))
            contexts = rows.groupBy("kind", "context").agg(F.sum("count").alias("total"), (F.sum("d") / F.sum("count")).alias("left"))
            shorter = lower.select("kind", F.col("gram").alias("suffix"), F.col("p").alias("shorter"))
            if size == 1:  # one context and one shorter n-gram of each kind: the empty ones
                contexts, shorter = F.broadcast(contexts), F.broadcast(shorter)
            rows = rows.join(contexts, ["kind", "context"]).join(shorter, ["kind", "suffix"])
            p = (F.col("count") - F.col("d")) / F.col("total") + F.col("left") * F.col("shorter")
            done = scratch.part(rows.select("kind", "gram", p.alias("p"), "context", "left", F.log(p / F.col("shorter")).alias("step")), ordered, "size", size)
            lower = done.select("kind", "gram", "p")
        orders = scratch.parts(done, ordered, "size")
        shares = orders.groupBy("kind", "size", F.col("context").alias("gram")).agg(F.first("left").alias("left"))
        model = model.unionByName(orders.select("kind", "size", "gram", F.lit(False).alias("context"), F.log("p").alias("value"), "step"))
        model = model.unionByName(shares.select("kind", (F.col("size") - 1).alias("size"), "gram", F.lit(True).alias("context"), F.log("left").alias("value"), F.log("left").alias("step")))
        return stored(model, "kn-model")


class Shard:
    """A part of the model in an open hash table from key to value."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.shift = np.uint64(64 - max(4, (3 * len(key) // 2).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.zeros(size, np.float32), np.zeros(size, bool)
        slot = self.slots(key)
        while len(key):
            free = ~self.used[slot]
            self.keys[slot[free]] = key[free]  # of several for one slot the last one stays
            self.used[slot[free]] = True
            here = self.keys[slot] == key
            self.values[slot[here]] = value[here]
            key, value, slot = key[~here], value[~here], (slot[~here] + 1) & (size - 1)

    def slots(self, key: np.ndarray) -> np.ndarray:
        return (key >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Values of keys; NaN for those that aren't there."""
        slot = self.slots(key)
        out = self.values[slot]
        open_ = np.flatnonzero(self.keys[slot] != key)
        out[open_] = np.nan
        open_ = open_[self.used[slot[open_]]]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            hit = self.keys[slot[open_]] == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & self.used[slot[open_]]]
        return out


class ShardRows:
    """A shard's rows on the way to the tasks: unpickled there, they are the hash table, which the driver never holds."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.key, self.value = key, value

    def __reduce__(self) -> tuple:
        return Shard, (self.key, self.value)


def keyed(model: DataFrame, shards: int) -> DataFrame:
    """shard, key and value of every row of the model.

    A context and the n-grams after it are in the shard that the context's key
    gives. One shard has each n-gram's whole log probability; several have steps.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind, size = batch.column("kind").to_numpy(), batch.column("size").to_numpy()
        context = batch.column("context").to_numpy(zero_copy_only=False).astype(bool)
        grams = np.array(batch.column("gram").to_pylist(), f"<U{ORDER}")
        code = np.ascontiguousarray(grams).view("<u4").reshape(len(grams), ORDER)
        key, after = np.zeros(len(grams), np.uint64), np.zeros(len(grams), np.uint64)
        for k, n, flag in itertools.product(range(len(READ)), range(ORDER + 1), (False, True)):
            at = np.flatnonzero((kind == k) & (size == n) & (context == flag))
            key[at] = mix([code[at, i] for i in range(n)], len(at), k, flag)
            after[at] = mix([code[at, i] for i in range(n if flag else max(n - 1, 0))], len(at), k, True)
        shard = (after % np.uint64(shards)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), batch.column("value")], names=["shard", "key", "value"])

    value = F.col("value" if shards == 1 else "step").alias("value")
    return map_arrow(model.select("kind", "size", "gram", "context", value), run, "shard int, key long, value double", 10_000)


def load_shard(table: DataFrame, shard: int) -> ShardRows:
    """The rows of a shard of the keyed model."""
    rows = table.where(F.col("shard") == shard).select("key", "value").toArrow()
    found = ShardRows(rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy().astype(np.float32))
    del rows
    pa.default_memory_pool().release_unused()
    return found


def whole_logs(code: np.ndarray, at: np.ndarray, kind: int, table: Shard) -> np.ndarray:
    """Log probabilities at some places, by a table of the whole model: of the longest n-gram that is there, after what longer contexts leave."""
    out, open_ = np.zeros(len(at)), np.arange(len(at))
    for size in range(ORDER, -1, -1):
        place = at[open_]
        found = table.find(mix([code[place - size + 1 + k] for k in range(size)], len(place), kind))
        miss = np.isnan(found)
        out[open_[~miss]] += found[~miss]
        open_, place = open_[miss], place[miss]
        if not len(open_) or not size:
            break
        # all, if the context was never seen
        out[open_] += np.nan_to_num(table.find(mix([code[place - size + 1 + k] for k in range(size - 1)], len(place), kind, True)))
    return out


def shard_logs(code: np.ndarray, at: np.ndarray, kind: int, table: Shard, shard: int, shards: int) -> np.ndarray:
    """What a shard's contexts add to the log probabilities at some places: one step at every order."""
    out = np.zeros(len(at))
    for size in range(ORDER + 1):
        context = mix([code[at - size + 1 + k] for k in range(size - 1)], len(at), kind, True)
        mine = np.flatnonzero(context % np.uint64(shards) == shard)
        place, context = at[mine], context[mine]
        found = table.find(mix([code[place - size + 1 + k] for k in range(size)], len(place), kind))
        miss = np.isnan(found)
        if size:
            found[miss] = table.find(context[miss])
        out[mine] += np.nan_to_num(found)
    return out


def text_sums(texts: list[str | None], kind: int, logs: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of logs and the number of places of every text, read as symbols of a kind; 0 and 0 without symbols."""
    symbols = [READ[kind](t) for t in texts]
    total, number = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    given = [k for k, x in enumerate(symbols) if x]
    for portion in portions([symbols[k] for k in given]):
        mine = [given[k] for k in portion]
        code = codes([symbols[k] for k in mine])
        length = np.array([len(symbols[k]) for k in mine])
        first = np.cumsum(length + ORDER) - length - 1  # the place of each text's first symbol
        count = length + ENDS[kind]
        whose = np.repeat(np.arange(len(mine)), count)
        at = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        for k in range(0, len(at), PORTION):
            total[mine] += np.bincount(whose[k : k + PORTION], logs(code, at[k : k + PORTION]), len(mine))
        number[mine] = count
    return total, number


NAMES, LIMITS = ("perplexity", "word_perplexity"), ("threshold", "word_threshold")


@dataclass
class Dealt:
    """A model's rows by key in a number of shards; `whole`: the broadcast of a single one."""

    table: DataFrame
    shards: int
    whole: Broadcast | None

    def ship(self, shard: int) -> Broadcast:
        return ship(self.table, shard) if self.whole is None else self.whole


def ship(table: DataFrame, shard: int) -> Broadcast:
    return table.sparkSession.sparkContext.broadcast(load_shard(table, shard))  # SHARD_ENTRIES rows or little more


def deal(model: DataFrame) -> Dealt:
    """The model for any number of scorings; one that has a single shard passes through the driver once for all of them."""
    shards = -(-model.count() // SHARD_ENTRIES)
    table = keyed(model, max(shards, 1))
    if shards > 1:
        table = stored(table.repartition(shards, "shard"), "kn-keyed")
    return Dealt(table, shards, ship(table, 0) if shards == 1 else None)


def score(docs: DataFrame, model: DataFrame | Dealt, *keep: str) -> DataFrame:
    """`keep` columns, perplexity (per character and the end mark) and word_perplexity of every row; null without text or model.

    With more than one shard, every shard reads all texts, one after the other,
    and a text's sums meet by its hash, one row a shard for each distinct text.
    """
    dealt = model if isinstance(model, Dealt) else deal(model)
    shards = dealt.shards
    carried = "text" in keep  # then it travels once
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("keep"), *([] if carried else [F.col("text").cast("string").alias("text")]))
    text = F.col("keep.text" if carried else "text").cast("string").alias("text")
    if shards == 0:
        return rows.select("keep.*", *(F.lit(None).cast("double").alias(n) for n in NAMES))
    of_sums = ["total0", "number0", "total1", "number1"]

    def scored(of: DataFrame, name: str, shard: int, shipped: Broadcast) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, found = (batch.column("keep").field("text") if carried and name == "keep" else batch.column("text")).to_pylist(), []
            for kind in range(len(READ)):
                logs = (lambda code, at: whole_logs(code, at, kind, shipped.value)) if shards == 1 else (lambda code, at: shard_logs(code, at, kind, shipped.value, shard, shards))  # noqa: B023
                found += text_sums(texts, kind, logs)
            return pa.RecordBatch.from_arrays([batch.column(name), *map(pa.array, found)], names=[name, *of_sums])

        schema = StructType([of.schema[name]])
        for column in of_sums:
            schema.add(column, "double" if column.startswith("total") else "long")
        return map_arrow(of, run, schema)

    def perplexity(kind: int) -> Column:
        total, number = F.col(f"total{kind}"), F.col(f"number{kind}")
        return F.when(number > 0, F.exp(-total / number)).alias(NAMES[kind])

    if shards == 1:
        return scored(rows, "keep", 0, dealt.ship(0)).select("keep.*", perplexity(0), perplexity(1))
    name = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("name")
    both = None
    for shard in range(shards):
        shipped = dealt.ship(shard)
        one = stored(scored(rows.select(name, text), "name", shard, shipped).groupBy("name").agg(*(F.first(c).alias(c) for c in of_sums)), "kn-sums")
        shipped.destroy()  # one shard at a time is in memory
        both = one if both is None else both.unionByName(one)
    both = both.groupBy("name").agg(*(F.sum(c).alias(c) if c.startswith("total") else F.first(c).alias(c) for c in of_sums))
    return rows.select("keep", name).join(both, "name", "left").select("keep.*", perplexity(0), perplexity(1))


def quantiles(rows: DataFrame, shares: dict[str, float], *group: str) -> DataFrame:
    """`group` columns, what, value and n: a group's number of values and, of them, the least with at least a share of all at or below it.

    `rows` have these columns and a value; `shares` gives the share by `what`. The
    value is exact: approximate quantiles on both sides enclose it, and what lies
    between them, a few of ACCURACY values, is counted.
    """
    key, what = [*group, "what"], F.col("what")
    ends = [min(max(share + side * 2 / ACCURACY, 0.0), 1.0) for share in shares.values() for side in (-1, 1)]
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.percentile_approx("value", ends, ACCURACY).alias("ends"))
    low, high, rank = F.lit(None), F.lit(None), F.lit(None)
    for k, (name, share) in enumerate(shares.items()):
        low, high = F.when(what == name, F.col("ends")[2 * k]).otherwise(low), F.when(what == name, F.col("ends")[2 * k + 1]).otherwise(high)
        rank = F.when(what == name, F.greatest(F.lit(1), F.ceil(share * F.col("n")))).otherwise(rank)
    bounds = found.select(*key, "n", low.alias("low"), high.alias("high"), rank.alias("rank"))
    value = F.when(F.col("value") < F.col("low"), float("-inf")).when(F.col("value") > F.col("high"), float("inf")).otherwise(F.col("value"))
    counted = rows.join(F.broadcast(bounds), key).groupBy(*key, "n", "rank", value.alias("value")).agg(F.count("*").alias("count"))  # bounds: a row per group
    places = counted.withColumn("place", F.sum("count").over(Window.partitionBy(*key).orderBy("value"))).where("place >= rank")
    exact = F.when(F.abs(F.min("value")) < float("inf"), F.min("value")).otherwise(F.raise_error(F.lit("approximate quantiles don't enclose the exact one")).cast("double"))
    return places.groupBy(*key, "n").agg(exact.alias("value"))


def thresholds(scored: DataFrame, trusted: DataFrame, apart: Column | None = None) -> DataFrame:
    """lang and, for each perplexity, its threshold: the QUANTILE over trusted documents that were kept out of the counts (`apart`, else held_out()).

    A language with fewer than LEAST_HELD_OUT of them takes its median perplexity
    times the same quantile, over the held-out trusted documents of all languages,
    of the perplexity relative to their language's median. The medians are over all documents
    held out, or over all documents where a language has none there.
    All of them are exact. Only where no held-out trusted document has text are thresholds null.
    """
    apart = held_out() if apart is None else apart
    measures = F.explode(F.array(*(F.struct(F.lit(of).alias("of"), F.col(of).alias("value")) for of in NAMES))).alias("measure")
    what = F.filter(F.array(F.when(apart, "held").otherwise("rest"), F.when(apart & F.col("known"), "own")), lambda name: name.isNotNull())
    known = scored.join(trusted.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left").withColumn("what", F.explode(what))
    rows = stored(known.select("lang", "what", measures).select("lang", "what", "measure.*").where("value is not null"), "kn-measured")
    found = quantiles(rows, {"own": QUANTILE, "held": 0.5, "rest": 0.5}, "lang", "of")
    by_what = {what: F.max(F.when(F.col("what") == what, F.struct("value", "n"))) for what in ("own", "held", "rest")}
    each = found.groupBy("lang", "of").agg(by_what["own"].alias("own"), F.coalesce(by_what["held"], by_what["rest"])["value"].alias("usual"))
    few, seen = F.coalesce(F.col("n") < LEAST_HELD_OUT, F.lit(True)), Observation()
    each = stored(each.select("lang", "of", F.col("own.value").alias("own"), F.col("own.n").alias("n"), "usual").observe(seen, F.count_if(few).alias("few")), "kn-quantiles")
    limit = lambda column: [F.max(F.when(F.col("of") == of, column)).alias(name) for of, name in zip(NAMES, LIMITS)]
    if not seen.get["few"]:
        return each.groupBy("lang").agg(*limit(F.col("own")))
    relative = rows.where("what = 'own'").join(F.broadcast(each.select("lang", "of", "usual")), ["lang", "of"])  # two rows per language
    ratio = quantiles(relative.select("of", "what", (F.col("value") / F.col("usual")).alias("value")), {"own": QUANTILE}, "of").select("of", F.col("value").alias("ratio"))
    return each.join(F.broadcast(ratio), "of", "left").groupBy("lang").agg(*limit(F.when(few, F.col("usual") * F.col("ratio")).otherwise(F.col("own"))))  # one ratio for each perplexity


def held_out(fold: int = 0) -> Column:
    """The documents of a fold, whose perplexities set thresholds; they aren't counted."""
    return F.coalesce(checksum() % HELD_OUT_FOLDS == fold, F.lit(False))


def checksum() -> Column:
    return F.crc32(F.col("doc_id").cast("string"))


def other_split(named: DataFrame, trusted: DataFrame) -> Column | None:
    """The documents to hold out where the first fold has no trusted text, or all of it; none if it makes no difference.

    It is another fold that has some and leaves some. Where all trusted text is in
    one fold, it is that of the lowest checksum, and nothing where that is all.
    """
    spoken = named.where(F.translate("text", START + END, "") != "").select("doc_id")
    found = with_ids(spoken, trusted).agg(F.sort_array(F.collect_set(checksum() % HELD_OUT_FOLDS)).alias("folds"), F.min(checksum()).alias("low"), F.max(checksum()).alias("high")).first()
    if len(found.folds) > 1:
        return held_out(found.folds[0])
    if found.low != found.high:
        return F.coalesce(checksum() == found.low, F.lit(False))
    return F.lit(False) if found.folds == [0] else None


def fitted(named: DataFrame, trusted: DataFrame, apart: Column) -> tuple[Dealt, DataFrame, int]:
    """The model of the trusted texts that aren't set apart, the thresholds that those set apart give for it, and their number."""
    model = deal(train(with_ids(named.where(~apart).select("doc_id", "text"), trusted)))
    # thresholds look at the held-out documents, and at all those of a language that has none there
    texts = named.where("text != ''")
    others = texts.groupBy("lang").agg(F.bool_or(apart).alias("asked")).where("NOT asked").select("lang")
    others, number = stored_and_counted(others, "kn-languages")
    sample = texts.where(apart)
    if number:
        sample = sample.unionByName(texts.where(~apart).join(others, "lang", "left_semi"))
    judged = stored(score(sample, model, "doc_id", "lang"), "kn-judged")
    seen = Observation()
    limits = thresholds(judged, trusted, apart).observe(seen, F.count("threshold").alias("n"))
    return model, stored(limits, "kn-limits"), seen.get["n"]  # a row per language; Spark broadcasts it if its file is small


def classify(docs: DataFrame, trusted: DataFrame, *keep: str) -> DataFrame:
    """doc_id, lang (and `keep` columns), perplexity, threshold, word_perplexity, word_threshold and kept of every row of `docs` (doc_id, text, lang).

    A row is kept if both perplexities, of its characters and of how its words
    recur, are within their thresholds. `trusted` holds the doc_ids of trusted
    documents. A null or empty text has no perplexity and isn't kept; a null
    language is the language ''. Rows that repeat a doc_id are each scored; text
    of a repeated trusted row counts as often as it stands there. Columns of
    `docs` that aren't asked for do no harm, whatever their names. Documents of
    one fold set the thresholds; where it has no trusted text or all of it, others
    do (`other_split`). Only with a single trusted document that has text is there
    no threshold, and what has a perplexity is kept.

    Texts are read three times (to count, to set thresholds, to decide) and
    neither shuffled nor stored; if the fold is changed, once more to choose
    it and twice more to count and to set thresholds.
    """
    columns = list(dict.fromkeys(["doc_id", "lang", *keep]))
    named = docs.withColumn("lang", F.coalesce("lang", F.lit(""))).select(*dict.fromkeys([*columns, "text"]))
    model, limits, number = fitted(named, trusted, held_out())
    if not number:  # the fold has no trusted text, or all of it
        split = other_split(named, trusted)
        if split is not None:
            model, limits, _ = fitted(named, trusted, split)
    found = score(named, model, *columns).join(limits, "lang", "left")
    within = F.col("perplexity").isNotNull()
    for of, name in zip(NAMES, LIMITS):
        within &= F.col(of).isNull() | F.col(name).isNull() | (F.col(of) <= F.col(name))
    return found.select(*columns, "perplexity", "threshold", "word_perplexity", "word_threshold", within.alias("kept"))
