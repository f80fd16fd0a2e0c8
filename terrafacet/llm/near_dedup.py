"""Near-duplicate documents: MinHash bands, odd sketches, exact verification, components.

Documents with equal shingle sets form a class first. Classes that share a band
of MinHash values meet in a bucket. A bucket isn't paired up. First all its
members are compared with one, a member that shares much with others; pairs whose
odd sketches differ in few enough bits, by the population count of their XOR, are
confirmed on the full sets, and links join components. Then every member outside
its bucket's largest component looks, by finer odd sketches, for the members of
other components that seem nearest to it: for one at first, then for eight. Those
to which the sketch allows still others meet all of them, in groups of bounded
size that confirm pairs on the full sets and give links only. So no link is lost
but by the bands or the sketch, and near copies cost about one comparison a
member. With 32 bands of 4 rows, two sets of similarity
0.8 share no band with a chance of 5e-8, at 0.85 of 6e-11; sketches allow 5.4
standard deviations.

A class is named by a 64-bit hash of its set, and never by an id of the rows, so
that absent, repeated and arbitrarily large ids do no harm. Sets are of 64-bit
hashes of shingles: among 10 ** 9 different sets, two have one name with a chance
of 3 percent, and a given pair of documents counts a shingle wrongly with one of
10 ** -12 at most at 1000 shingles each.

Texts aren't shuffled. The second pass over them computes the sets of those
documents alone that a bitmap of fixed size lets through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.llm.shared import Scratch, map_arrow, stored, texts_of, with_ids

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SKETCH_WORDS = 8  # 64-bit words of an odd sketch
FINE_HASHES, FINE_WORDS = 1024, 64
CHUNK_VALUES = 1 << 19
GROUP_ROWS, GROUP_SHINGLES = 1024, 1 << 21
PARTNERS = (1, 8)
BITMAP_BITS, ID_BITS = 1 << 26, 128

# Odd 64-bit constants of the hashes.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """A 64-bit hash of every word `[^\\x20\\x09-\\x0D]+` of each text, A to Z lower-cased."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    words = split.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    given = pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)
    index = words.indices.to_numpy()
    kept = given[index] if len(given) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(kept)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    found = hashes[index[kept]]
    return [found[a:b] for a, b in zip(ends, ends[1:])]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of hashed words; with fewer words, of the whole sequence; without words, none."""
    if not len(words):
        return words
    size = min(SHINGLE_WORDS, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += words[k : k + n] * PLACE[k]
    return np.unique(mix(total))


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * PLACE[0])
    return (seeds >> np.uint64(32)).astype(np.uint32)[:, None], (seeds.astype(np.uint32) | np.uint32(1))[:, None]


def minhashes(shingles: np.ndarray, count: int = HASHES) -> np.ndarray:
    """The least value of each hash function over a set."""
    flip, times = hash_family(count)
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(count, 0xFFFFFFFF, np.uint32)
    step = CHUNK_VALUES // count
    for at in range(0, len(short), step):
        np.minimum(least, ((short[at : at + step] ^ flip) * times).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key of each band of ROWS values."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * PLACE[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACE[4]).view(np.int64)


def odd_sketch(least: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The MinHash samples folded into a bitmap: a bit is the parity of the samples that fall on it."""
    bit = mix(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * words)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=64 * words).astype(np.uint8) & 1).view(np.int64)


def most_different_bits(similarity: float, hashes: int = HASHES, words: int = SKETCH_WORDS) -> int:
    """The number of differing bits that two sets of this similarity are expected to have at most, 5.4 deviations allowed.

    The samples that differ are binomial; twice as many bits are flipped, of which some meet.
    """
    low = similarity - 5.4 * (similarity * (1 - similarity) / hashes) ** 0.5
    bits = 64 * words
    expected = bits / 2 * (1 - np.exp(-4 * hashes * (1 - low) / bits))
    return int(np.ceil(expected + expected**0.5))


def set_name(shingles: np.ndarray) -> int:
    """The name of the class of documents with this set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, id (the name of the set), bands and sketch of each row of `docs` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, ids, bands, sketches = [], [], [], []
        for words in word_hashes(batch.column("text")):
            shingles = shingle_set(words)
            least = minhashes(shingles)
            sizes.append(len(shingles))
            ids.append(set_name(shingles))
            bands.append(band_keys(least))
            sketches.append(odd_sketch(least))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)],
            names=["doc_id", "tie", "n_shingles", "id", "bands", "sketch"],
        )

    rows = docs.select("doc_id", "text", text_tie().alias("tie"))
    return map_arrow(rows, run, "doc_id long, tie long, n_shingles long, id long, bands array<long>, sketch array<long>")


def text_tie() -> Column:
    return F.xxhash64("text")


def bitmap_slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = bitmap_slot(ids, 32 * len(bitmap))
    return (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def bitmap_of(ids: DataFrame, number: int | None = None) -> np.ndarray:
    """Bits at the slots of all ids (one column, stored; `number` of them, if known), ID_BITS an id up to BITMAP_BITS in all; the rows that reach the driver are its words, at most."""
    bits = min(BITMAP_BITS, 1 << max(10, (ID_BITS * (ids.count() if number is None else number) - 1).bit_length()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = bitmap_slot(batch.column(0).to_numpy(), bits)
        return pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], names=["word", "bit"])

    words = map_arrow(ids, run, "word long, bit long", 10_000).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(bits >> 5, np.uint32)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bitmap


def member_sets(docs: DataFrame, picks: DataFrame, scratch: Scratch) -> DataFrame:
    """id, shingles and fine sketch of the sets of the rows among `picks`, once each, and of a few others that the bitmap can't tell from them."""
    shipped = scratch.broadcast(bitmap_of(picks))  # BITMAP_BITS / 8 bytes at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.filter(pa.array(in_bitmap(shipped.value, batch.column("pick").to_numpy())))
        sets = [shingle_set(words) for words in word_hashes(found.column("text"))]
        fine = [odd_sketch(minhashes(x, FINE_HASHES), FINE_WORDS) for x in sets]
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], longs), pa.array(fine, longs)], names=["id", "shingles", "fine"])

    rows = docs.select("text", row_pick(F.col("doc_id"), text_tie()).alias("pick"))
    sets = scratch.stored(map_arrow(rows, run, "id long, shingles array<long>, fine array<long>").where(F.size("shingles") > 0), "sets")
    twice, number = scratch.counted(sets.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "sets-twice")
    if not number:
        return sets
    return scratch.stored(of_ids(sets, twice, "left_anti").unionByName(of_ids(sets, twice).dropDuplicates(["id"])), "sets-once")


def row_pick(doc_id: Column, tie: Column) -> Column:
    """A hash of a row's id and text, by which a second reading finds it again."""
    return F.xxhash64(doc_id, tie)


def differing_bits(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, SKETCH_WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def shared_buckets(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """key and id of the classes in buckets of two or more, with the bucket's size n; of buckets with the same members one stands for all.

    Most buckets hold one class. Its rows don't travel twice: a bitmap of the
    shared keys holds them back, but for a few that it can't tell apart.
    """
    rows = classes.select(F.explode("bands").alias("key"), "id")
    shared, number = scratch.counted(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-keys")
    shipped = scratch.broadcast(bitmap_of(shared, number))  # BITMAP_BITS / 8 bytes at most
    near = scratch.stored(map_arrow(rows, lambda batch: batch.filter(pa.array(in_bitmap(shipped.value, batch.column("key").to_numpy()))), "key long, id long", 10_000), "band-rows")
    members = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    alike = near.groupBy("key").agg(F.count("*").alias("n"), *members).where("n > 1").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    return near.join(alike.select("key", "n"), "key")


def star_pairs(members: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """a > b: each bucket's member whose buckets are largest in all, with the others that the sketch allows."""
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    middle = members.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("middle"))
    pairs = members.join(middle, "key").where("id != middle").select("id", "middle").distinct()
    sketch = classes.select("id", "sketch")
    both = pairs.join(sketch, "id").join(sketch.select(F.col("id").alias("middle"), F.col("sketch").alias("other")), "middle")
    close = both.where(differing_bits(F.col("sketch"), F.col("other")) <= most)
    return close.select(F.greatest("id", "middle").alias("a"), F.least("id", "middle").alias("b"))


def grouped(rows: DataFrame, seekers: DataFrame, sets: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str, weight: Column | None = None) -> DataFrame:
    """Apply `f` to groups in which every seeker of a bucket meets every member of it, each pair once.

    `rows` holds key, id, component and the bucket's numbers n of rows and s of
    seekers, `seekers` those rows that seek; `f` gets key, id, component, `seeks`
    and the columns of `sets`. Buckets are cut into groups of about
    GROUP_ROWS seekers and GROUP_ROWS members, or fewer if these weigh more than
    GROUP_ROWS. Sketches and sets join the rows last and travel once.
    """
    sets = of_ids(sets, rows)
    common, hashed = ["key", "id", "component"], F.xxhash64("id")
    if weight is not None:
        weights = sets.select("id", weight.alias("w"))
        heavy = [x.join(weights, "id").groupBy("key").agg(F.sum("w").alias(n)) for x, n in ((rows, "n"), (seekers, "s"))]
        sized = heavy[0].join(heavy[1], "key")  # a row per bucket
        rows, seekers = (x.select(*common).join(sized, "key") for x in (rows, seekers))

    def cut(n: str) -> Column:
        return F.ceil(F.col(n) / GROUP_ROWS)

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), cut(n) - 1))

    left = seekers.select(*common, F.lit(True).alias("seeks"), F.pmod(hashed, cut("s")).alias("g"), spread("n").alias("h"))
    right = rows.select(*common, F.lit(False).alias("seeks"), spread("s").alias("g"), F.pmod(hashed, cut("n")).alias("h"))
    return left.unionByName(right).join(sets, "id").groupBy("key", "g", "h").applyInArrow(f, schema)


class Group:
    """One group's seekers and members, in Arrow's rows, and what their fine sketches allow."""

    def __init__(self, group: pa.Table, most: int):
        self.ids, self.component = group.column("id").to_numpy(), group.column("component").to_numpy()
        self.fine = np.array(group.column("fine").combine_chunks().flatten().to_numpy()).view(np.uint64).reshape(-1, FINE_WORDS)  # bit_count takes absolute values
        seeks = group.column("seeks").to_numpy(zero_copy_only=False).astype(bool)
        members = np.flatnonzero(~seeks)
        self.seekers, self.members, self.most = np.flatnonzero(seeks), members[np.argsort(self.ids[members], kind="stable")], most

    def allowed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each seeker: its row, the places among members of other components that its sketch allows, and the bits that differ."""
        for at in range(0, len(self.seekers), 16):
            some = self.seekers[at : at + 16]
            bits = np.bitwise_count(self.fine[some][:, None, :] ^ self.fine[self.members][None]).sum(2, dtype=np.int32)
            bits[self.component[some][:, None] == self.component[self.members]] = self.most + 1
            for row, mine in zip(bits, some):
                places = np.flatnonzero(row <= self.most)
                if len(places):
                    yield int(mine), places, row[places]


def partner_pairs(rows: DataFrame, seekers: DataFrame, sets: DataFrame, partners: int, most: int) -> DataFrame:
    """key, seeker, id and more: for each seeker the `partners` members of other components that differ least in the fine sketch.

    `rows` and `seekers` as in `grouped`. `more`: the sketch allows others.
    """

    def nearest(table: pa.Table) -> pa.Table:
        group = Group(table, most)
        seeker, found, more = [], [], []
        for mine, places, bits in group.allowed():
            best = places[np.argsort(bits, kind="stable")[:partners]]
            seeker += [group.ids[mine]] * len(best)
            found += group.ids[group.members[best]].tolist()
            more += [len(places) > partners] * len(best)
        key = pa.array([table.column("key")[0].as_py()] * len(seeker), pa.int64())
        return pa.Table.from_arrays([key, pa.array(seeker, pa.int64()), pa.array(found, pa.int64()), pa.array(more, pa.bool_())], names=["key", "seeker", "id", "more"])

    return grouped(rows, seekers, sets.select("id", "fine"), nearest, "key long, seeker long, id long, more boolean")


def remaining_links(rows: DataFrame, seekers: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b: links of seekers with members of other components, as many in each group as join what is joined by any of its links.

    `rows` and `seekers` as in `grouped`. All pairs that the sketch
    allows are confirmed on the full sets inside the group, by a list of the
    members that hold each shingle, and none of them leaves it but the links.
    """

    def confirmed(table: pa.Table) -> pa.Table:
        group = Group(table, most)
        sets = table.column("shingles").combine_chunks()
        flat, ends = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
        size = np.diff(ends)
        held = np.concatenate([flat[:0], *(flat[ends[m] : ends[m + 1]] for m in group.members)])
        order = np.argsort(held, kind="stable")
        held, holder = held[order], np.repeat(np.arange(len(group.members)), size[group.members])[order]
        _, part = np.unique(group.component, return_inverse=True)
        links: list[tuple[int, int]] = []
        for mine, places, _ in group.allowed():
            places = places[part[group.members[places]] != part[mine]]
            if not len(places):
                continue
            own = flat[ends[mine] : ends[mine + 1]]
            first, past = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            n = past - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(holder[at], minlength=len(group.members))[places]
            linked = places[100 * common >= percent * (size[mine] + size[group.members[places]] - common)]
            _, one = np.unique(part[group.members[linked]], return_index=True)
            for member in group.members[linked[one]]:
                links.append((int(group.ids[mine]), int(group.ids[member])))
                part[part == part[member]] = part[mine]
        return pa.Table.from_arrays([pa.array([max(x) for x in links], pa.int64()), pa.array([min(x) for x in links], pa.int64())], names=["a", "b"])

    weight = F.greatest(F.lit(1.0), F.size("shingles") / GROUP_SHINGLES * GROUP_ROWS)
    return grouped(rows, seekers, sets, confirmed, "a long, b long", weight)


def of_ids(sets: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The sets of some ids, picked before they travel; the others if `how` is left_anti."""
    return with_ids(sets.withColumnRenamed("id", "doc_id"), ids.select(F.col("id").alias("doc_id")), how=how).withColumnRenamed("doc_id", "id")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are as similar as asked. Only sets of these pairs travel."""
    sets = of_ids(sets, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every end a stands there once and is no b."""
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(x).alias("id"), F.lit(leaf).alias("leaf")) for x, leaf in (("a", 1), ("b", 0))))))
    return ends.groupBy("id").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least")).where("n > least").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (its least id) of every other end of the edges a, b, by alternating large and small stars.

    In every round a > b, and the edges stand in its plan as few times as can be: each scan, join and exchange costs memory of the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    while True:
        both = edges.select(F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba")))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in "ab")))).where("a != b")
        edges = scratch.stored(small.distinct(), "stars")
        if are_stars(edges):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def join_components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component after more links a, b."""
    known = [labels.select(F.col("id").alias(x), F.col("component").alias(x + "c")) for x in "ab"]
    joined = links.join(known[0], "a", "left").join(known[1], "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    merged = components(joined, scratch)
    old = labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return scratch.stored(old.unionByName(merged.join(labels, "id", "left_anti")), "labels")


def open_buckets(wide: DataFrame, labels: DataFrame, asked: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Rows and seekers, as in `grouped`, and the number of rows of the buckets of `wide` (key, id) in which some have to meet others of other components.

    Seekers are the rows outside of their bucket's largest component, or those
    `asked` (key, id): of two members of different components one has asked so far.
    So every such bucket has seekers, and there are none only if there are no rows. No row looks for its bucket's seekers: buckets are joined with buckets.
    """
    if asked is not None:
        wide = wide.join(asked.select("key").distinct(), "key", "left_semi")
    named = scratch.stored(wide.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "named-rows")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("m"))
    split = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("m").alias("n")).where("parts > 1")
    split = split.select("key", "n", (F.col("n") - F.col("largest.m")).alias("s"), F.col("largest.component").alias("main"))
    if asked is not None:
        split = split.drop("s").join(asked.groupBy("key").agg(F.count("*").alias("s")), "key")
    rows, number = scratch.counted(named.join(split, "key"), "open-buckets")
    return rows, rows.where("component != main") if asked is None else rows.join(asked, ["key", "id"], "left_semi"), number


def link_classes(docs: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """id and component of every class that is linked with another."""
    spark = docs.sparkSession
    members = scratch.stored(shared_buckets(classes, scratch), "buckets")
    starred = scratch.stored(star_pairs(members, classes, most_different_bits(percent / 100)), "star-pairs")
    # a bucket of two is through with its pair: without one that the sketch allows, neither set is asked for
    asked_for = members.where("n > 2").select("id").union(starred.select("a")).union(starred.select("b"))
    picks = classes.join(asked_for.distinct(), "id", "left_semi").select(row_pick(F.col("least.doc_id"), F.col("least.tie")).alias("pick"))
    picks = scratch.stored(picks, "picks")
    sets = member_sets(docs, picks, scratch)
    labels = spark.range(0).select("id", F.col("id").alias("component"))
    links, number = scratch.counted(confirm(starred, sets, percent), "links")
    asked, most = None, most_different_bits(percent / 100, FINE_HASHES, FINE_WORDS)
    wide = members.where("n > 2").select("key", "id")  # all pairs of a bucket of two are through
    for partners in (*PARTNERS, None):
        if number:
            labels = join_components(labels, links, scratch)
        rows, seekers, open_rows = open_buckets(wide, labels, asked, scratch)
        if not open_rows:
            return labels
        if partners is None:
            links, number = scratch.counted(remaining_links(rows, seekers, sets, percent, most).distinct(), "links")
        else:
            found = scratch.stored(partner_pairs(rows, seekers, sets, partners, most), "partners")
            pairs = found.select(F.greatest("seeker", "id").alias("a"), F.least("seeker", "id").alias("b")).distinct()
            links, number = scratch.counted(confirm(pairs, sets, percent), "links")
            asked, wide = found.where("more").select("key", F.col("seeker").alias("id")).distinct(), rows.select("key", "id")
    return join_components(labels, links, scratch) if number else labels


def find_components(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, tie, n_shingles and least (the component's first row: absent, doc_id, tie; null without words) of each row of `docs`, stored; all else is deleted."""
    docs = texts_of(docs)
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.stored(signatures(docs), "signatures")
        row = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tie")
        classes = signed.where("n_shingles > 0").groupBy("id").agg(F.min(row).alias("least"), F.first(F.struct("bands", "sketch")).alias("s")).select("id", "least", "s.*")
        classes = scratch.stored(classes, "classes")
        labels = link_classes(docs, classes, percent, scratch)
        named = scratch.stored(classes.select("id", "least").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
        least = named.groupBy("component").agg(F.min("least").alias("least"))
        sets = named.select("id", "component").join(least, "component").select("id", "least")
        rows = signed.select("doc_id", "tie", "n_shingles", "id")
        worded = rows.where("n_shingles > 0").join(sets, "id").drop("id")
        wordless = rows.where("n_shingles = 0").drop("id").withColumn("least", F.lit(None).cast(sets.schema["least"].dataType))
        return stored(worded.unionByName(wordless), "near-duplicates")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Documents are linked whose 5-word shingle sets have 100 * common >= percent *
    united. component_id is the least doc_id that links reach. A null or empty
    text, or one without words, is linked with nothing. Rows that repeat a doc_id
    are each judged by their own text, and linked through it alone. Rows without a
    doc_id take part; one of them is kept only if nothing else of its component
    has one, and then has no component_id. A doc_id may be any 64-bit number.
    """
    doc_id, least = F.col("doc_id"), F.col("least")
    first = doc_id.isNull() & least.absent & (F.col("tie") == least.tie)
    return find_components(docs, percent).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, least.doc_id).otherwise(doc_id).alias("component_id"),
        ((F.col("n_shingles") == 0) | F.coalesce(doc_id == least.doc_id, first)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs` without all but one document of each component.

    The least doc_id of a component stays. Texts without words stay. Rows that
    repeat a doc_id are each judged by their own text: of those of a component's
    least doc_id one stays, of the least text hash. Rows without a doc_id give
    way to those with one. Columns of `docs` may have any names.

    Texts aren't shuffled, but those of repeated or absent doc_ids.
    """
    names = docs.columns
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), words.alias("words"))
    found = find_components(docs, percent).where("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tie") == F.col("least.tie"))
    repeated = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    gone = found.where(~stays).select("doc_id").union(repeated)
    once = with_ids(rows.where("words and doc_id is not null"), gone, how="left_anti")
    first = found.where(stays).select("doc_id", "tie").distinct()
    several = with_ids(rows.where("words and doc_id is not null"), repeated).join(first.join(repeated, "doc_id", "left_semi"), ["doc_id", "tie"], "left_semi").dropDuplicates(["doc_id", "tie"])
    nameless = rows.where("words and doc_id is null").join(first.where("doc_id is null").select("tie"), "tie", "left_semi").dropDuplicates(["tie"])
    parts = [rows.where("not words"), once, several, nameless]
    kept = parts[0].select("row")
    for part in parts[1:]:
        kept = kept.union(part.select("row"))
    return kept.select("row.*")
