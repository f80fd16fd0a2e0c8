"""Legends: class limits of a numeric column, and their sizes.

Limits come from aggregates; those that need a walk over values walk the
histogram, which Spark makes, and not the records.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.operators.order import numbered, running
from terrafacet.session import settle

CLASSES = 10


def ends(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def from_ends(df: DataFrame, value: str, limit: callable) -> DataFrame:
    """k and cutoff of CLASSES classes, the last at the maximum."""
    low, high = F.col("low"), F.col("high")
    rows = ends(df, value).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(CLASSES))))
    return rows.select("k", F.when(F.col("k") == CLASSES, high).otherwise(limit(low, high, F.col("k") / CLASSES)).alias("cutoff"))


def even(df: DataFrame, value: str) -> DataFrame:
    return from_ends(df, value, lambda low, high, t: low + (high - low) * t)


def even_log(df: DataFrame, value: str, ten: bool = False) -> DataFrame:
    """Even steps of the logarithm; values are moved up first if the least is below 1."""
    log, power = (F.log10, lambda x: F.pow(F.lit(10.0), x)) if ten else (F.ln, F.exp)

    def limit(low: Column, high: Column, t: Column) -> Column:
        move = F.when(low < 1, 1 - low).otherwise(0.0)
        return power(log(low + move) + (log(high + move) - log(low + move)) * t) - move

    return from_ends(df, value, limit)


def decades(df: DataFrame, year: str) -> DataFrame:
    """low and high of every decade that occurs, with its records."""
    low = (F.floor(F.col(year) / 10) * 10).cast("int")
    return df.where(F.col(year).isNotNull()).groupBy(low.alias("low")).agg(F.count("*").alias("records")).withColumn("high", F.col("low") + 9)


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def positions(df: DataFrame, value: str) -> DataFrame:
    """value, n, rank from 1, and the records before (start) and up to (end) each distinct value."""
    ranked = numbered(histogram(df.where(~F.isnan(F.col(value).cast("double"))), value), [F.col("value")], "rank")
    return settle(running(ranked, F.col("n"), [F.col("value")], "end").withColumn("start", F.col("end") - F.col("n")))


def equal_size(df: DataFrame, value: str) -> DataFrame:
    """k and cutoff: classes of equal numbers of distinct values, what is left dealt anew after each.

    A class whose last value has one record also takes the next value if that has
    more, and the count of what is left doesn't see it. The last class ends at the
    maximum; classes without values are left out. The ranks at which a class may
    end are known from the number of values, so at most CLASSES ** 2 rows meet.
    """
    placed = positions(df, value)
    ends = placed.agg(F.count("*").alias("all"), F.max("value").alias("high"))

    def deal(done: Column, k: Column) -> Column:
        return F.concat(done, F.array(F.element_at(done, -1) + F.ceil((F.col("all") - F.element_at(done, -1)) / (CLASSES + 1 - k))))

    dealt = F.aggregate(F.sequence(F.lit(1), F.lit(CLASSES)), F.array(F.lit(0).cast("long")), deal)
    ends = ends.withColumn("dealt", dealt)
    # as many values as classes ended before may have been taken on the way
    near = placed.join(F.broadcast(ends.select(F.posexplode("dealt").alias("k", "at"))), F.col("rank").between(F.col("at"), F.col("at") + F.col("k")))
    known = near.groupBy().agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("rank", F.struct("value", "n"))))).alias("known"))

    def end(state: Column, k: Column) -> Column:
        at = F.get("dealt", k) + state["taken"]
        own, after = F.try_element_at("known", at), F.try_element_at("known", at + 1)
        takes = F.coalesce((own["n"] == 1) & (after["n"] > 1), F.lit(False))
        ended = F.coalesce((at < F.col("all")) | (own["n"] > 1) & (F.get("dealt", k) > F.get("dealt", k - 1)), F.lit(False))
        cutoff = F.struct(k.alias("k"), F.when(takes, after["value"]).otherwise(own["value"]).alias("cutoff"))
        return F.struct((state["taken"] + takes.cast("long")).alias("taken"), F.when(ended, F.array_append(state["found"], cutoff)).otherwise(state["found"]).alias("found"))

    none = F.struct(F.lit(0).cast("long").alias("taken"), F.expr("cast(array() as array<struct<k: int, cutoff: double>>)").alias("found"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(CLASSES - 1)), none, end)["found"]
    last = F.array(F.struct(F.lit(CLASSES).alias("k"), F.col("high").alias("cutoff")))
    return ends.crossJoin(F.broadcast(known)).where("all > 0").select(F.inline(F.concat(found, last)))  # one row each


SCALES = (200, 20)  # powers of 1.2 by which a step is made smaller and larger: enough for 10^16 records
POWERS_AT_ONCE = 8


def walked(rows: DataFrame, every: int, scales: list[float]) -> list[tuple[bool, list[float]]]:
    """Of each scale: whether its classes take all records, and their cutoffs. One aggregate a class, for all scales at once.

    `rows` holds value, n, start, end and next of the distinct values; what comes
    back to the driver is an end and a value for each scale.
    """

    def step(left: int, classes: int, scale: float) -> int:
        return math.floor(math.ceil(left / classes) * scale)

    first = [step(every, CLASSES, scale) for scale in scales]
    begin, at, cutoffs, open_ = [0] * len(scales), list(first), [[] for _ in scales], set(range(len(scales)))
    for k in range(1, CLASSES + 1):
        ended = []
        for p in sorted(open_):  # `at`: the record at which a class ends at the latest; the first class begins to count one record late
            stops = (F.col("start") >= begin[p]) & ((F.col("end") > min(at[p], every - 1)) | (F.col("n") >= first[p]) | (F.col("next") >= first[p]))
            ended.append(F.min(F.when(stops, F.struct("end", "value"))).alias(f"p{p}"))
        if not ended:
            break
        stop = rows.agg(*ended).first()
        for p in sorted(open_):
            if stop[f"p{p}"] is None:
                open_.remove(p)
                continue
            begin[p], cutoff = stop[f"p{p}"]
            cutoffs[p].append(cutoff)
            size = step(every - begin[p] + 1, CLASSES - k, scales[p]) if k < CLASSES else 0
            at[p] = max(begin[p] + size - 1, begin[p])
    return [(b == every, c) for b, c in zip(begin, cutoffs)]


def equal_area(df: DataFrame, value: str) -> DataFrame:
    """k and cutoff: classes of about equal numbers of records, equal values in one class.

    A value with as many records as a step is a class alone. A step is what is left
    over the classes left, times a power of 1.2: the least power from 1 on that takes
    all records, or, if classes are left over and there are values enough, the
    greatest one below 1 that fills them. Powers are walked outwards from 1, a few
    at once, until one does. Fewer values than classes give fewer classes.
    """
    placed = positions(df, value)
    following = placed.select(F.col("start").alias("end"), F.col("n").alias("next"))
    rows = settle(placed.join(following, "end", "left").select("value", "n", "start", "end", F.coalesce("next", F.lit(0)).alias("next")))
    uniques, every = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()  # one row
    cutoffs: list[float] = []
    if every:
        whole, cutoffs = walked(rows, every, [1.0])[0]
        few = len(cutoffs) < CLASSES and uniques > CLASSES
        if not whole or few:
            cutoffs = _first_good(rows, every, larger=not whole)
    return df.sparkSession.createDataFrame(list(enumerate(cutoffs, 1)), "k int, cutoff double")


def _first_good(rows: DataFrame, every: int, larger: bool) -> list[float]:
    """Cutoffs of the power nearest to 1, upwards or downwards, that takes all records or fills the classes."""
    scale, most = 1.0, SCALES[larger]
    for begun in range(0, most, POWERS_AT_ONCE):
        scales = []
        for _ in range(min(POWERS_AT_ONCE, most - begun)):
            scale = scale * 1.2 if larger else scale / 1.2
            scales.append(scale)
        for whole, cutoffs in walked(rows, every, scales):
            if whole if larger else len(cutoffs) >= CLASSES:
                return cutoffs
    return []


def sizes(df: DataFrame, value: str, cutoffs: DataFrame) -> DataFrame:
    """k, cutoff, records and distinct values of every class; a class holds what is above the cutoff before and up to its own."""
    limits = cutoffs.agg(F.array_sort(F.collect_list("cutoff")).alias("limits"))
    counted = histogram(df, value).crossJoin(F.broadcast(limits))  # one row of CLASSES numbers
    k = F.size(F.filter("limits", lambda c: c < F.col("value"))) + 1
    inside = counted.groupBy(k.alias("k")).agg(F.sum("n").alias("records"), F.count("*").alias("uniques"))
    numbered = limits.select(F.posexplode("limits").alias("p", "cutoff")).select((F.col("p") + 1).alias("k"), "cutoff")
    return numbered.join(inside, "k", "left").na.fill(0, ["records", "uniques"])


def best(df: DataFrame, value: str) -> DataFrame:
    """name and deviation of the legend whose classes are most alike in records, of log10, even and log; the first of equals."""
    found = None
    for rank, (name, cutoffs) in enumerate((("log10", even_log(df, value, True)), ("even", even(df, value)), ("log", even_log(df, value)))):
        one = sizes(df, value, cutoffs).agg(F.stddev_pop("records").alias("deviation")).select(F.lit(rank).alias("rank"), F.lit(name).alias("name"), "deviation")
        found = one if found is None else found.unionByName(one)
    return found.orderBy("deviation", "rank").limit(1).select("name", "deviation")


def categories(df: DataFrame, value: str, most: int) -> DataFrame:
    """value, records and colour number by falling records, ties by value; the last colour is used again."""
    counted = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("records"))
    ranked = numbered(counted, [F.desc("records"), F.col("value")], "rank")
    return ranked.withColumn("colour", F.least("rank", F.lit(most)).cast("int")).drop("rank")


def by_type(df: DataFrame, value: str, most: int = CLASSES) -> DataFrame:
    """name and records: of a numeric column the ranges of equal_area, with 'n/a' for what is no number; of another its values, of which all beyond the first `most` are one 'n more'."""
    if df.schema[value].dataType.simpleString() in ("string", "boolean", "date", "timestamp"):
        ranked = categories(df, value, most)
        counted = ranked.groupBy("colour").agg(F.count("*").alias("all"), F.min(F.col("value").cast("string")).alias("one"), F.sum("records").alias("records"))
        return counted.select("colour", F.when(F.col("all") == 1, F.col("one")).otherwise(F.concat(F.col("all").cast("string"), F.lit(" more"))).alias("name"), "records")
    number = F.col(value).cast("double")
    known = df.where(number.isNotNull() & ~F.isnan(number))
    cutoffs = settle(equal_area(known, value))
    text = F.array_sort(F.collect_list("cutoff"))
    limits = cutoffs.agg(text.alias("all"))  # CLASSES at most
    inside = sizes(known, value, cutoffs).crossJoin(F.broadcast(limits))
    low = F.when(F.col("k") == 1, "*").otherwise(F.get("all", F.col("k") - 2).cast("string"))
    high = F.when(F.col("k") == F.size("all"), "*").otherwise(F.col("cutoff").cast("string"))
    named = inside.select(F.col("k").alias("colour"), F.concat(F.lit(f"{value}:["), low, F.lit(" TO "), high, F.lit("]")).alias("name"), "records")
    unknown = df.where(number.isNull() | F.isnan(number)).agg(F.count("*").alias("records")).where("records > 0")
    return named.unionByName(unknown.select(F.lit(0).alias("colour"), F.lit("n/a").alias("name"), "records"))

