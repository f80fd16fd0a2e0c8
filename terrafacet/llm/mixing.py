"""Mixing sources to target weights, in DataFrame functions alone.

Temperature mixing: source s with token share p_s gets the weight p_s ** a,
normalised. The exponent a is bisected until the weights' entropy, as a share of
the largest possible, is the target, or until no source is repeated more often
than a limit. A source's budget is realised as whole passes over its documents
and one part of a pass. A pass is a permutation of the source's blocks of
documents, and of the documents in each block, by seeded hashes; the part ends
where the budget does, which is a place in that order: a block's key and a
document's key. So what a document row must know fits in one row per source, and
the documents themselves, with their texts, aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.llm.shared import stored

STEPS = 60
HIGHEST = 16.0
MAX_SOURCES = 100_000
SEED = "mix"


def text_tokens() -> Column:
    """Tokens of a text, at four UTF-8 bytes each, rounded up."""
    return F.expr("cast((octet_length(coalesce(text, '')) + 3) div 4 as long)")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def weight_list(shares: Column, exponent: Column) -> Column:
    raised = F.transform(shares, lambda p: F.pow(p, exponent))
    return F.transform(raised, lambda x: x / total(raised))


def entropy_share(shares: Column, exponent: Column) -> Column:
    """Entropy of the weights over the logarithm of their number; 1 for a single source."""
    raised = F.transform(shares, lambda p: F.pow(p, exponent))
    norm = total(raised)
    logs = total(F.transform(raised, lambda x: x * F.ln(x)))
    return F.when(F.size(shares) > 1, (F.ln(norm) - logs / norm) / F.ln(F.size(shares))).otherwise(1.0)


def most_repeated(shares: Column, exponent: Column, budget: Column) -> Column:
    """The largest number of passes over a source; `budget` as a share of all tokens."""
    raised = F.transform(shares, lambda p: F.pow(p, exponent - 1))
    return F.array_max(raised) / total(F.transform(shares, lambda p: F.pow(p, exponent))) * budget


def bisect(low: float, high: float, good: callable) -> Column:
    """Struct low, high after STEPS halvings; `good` says of a middle whether the answer lies above it."""
    start = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))

    def step(at: Column, _: Column) -> Column:
        middle = (at["low"] + at["high"]) / 2
        above = good(middle)
        return F.struct(F.when(above, middle).otherwise(at["low"]).alias("low"), F.when(above, at["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def source_weights(sources: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: float = 1.0) -> DataFrame:
    """source, tokens, docs, weight, exponent and quota of each source with tokens.

    `sources` has source, tokens and docs. The exponent is the highest with at
    least `entropy`, or the lowest with at most `repetition` passes over any
    source (1, the natural shares, if none has). `budget` is the number of tokens
    to take as a share of all. More than MAX_SOURCES sources raise an error.
    """
    one = sources.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("source", "tokens", "docs"))).alias("s"))
    one = one.withColumn("s", F.when(F.size("s") <= MAX_SOURCES, F.col("s")).otherwise(F.raise_error(F.lit("too many sources"))))
    one = one.withColumn("all", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    one = one.withColumn("p", F.transform("s", lambda x: x["tokens"] / F.col("all")))
    p = F.col("p")
    if entropy is not None:
        exponent = bisect(0.0, HIGHEST, lambda a: entropy_share(p, a) >= entropy)["low"]
    else:
        exponent = bisect(0.0, 1.0, lambda a: most_repeated(p, a, F.lit(budget)) > repetition)["high"]
    one = one.withColumn("exponent", exponent).withColumn("w", weight_list(p, F.col("exponent")))
    rows = one.select("exponent", "all", F.explode(F.arrays_zip("s", "w")).alias("x"))
    quota = F.floor(F.col("x.w") * F.col("all") * budget).cast("long")
    return rows.select(F.col("x.s.source").alias("source"), F.col("x.s.tokens").alias("tokens"), F.col("x.s.docs").alias("docs"), F.col("x.w").alias("weight"), "exponent", quota.alias("quota"))


def doc_name() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def block_of(docs: Column) -> Column:
    """The document's block: as many blocks as the root of the source's number of documents, rounded up."""
    number = F.conv(F.substring(F.md5(doc_name()), 1, 8), 16, 10).cast("long")
    return number % F.ceil(F.sqrt(docs)).cast("long")


def block_key(turn: Column, source: Column, block: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), turn.cast("string"), source, block.cast("string")))


def doc_key(turn: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), turn.cast("string"), doc_name()))


def mix_sources(docs: DataFrame, tokens: Column, entropy: float | None = None, repetition: float | None = None, budget: float = 1.0) -> DataFrame:
    """The rows of `docs` as often as their source's budget takes them, with `pass` and `place`.

    `pass` counts from 1; `place` sorts the rows of a source's pass into its
    permutation. A null source is the source ''. A source without tokens has the
    weight 0 and isn't taken; a document without tokens goes with its block.
    Rows that repeat a doc_id stand side by side, all inside the budget or all
    outside. Columns of `docs` named pass or place are replaced; others may have any name.
    """
    names = [c for c in docs.columns if c not in ("pass", "place")]
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    narrow = docs.select("doc_id", source, tokens.alias("tokens"))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "doc_id", source)
    sources = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    weights = stored(source_weights(sources, entropy, repetition, budget), "mix-weights")
    plan = weights.select("source", "docs", F.expr("quota div tokens").alias("passes"), F.expr("quota % tokens").alias("rest"))
    # the last, partial pass: which block does the budget end in, and at which document of it
    turn = F.col("passes") + 1
    last_key = block_key(turn, F.col("source"), block_of(F.col("docs")))
    dealt = narrow.join(F.broadcast(plan), "source").withColumn("bkey", last_key)  # MAX_SOURCES rows
    blocks = dealt.groupBy("source", "bkey", "rest").agg(F.sum("tokens").alias("tokens"))
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("bkey").rowsBetween(Window.unboundedPreceding, 0))
    over = blocks.withColumn("end", so_far).where("end > rest")
    last = over.groupBy("source").agg(F.min("bkey").alias("last"), F.min_by(F.col("rest") - F.col("end") + F.col("tokens"), "bkey").alias("room"))
    # a row per source; stored, so that the documents are looked through once for it, and by a small plan
    found = stored(plan.join(last, "source", "left"), "mix-last")
    within = narrow.join(F.broadcast(found), "source").where(last_key == F.col("last")).withColumn("key", doc_key(turn))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    cut = within.withColumn("end", upto).where("end <= room").groupBy("source").agg(F.max("key").alias("cut"))
    ends = stored(found.drop("room").join(cut, "source", "left"), "mix-ends")
    taken = base.join(F.broadcast(ends), "source")  # MAX_SOURCES rows
    part = (last_key < F.col("last")) | (last_key == F.col("last")) & (doc_key(turn) <= F.coalesce("cut", F.lit("")))
    copies = (F.col("passes") + F.coalesce(part, F.lit(False)).cast("long")).cast("int")
    rows = taken.withColumn("copies", copies).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), "copies")))
    place = F.concat(F.substring(block_key(F.col("pass"), F.col("source"), block_of(F.col("docs"))), 1, 16), F.substring(doc_key(F.col("pass")), 1, 16))
    return rows.select("row.*", "pass", place.alias("place"))


def oracle(entropy: float) -> str:
    """DuckDB SQL of mix_sources(documents, text_tokens(), entropy) with columns doc_id, source, tokens, pass, place."""
    norm = "list_sum(list_transform(p, lambda x: pow(x, {a})))"
    share = f"(ln({norm}) - list_sum(list_transform(p, lambda x: pow(x, {{a}}) * ln(pow(x, {{a}})))) / {norm}) / ln(len(p))".replace("{a}", "((low + high) / 2)")
    key = "md5(concat_ws('|', '" + SEED + "', cast({turn} as varchar), {rest}))"
    block = key.replace("{rest}", "source, cast(block as varchar)")
    doc = key.replace("{rest}", "coalesce(cast(doc_id as varchar), '')")
    return f"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, coalesce(source, '') AS source, (strlen(coalesce(text, '')) + 3) // 4 AS tokens FROM documents),
    sources AS (SELECT source, sum(tokens) AS tokens, count(*) AS docs FROM docs GROUP BY source HAVING sum(tokens) > 0),
    shares AS (SELECT list(tokens / (SELECT sum(tokens) FROM sources) ORDER BY source) AS p FROM sources),
    steps(i, low, high) AS (
      SELECT 0, 0.0::DOUBLE, {HIGHEST}::DOUBLE
      UNION ALL
      SELECT i + 1, CASE WHEN good THEN (low + high) / 2 ELSE low END, CASE WHEN good THEN high ELSE (low + high) / 2 END
      FROM (SELECT i, low, high, len(p) = 1 OR {share} >= {entropy} AS good FROM steps, shares WHERE i < {STEPS})),
    best AS (SELECT low AS a FROM steps WHERE i = {STEPS}),
    norms AS (SELECT sum(pow(tokens / (SELECT sum(tokens) FROM sources), a)) AS norm FROM sources, best),
    plan AS (
      SELECT source, docs, tokens AS source_tokens,
        cast(floor(pow(tokens / (SELECT sum(tokens) FROM sources), a) / norm * (SELECT sum(tokens) FROM sources)) AS bigint) AS quota
      FROM sources, best, norms),
    dealt AS (
      SELECT doc_id, source, tokens, cast(quota // source_tokens AS bigint) AS passes, cast(quota % source_tokens AS bigint) AS rest,
        ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 8))::bigint % cast(ceil(sqrt(docs)) AS bigint) AS block
      FROM docs JOIN plan USING (source)),
    keyed AS (SELECT *, {block.format(turn='passes + 1')} AS bkey, {doc.format(turn='passes + 1')} AS dkey FROM dealt),
    ordered AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY bkey, dkey) AS upto, sum(tokens) OVER (PARTITION BY source ORDER BY bkey) AS block_end FROM keyed),
    lasts AS (SELECT source, min(bkey) AS last FROM ordered WHERE block_end > rest GROUP BY source),
    copies AS (SELECT o.*, passes + CASE WHEN bkey < last OR (bkey = last AND upto <= rest) THEN 1 ELSE 0 END AS n FROM ordered o LEFT JOIN lasts USING (source)),
    passes AS (SELECT *, unnest(range(1, n + 1)) AS turn FROM copies)
    SELECT doc_id, source, cast(tokens AS bigint) AS tokens, cast(turn AS integer) AS pass,
      substr({block.format(turn='turn')}, 1, 16) || substr({doc.format(turn='turn')}, 1, 16) AS place
    FROM passes"""
