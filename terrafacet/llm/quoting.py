"""Quotation linking for chat and mail, in DataFrame functions alone.

A message's lines fall into passages: runs of one quote level, cut at blank
lines. Quoted passages are normalised and hashed, and joined to the first message
of the conversation that holds the same passage as its own text. A message
replies to the original of its least deeply quoted linked passage. Following
replies to their roots gives threads; the messages of a thread in turn order,
without what they quote, are the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.llm.shared import stored

# Quote marks before a line, and the line that announces a quotation.
MARKS = r"^((?:[ \t]?>)+)[ \t]?(.*)$"
ANNOUNCES = r"(?md)^(?![ \t]?>)(?:On .{1,200} wrote:|.{1,80} (?:schrieb|a écrit|escribió) ?:)[^\S\n]*$(?=\n(?:[^\S\n]*\n)*[ \t]?>)"
ANNOUNCED = "\r"  # put before an announcing line; no line holds one otherwise


def parse_lines(text: Column) -> Column:
    """level and content of every line. A line announces a quotation only if one follows it, but for blank lines."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    lines = F.split(F.regexp_replace(plain, ANNOUNCES, ANNOUNCED + "$0"), "\n")

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_extract(line, MARKS, 2)).otherwise(line).alias("content"))

    return F.transform(lines, parsed)


def passages(lines: Column) -> Column:
    """level and text of every run of lines of one level without a blank one; announcing lines are left out."""

    def blank(x: Column) -> Column:
        return (F.trim(x["content"]) == "") | x["content"].startswith(ANNOUNCED)

    def begins(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        return ~blank(x) & ((i == 0) | (before["level"] != x["level"]) | blank(before))

    places = F.filter(F.transform(lines, lambda x, i: F.when(begins(x, i), i).otherwise(-1)), lambda i: i >= 0)
    ends = F.transform(places, lambda i, k: F.coalesce(F.get(places, k + 1), F.size(lines)))
    runs = F.arrays_zip(places.alias("a"), ends.alias("b"))

    def joined(run: Column) -> Column:
        mine = F.filter(F.slice(lines, run["a"] + 1, run["b"] - run["a"]), lambda x: ~blank(x))
        return F.struct(F.get(lines, run["a"])["level"].alias("level"), F.array_join(F.transform(mine, lambda x: x["content"]), " ").alias("text"))

    return F.transform(runs, joined)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(lines: Column) -> Column:
    """The lines of level 0 without announcing ones, blank lines cut from both ends."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["content"].startswith(ANNOUNCED))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"^\s*\n|\s+$", "")


def link_replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, depth, thread, n_quotes, n_linked and text (without quotes) of every message.

    `messages` has conv_id, turn, role and text. A message is found by (conv_id,
    turn); rows that repeat it share its links. `thread` is the turn at the root of
    a message's replies, `depth` its distance from it: sorted by conv_id, thread
    and turn the rows are reply-ordered. A null or empty text quotes nothing and
    stands for no passage. Without conv_id or turn, a row is its own thread.
    """
    lines = stored(messages.select("conv_id", "turn", "role", parse_lines(F.col("text")).alias("lines")), "quote-lines")
    found = lines.select("conv_id", "turn", F.posexplode(passages(F.col("lines"))).alias("k", "x"))
    hashed = stored(found.select("conv_id", "turn", F.col("x.level").alias("level"), F.md5(normalised(F.col("x.text"))).alias("hash")), "quote-hashes")
    originals = hashed.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quotes = hashed.where("level > 0").join(originals, ["conv_id", "hash"], "left")
    linked = F.col("origin") < F.col("turn")
    nearest = F.min(F.when(linked, F.struct("level", (-F.col("origin")).alias("origin"))))
    per = quotes.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count(F.when(linked, 1)).alias("n_linked"), (-nearest["origin"]).alias("reply_to"))
    per = stored(per, "quote-links")
    roots = thread_roots(per.where("reply_to is not null").select("conv_id", "turn", "reply_to"))
    joined = lines.join(per, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        own_text(F.col("lines")).alias("text"),
    )


def thread_roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread and depth of every message that replies, by doubling the distance looked ahead."""
    ahead = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"))
    while True:
        further = ahead.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("to"), F.col("depth").alias("more"))
        ahead = stored(
            ahead.join(further, ["conv_id", "thread"], "left").select(
                "conv_id", "turn", F.coalesce("to", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("to").isNotNull().alias("went")
            ),
            "quote-roots",
        )
        if ahead.where("went").isEmpty():
            return ahead.drop("went")
        ahead = ahead.drop("went")


def as_mail(messages: DataFrame) -> DataFrame:
    """The messages with what mail programs add: the message before quoted in full, and in it the one before that.

    The messages before are found by (conv_id, turn - 1) and (conv_id, turn - 2), of rows that repeat a place the one of least text.
    """
    text = F.coalesce("text", F.lit(""))
    kept = messages.select("conv_id", "turn", "role", text.alias("text"))
    once = kept.groupBy("conv_id", "turn").agg(F.min("text").alias("q"))
    for back in (1, 2):
        kept = kept.join(once.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("q").alias(f"q{back}")), ["conv_id", "turn"], "left")
    marked = [F.regexp_replace(F.col(f"q{k}"), "(?m)^", ">" * k + " ") for k in (1, 2)]
    quoted = F.concat(F.lit("\n\nOn turn "), (F.col("turn") - 1).cast("string"), F.lit(" they wrote:\n"), marked[0], F.coalesce(F.concat(F.lit("\n"), marked[1]), F.lit("")))
    return kept.select("conv_id", "turn", "role", F.concat("text", F.coalesce(quoted, F.lit(""))).alias("text"))


ORACLE = r"""
    WITH RECURSIVE own AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text, md5(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS hash FROM conversations),
    firsts AS (SELECT conv_id, hash, min(turn) AS origin FROM own GROUP BY ALL),
    quotes AS (
      SELECT o.conv_id, o.turn, k AS level, f.origin
      FROM own o, (VALUES (1), (2)) AS levels(k)
      JOIN own q ON q.conv_id = o.conv_id AND q.turn = o.turn - k
      JOIN firsts f ON f.conv_id = q.conv_id AND f.hash = q.hash
      WHERE k = 1 OR EXISTS (SELECT 1 FROM own p WHERE p.conv_id = o.conv_id AND p.turn = o.turn - 1)),
    links AS (SELECT conv_id, turn, min_by(origin, level) AS reply_to, count(*) AS n FROM quotes WHERE origin < turn GROUP BY ALL),
    roots AS (
      SELECT o.conv_id, o.turn, o.turn AS thread, 0 AS depth FROM own o ANTI JOIN links l ON o.conv_id = l.conv_id AND o.turn = l.turn
      UNION ALL
      SELECT l.conv_id, l.turn, r.thread, r.depth + 1 FROM roots r JOIN links l ON l.conv_id = r.conv_id AND l.reply_to = r.turn)
    SELECT o.conv_id, o.turn, o.role, l.reply_to, cast(r.depth AS bigint) AS depth, r.thread, coalesce(l.n, 0) AS n_quotes, coalesce(l.n, 0) AS n_linked, o.text
    FROM own o LEFT JOIN links l USING (conv_id, turn) JOIN roots r USING (conv_id, turn)"""
