"""Merkle fixity audit of WARC replicas, in DataFrame functions alone.

A file's records lie one after the other. A leaf is the hash of a record's
name, offset, length and digest; a node of the tree is the hash of the hashes of up to
FAN_OUT children in order. Replicas compare the roots of their files, and go down
only into branches whose hashes differ, a level at a time, to the records that
are corrupt, moved, missing or surplus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafacet.llm.shared import Scratch, stored

FAN_OUT = 16
FILE_RECORDS = 1024


def record_text(uri: Column, body: Column) -> Column:
    """A WARC response record of a body; null parts count as empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def lay_out(records: DataFrame) -> DataFrame:
    """file, record, copy, start, length, digest of records (file, sort key `record`, `bytes`): where each lies in its file.

    `copy` counts the records of one key, by digest. A file's records meet in one
    task as their lengths and digests, not their bytes.
    """
    narrow = records.select("file", "record", F.length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    in_file = Window.partitionBy("file").orderBy("record", "digest").rowsBetween(Window.unboundedPreceding, 0)
    copy = F.row_number().over(Window.partitionBy("file", "record").orderBy("digest"))
    return narrow.select("file", "record", copy.alias("copy"), (F.sum("length").over(in_file) - F.col("length")).alias("start"), "length", "digest")


def numbered(laid: DataFrame) -> DataFrame:
    """A laid-out replica with each record's ordinal in its own file."""
    order = Window.partitionBy("file").orderBy("record", "copy")
    return laid.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def tree(leaves: DataFrame, height: int) -> DataFrame:
    """file, level, node, hash: level 0 holds the leaves, level `height` the root (node 0)."""
    named = F.to_json(F.struct("record", "copy", "start", "length", "digest"))
    level = leaves.select("file", F.lit(0).alias("level"), F.col("ordinal").alias("node"), F.sha2(named, 256).alias("hash"))
    levels = [level]
    for k in range(1, height + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # FAN_OUT at most
        joined = F.array_join(F.transform(children, lambda x: x["hash"]), "")
        level = level.groupBy("file", F.expr(f"node div {FAN_OUT}").alias("parent")).agg(F.sha2(joined, 256).alias("hash"))
        level = level.select("file", F.lit(k).alias("level"), F.col("parent").alias("node"), "hash")
        levels.append(level)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def height_of(leaves: DataFrame) -> int:
    """Levels above the leaves that make one root of the longest file."""
    most = leaves.agg(F.max("ordinal")).first()[0] or 0
    height = 0
    while FAN_OUT**height <= most:
        height += 1
    return height


def leaves_of(records: DataFrame, scratch: Scratch) -> DataFrame:
    """A replica's leaves, from its own records alone. Names are wrapped, so that null is a name like any other."""
    clean = records.select(F.struct("file").alias("file"), F.struct("record").alias("record"), F.coalesce("bytes", F.lit(b"")).alias("bytes"))
    return scratch.stored(numbered(scratch.stored(lay_out(clean), "fixity-layout")), "fixity-leaves")


def differing_leaves(nodes: list[DataFrame], height: int) -> DataFrame:
    """file and ordinal of the leaves that two trees don't share, by descent into unequal branches alone."""

    def differing(level: int, parents: DataFrame | None) -> DataFrame:
        sides = [n.where(F.col("level") == level).select("file", "node", F.col("hash").alias(f"h{k}")) for k, n in enumerate(nodes)]
        if parents is not None:
            sides = [s.join(parents, (s["file"] == parents["pf"]) & (F.expr(f"node div {FAN_OUT}") == parents["pn"]), "left_semi") for s in sides]
        both = sides[0].join(sides[1], ["file", "node"], "full")
        return both.where(~F.col("h0").eqNullSafe(F.col("h1"))).select("file", "node")

    open_ = differing(height, None)
    for level in range(height - 1, -1, -1):
        open_ = differing(level, open_.select(F.col("file").alias("pf"), F.col("node").alias("pn")))
    return open_.withColumnRenamed("node", "ordinal")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """file, ordinal, kind, and both replicas' start, length and digest of every record that differs.

    `first` and `second` hold file, record and bytes. kind: corrupt (another
    digest), moved (the same bytes at another offset), missing (not in the second)
    or surplus (not in the first). `ordinal` is a record's place among those that
    either replica holds. Each replica's tree stands on its own records; only
    leaves below unequal branches are fetched and matched by name. Null bytes
    count as a record without bytes, null files and records are names of their
    own; files without records in either replica differ by their records alone;
    rows that repeat a record key stand in the order of their digests.
    """
    sides = ("first", "second")
    with Scratch(first.sparkSession) as scratch:
        leaves = [leaves_of(r, scratch) for r in (first, second)]
        height = max(map(height_of, leaves))
        nodes = [scratch.stored(tree(x, height), "fixity-nodes") for x in leaves]
        open_ = scratch.stored(differing_leaves(nodes, height), "fixity-open")
        both = None
        for side, x in zip(sides, leaves):
            fetched = x.join(open_, ["file", "ordinal"], "left_semi")
            fetched = fetched.select("file", "record", "copy", *(F.col(c).alias(f"{side}_{c}") for c in ("ordinal", "start", "length", "digest")))
            both = fetched if both is None else both.join(fetched, ["file", "record", "copy"], "full")
        missing, surplus = F.col("second_digest").isNull(), F.col("first_digest").isNull()
        before = Window.partitionBy("file").orderBy("record", "copy").rowsBetween(Window.unboundedPreceding, -1)
        n = [F.coalesce(F.sum(F.when(x, 1).otherwise(0)).over(before), F.lit(0)) for x in (missing, surplus)]
        # a record's own place, and those before it that only the other replica holds: they are all among the fetched
        both = both.withColumn("ordinal", F.coalesce(F.col("first_ordinal") + n[1], F.col("second_ordinal") + n[0]))
        differs = F.lit(False)
        for c in ("start", "length", "digest"):
            differs |= ~F.col(f"first_{c}").eqNullSafe(F.col(f"second_{c}"))
        kind = F.when(missing, "missing").when(surplus, "surplus").when(F.col("first_digest") != F.col("second_digest"), "corrupt").otherwise("moved")
        columns = [f"{side}_{c}" for side in sides for c in ("start", "length", "digest")]
        return stored(both.where(differs).select(F.col("file.file").alias("file"), "ordinal", kind.alias("kind"), *columns), "fixity-audit")


def roots(records: DataFrame) -> DataFrame:
    """file and root hash of a replica."""
    with Scratch(records.sparkSession) as scratch:
        leaves = leaves_of(records, scratch)
        height = height_of(leaves)
        return stored(tree(leaves, height).where(F.col("level") == height).select(F.col("file.file").alias("file"), F.col("hash").alias("root")), "fixity-roots")


def page_records(pages: DataFrame) -> DataFrame:
    """The pages as WARC records in files of FILE_RECORDS page numbers: file, record, bytes."""
    return pages.select(
        F.expr(f"coalesce(cast(floor(page_id / {FILE_RECORDS}) as long), -1)").alias("file"),
        F.coalesce(F.col("page_id"), F.lit(-1)).alias("record"),
        record_text(F.col("url").cast("string"), F.col("html").cast("string")).cast("binary").alias("bytes"),
    )


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults: a byte more at the end (record % 997 = 600), a byte replaced (record % 331 = 7), and losses (record % 4001 = 11)."""
    size = F.length("bytes")
    replaced = F.concat(F.expr("substring(bytes, 1, length(bytes) - 5)"), F.lit(b"#"), F.expr("substring(bytes, -4, 4)"))
    spoiled = F.when(F.col("record") % 997 == 600, F.concat("bytes", F.lit(b"\n"))).when((F.col("record") % 331 == 7) & (size > 5), replaced).otherwise(F.col("bytes"))
    return records.where("record % 4001 != 11").withColumn("bytes", spoiled)


ORACLE = f"""
    WITH made AS (
      SELECT coalesce(cast(floor(page_id / {FILE_RECORDS}) AS bigint), -1) AS file, coalesce(page_id, -1) AS record,
        'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
        || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
        || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS bytes FROM pages),
    spoiled AS (
      SELECT file, record, CASE WHEN record % 997 = 600 THEN bytes || chr(10)
        WHEN record % 331 = 7 THEN left(bytes, length(bytes) - 5) || '#' || right(bytes, 4) ELSE bytes END AS bytes
      FROM made WHERE record % 4001 != 11),
    a AS (SELECT file, record, row_number() OVER (PARTITION BY file, record ORDER BY sha256(bytes)) AS copy,
        sum(strlen(bytes)) OVER w - strlen(bytes) AS start, strlen(bytes) AS length, sha256(bytes) AS digest
      FROM made WINDOW w AS (PARTITION BY file ORDER BY record, sha256(bytes) ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT file, record, row_number() OVER (PARTITION BY file, record ORDER BY sha256(bytes)) AS copy,
        sum(strlen(bytes)) OVER w - strlen(bytes) AS start, strlen(bytes) AS length, sha256(bytes) AS digest
      FROM spoiled WINDOW w AS (PARTITION BY file ORDER BY record, sha256(bytes) ROWS UNBOUNDED PRECEDING)),
    both_sides AS (
      SELECT file, row_number() OVER (PARTITION BY file ORDER BY record, copy) - 1 AS ordinal,
        a.start AS s1, a.length AS l1, a.digest AS d1, b.start AS s2, b.length AS l2, b.digest AS d2
      FROM a FULL JOIN b USING (file, record, copy))
    SELECT file, cast(ordinal AS bigint) AS ordinal,
      CASE WHEN d2 IS NULL THEN 'missing' WHEN d1 IS NULL THEN 'surplus' WHEN d1 != d2 THEN 'corrupt' ELSE 'moved' END AS kind,
      cast(s1 AS bigint) AS first_start, cast(l1 AS bigint) AS first_length, d1 AS first_digest,
      cast(s2 AS bigint) AS second_start, cast(l2 AS bigint) AS second_length, d2 AS second_digest
    FROM both_sides
    WHERE d1 IS DISTINCT FROM d2 OR s1 IS DISTINCT FROM s2 OR l1 IS DISTINCT FROM l2"""
