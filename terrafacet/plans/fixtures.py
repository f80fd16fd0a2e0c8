"""Spatial inputs derived from the star-schema tables by arithmetic that both engines evaluate alike.

Coordinates are dyadic, so doubles are exact. A fixture's SQL is read by Spark,
to make a DataFrame for the operators, and stands as a common table expression
before the SQL oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents".split()

SQL = {
    "occ": """
        SELECT event_id AS pt, 112 + ((event_id * 7919) % 2560) / 64.0e0 AS x, -44 + ((event_id * 104729) % 2176) / 64.0e0 AS y,
          cast(user_id % 37 AS bigint) AS species, cast(year(ts) AS int) AS year, event_type AS kind, value AS amount, user_id, ts
        FROM events""",
    "diamond": """
        SELECT cast(n_nationkey AS bigint) AS oid, n_name AS name, 116 + 8.0e0 * (n_nationkey % 5) AS cx,
          -40.5e0 + 7.0e0 * floor(n_nationkey / 5) AS cy, n_regionkey AS region FROM nation""",
    "corner": "SELECT * FROM (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1), (4, 1, 0)) AS t(i, dx, dy)",
    "ring": "SELECT oid, 0 AS part, 0 AS ring, i, cx + 5.0e0 * dx AS x, cy + 4.375e0 * dy AS y FROM diamond CROSS JOIN corner",
    "square": "SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS t(i, fx, fy)",
    "hole": "SELECT * FROM (VALUES (0), (1)) AS t(h)",
    "box": """
        SELECT cast(r_regionkey AS bigint) AS oid, 0 AS part, h AS ring, i,
          112 + 8.0e0 * r_regionkey + h * 2.0e0 + (8.0e0 - h * 4.0e0) * fx AS x, -44.0e0 + h * 8.0e0 + (34.0e0 - h * 16.0e0) * fy AS y
        FROM region CROSS JOIN square CROSS JOIN hole""",
    "plot": """
        SELECT cast(n_nationkey AS bigint) AS oid, 0 AS part, 0 AS ring, i,
          112 + 8.0e0 * (n_nationkey % 5) + 8.0e0 * fx AS x, -44 + 7.0e0 * floor(n_nationkey / 5) + 7.0e0 * fy AS y
        FROM nation CROSS JOIN square""",
    "edge": """
        SELECT a.oid, a.part, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM ring a JOIN ring b ON a.oid = b.oid AND a.part = b.part AND a.ring = b.ring AND b.i = a.i + 1""",
    "box_edge": """
        SELECT a.oid, a.part, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM box a JOIN box b ON a.oid = b.oid AND a.part = b.part AND a.ring = b.ring AND b.i = a.i + 1""",
    "cellrow": """
        SELECT cast(o_orderkey % 5600 AS int) AS cell, min(cast(o_totalprice AS float)) AS value, count(*) AS n FROM orders GROUP BY 1""",
    "raster": "SELECT 'el1' AS layer, cell, cast(floor(cell / 80) AS int) AS row, cell % 80 AS col, value FROM cellrow",
    "raster2": """
        SELECT 'el2' AS layer, cast(l_orderkey % 5600 AS int) AS cell, cast(floor((l_orderkey % 5600) / 80) AS int) AS row,
          cast(l_orderkey % 80 AS int) AS col, max(cast(l_extendedprice AS float)) AS value FROM lineitem GROUP BY ALL""",
    "classes": "SELECT 'cl3' AS layer, cell, row, col, cast(cell % 7 AS float) AS value FROM raster",
    "classname": "SELECT * FROM (VALUES (0, 'Bare'), (1, 'Crop'), (2, 'Forest'), (3, 'Grass'), (4, 'Heath'), (5, 'Water')) AS t(class, class_name)",
    "field": """
        SELECT concat('cl', cast(n_nationkey AS string)) AS id, n_name AS name, cast(n_regionkey AS string) AS spid,
          n_nationkey % 3 <> 1 AS enabled, n_nationkey % 2 = 0 AS indb, n_nationkey % 4 = 0 AS analysis FROM nation""",
    "layer": """
        SELECT r_regionkey AS id, r_name AS name, concat(r_name, ' layer') AS displayname,
          CASE WHEN r_regionkey % 2 = 0 THEN 'Environmental' ELSE 'Contextual' END AS type,
          CASE r_regionkey % 3 WHEN 0 THEN 'Terrestrial,Marine' WHEN 1 THEN 'marine' END AS domain,
          r_regionkey <> 3 AS enabled FROM region""",
    "object": """
        SELECT cast(p_partkey AS string) AS pid, p_name AS name, concat(p_brand, ' ', p_type) AS description,
          concat('cl', cast(p_partkey % 25 AS string)) AS fid, p_size AS size, p_partkey,
          112 + ((p_partkey * 7919) % 2560) / 64.0e0 AS x, -44 + ((p_partkey * 104729) % 2176) / 64.0e0 AS y FROM part""",
    "walk": """
        SELECT p_partkey % 5 AS oid, cast(row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS int) AS i,
          112 + (row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1) / 8.0e0 AS x, -44 + p_size / 8.0e0 AS y FROM part""",
    "coast": """
        SELECT oid, 0 AS part, 0 AS ring, i, x, y FROM walk
        UNION ALL SELECT oid, 0 AS part, 0 AS ring, cast(n AS int) AS i, x, y FROM (SELECT oid, i, x, y, count(*) OVER (PARTITION BY oid) AS n FROM walk) AS w WHERE i = 0""",
    "globe": """
        SELECT p_partkey AS pid, ((p_partkey * 7919) % 5760) / 16.0e0 - 180 AS x, ((p_partkey * 104729) % 2880) / 16.0e0 - 90 AS y FROM part""",
    "dist": """
        SELECT p_partkey AS spcode, p_brand AS family, p_name AS scientific, concat('urn:lsid:', cast(p_partkey % 40 AS string)) AS lsid,
          cast(p_size AS double) * 10 AS min_depth, cast(p_size AS double) * 10 + 25 AS max_depth,
          p_partkey % 2 = 0 AS coastal, cast(p_partkey % 3 AS double) AS pelagic, p_type AS resource,
          concat('genus ', cast(p_partkey % 11 AS string)) AS genus, concat('urn:family:', cast(p_size AS string)) AS family_lsid,
          concat('urn:genus:', cast(p_partkey % 11 AS string)) AS genus_lsid, concat('group ', cast(p_partkey % 4 AS string)) AS group_name,
          CASE WHEN p_partkey % 5 < 3 THEN 'e' ELSE 't' END AS type, cast(p_partkey % 25 AS bigint) AS geom_idx, p_partkey % 7 < 3 AS estuarine,
          cast(p_partkey % 6 AS double) AS desmersal, p_partkey % 9 < 5 AS endemic, concat('37 ', cast(p_partkey AS string)) AS caab FROM part""",
}


def body(name: str) -> str:
    return SQL[name].strip()


def chain(*names: str) -> list[str]:
    """The fixtures that `names` need, before them and in order."""
    found: list[str] = []
    for name in names:
        needs = [n for n in re.findall(r"(?:FROM|JOIN) (\w+)", body(name)) if n in SQL]
        found += [n for n in [*chain(*needs), name] if n not in found]
    return found


def with_clause(*names: str) -> str:
    """The common table expressions of fixtures, for an oracle."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({body(n)})" for n in chain(*names)) + "\n"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the Parquet tables of a data directory."""
    text = "WITH " + ",\n".join(f"{n} AS ({body(n)})" for n in chain(name)) + f"\nSELECT * FROM {name}"
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", text))
