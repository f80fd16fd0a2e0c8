"""Catalogue, search, distributions and user data: relational operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafacet.operators.order import numbered, running


def keyword_search(df: DataFrame, columns: list[str], words: str) -> DataFrame:
    """Rows with the words in any of the columns, whatever their case."""
    return df.where(reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(words.lower()) for c in columns)))


def name_search(objects: DataFrame, fields: DataFrame, words: str, limit: int, offset: int = 0, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Objects of enabled fields by place of the words in their name, name and pid; an include list wins over an exclude list."""
    place = F.locate(words.lower(), F.lower("name"))
    usable = fields.where("enabled").select(F.col("id").alias("fid"), F.col("name").alias("field"))
    if include:
        usable = usable.where(F.col("fid").isin(include))
    elif exclude:
        usable = usable.where(~F.col("fid").isin(exclude))
    found = objects.withColumn("place", place).where("place > 0").join(usable, "fid")
    return found.orderBy("place", "name", "pid").offset(offset).limit(limit).select("pid", "name", "fid", "field", "place")


def field_names_json(fields: DataFrame) -> DataFrame:
    """All field names as one JSON array, in order."""
    return fields.agg(F.to_json(F.array_sort(F.collect_set("name"))).alias("fields"))


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """The page `number` (from 0) of rows in an order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def class_pages(classes: DataFrame, start: int, size: int) -> DataFrame:
    """Classes (class, polygons) that hold the polygons start to start + size - 1 of all, with their running position."""
    placed = running(classes.select("class", "polygons"), F.col("polygons"), [F.col("class")], "end").withColumn("begin", F.col("end") - F.col("polygons"))
    return placed.where((F.col("begin") < start + size) & (F.col("end") > start)).select("class", "polygons", "begin")


def where_all(tests: list[Column | None]) -> Column:
    """The conjunction of the tests that are asked for."""
    return reduce(lambda a, b: a & b, (t for t in tests if t is not None), F.lit(True))


def depth_overlap(low: float | None, high: float | None) -> Column:
    """Depth intervals that overlap a wanted one; None is open."""
    return where_all([None if high is None else F.col("min_depth") <= high, None if low is None else F.col("max_depth") >= low])


def flag(column: str, wanted: bool | None, numeric: bool = False) -> Column | None:
    """A three-way test: None asks nothing; a numeric flag holds above 0."""
    if wanted is None:
        return None
    return (F.col(column) > 0 if wanted else F.col(column) == 0) if numeric else F.col(column) == wanted


def token_member(column: str, listed: str) -> Column:
    """The column's value is one of a comma list, whatever its case."""
    return F.array_contains(F.transform(F.split(F.lit(listed.lower()), ","), F.trim), F.lower(F.col(column)))


def one_of(column: str, wanted: list[str] | None) -> Column | None:
    return F.col(column).isin(wanted) if wanted else None


def distributions(
    df: DataFrame,
    low: float | None = None,
    high: float | None = None,
    lsids: str | None = None,
    families: list[str] | None = None,
    genera: list[str] | None = None,
    coastal: bool | None = None,
    pelagic: bool | None = None,
    estuarine: bool | None = None,
    desmersal: bool | None = None,
    endemic: bool | None = None,
    family_lsids: list[str] | None = None,
    genus_lsids: list[str] | None = None,
    resources: list[str] | None = None,
    group: str | None = None,
    geometry: int | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Range maps that pass every test given; a negative number of a geometry asks nothing."""
    tests = [
        depth_overlap(low, high),
        token_member("lsid", lsids) if lsids else None,
        *(one_of(c, wanted) for c, wanted in (("family", families), ("genus", genera), ("family_lsid", family_lsids), ("genus_lsid", genus_lsids), ("resource", resources))),
        *(flag(c, wanted) for c, wanted in (("coastal", coastal), ("estuarine", estuarine), ("endemic", endemic))),
        *(flag(c, wanted, True) for c, wanted in (("pelagic", pelagic), ("desmersal", desmersal))),
        F.col("group_name") == group if group else None,
        F.col("geom_idx") == geometry if geometry is not None and geometry >= 0 else None,
        F.col("type") == kind if kind else None,
    ]
    return df.where(where_all(tests))


def distributions_by_lsid(df: DataFrame, lsids: list[str], kind: str) -> DataFrame:
    """Range maps of some lsids, of one type."""
    return df.where(F.col("lsid").isin(lsids) & (F.col("type") == kind))


def distribution_by_code(df: DataFrame, code: int, kind: str) -> DataFrame:
    """The range map of a species code and a type, the first of several by geom_idx; no row if there is none."""
    return df.where((F.col("spcode") == code) & (F.col("type") == kind)).orderBy("geom_idx").limit(1)


def distribution_by_name(df: DataFrame, text: str, kind: str) -> DataFrame:
    """The first range map by species code whose lsid or number is a text, or whose name is it, with or without a subgenus, whatever the case."""
    plain = re.sub(r" \([A-Z][a-z]+\) ", " ", text)
    met = (F.col("lsid") == text) | (F.col("caab") == text) | F.col("scientific").ilike(text) | F.col("scientific").ilike(plain)
    return df.where(met & (F.col("type") == kind)).orderBy("spcode").limit(1)


def objects_of_field(objects: DataFrame, fid: str, text: str | None = None, start: int = 0, size: int | None = None) -> DataFrame:
    """Objects of a field whose name or description holds a text, whatever the case, in the order of pid, from `start` on."""
    held = where_all([F.col("fid") == fid, None if not text else F.lower("name").contains(text.lower()) | F.lower("description").contains(text.lower())])
    found = objects.where(held).orderBy("pid").offset(start)
    return found if size is None else found.limit(size)


def objects_by_name(objects: DataFrame, fid: str, name: str) -> DataFrame:
    """Objects of a field with a name, whatever the case; % and _ stand for any text and any character."""
    return objects.where((F.col("fid") == fid) & F.col("name").ilike(name))


def object_by_pid(objects: DataFrame, classes: DataFrame, pid: str) -> DataFrame:
    """pid, name and fid of a stored object, or else of the class of a raster (fid, class, class_name), whose pid is fid:class."""
    named = classes.select(F.concat_ws(":", "fid", "class").alias("pid"), F.col("class_name").alias("name"), "fid")
    every = objects.select("pid", "name", "fid", F.lit(0).alias("rank")).unionByName(named.withColumn("rank", F.lit(1)))
    return every.where(F.col("pid") == pid).orderBy("rank").limit(1).drop("rank")


def ordered_distinct(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same key the first in an order, in that order."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("rest"))
    return first.select(*key, "rest.*").select(df.columns).orderBy(*order)


def with_area(df: DataFrame, geometry: str = "geometry", area: str = "area") -> DataFrame:
    """Rows without those whose geometry has no area; rows without a geometry stay."""
    return df.where(F.col(geometry).isNull() | (F.col(area) > 0))


def with_count(df: DataFrame, counted: DataFrame, name: str) -> DataFrame:
    """Every row with the number of rows of another table."""
    return df.crossJoin(F.broadcast(counted.agg(F.count("*").alias(name))))  # one row


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("family").agg(F.count("*").alias("count"))


def without_subgenus(name: Column) -> Column:
    """A scientific name without a subgenus in parentheses."""
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))


def upsert_names(known: DataFrame, names: DataFrame) -> DataFrame:
    """The name index (id, name) with new lower-cased names numbered on from the highest id, in order."""
    new = names.select(F.lower("name").alias("name")).where("name is not null").distinct().join(known.select("name"), "name", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    placed = numbered(new, [F.col("name")]).crossJoin(F.broadcast(top))  # one row
    return known.select("id", "name").unionByName(placed.select((F.col("top") + F.col("n")).cast("int").alias("id"), "name"))


def infer_type(df: DataFrame, column: str) -> DataFrame:
    """type of a text column, by how many of its values read as which.

    Values 'n/a' and '' don't count. Text if at most one value is left or if more
    values are left than longs and than doubles; else double if doubles outnumber
    longs; else int if all longs fit, or long.
    """
    text = F.col(column).cast("string")
    given = text.isNotNull() & ~text.isin("", "n/a")
    counts = df.where(given).agg(
        F.count("*").alias("n"),
        *(F.count(F.expr(f"try_cast(cast(`{column}` as string) as {t})")).alias(t) for t in ("bigint", "int", "double")),
    )
    found = F.when((F.col("n") <= 1) | (F.col("n") > F.greatest("bigint", "double")), "STRING").when(F.col("double") > F.col("bigint"), "DOUBLE").when(F.col("int") == F.col("bigint"), "INT").otherwise("LONG")
    return counts.select(found.alias("type"), "n")


def quality_checks(layers: DataFrame) -> DataFrame:
    """id and the broken rules of every layer that breaks one."""
    rules = {
        "name": F.col("name").isNull() | (F.col("name") == ""),
        "type": ~F.coalesce(F.col("type").isin("Environmental", "Contextual"), F.lit(False)),
        "domain": F.col("domain").isNotNull() & F.exists(F.split(F.lower("domain"), ","), lambda d: ~F.trim(d).isin("terrestrial", "marine")),
        "disabled": ~F.coalesce(F.col("enabled"), F.lit(False)),
    }
    broken = F.concat_ws(",", *(F.when(test, F.lit(rule)) for rule, test in rules.items()))
    return layers.select("id", broken.alias("broken")).where("broken != ''")


def field_id(fields: DataFrame, layers: DataFrame, layer: int) -> DataFrame:
    """One row, id: a new field id for a layer: prefix and number; if taken, prefix, the next count and the number in three places."""
    kind = layers.where(F.col("id") == layer).select(F.when(F.lower("type") == "contextual", "cl").otherwise("el").alias("prefix"))
    end = str(layer).rjust(3, "0")
    rest = F.regexp_extract("id", rf"^..(\d+){end}$", 1)
    joined = kind.join(fields.select("id"), F.substring("id", 1, 2) == F.col("prefix"), "left").groupBy("prefix").agg(
        F.coalesce(F.bool_or(F.substring("id", 3, 100) == str(layer)), F.lit(False)).alias("taken"), F.coalesce(F.max(rest.try_cast("int")), F.lit(0)).alias("most")
    )
    return joined.select(F.when(F.col("taken"), F.concat("prefix", (F.col("most") + 1).cast("string"), F.lit(end))).otherwise(F.concat("prefix", F.lit(str(layer)))).alias("id"))


def layer_number(field: Column) -> Column:
    """The layer number in a field id of up to six characters, null for other texts."""
    return F.when(F.length(field) <= 6, F.substring(field, 3, 4).try_cast("int"))


def typed(column: str, kind: str) -> Column:
    """A text column as INT, LONG, FLOAT, DOUBLE or STRING: whole numbers may be cut from decimals; what doesn't read is null, as is 'n/a'."""
    text = F.trim(F.col(column).cast("string"))
    given = F.when(~text.isin("", "n/a"), text)
    if kind == "STRING":
        return given
    number = given.try_cast("double")
    if kind in ("INT", "LONG"):
        whole = "int" if kind == "INT" else "long"
        return F.coalesce(given.try_cast(whole), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast(whole))
    return number if kind == "DOUBLE" else given.try_cast("float")


def masked(df: DataFrame, mask: DataFrame, columns: list[str], key: str = "pt") -> DataFrame:
    """Columns of the rows that a mask (a table of keys) lets through."""
    return df.join(mask.select(key).distinct(), key, "left_semi").select(*columns)


def user_data_search(headers: DataFrame, every: dict[str, str], any_: dict[str, str], start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows whose columns equal all of `every` (description without case, as a pattern) and one of `any_`, by id."""
    tests = [F.col(c).ilike(v) if c == "description" else F.col(c) == v for c, v in every.items()]
    ors = [F.col(c) == v for c, v in any_.items()]
    found = headers.where(where_all([*tests, reduce(lambda a, b: a | b, ors) if ors else None])).orderBy("id").offset(start)
    return found if limit is None else found.limit(limit)


def list_refs(data: DataFrame, header: str, kind: str) -> DataFrame:
    """ref of a header's data of one type: those of a facet ('id:facet') without its name, or those of none."""
    number, _, facet = header.partition(":")
    rows = data.where((F.col("header") == int(number)) & (F.col("data_type") == kind))
    if facet:
        return rows.where(F.col("ref").endswith(" " + facet)).select(F.replace("ref", F.lit(" " + facet), F.lit("")).alias("ref"))
    return rows.where(~F.col("ref").contains(" ")).select("ref")


def resolved_url(path: Column, base: str, mark: str) -> Column:
    """A path below a base address; another text has its mark replaced by the address."""
    return F.when(path.startswith("/"), F.concat(F.lit(base), path)).otherwise(F.replace(path, F.lit(mark), F.lit(base)))


def names_then_objects(names: DataFrame, objects: DataFrame, words: str, limit: int) -> DataFrame:
    """The first objects of names in order of the place of the words, name and pid."""
    ranked = names.withColumn("place", F.locate(words.lower(), F.lower("name"))).where("place > 0")
    met = ranked.join(objects.select("pid", F.lower("name").alias("name"), "fid"), "name")
    return met.orderBy("place", "name", "pid").limit(limit).select("pid", "name", "fid", "place")


def with_classes(found: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """Search results, and raster classes after them if there are fewer than the limit; the classes aren't cut."""
    room = found.agg((F.count("*") < limit).alias("room"))
    return found.unionByName(classes.crossJoin(F.broadcast(room)).where("room").drop("room"))  # one row


def numeric_order(names: DataFrame, prefix: str = "__f") -> DataFrame:
    """name and place: names of the prefix by their number, then all others by text, from 0."""
    number = F.when(F.col("name").startswith(prefix), F.regexp_extract("name", r"(\d+)$", 1).try_cast("int"))
    order = [F.col("number").asc_nulls_last(), F.col("name")]
    return numbered(names.withColumn("number", number), order, "place").select("name", (F.col("place") - 1).alias("place"))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A table with the rows whose keys it doesn't hold; null keys are keys, of rows that repeat one any stays."""
    named = [F.struct(*keys).alias("key_"), F.struct(*table.columns).alias("row_")]
    new = rows.select(*table.columns).dropDuplicates(keys).select(*named).join(table.select(named[0]), "key_", "left_anti")
    return table.unionByName(new.select("row_.*"))


def replace_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A table in which rows replace those of their keys, or join them."""
    return delete_rows(table, rows, keys).unionByName(rows.select(*table.columns))


def delete_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A table without the rows whose keys are among those of `rows`; null keys are keys."""
    gone = rows.select(F.struct(*keys).alias("key_")).distinct()
    return table.withColumn("key_", F.struct(*keys)).join(gone, "key_", "left_anti").select(*table.columns)


def delete_field(fields: DataFrame, objects: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """Fields and objects without a field and its objects."""
    return fields.where(F.col("id") != field), objects.where(F.col("fid") != field)


def add_task(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """Tasks with those added of which none of the same name and json waits."""
    waiting = tasks.where("started is null")
    fresh = insert_absent(waiting, new, ["name", "json"])
    return tasks.where("started is not null").unionByName(fresh)


def start_tasks(tasks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The tasks of `ids` started now, unless they already were."""
    marked = tasks.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return marked.withColumn("started", F.when(F.col("hit"), F.coalesce("started", now)).otherwise(F.col("started"))).select(*tasks.columns)


def reset_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that began and never ended wait again."""
    return tasks.withColumn("started", F.when(F.col("finished").isNotNull(), F.col("started")))


def next_task(tasks: DataFrame, most: int) -> DataFrame:
    """The oldest waiting task of at most a size."""
    return tasks.where(F.col("started").isNull() & (F.coalesce("size", F.lit(0)) <= most)).orderBy("created", "id").limit(1)


def registry(fields: DataFrame, layers: DataFrame) -> DataFrame:
    """key and field: how a source is found: by field id, and by layer name and layer id the default field, or the least."""
    joined = fields.join(layers.select(F.col("id").cast("string").alias("spid"), F.col("name").alias("layer")), "spid")
    first = F.min_by("id", F.struct(~F.coalesce("defaultlayer", F.lit(False)), "id"))
    by_id = joined.select(F.col("id").alias("key"), F.col("id").alias("field"))
    by_name = joined.groupBy(F.col("layer").alias("key")).agg(first.alias("field"))
    by_number = joined.groupBy(F.col("spid").alias("key")).agg(first.alias("field"))
    return by_id.unionByName(by_name).unionByName(by_number)


def nested(fields: DataFrame, layers: DataFrame) -> DataFrame:
    """field and layer: joined rows as two structs."""
    a = fields.select(F.struct(*fields.columns).alias("field"))
    b = layers.select(F.struct(*layers.columns).alias("layer"))
    return a.join(b, F.col("field.spid") == F.col("layer.id").cast("string"))
