"""Look-ups of distributions and objects on small cases."""

from terrafacet.operators import catalog

DISTRIBUTION = "spcode long, lsid string, caab string, scientific string, type string, geom_idx long, group_name string, coastal boolean, pelagic double"


def distributions(spark):
    rows = [
        (1, "a:1", "37 1", "Aus bus", "e", 5, "g", True, 0.0),
        (2, "a:1", "37 2", "Aus (Sub) cus", "t", 6, "h", False, 1.0),
        (3, "a:3", "37 3", "Aus cus", "e", 7, None, None, None),
        (3, "a:3", "37 3", "Aus cus", "e", 4, "g", True, 2.0),
    ]
    return spark.createDataFrame(rows, DISTRIBUTION)


def test_distribution_lookups(spark):
    df = distributions(spark)
    assert [r.spcode for r in catalog.distribution_by_name(df, "AUS (Sub) CUS", "e").collect()] == [3]
    assert [r.spcode for r in catalog.distribution_by_name(df, "Aus (Sub) cus", "t").collect()] == [2]
    assert [r.spcode for r in catalog.distribution_by_name(df, "37 1", "e").collect()] == [1]
    assert catalog.distribution_by_name(df, "unknown", "e").collect() == []
    assert [r.geom_idx for r in catalog.distribution_by_code(df, 3, "e").collect()] == [4]
    assert catalog.distribution_by_code(df, 3, "t").collect() == []
    assert [r.spcode for r in catalog.distributions_by_lsid(df, ["a:1", "x"], "e").collect()] == [1]


def test_distribution_terms_leave_nulls_out_and_ask_nothing_by_default(spark):
    df = distributions(spark)
    codes = lambda **terms: sorted(r.geom_idx for r in catalog.distributions(df, **terms).collect())
    assert codes() == codes(geometry=-1) == [4, 5, 6, 7]
    assert codes(group="g") == [4, 5] and codes(coastal=True) == [4, 5] and codes(pelagic=False) == [5]
    assert codes(pelagic=True, kind="e") == [4] and codes(geometry=6, kind="e") == []


def test_objects_by_field_name_and_pid(spark):
    objects = spark.createDataFrame([("2", "Ab", "x", "f"), ("10", "aB", "y", "f"), ("3", None, "AB", "f"), ("4", "ab", None, "g")], "pid string, name string, description string, fid string")
    classes = spark.createDataFrame([("f", 1, "one"), ("f", 2, "two")], "fid string, class int, class_name string")
    assert [r.pid for r in catalog.objects_of_field(objects, "f", "ab").collect()] == ["10", "2", "3"]
    assert [r.pid for r in catalog.objects_of_field(objects, "f", start=1, size=1).collect()] == ["2"]
    assert sorted(r.pid for r in catalog.objects_by_name(objects, "f", "AB").collect()) == ["10", "2"]
    assert sorted(r.pid for r in catalog.objects_by_name(objects, "f", "_b").collect()) == ["10", "2"]
    pid = lambda p: [tuple(r) for r in catalog.object_by_pid(objects, classes, p).collect()]
    assert pid("2") == [("2", "Ab", "f")] and pid("f:2") == [("f:2", "two", "f")] and pid("f:9") == []


def test_ordered_distinct_and_rows_with_area(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 2), ("a", 1), (None, 5), ("b", 2)], "key string, n int")
    assert [tuple(r) for r in catalog.ordered_distinct(rows, ["key"], ["n"]).collect()] == [("a", 1), ("b", 2), (None, 5)]
    shaped = spark.createDataFrame([(1, "g", 0.0), (2, "g", 1.0), (3, None, None), (4, None, 0.0)], "id int, geometry string, area double")
    assert sorted(r.id for r in catalog.with_area(shaped).collect()) == [2, 3, 4]
    assert [r.n for r in catalog.with_count(shaped.where("id = 1"), rows, "n").collect()] == [5]
