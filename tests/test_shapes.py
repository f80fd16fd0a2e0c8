"""Shapefiles: written and read back, holes and parts, collections, attributes, and a file packed by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from terrafacet.sources import shapes

HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1))"
TWO = "MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((5 5,9 5,9 9,5 9,5 5),(6 6,6 7,7 7,7 6,6 6)))"


def test_written_files_read_back(spark, tmp_path):
    texts = spark.createDataFrame([("a", HOLED), ("b é", TWO), ("c", f"GEOMETRYCOLLECTION({HOLED},POINT(1 2))"), ("d", "POINT(1 2)"), (None, HOLED), ("e", None)], "name string, wkt string")
    areas = shapes.features(texts)
    assert sorted(str(r.name) for r in areas.select("name").collect()) == ["None", "a", "b é", "c_0"]
    shapes.write_shapes(areas, str(tmp_path / "out"), zipped=True)
    raw = (tmp_path / "out.shp").read_bytes()
    assert struct.unpack_from(">i20xi", raw) == (9994, len(raw) // 2) and struct.unpack_from("<2i4d", raw, 28) == (1000, 5, 0.0, 0.0, 9.0, 9.0)
    index = (tmp_path / "out.shx").read_bytes()
    for k in range(4):
        at, words = struct.unpack_from(">2i", index, 100 + 8 * k)
        assert struct.unpack_from(">2i", raw, 2 * at) == (k + 1, words)
    (tmp_path / "un").mkdir()
    main = shapes.unzip_shapes(str(tmp_path / "out.zip"), str(tmp_path / "un"))
    held = {r.record: r.attributes["name"] for r in shapes.read_attributes(spark, main.replace(".shp", ".dbf")).collect()}
    assert held == {0: "", 1: "a", 2: "b é", 3: "c_0"}
    found = shapes.read_shapes(spark, main)
    assert {(r.file, r.record, r.n) for r in found.groupBy("file", "record").agg(F.count("*").alias("n")).collect()} == {("out", 0, 10), ("out", 1, 10), ("out", 2, 15), ("out", 3, 10)}
    assert {tuple(r) for r in found.where("record = 2").select("part", "ring").distinct().collect()} == {(0, 0), (1, 0), (1, 1)}
    text = shapes.feature_wkt(found, 1).first().wkt
    assert text == "POLYGON((0.0 0.0,0.0 4.0,4.0 4.0,4.0 0.0,0.0 0.0),(1.0 1.0,2.0 1.0,2.0 2.0,1.0 2.0,1.0 1.0))"


def test_files_packed_by_hand(spark, tmp_path):
    ring = struct.pack("<8d", 0, 0, 0, 20037508.342789244, 20037508.342789244, 0, 0, 0)
    polygon = struct.pack("<i4d2ii", 15, 0, 0, 1, 1, 1, 4, 0) + ring + bytes(48)  # with heights, which are passed over
    body = b"".join(struct.pack(">2i", k + 1, len(c) // 2) + c for k, c in enumerate((struct.pack("<i", 0), polygon)))
    (tmp_path / "one.shp").write_bytes(bytes(100) + body)
    found = shapes.read_shapes(spark, str(tmp_path / "*.shp"))
    assert {r.record for r in found.collect()} == {1}
    corner = found.where("i = 2").select(F.round("x", 3)).first()[0]
    assert corner == 20037508.343
    assert shapes.feature_wkt(found, 1, mercator=True).first().wkt.startswith("POLYGON((0.0 0.0,0.0 85.05112877980")
    (tmp_path / "points.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, 10) + struct.pack("<i2d", 1, 0, 0))
    with pytest.raises(Exception, match="not a file of polygons"):
        shapes.read_shapes(spark, str(tmp_path / "points.shp")).collect()


def test_no_features(spark, tmp_path):
    none = shapes.features(spark.createDataFrame([], "name string, wkt string"))
    shapes.write_shapes(none, str(tmp_path / "no"))
    assert shapes.read_shapes(spark, str(tmp_path / "no.shp")).count() == 0 and shapes.read_attributes(spark, str(tmp_path / "no.dbf")).count() == 0
