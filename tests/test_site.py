"""Ingestion, tiles, tables and products that no SQL can express."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from terravela.functions import geodesy, geometry, text
from terravela.operators import catalogue, compare, flow, grid, ingest, quality, tiles, vector
from terravela.operators.grid import GridMeta
from terravela.sources import tables
from terravela.streaming import limits


def pick(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tiles_written_are_read_back(spark, tmp_path):
    meta = GridMeta(8, 8, 10.0, 300000.0, 2500080.0, epsg=32643)
    cells = spark.createDataFrame([(r, c, 100.0 + r + c / 10) for r in range(8) for c in range(8)], "row int, col int, v double")
    over = tiles.tiles_over(spark, tiles.lon_lat_box(spark, meta), tiles.zoom_range(15, 0))
    pixels = tiles.terrain_tiles(cells, over, meta)
    made = tiles.encode_tiles(pixels, over.union(spark.createDataFrame([(15, 1, 1)], "z int, x long, y long"))).cache()
    assert tiles.write_tiles(made, f"file://{tmp_path}/all").count() == made.count() == tiles.write_tiles(made, f"{tmp_path}/full", keep_empty=False).count() + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/all")
    part = lambda k: F.element_at(F.split(F.regexp_replace("path", "[.]png$", ""), "/"), k)
    back = tiles.decode_tiles(files.select(part(-3).cast("int").alias("z"), part(-2).cast("long").alias("x"), part(-1).cast("long").alias("y"), F.col("content").alias("png")))
    columns = ["z", "x", "y", "px", "py", "r", "g", "b", "a"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, pixels.select(columns).collect()))
    assert tiles.decode_tiles(spark.createDataFrame([(1, 0, 0, b"no png"), (1, 0, 1, None)], "z int, x long, y long, png binary")).count() == 0


def test_files_are_read_by_key_within_their_site(spark, tmp_path):
    (tmp_path / "sites" / "1").mkdir(parents=True)
    (tmp_path / "sites" / "1" / "a.csv").write_text("x")
    (tmp_path / "secret.csv").write_text("y")
    assets = spark.createDataFrame([("sites/1/a.csv",), ("sites/1/../../secret.csv",), ("secret.csv",), ("sites/1/none.csv",)], "storage_key string")
    got = tables.read_files(spark, str(tmp_path), assets, "sites/1/").collect()
    assert [(r["storage_key"], bytes(r["content"])) for r in got] == [("sites/1/a.csv", b"x")]


def test_products_are_written(spark, tmp_path):
    meta = GridMeta(21, 12, 1.0, 300000.0, 2500012.0, epsg=32643)
    cells = spark.createDataFrame([(r, c, 100 + abs(c - 10) * 0.5 - r * 0.05) for r in range(12) for c in range(21)], "row int, col int, v double")
    grid.refuse_implausible(cells, meta)
    products = flow.run_hydrology(cells, meta, threshold=20)
    manifest = {r["key"]: r["n"] for r in flow.write_products(products, cells, meta, str(tmp_path / "out"), threshold=200).collect()}
    assert set(manifest) == {"filled", "sinks", "directions", "accumulation", "orders", "slope", "streams", "basins"} and manifest["filled"] == 252 and manifest["basins"] == 1
    basin = json.loads(spark.read.text(str(tmp_path / "out" / "basins.geojsonl")).first()["value"])
    assert basin["properties"]["truncated_by_survey_edge"] and basin["properties"]["area_m2"] >= 200 and basin["geometry"]["type"] == "Polygon"
    lon, lat = basin["geometry"]["coordinates"][0][0]
    assert 72 < lon < 74 and 22 < lat < 23
    with pytest.raises(ValueError, match="plausible"):
        grid.refuse_implausible(cells.withColumn("v", F.col("v") * 10000), meta)
    with pytest.raises(ValueError, match="UTM"):
        vector.to_geojson(cells, 4326)


def test_users_and_manifests_that_lack_something(spark, tmp_path):
    with pytest.raises(Exception, match='user 0 is missing "passwordHash"'):
        ingest.parse_users(spark.createDataFrame([('[{"id": "a", "email": "A@b.c", "fullName": "n", "role": "admin"}]',)], "json string")).collect()
    (tmp_path / "a.json").write_text("no json")
    (tmp_path / "b.json").write_text('{"site": "s", "layers": [{"key": "k", "kind": "dem", "tiles": "tiles/k/{z}/{x}/{y}.png"}, {"key": "f", "kind": "vector", "file": "../f.json"}]}')
    got = ingest.safe_layers(ingest.read_manifests(spark, str(tmp_path))).collect()
    assert [(r["site"], [x["key"] for x in r["layers"]]) for r in got] == [("s", ["k"])]
    assert ingest.height_field([("NAME", "C"), ("Elev", "N")]) == "Elev" and ingest.height_field([("NAME", "C"), ("A", "F")]) == "A" and ingest.height_field([("NAME", "C")]) is None
    assert ingest.site_paths(spark, {"s": {"dtm": "a.tif"}}).collect() == [("s", "dtm", "a.tif")]
    with pytest.raises(ValueError, match="below 0.9"):
        ingest.refuse_below(spark.createDataFrame([("n", "iou", 0.5)], "name string, metric string, value double"), {"iou": 0.9})


def test_a_faulty_publication_changes_nothing(spark):
    row = "storage_key string, category string, mime_type string, is_published boolean, id long"
    old = spark.createDataFrame([("s/1/a", "report", "text/csv", True, 1), ("s/1/b", "report", "text/csv", True, 2)], row)
    new = spark.createDataFrame([("s/1/a", "drawing", "text/csv", True, 9)], row)
    got = {r["storage_key"]: (r["id"], r["category"], r["is_published"]) for r in ingest.publish(old, new, F.lit("s/1/"), F.lit(True)).collect()}
    assert got == {"s/1/a": (1, "drawing", True), "s/1/b": (2, "report", False)}
    with pytest.raises(ValueError, match="unknown category"):
        ingest.publish(old, new.withColumn("category", F.lit("x")), F.lit("s/1/"), F.lit(True))


def test_small_functions(spark):
    assert [pick(spark, text.grouped_digits(F.lit(n))) for n in (7, 999, 1000, 123456, 1234567)] == ["7", "999", "1,000", "1,23,456", "12,34,567"]
    rings = F.array(*[F.struct(F.lit(a).alias("signed_area"), F.lit(i).alias("i")) for i, a in enumerate((-1.0, 9.0, 4.0))])
    assert [r["i"] for r in pick(spark, geometry.outer_first(rings))] == [1, 2, 0]
    assert list(tiles.zoom_range(20)) == list(range(14, 21)) and list(tiles.zoom_range(3)) == [0, 1, 2, 3]
    assert pick(spark, quality.kind_rank(F.lit("dem"))) == 2 and pick(spark, quality.kind_rank(F.lit("x"))) == 4
    one = F.array(F.struct(F.lit(73.0).alias("lon"), F.lit(22.0).alias("lat")))
    assert pick(spark, geodesy.lon_lat_area(one, F.lit(43), F.lit(True))) == 0 and pick(spark, geodesy.measured(one, True, F.lit(43), F.lit(True))) is None
    assert pick(spark, geodesy.box_hectares(F.lit(0.0), F.lit(0.0), F.lit(0.01), F.lit(0.01))) == pytest.approx(123.05, abs=0.1)
    assert compare.best_match(spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (1, 9, 0.1)], "k int, o int, s double"), "k", "o", "s").collect() == [(1, 4, 0.5)]
    assert limits.valid_grants(spark.createDataFrame([(100,), (5,)], "exp long"), F.timestamp_seconds(F.lit(50))).collect() == [(100,)]
    assert catalogue.queryable(spark.range(3), catalogue.Viewer("x")).count() == 0
    assert pick(spark, text.iso_date(F.lit(datetime.date(2024, 2, 29)))) == "2024-02-29"
