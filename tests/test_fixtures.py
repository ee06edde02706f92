"""Known-answer terrains: planes, pits, valleys and masks whose results follow from a formula."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravela.functions import encode, geodesy, geometry, text
from terravela.operators import compare, flow, focal, grid, sample, vector, zonal
from terravela.operators.grid import GridMeta


def cells(spark, width, height, z):
    rows = [(r, c, None if (v := z(r, c)) is None else float(v)) for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, "row int, col int, v double")


def meta(width, height, cell=1.0):
    return GridMeta(width, height, cell, 0.0, height * cell, epsg=32643)


def values(df, name="v"):
    return {(r["row"], r["col"]): r[name] for r in df.collect()}


PLANE = meta(100, 100)
SQUARE = [(10.0, 20.0), (30.0, 20.0), (30.0, 40.0), (10.0, 40.0)]


@pytest.fixture(scope="module")
def plane(spark):
    """z = 10 + 0.1 x + 0.02 y at cell centres."""
    return cells(spark, 100, 100, lambda r, c: 10 + 0.1 * (c + 0.5) + 0.02 * (100 - r - 0.5)).cache()


def test_tilted_plane_drains_east(spark):
    m, dem = meta(20, 8), cells(spark, 20, 8, lambda r, c: 100 - 0.1 * c)
    filled = flow.fill_depressions(dem, block=8)
    assert filled.where("depth IS NOT NULL OR abs(filled - v) > 1e-12").count() == 0
    directions = focal.d8_direction(dem)
    assert {(r["col"] == 19, r["dir"]) for r in directions.collect()} == {(True, -1), (False, 0)}
    acc = flow.accumulate(focal.downstream(directions, m)).collect()
    assert all(r["acc"] == r["node"] % 20 + 1 for r in acc)
    slope = values(focal.slope_degrees(dem, m), "slope")
    assert slope[4, 10] == pytest.approx(math.degrees(math.atan(0.1)))


@pytest.mark.parametrize("block", [4, 5, 64])
def test_pits_fill_to_their_spill_point(spark, block):
    flat = values(flow.fill_depressions(cells(spark, 15, 15, lambda r, c: 46.75 if (r, c) == (7, 7) else 50), block=block), "depth")
    assert {k for k, v in flat.items() if v is not None} == {(7, 7)} and flat[7, 7] == pytest.approx(3.25)
    sloped = flow.fill_depressions(cells(spark, 15, 15, lambda r, c: 50 - 0.01 * c - (3.25 if (r, c) == (7, 7) else 0)), block=block)
    row = sloped.where("row = 7 AND col = 7").first()
    assert row["filled"] == pytest.approx(49.92, abs=1e-4) and row["depth"] == pytest.approx(3.24, abs=1e-9)


def priority_flood(z, epsilon):
    import heapq

    h, w = z.shape
    level = np.full(z.shape, np.inf)
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    ok = lambda r, c: 0 <= r < h and 0 <= c < w and not np.isnan(z[r, c])
    heap = []
    for r in range(h):
        for c in range(w):
            if ok(r, c) and not all(ok(r + a, c + b) for a, b in near):
                level[r, c] = z[r, c]
                heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        v, r, c = heapq.heappop(heap)
        if v > level[r, c]:
            continue
        for a, b in near:
            if ok(r + a, c + b) and max(z[r + a, c + b], v + epsilon) < level[r + a, c + b]:
                level[r + a, c + b] = max(z[r + a, c + b], v + epsilon)
                heapq.heappush(heap, (level[r + a, c + b], r + a, c + b))
    return level


def test_block_relaxation_equals_a_priority_flood(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(300, 340, (23, 19)).astype(float)
    z[rng.random(z.shape) < 0.1] = np.nan
    dem = cells(spark, 19, 23, lambda r, c: None if np.isnan(z[r, c]) else z[r, c])
    for epsilon in (0.0, 1e-5):
        want = priority_flood(z, epsilon)
        got = values(flow.fill_levels(dem, epsilon, block=6), "w")
        assert set(got) == {(r, c) for r, c in np.argwhere(~np.isnan(z))} and all(v == want[k] for k, v in got.items())
    filled = flow.fill_depressions(dem, block=6).select("row", "col", F.col("filled").alias("v"))
    out = focal.d8_direction(filled).where("dir < 0").join(focal.open_sides(dem), ["row", "col"]).where("n_open = 0")
    assert out.count() == 0  # every inner cell of a filled terrain drains


def test_valley_channel_and_watershed(spark):
    m, dem = meta(21, 12), cells(spark, 21, 12, lambda r, c: 100 + abs(c - 10) * 0.5 - r * 0.05)
    forest = focal.downstream(focal.d8_direction(dem), m).cache()
    acc = flow.accumulate(forest).withColumns({"row": F.expr("cast(node div 21 as int)"), "col": (F.col("node") % 21).cast("int")}).cache()
    assert acc.join(forest, "node").where("node = root").agg(F.sum("acc")).first()[0] == 252
    assert {r["col"] for r in acc.where("acc >= 20").collect()} == {10}
    assert flow.snap_to_channel(acc, 6, 7, 5).first()["col"] == 10
    outlet = acc.orderBy(F.desc("acc")).first()
    assert flow.watershed(forest, outlet["node"]).count() == outlet["acc"] == flow.basins(forest).where(F.col("root") == outlet["node"]).count()
    links = flow.stream_links(forest, acc.select("node", "acc"), 20)
    assert {r["ord"] for r in flow.strahler(links).collect()} == {1}
    walk = flow.walk_upstream(forest, acc.select("node", "acc"), outlet["node"], 4).collect()
    assert [r["node"] % 21 for r in walk] == [10] * 5


def test_orders_rise_where_equal_streams_meet(spark):
    """Four heads make two seconds, which make a third; a first joining the third leaves it."""
    tree = {1: 5, 2: 5, 3: 6, 4: 6, 5: 7, 6: 7, 7: 8, 8: 10, 9: 10, 10: 11, 11: 11}
    forest = spark.createDataFrame(list(tree.items()), "node long, root long")
    links = flow.stream_links(forest, spark.createDataFrame([(k, 1) for k in tree], "node long, acc long"), 1)
    assert {r["node"]: r["ord"] for r in flow.strahler(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 8: 3, 9: 1, 10: 3, 11: 3}
    lines = flow.stream_lines(links, meta(20, 1)).collect()
    assert sorted(r["ord"] for r in lines) == [1, 1, 1, 1, 1, 2, 2, 3, 3]


def test_a_cycle_is_refused(spark):
    with pytest.raises(ValueError, match="cycle"):
        flow.accumulate(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, root long"))


def test_flood_stays_in_its_basin(spark):
    def z(r, c):
        return 10 if 4 <= r <= 7 and (4 <= c <= 9 or 26 <= c <= 31) else 60 if c >= 20 else 14

    m, dem = meta(40, 12), cells(spark, 40, 12, z)
    flood = flow.connected_flood(dem, m, 12.0, [(6, 6)]).cache()
    s = flow.flood_summary(flood, m).first()
    assert (s["n_cells"], s["volume"]) == (24, 48.0) and flood.where("row = 6 AND col = 28").count() == 0
    assert flow.connected_flood(dem, m, 12.0, [(0, 0), (-1, 5)]).count() == 0


def test_bilinear_levels_are_exact_on_a_plane(spark, plane):
    rng = np.random.default_rng(1)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(1, 99, (50, 2)))] + [(99, -5.0, 4.0)]
    got = {r["id"]: r["elevation"] for r in sample.spot_levels(spark.createDataFrame(places, "id long, x double, y double"), plane, PLANE).collect()}
    assert got[99] is None and all(got[i] == pytest.approx(10 + 0.1 * x + 0.02 * y) for i, x, y in places[:-1])


def test_areas_and_volumes_have_closed_forms(spark, plane):
    ring = geometry.points(SQUARE)
    row = spark.range(1).select(geometry.polygon_area(ring).alias("a"), geometry.polygon_perimeter(ring).alias("p"), geometry.path_length(ring).alias("l"), geometry.signed_area(ring).alias("s")).first()
    assert (row["a"], row["p"], row["l"], row["s"]) == (400.0, 80.0, 60.0, 400.0)
    cut = zonal.cut_fill(plane, PLANE, SQUARE, F.lit(10 + 0.1 * 10 + 0.02 * 20), 0.04).first()
    assert cut["cut"] - cut["fill"] == pytest.approx(480.0) and cut["uncertainty"] == pytest.approx(16.0)
    lower = plane.withColumn("v", F.col("v") - 2)
    both = zonal.cut_fill(plane, PLANE, SQUARE, lower).first()
    assert both["cut"] == pytest.approx(800.0) and both["mean_depth"] == pytest.approx(2.0)
    change = zonal.surface_difference(plane, plane.withColumn("v", F.col("v") - 0.5), PLANE).first()
    assert change["gained"] == pytest.approx(5000.0) and change["mean_d"] == pytest.approx(0.5)
    fitted = zonal.boundary_plane(plane.where("row % 9 = 0").select(PLANE.x(F.col("col")).alias("x"), PLANE.y(F.col("row")).alias("y"), "v")).first()
    assert (fitted["a"], fitted["b"], fitted["c"]) == pytest.approx((10, 0.1, 0.02))


def test_a_hole_makes_a_polygon_incomplete(spark, plane):
    holed = plane.withColumn("v", F.when(~((F.col("row").between(60, 79)) & (F.col("col").between(10, 29))), F.col("v")))
    s = zonal.polygon_stats(holed, PLANE, SQUARE).first()
    assert not s["complete"] and s["nodata_area"] > 0 and s["covered_area"] + s["nodata_area"] == pytest.approx(400)


def test_profile_of_a_plane(spark, plane):
    p = sample.spot_levels(sample.profile_points(spark, [(10.0, 50.0), (90.0, 50.0)], 1.0), plane, PLANE)
    s = sample.profile_summary(p).first()
    assert (s["length"], s["gain"], s["loss"], s["grade_percent"]) == pytest.approx((80, 8, 0, 10))


def test_levels_snap_to_whole_multiples_and_have_a_cap(spark, plane):
    got = sample.grid_levels(spark, plane, PLANE, SQUARE, 5.0).collect()
    assert {r["x"] % 5 for r in got} == {0.0} and len(got) == 16
    with pytest.raises(ValueError, match="would keep"):
        sample.grid_levels(spark, plane, PLANE, SQUARE, 0.01)


def test_resampling(spark):
    m = meta(4, 4)
    dem = cells(spark, 4, 4, lambda r, c: None if (r, c) in {(0, 0), (2, 2), (2, 3), (3, 2), (3, 3)} else r * 4 + c)
    out, bigger = zonal.resample(dem, m, 2.0)
    assert values(out) == {(0, 0): pytest.approx((1 + 4 + 5) / 3), (0, 1): pytest.approx(4.5), (1, 0): pytest.approx(10.5)} and (bigger.width, bigger.height) == (2, 2)
    with pytest.raises(ValueError, match="finer"):
        zonal.resample(dem, m, 0.5)
    assert zonal.resample(dem, m, 1.0)[0] is dem


def areas(spark, mask, size=8):
    m = meta(size, size)
    return sorted(r["signed_area"] for r in vector.polygonize(spark.createDataFrame(mask, "row int, col int"), m).collect())


def test_outlines_of_masks(spark):
    block = [(r, c) for r in range(2, 5) for c in range(2, 5)]
    assert areas(spark, block) == [9.0]
    assert areas(spark, [k for k in block if k != (3, 3)]) == [-1.0, 9.0]
    assert areas(spark, [(1, 1), (5, 5)]) == [1.0, 1.0]
    assert areas(spark, [(1, 1), (2, 2)]) == [1.0, 1.0]
    ring = vector.polygonize(spark.createDataFrame([(1, 1)], "row int, col int"), meta(8, 8)).first()
    assert ring["n_corners"] == 4 and {(p["x"], p["y"]) for p in ring["points"]} == {(1.0, 7.0), (2.0, 7.0), (1.0, 6.0), (2.0, 6.0)}


def test_outlines_hold_the_area_of_random_masks(spark):
    rng = np.random.default_rng(2)
    mask = [(int(r), int(c)) for r, c in np.argwhere(rng.random((12, 12)) < 0.55)]
    assert sum(areas(spark, mask, 12)) == len(mask)


def test_border_colour_is_cleared_and_an_inner_pixel_kept(spark):
    def colour(r, c):
        inside = 10 <= r <= 29 and 10 <= c <= 29 and (r, c) != (20, 20)
        return (40, 160, 60) if inside else (255, 255, 255)

    m = meta(40, 40)
    pixels = spark.createDataFrame([(r, c, *colour(r, c)) for r in range(40) for c in range(40)], "row int, col int, r int, g int, b int")
    assert flow.detect_background(pixels, m) == (255, 255, 255)
    gone = {(r["row"], r["col"]) for r in flow.border_mask(pixels, m, (255, 255, 255)).collect()}
    assert len(gone) == 1600 - 400 and (20, 20) not in gone
    assert flow.detect_background(pixels.withColumns({"r": F.lit(40), "g": F.lit(160), "b": F.lit(60)}), m) is None


def test_elevation_predicate(spark):
    probe = [(-9999.0, False), (-32767.0, False), (-32768.0, False), (-3.4028235e38, False), (float("nan"), False), (338.0, True), (-120.0, True), (8848.0, True), (None, False)]
    got = spark.createDataFrame(probe, "v double, want boolean").select(grid.is_elevation(F.col("v")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_rates_of_empty_masks_and_networks(spark):
    none = spark.createDataFrame([], "row int, col int")
    c = compare.confusion(none, none).first()
    assert (c["iou"], c["precision"], c["recall"]) == (1.0, 1.0, 1.0)
    n = compare.network_agreement(none, none, 2.0).first()
    assert (n["precision"], n["recall"], n["f1"]) == (0.0, 0.0, 0.0)


def test_chamfer_offsets_equal_a_distance_transform():
    reach = {(r, c) for r in range(-6, 7) for c in range(-6, 7) if (3 * max(abs(r), abs(c)) + min(abs(r), abs(c))) / 3 <= 4}
    assert set(compare.chamfer_offsets(4.0, 1.0)) == reach


def test_coordinates_come_back(spark):
    places = spark.createDataFrame([(72.8, 19.1, 43, True), (-70.6, -33.4, 19, False), (75.0, 0.5, 43, True)], "lon double, lat double, zone int, north boolean")
    east, north = geodesy.lon_lat_to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("north"))
    there = places.select("*", east.alias("e"), north.alias("n"))
    lon, lat = geodesy.utm_to_lon_lat(F.col("e"), F.col("n"), F.col("zone"), F.col("north"))
    for r in there.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert (r["lon2"], r["lat2"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-8)
    x, y = geodesy.lon_lat_to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geodesy.mercator_to_lon_lat(x, y)
    assert all(r[0] == pytest.approx(r[1]) for r in places.select(lat, "lat").collect())


def test_gaps_cross_partitions(spark):
    got = sample.gaps(spark.range(0, 3000, 3).selectExpr("cast(id as double) AS z").repartition(7), "z", 2).collect()
    assert len(got) == 999 and {r["gap"] for r in got} == {3.0}
    assert sample.modal_gap(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "z double"), "z").first()["gap"] == 1.0
    assert sample.modal_gap(spark.createDataFrame([(1.0,)], "z double"), "z").count() == 0


def test_texts(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(text.wrap(F.lit("aaa bb c dddddd e"), 5)) == ["aaa", "bb c", "dddddd", "e"]
    assert pick(text.client_ip(F.lit("1.1.1.1, 2.2.2.2 , "))) == "2.2.2.2" and pick(text.client_ip(F.lit(" , "))) is None
    assert pick(text.safe_filename(F.lit('a"b\\cé\n'))) == "abc_" and pick(text.safe_filename(F.lit('"'))) == "file"
    assert [(p["x"], p["y"]) for p in pick(text.parse_coordinates(F.lit("1,2 3.5,-4;5,6")))] == [(1.0, 2.0), (3.5, -4.0), (5.0, 6.0)]
    assert pick(text.title_for(F.lit("DSM"))) == "DSM preview" and pick(text.title_for(F.lit("site_LOG-2 final"))) == "Site LOG 2 Final"
    assert pick(text.leading_number(F.lit("338 m"))) == 338.0 and pick(text.leading_number(F.lit(""))) is None
    assert pick(text.format_elevation(F.lit(12.345))) == "12.35 m ±4 cm" and pick(text.percent(F.lit(0.9814))) == "98.1%"
    assert pick(encode.stable_uuid(F.lit("a"), F.lit("b"))) == str(__import__("uuid").uuid5(__import__("uuid").UUID(encode.NAMESPACE), "a/b"))
    with pytest.raises(Exception, match="coordinate pair"):
        pick(text.parse_coordinates(F.lit("1;2")))


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    dem = cells(spark, 30, 30, lambda r, c: 50 + math.sin(c / 3) * 2 + math.cos(r / 4) * 3 - r * 0.05)
    seen = set()
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        forest = focal.downstream(focal.d8_direction(dem.repartition(int(n))), meta(30, 30))
        seen.add(tuple(sorted(map(tuple, flow.accumulate(forest).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
