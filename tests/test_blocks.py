"""Block rasters against plain versions, for blocks of several sizes."""

import heapq
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravela.functions import geodesy
from terravela.operators import blocks, flow, tiles, vector
from terravela.operators.focal import DIRECTIONS
from terravela.operators.grid import GridMeta
from terravela.plans.lineage import stored
from terravela.sources.geotiff import _Writer, read_meta, write_geotiff


def rough(height, width, seed, hole=0.06):
    rng = np.random.default_rng(seed)
    z = np.cumsum(rng.normal(0, 1, (height, width)), 1) + np.cumsum(rng.normal(0, 1, (height, width)), 0)
    z = np.round(z * 2) / 2  # flats and ties
    z[rng.random((height, width)) < hole] = np.nan
    return z


def cells_of(spark, z):
    return spark.createDataFrame([(int(r), int(c), float(z[r, c])) for r, c in np.argwhere(~np.isnan(z))], "row int, col int, v double")


def grid_of(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def plain_fill(z, epsilon):
    """Reach cells in the order of their levels over the whole grid."""
    height, width = z.shape
    at = lambda r, c: z[r, c] if 0 <= r < height and 0 <= c < width else np.nan
    w, heap = np.full(z.shape, np.nan), []
    for r, c in np.argwhere(~np.isnan(z)):
        if any(np.isnan(at(r + dr, c + dc)) for _, dr, dc in DIRECTIONS):
            w[r, c] = z[r, c]
            heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        level, r, c = heapq.heappop(heap)
        for _, dr, dc in DIRECTIONS:
            y, x = r + dr, c + dc
            if not np.isnan(at(y, x)) and np.isnan(w[y, x]):
                w[y, x] = max(z[y, x], level + epsilon)
                heapq.heappush(heap, (w[y, x], y, x))
    return w


def plain_flow(w, cell):
    """Directions, sums and ends, cell by cell from the highest."""
    height, width = w.shape
    direction, acc, root = np.full(w.shape, -1), np.zeros(w.shape, int), np.full(w.shape, -1)
    order = sorted(map(tuple, np.argwhere(~np.isnan(w))), key=lambda k: -w[k])
    to = {}
    for r, c in order:
        best = 0
        for k, (_, dr, dc) in enumerate(DIRECTIONS):
            y, x = r + dr, c + dc
            if 0 <= y < height and 0 <= x < width and not np.isnan(w[y, x]):
                drop = (w[r, c] - w[y, x]) / (cell * (2**0.5 if dr and dc else 1.0))
                if drop > best:
                    best, direction[r, c], to[r, c] = drop, k, (y, x)
    for k in order:
        acc[k] += 1
        if k in to:
            acc[to[k]] += acc[k]
    for k in reversed(order):
        root[k] = root[to[k]] if k in to else k[0] * width + k[1]
    return direction, acc, root


@pytest.mark.parametrize("size", [7, 16, 64])
def test_drained_blocks_equal_a_plain_version(spark, size):
    z = rough(26, 33, 5)
    m = GridMeta(33, 26, 2.0)
    drained = stored(blocks.drain_blocks(stored(blocks.to_blocks(cells_of(spark, z), size)), m, 1e-5, size))
    got = blocks.from_blocks(drained, {n: n for n in ("z", "filled", "flat", "dir", "acc", "root")}, size).collect()
    filled, flat = plain_fill(z, 1e-5), plain_fill(z, 0.0)
    direction, acc, root = plain_flow(filled, 2.0)
    assert len(got) == np.isfinite(z).sum()
    for r in got:
        at = r["row"], r["col"]
        assert (r["z"], r["filled"], r["flat"], r["dir"], r["acc"], r["root"]) == (z[at], filled[at], flat[at], direction[at], acc[at], root[at])
    # The catchment of a cell in the middle of the largest stream has that cell's accumulation as its area.
    inner = np.where(direction >= 0, acc, 0)
    outlet = int(inner.argmax())
    found = flow.catchment(drained, m, outlet, size).collect()
    assert sum(r["signed_area"] for r in found) == inner.max() * 4.0 and {r["label"] for r in found} == {outlet}


def test_blocks_of_nothing(spark):
    m = GridMeta(9, 9)
    none = spark.createDataFrame([], "row int, col int, v double")
    assert flow.fill_levels(none, 0.0).count() == 0 and blocks.drain_blocks(blocks.to_blocks(none, 4), m, 0.0, 4).count() == 0
    assert flow.cell_components(none, m).count() == 0 and vector.polygonize(none, m).count() == 0
    lone = spark.createDataFrame([(8, 8, 3.0), (0, 0, None)], "row int, col int, v double")
    assert [tuple(r) for r in flow.fill_levels(lone, 1.0, 4).collect()] == [(8, 8, 3.0, 3.0)]


@pytest.mark.parametrize("eight", [True, False])
def test_parts_across_blocks_equal_a_search(spark, eight):
    rng = np.random.default_rng(8)
    held = set(map(tuple, np.argwhere(rng.random((21, 25)) < 0.5).tolist()))
    steps = [(dr, dc) for _, dr, dc in DIRECTIONS if eight or 0 in (dr, dc)]
    expected, left = {}, set(held)
    while left:
        first = min(left)
        todo, part = [first], {first}
        while todo:
            r, c = todo.pop()
            new = {(r + dr, c + dc) for dr, dc in steps} & held - part
            part |= new
            todo += new
        left -= part
        expected |= {r * 25 + c: first[0] * 25 + first[1] for r, c in part}
    m, cells = GridMeta(25, 21), spark.createDataFrame(sorted(held), "row int, col int")
    for size in (6, 32):
        assert {r["node"]: r["root"] for r in flow.cell_components(cells, m, eight, size).collect()} == expected


def test_outlines_dont_depend_on_blocks(spark):
    rng = np.random.default_rng(9)
    mask = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(rng.random((24, 24)) < 0.6)], "row int, col int")
    m = GridMeta(24, 24)
    found = [sorted(map(tuple, vector.polygonize(mask, m, size).collect()), key=str) for size in (5, 24)]
    assert found[0] == found[1] and sum(r[2] for r in found[0]) == mask.count()


def test_tiles_drawn_from_blocks_equal_those_drawn_by_pixel(spark):
    z = np.abs(rough(40, 40, 3)) + 5
    m = GridMeta(40, 40, 10.0, 300000.0, 2500400.0, epsg=32643)
    cells = cells_of(spark, z)
    over = tiles.tiles_over(spark, tiles.lon_lat_box(spark, m), range(13, 16))
    pixels = tiles.terrain_tiles(cells, over, m, 64)
    expected = {tuple(r) for r in tiles.encode_tiles(pixels, over, 64, (1, 2, 3)).collect()}
    for size in (11, 64):
        assert {tuple(r) for r in tiles.draw_tiles(blocks.to_blocks(cells, size), over, m, 64, size, (1, 2, 3)).collect()} == expected
    full = tiles.draw_tiles(blocks.to_blocks(cells, 11), over, m, 64, 11, keep_empty=False)
    assert full.count() == sum(r[4] > 0 for r in expected)
    with pytest.raises(ValueError, match="UTM"):
        tiles.draw_tiles(cells, over, GridMeta(4, 4, epsg=4326))


def test_array_projection_equals_the_columns(spark):
    lon, lat = np.linspace(72, 78, 13), np.linspace(-60, 60, 13)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "lon double, lat double")
    e, n = geodesy.lon_lat_to_utm(F.col("lon"), F.col("lat"), F.lit(43), F.lit(True))
    got = rows.select(e.alias("e"), n.alias("n")).collect()
    east, north = geodesy.transverse(np, lon, lat, 43)
    assert np.allclose([r["e"] for r in got], east, atol=1e-6) and np.allclose([r["n"] for r in got], north, atol=1e-6)


def test_a_geotiff_is_the_same_after_retries_and_gone_after_failures(spark, tmp_path):
    import pyarrow as pa

    z, m = rough(23, 9, 1), GridMeta(9, 23, 1.0, 300000.0, 2500023.0, epsg=32643)
    write_geotiff(cells_of(spark, z), m, str(tmp_path / "a" / "x.tif"), rows_per_strip=4)
    write_geotiff(cells_of(spark, z).repartition(7), m, f"file://{tmp_path}/y.tif", rows_per_strip=4)
    data = (tmp_path / "a" / "x.tif").read_bytes()
    assert (tmp_path / "y.tif").read_bytes() == data and read_meta(str(tmp_path / "y.tif")).height == 23
    got = spark.read.format("geotiff").option("first_row", 6).option("last_row", 13).load(str(tmp_path / "y.tif")).collect()
    assert {(r["row"], r["col"]) for r in got} == {(r, c) for r in range(6, 14) for c in range(9)}
    assert all((r["v"] is None) == bool(np.isnan(z[r["row"], r["col"]])) and (r["v"] is None or r["v"] == np.float32(z[r["row"], r["col"]])) for r in got)
    writer = _Writer({"path": str(tmp_path / "z.tif"), "width": "9", "height": "23", "origin_x": "300000.0", "origin_y": "2500023.0", "epsg": "32643", "rows_per_strip": "4"})
    rows = [(int(r), int(c), float(z[r, c])) for r, c in np.argwhere(~np.isnan(z))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], ["row", "col", "v"])
    writer.write(iter([batch.slice(0, 60)]))  # an attempt that is lost
    message = writer.write(iter([batch.slice(0, 100), batch.slice(100)]))
    writer.commit([None, message])
    assert (tmp_path / "z.tif").read_bytes() == data
    failed = _Writer({"path": str(tmp_path / "w.tif"), "width": "9", "height": "23"})
    failed.write(iter([batch]))
    failed.abort([None])
    assert sorted(os.listdir(tmp_path)) == ["a", "x.tif", "y.tif", "z.tif"][0:1] + ["y.tif", "z.tif"]


def test_a_survey_of_many_cells_is_drained_in_time(spark):
    z = 50 + np.add.outer(np.sin(np.arange(300) / 9) * 3, np.cos(np.arange(400) / 7) * 3)
    m = GridMeta(400, 300)
    made = stored(blocks.to_blocks(cells_of(spark, z)))
    began = time.time()
    ends = blocks.from_blocks(blocks.drain_blocks(made, m), {"acc": "acc", "dir": "dir"}).where("dir = -1").agg(F.sum("acc")).first()[0]
    assert ends == 120_000 and time.time() - began < 60


def test_orders_by_contraction_equal_those_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    to = {k: int(rng.integers(max(0, k // 2 - 3), k)) if k and rng.random() < 0.97 else None for k in range(160)}
    n_in = {k: sum(t == k for t in to.values()) for k in to}
    links = stored(spark.createDataFrame([(k, t, n_in[k]) for k, t in to.items()], "node long, to long, n_in long"))
    found = []
    for most in (200_000, 0):
        monkeypatch.setattr(flow, "AT_ONCE", most)
        found.append(sorted(map(tuple, flow.strahler(links).collect())))
    assert found[0] == found[1] and len(found[0]) == 160 and max(o for _, o in found[0]) > 2
    ring = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (3, 2, 0)], "node long, to long, n_in long")
    for most in (200_000, 0):
        monkeypatch.setattr(flow, "AT_ONCE", most)
        with pytest.raises(Exception, match="cycle"):
            flow.strahler(ring).collect()


@pytest.mark.parametrize("in_task", [3, 10, 1_000_000])
def test_long_lines_are_thinned_by_rounds_as_in_one_task(spark, in_task):
    from terravela.operators.vector import simplify_lines, thin

    rng = np.random.default_rng(5)
    lines = {i: np.round(np.column_stack([np.cumsum(rng.random(n)), rng.normal(size=n).cumsum()]), 1) for i, n in enumerate((1, 2, 3, 60, 200))}
    lines[9] = np.array([[0, 0], [1, 2], [2, 2], [1, -2], [0, 0]], float)  # closed, with a tie
    rows = [(i, 3 * k, *map(float, p)) for i, pts in lines.items() for k, p in enumerate(pts)] + [(None, 1, 0.0, 0.0), (3, None, 5.0, 5.0), (3, 1, None, 5.0)]
    frame = spark.createDataFrame(rows, "line long, seq int, x double, y double")
    got = sorted(map(tuple, simplify_lines(frame.repartition(5), 0.8, in_task).collect()))
    want = [(i, 3 * k, *map(float, p)) for i, pts in lines.items() for k, p in enumerate(pts) if len(pts) < 3 or thin(pts, 0.8)[k]]
    assert got == sorted(want) and len(want) < len(rows) - 20
    assert simplify_lines(frame.limit(0), 0.8, in_task).count() == 0
