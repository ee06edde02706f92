"""Vectors: outlines of masks, lines on grids, thinning, GeoJSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from terravela.functions.geodesy import utm_is_north, utm_points_to_lon_lat, utm_zone
from terravela.operators.blocks import BLOCK, component_blocks, to_blocks
from terravela.operators.grid import GridMeta
from terravela.operators.rings import outline_blocks
from terravela.plans.lineage import broadcast_below, stored

#: Long lines, or stretches of them, that may be broadcast, about 8 MB; beyond that they are joined by a shuffle.
LONG_ROWS = 100_000
#: Points that are thinned at once, some 20 MB of arrays; a longer line is thinned by itself.
THINNED = 200_000


def line_cells(c0: np.ndarray, r0: np.ndarray, c1: np.ndarray, r1: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of the cells of straight lines that lie in the grid, both ends included: along the longer axis cell by cell, the other rounded half up from the start."""
    across, down = np.abs(c1 - c0), np.abs(r1 - r0)
    level, long = across >= down, np.maximum(across, down)
    start, step = np.where(level, c0, r0), np.sign(np.where(level, c1 - c0, r1 - r0))
    last = np.where(level, width, height) - 1
    # Cells outside along the longer axis are never made.
    low = np.maximum(0, np.where(step < 0, start - last, -start))
    n = np.maximum(0, np.minimum(long, np.where(step < 0, start, last - start)) - low + 1)
    n[(step == 0) & ((start < 0) | (start > last))] = 0
    ends = np.cumsum(n)
    k = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - low, n)
    span, twice = np.repeat(np.where(level, down, across), n), np.repeat(np.maximum(2 * long, 1), n)
    aside = np.repeat(np.where(level, r0, c0), n) + np.repeat(np.sign(np.where(level, r1 - r0, c1 - c0)), n) * ((2 * k * span + twice // 2) // twice)
    along, level = np.repeat(start, n) + np.repeat(step, n) * k, np.repeat(level, n)
    row, col = np.where(level, aside, along), np.where(level, along, aside)
    inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
    return row[inside], col[inside]


def _drawn(height: int, width: int):
    """Cells of lines (c, r, c1, r1), each once for some thousand lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [np.asarray(batch.column(i)).astype(np.int64) for i in range(4)]
            # A line has as many cells in the grid as its longer side at most, so that a piece has some million.
            lines = max(1, 1_000_000 // max(height, width))
            for i in range(0, batch.num_rows, lines):
                row, col = line_cells(*[e[i : i + lines] for e in ends], height, width)
                cells = np.unique(row * width + col)
                yield pa.RecordBatch.from_arrays([pa.array((cells // width).astype(np.int32)), pa.array((cells % width).astype(np.int32))], ["row", "col"])

    return run


def rasterize_lines(vertices: DataFrame, meta: GridMeta) -> DataFrame:
    """(row, col) of the cells that lines(line, seq, x, y) pass; ends may lie outside, cells outside are left out."""
    at = vertices.select("line", "seq", meta.col(F.col("x")).alias("c"), meta.row(F.col("y")).alias("r"))
    w = Window.partitionBy("line").orderBy("seq")
    pairs = at.withColumns({"c1": F.lead("c").over(w), "r1": F.lead("r").over(w)}).where("c1 IS NOT NULL").select("c", "r", "c1", "r1").distinct()
    return pairs.dropna().mapInArrow(_drawn(meta.height, meta.width), "row int, col int").distinct()


def thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: which of the points (n x 2) stay; a point splits a stretch if it is farther than tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a], points[b] - points[a]
        inner = points[a + 1 : b]
        x, y, length = inner[:, 0] - p[0], inner[:, 1] - p[1], d[0] * d[0] + d[1] * d[1]
        t = np.clip((x * d[0] + y * d[1]) / length, 0, 1) if length > 0 else np.zeros(len(inner))
        ex, ey = x - t * d[0], y - t * d[1]
        far = np.sqrt(ex * ex + ey * ey)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def thin_lines(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, tolerance: float) -> np.ndarray:
    """As thin, for many lines one after another: line k holds the points from offsets[k] up to offsets[k + 1].

    Each round splits all open stretches of all lines at once, in the operations of thin, so that both keep the same points.
    """
    keep = np.zeros(len(x), bool)
    a, b = np.asarray(offsets[:-1], np.int64), np.asarray(offsets[1:], np.int64) - 1
    a, b = a[b >= a], b[b >= a]
    keep[a] = keep[b] = True
    a, b = a[b - a > 1], b[b - a > 1]
    while len(a):
        inner = b - a - 1
        ends = np.cumsum(inner)
        stretch = np.repeat(np.arange(len(a)), inner)
        at = np.arange(ends[-1]) + (a + 1 - ends + inner)[stretch]
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = dx * dx + dy * dy
        px, py, dx, dy, length = x[at] - x[a][stretch], y[at] - y[a][stretch], dx[stretch], dy[stretch], length[stretch]
        t = np.clip(np.divide(px * dx + py * dy, length, out=np.zeros(len(at)), where=length > 0), 0, 1)
        ex, ey = px - t * dx, py - t * dy
        far = np.sqrt(ex * ex + ey * ey)
        top = np.maximum.reduceat(far, ends - inner)
        split = top > tolerance
        hits = np.flatnonzero((far == top[stretch]) & split[stretch])
        first = np.ones(len(hits), bool)
        first[1:] = stretch[hits[1:]] != stretch[hits[:-1]]
        cut = at[hits[first]]
        keep[cut] = True
        a, b = np.concatenate([a[split], cut]), np.concatenate([cut, b[split]])
        a, b = a[b - a > 1], b[b - a > 1]
    return keep


def _line_runs(offsets: np.ndarray, most: int = THINNED) -> Iterator[tuple[int, int]]:
    """Runs of whole lines with about `most` points each."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def simplify(line: Column, tolerance: float = 0.15) -> Column:
    """Thin a line, an array of struct<x, y>; lines of fewer than three points stay as they are."""

    @arrow_udf("array<struct<x:double,y:double>>")
    def run(lines: pa.Array) -> pa.Array:
        kinds = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        lines = lines.cast(kinds) if lines.type != kinds else lines
        points, none = lines.flatten(), np.asarray(lines.is_null())
        x, y = (np.asarray(pc.struct_field(points, k).to_numpy(zero_copy_only=False), float) for k in ("x", "y"))
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lines), 0), np.int64))])
        held = [thin_lines(x[offsets[i] : offsets[j]], y[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tolerance) for i, j in _line_runs(offsets)]
        keep = np.concatenate([np.zeros(0, bool), *held])
        begins = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(begins, mask=np.append(none, False)), points.filter(pa.array(keep)), type=kinds)

    return run(line)


def _distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Of a point to the stretch from a to b, in the operations of thin, so that both give the same doubles."""
    dx, dy, px, py = b["x"] - a["x"], b["y"] - a["y"], x - a["x"], y - a["y"]
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length))).otherwise(0.0)
    ex, ey = px - t * dx, py - t * dy
    return F.sqrt(ex * ex + ey * ey)


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())))


def _thin_sorted(tolerance: float, most: int = THINNED):
    """Thin rows (line, from, seq, x, y, own) sorted by all but own, many stretches at once; rows that repeat another one are left out."""

    def thinned(rows: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        x, y, own = (np.asarray(rows.column(i)) for i in (3, 4, 5))
        held = thin_lines(x, y, np.append(begins, len(x)), tolerance) & own
        return rows.select(["line", "seq", "x", "y"]).filter(pa.array(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def taken(last: bool) -> Iterator[pa.RecordBatch]:
            """What is thinned of the waiting rows; the last stretch waits unless no more rows come."""
            nonlocal waiting, n
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            new = np.ones(len(rows), bool)
            new[1:] = np.logical_or.reduce([_differs(c.slice(1), c.slice(0, len(rows) - 1)) for c in rows.columns[:5]])
            rows = rows.filter(pa.array(new))
            begins = np.flatnonzero(np.append(True, np.logical_or.reduce([_differs(c.slice(1), c.slice(0, len(rows) - 1)) for c in rows.columns[:2]])))
            end = len(rows) if last else int(begins[-1])
            waiting, n = [] if last else [rows.slice(end)], len(rows) - end
            if end:
                yield thinned(rows.slice(0, end), begins if last else begins[:-1])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
                # A stretch longer than `most` is looked at again only when it has doubled.
                if n >= most and n >= 2 * waiting[0].num_rows:
                    yield from taken(False)
        if n:
            yield from taken(True)

    return run


def simplify_lines(points: DataFrame, tolerance: float = 0.15, in_task: int = 1_000_000) -> DataFrame:
    """(line, seq, x, y): the points(line, seq, x, y) that stay when each line is thinned; seq is an integer, unique in its line but for equal rows, which count once.

    A line of in_task points or fewer is thinned in one task. A longer one is never gathered: each round finds the farthest
    point of every open stretch by one aggregate and splits the stretch there, until stretches are closed or fit a
    task; rounds grow with the depth of such splits, which is small unless a line repeats one wave many times. Of points equally far the first splits. Both ends stay, as do lines of fewer than three points. Rows with
    a null are left out.
    """
    points = points.select("line", F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    line = points.schema["line"].dataType.simpleString()
    place = F.struct("seq", "x", "y")
    thinned = lambda rows: rows.repartition("line", "from").sortWithinPartitions("line", "from", "seq", "x", "y").mapInArrow(_thin_sorted(tolerance), f"line {line}, seq long, x double, y double")
    named = stored(points.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_task).select("line"))
    if named.isEmpty():
        return thinned(points.select("line", F.lit(None).cast("long").alias("from"), "seq", "x", "y", F.lit(True).alias("own")))
    long = stored(points.join(broadcast_below(named, LONG_ROWS), "line").groupBy("line").agg(F.min(place).alias("a"), F.max(place).alias("b")))
    few = broadcast_below(long, LONG_ROWS)
    whole = points.join(few, "line", "left_anti").select("line", F.lit(None).cast("long").alias("from"), "seq", "x", "y", F.lit(True).alias("own"))
    fit, stay = [whole], [long.select("line", F.inline(F.array("a", "b")))]
    state = points.join(few, "line").where((F.col("seq") > F.col("a.seq")) & (F.col("seq") < F.col("b.seq")))
    while True:
        state = stored(state)
        key = [F.col("line"), F.col("a.seq").alias("from")]
        far = F.max(F.struct(_distance(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("d"), (-F.col("seq")).alias("back"), "x", "y")).alias("far")
        best = stored(state.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), far, F.first("a").alias("a"), F.first("b").alias("b")))
        if best.isEmpty():
            break
        small = best.where(F.col("n") <= in_task - 2)
        own = state.join(broadcast_below(small.select("line", "from"), LONG_ROWS), (state["line"] == small["line"]) & (state["a.seq"] == small["from"]), "left_semi")
        fit += [own.select("line", F.col("a.seq").alias("from"), "seq", "x", "y", F.lit(True).alias("own")), small.select("line", "from", F.inline(F.array("a", "b")), F.lit(False).alias("own")).select("line", "from", "seq", "x", "y", "own")]
        split = stored(best.where((F.col("n") > in_task - 2) & (F.col("far.d") > tolerance)).select("line", "from", F.struct((-F.col("far.back")).alias("seq"), "far.x", "far.y").alias("at")))
        stay.append(split.select("line", "at.seq", "at.x", "at.y"))
        cuts = broadcast_below(split.withColumnsRenamed({"line": "_line", "from": "_from"}), LONG_ROWS)
        state = state.join(cuts, (F.col("line") == F.col("_line")) & (F.col("a.seq") == F.col("_from"))).where(F.col("seq") != F.col("at.seq"))
        after = F.col("seq") > F.col("at.seq")
        state = state.select("line", "seq", "x", "y", F.when(after, F.col("at")).otherwise(F.col("a")).alias("a"), F.when(after, F.col("b")).otherwise(F.col("at")).alias("b"))
    gathered, kept = fit[0], stay[0]
    for part in fit[1:]:
        gathered = gathered.unionByName(part)
    for part in stay[1:]:
        kept = kept.unionByName(part)
    return thinned(gathered).unionByName(kept)


def mask_edges(mask: DataFrame) -> DataFrame:
    """(row, col, side, r0, c0, r1, c1): edges between a mask's cells and the rest, with the mask on the left.

    With a column label, which stays, the rest are the cells of other labels too.
    """
    label = [c for c in mask.columns if c == "label"]
    sides = ((0, -1, 0, 0, 0, 1, 0), (1, 1, 0, 1, 1, 1, 0), (2, 0, -1, 0, 0, 1, 0), (3, 0, 1, 1, 1, 0, 1))
    # In grid corners with rows growing southwards: north edge westwards, south edge eastwards, west edge southwards, east edge northwards.
    corners = {0: ((0, 1), (0, 0)), 1: ((1, 0), (1, 1)), 2: ((0, 0), (1, 0)), 3: ((1, 1), (0, 1))}
    options = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), (F.col("row") + s[1]).alias("nr"), (F.col("col") + s[2]).alias("nc"), (F.col("row") + corners[k][0][0]).alias("r0"), (F.col("col") + corners[k][0][1]).alias("c0"), (F.col("row") + corners[k][1][0]).alias("r1"), (F.col("col") + corners[k][1][1]).alias("c1")) for k, s in enumerate(sides)]))
    own = mask.select("row", "col", *label, options.alias("o")).select("row", "col", *label, "o.*")
    there = mask.select(F.col("row").alias("nr"), F.col("col").alias("nc"), *label)
    return own.join(there, ["nr", "nc", *label], "left_anti").select("row", "col", *label, "side", "r0", "c0", "r1", "c1")


def polygonize(mask: DataFrame, meta: GridMeta, block: int = BLOCK) -> DataFrame:
    """(root, ring, signed_area, n_corners, points): rings on cell edges, outer ones counter-clockwise, holes clockwise.

    Cells connect eight ways; a component's rings belong to one (multi-part) polygon. A ring is named by its smallest
    edge; only its own corners are gathered, as its points.
    """
    held = stored(to_blocks(mask.select("row", "col", F.lit(1.0).alias("v")), block))
    return outline_blocks(component_blocks(held, meta, True, block), meta, block).withColumnRenamed("label", "root")


def outline(cells: DataFrame, meta: GridMeta, block: int = BLOCK) -> DataFrame:
    """(label, ring, signed_area, n_corners, points): the rings around the cells(row, col, label) of each label, such as basins by their root."""
    return outline_blocks(to_blocks(cells, block, "label", "label"), meta, block)


def to_geojson(features: DataFrame, epsg: int, digits: int = 8) -> DataFrame:
    """(feature): a JSON text for each row of (points, kind, properties struct), in longitude and latitude; UTM only."""
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"EPSG {epsg} is no WGS84 UTM zone")
    code = F.lit(epsg)
    line = F.transform(utm_points_to_lon_lat(F.col("points"), utm_zone(code), utm_is_north(code)), lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits)))
    closed = F.concat(line, F.slice(line, 1, 1))
    geometry = F.when(F.col("kind") == "Polygon", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))))
    return features.select(F.concat(F.lit('{"type":"Feature","properties":'), F.to_json("properties"), F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature"))


def contours(shapes: DataFrame, attributes: DataFrame, height: str, epsg: int, tolerance: float = 0.15) -> DataFrame:
    """(feature, elevation, n_before, n_after): contour lines from shapes(rec, part, points) and attributes(rec, ...) joined by place.

    Lines are thinned; those left with fewer than two points and heights without a number are dropped.
    """
    from terravela.functions.text import leading_number

    joined = shapes.join(attributes, "rec").withColumn("elevation", leading_number(F.col(height).cast("string"))).where("elevation IS NOT NULL")
    # Ends stay, so that thinning leaves fewer than two points only of lines that had no more; a filter behind it would thin all lines twice.
    thinned = joined.where("size(points) >= 2").withColumn("n_before", F.size("points")).withColumn("points", simplify(F.col("points"), tolerance))
    drawn = thinned.select("points", F.lit("LineString").alias("kind"), F.struct("elevation").alias("properties"), "elevation", "n_before", F.size("points").alias("n_after"))
    code = F.lit(epsg)
    placed = F.transform(utm_points_to_lon_lat(F.col("points"), utm_zone(code), utm_is_north(code)), lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6)))
    geometry = F.struct(F.lit("LineString").alias("type"), placed.alias("coordinates"))
    return drawn.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "properties", geometry.alias("geometry"))).alias("feature"), "elevation", "n_before", "n_after")
