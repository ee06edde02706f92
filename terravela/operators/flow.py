"""Flow networks: a forest of cells (node, root), root the cell that it drains to, itself at an outlet.

Trees are followed by pointer doubling, so that the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.operators.blocks import BLOCK, catchment_blocks, component_blocks, drain_blocks, fill_blocks, from_blocks, to_blocks
from terravela.operators.focal import DIRECTIONS, downstream
from terravela.operators.grid import GridMeta
from terravela.plans.graph import jump_to_roots
from terravela.plans.lineage import cut, stored

#: Segments of streams that one task solves, some 50 MB; larger trees are contracted.
AT_ONCE = 200_000


def accumulate(forest: DataFrame) -> DataFrame:
    """(node, acc): cells that drain through each cell, itself included; fails on a cycle.

    Round k adds to a cell the sums of the cells whose 2**k-th cell downstream it is.
    """
    state = cut(forest.select("node", F.when(F.col("root") != F.col("node"), F.col("root")).alias("up"), F.lit(1).cast("long").alias("acc")))
    rounds = max(1, state.count()).bit_length() + 1
    while state.where("up IS NOT NULL").limit(1).count():
        if not rounds:
            raise ValueError("the flow directions hold a cycle")
        rounds -= 1
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("acc").alias("more"))
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        state = cut(state.join(given, "node", "left").join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    return state.select("node", "acc")


def basins(forest: DataFrame) -> DataFrame:
    """(node, root): the outlet that each cell drains to."""
    return jump_to_roots(forest)


def watershed(forest: DataFrame, outlet: int) -> DataFrame:
    """(node): the cells that drain to a cell, itself included."""
    cut_off = forest.select("node", F.when(F.col("node") == outlet, F.col("node")).otherwise(F.col("root")).alias("root"))
    return jump_to_roots(cut_off).where(F.col("root") == outlet).select("node")


def snap_to_channel(accumulation: DataFrame, row: int, col: int, radius: int = 5) -> DataFrame:
    """One row (row, col, acc): the largest accumulation within a square, the first in row-major order of equals."""
    near = accumulation.where(F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius) & F.col("acc").isNotNull())
    best = near.agg(F.max(F.struct("acc", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("best")).where("best IS NOT NULL")
    return best.select((-F.col("best.r")).alias("row"), (-F.col("best.c")).alias("col"), F.col("best.acc").alias("acc"))


def lowest_cell(cells: DataFrame) -> DataFrame:
    """One row (row, col, v): the lowest cell, the first in row-major order of equals."""
    return cells.where("v IS NOT NULL").agg(F.min(F.struct("v", "row", "col")).alias("low")).where("low IS NOT NULL").select("low.row", "low.col", "low.v")


def stream_links(forest: DataFrame, accumulation: DataFrame, threshold: int) -> DataFrame:
    """(node, to, n_in): cells with accumulation of threshold or more, the stream cell below (null at an end), and how many flow in."""
    streams = accumulation.where(F.col("acc") >= threshold).select("node")
    links = forest.join(streams, "node").select("node", F.when(F.col("root") != F.col("node"), F.col("root")).alias("to"))
    n_in = links.where("to IS NOT NULL").groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    inside = streams.withColumnRenamed("node", "to").withColumn("there", F.lit(True))
    out = links.join(inside, "to", "left").join(n_in, "node", "left")
    return cut(out.select("node", F.when(F.col("there"), F.col("to")).alias("to"), F.coalesce("n_in", F.lit(0)).alias("n_in")))


def stream_segments(links: DataFrame) -> DataFrame:
    """(node, head, place): each stream cell with the head of its segment, and its place in it.

    A segment begins at a cell with no or several cells flowing in and runs to the next such cell.
    """
    starts = F.col("n_in") != 1
    single = links.where("to IS NOT NULL").select(F.col("to").alias("node"), F.col("node").alias("above"))
    back = links.join(single, "node", "left").select("node", F.when(starts, F.col("node")).otherwise(F.col("above")).alias("head"), F.when(starts, 0).otherwise(1).cast("long").alias("place"))
    back = cut(back.groupBy("node").agg(F.max("head").alias("head"), F.max("place").alias("place")))
    while True:
        up = back.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"))
        moved = cut(back.join(up, "head").select("node", F.col("next").alias("head"), (F.col("place") + F.col("more")).alias("place"), (F.col("next") != F.col("head")).alias("moved")))
        back = moved.select("node", "head", "place")
        if not moved.where("moved").limit(1).count():
            return back


def _orders_at_once(tree: DataFrame) -> DataFrame:
    """tree(node, next, pend) -> (node, ord), solved from the heads down in one task."""

    def solve(table: pa.Table) -> pa.Table:
        node, below, pend = (table.column(n).to_pylist() for n in ("node", "next", "pend"))
        at, to = {k: i for i, k in enumerate(node)}, below
        top, n_top, ord_ = [0] * len(node), [0] * len(node), [0] * len(node)
        ready, done = [i for i, n in enumerate(pend) if n == 0], 0
        while ready:
            i = ready.pop()
            done += 1
            ord_[i] = 1 if not top[i] else top[i] + (n_top[i] > 1)
            j = at[to[i]] if to[i] is not None else -1
            if j >= 0:
                top[j], n_top[j] = (ord_[i], 1) if ord_[i] > top[j] else (top[j], n_top[j] + (ord_[i] == top[j]))
                pend[j] -= 1
                if not pend[j]:
                    ready.append(j)
        if done < len(node):
            raise ValueError("the streams hold a cycle")
        return pa.table({"node": pa.array(node, pa.int64()), "ord": pa.array(ord_, pa.int32())})

    return tree.select("node", "next", "pend").groupBy(F.lit("all")).applyInArrow(solve, "node long, ord int")


def strahler(links: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(node, ord): 1 at a head; one more where several streams of the highest order meet, else the highest.

    An order is constant along a segment, so that only the tree of segments is solved, by contraction: segments whose
    inputs are all known get their order, and one with a single unknown input is a function of it, an array by
    order, which is composed with that of the input if it has a single unknown one too. Rounds grow with
    the logarithm of the tree, however long its main stem is. A tree of AT_ONCE segments at most is solved in one task.
    """
    segments = stream_segments(links) if segments is None else segments
    ends = segments.join(links, "node").select("head", "node", "to", "place")
    tree = ends.groupBy("head").agg(F.max(F.struct("place", "to")).alias("end")).select(F.col("head").alias("node"), F.col("end.to").alias("next"))
    inputs = tree.where("next IS NOT NULL").groupBy(F.col("next").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("pend"))
    tree = cut(tree.join(inputs, "node", "left").withColumn("pend", F.coalesce("pend", F.lit(0))))
    if tree.limit(AT_ONCE + 1).count() <= AT_ONCE:
        return segments.join(stored(_orders_at_once(tree)).withColumnRenamed("node", "head"), "head").select("node", "ord")
    most = tree.where("pend = 0").count().bit_length() + 1  # an order more needs twice the heads
    one = F.when(F.col("pend") == 0, 1)
    state = stored(tree.select("node", "next", "pend", F.lit(0).alias("top"), F.lit(0).alias("n_top"), F.lit(None).cast(tree.schema["node"].dataType).alias("child"), F.lit(None).cast("array<int>").alias("f"), one.cast("int").alias("ord"), one.isNotNull().alias("fresh")))
    while state.where("ord IS NULL").limit(1).count():
        if not state.where("fresh").limit(1).count():
            raise ValueError("the streams hold a cycle")
        given = state.where("fresh AND next IS NOT NULL").groupBy(F.col("next").alias("node"), "ord").agg(F.count(F.lit(1)).cast("int").alias("n"))
        given = given.groupBy("node").agg(F.sum("n").cast("int").alias("n"), F.max(F.struct("ord", "n")).alias("g"))
        known = state.where("fresh").select(F.col("node").alias("child"), F.col("ord").alias("child_ord"))
        open_ = F.col("ord").isNull() & F.col("n").isNotNull()
        n_top = F.when(F.col("g.ord") > F.col("top"), F.col("g.n")).when(F.col("g.ord") == F.col("top"), F.col("g.n") + F.col("n_top")).otherwise(F.col("n_top"))
        heard = state.join(given, "node", "left").join(known, "child", "left")
        heard = heard.select("node", "next", "child", "f", "ord", "child_ord", F.when(open_, F.col("pend") - F.col("n")).otherwise(F.col("pend")).alias("pend"), F.when(open_, F.greatest("top", "g.ord")).otherwise(F.col("top")).alias("top"), F.when(open_, n_top).otherwise(F.col("n_top")).alias("n_top"))
        found = F.when(F.col("ord").isNotNull(), F.col("ord")).when(F.col("pend") == 0, F.col("top") + (F.col("n_top") > 1).cast("int")).when(F.col("child_ord").isNotNull(), F.element_at("f", F.col("child_ord")))
        heard = stored(heard.select("node", "next", "pend", "top", "n_top", "child", "f", found.alias("ord"), (F.col("ord").isNull() & found.isNotNull()).alias("fresh")))
        unknown = heard.where("ord IS NULL")
        lone = unknown.where("next IS NOT NULL").groupBy(F.col("next").alias("node")).agg(F.min("node").alias("lone"))
        of = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda x: F.when(x > F.col("top"), x).when(x == F.col("top"), x + 1).otherwise(F.col("top") + (F.col("n_top") > 1).cast("int")).cast("int"))
        new = (F.col("pend") == 1) & F.col("child").isNull() & F.col("ord").isNull()
        chained = stored(heard.join(lone, "node", "left").withColumns({"child": F.when(new, F.col("lone")).otherwise(F.col("child")), "f": F.when(new, of).otherwise(F.col("f"))}).drop("lone"))
        hop = chained.where("ord IS NULL AND f IS NOT NULL").select(F.col("node").alias("child"), F.col("child").alias("beyond"), F.col("f").alias("inner"))
        composed = F.transform("inner", lambda y: F.element_at("f", F.least(y, F.lit(most))))
        both = F.col("ord").isNull() & F.col("beyond").isNotNull()
        state = stored(chained.join(hop, "child", "left").select("node", "next", "pend", "top", "n_top", F.when(both, F.col("beyond")).otherwise(F.col("child")).alias("child"), F.when(both, composed).otherwise(F.col("f")).alias("f"), "ord", "fresh"))
    return segments.join(state.select(F.col("node").alias("head"), "ord"), "head").select("node", "ord")


def channel_totals(lines: DataFrame) -> DataFrame:
    """One row (n_segments, length) of stream_lines' lines."""
    return lines.agg(F.count(F.lit(1)).alias("n_segments"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))


def stream_lines(links: DataFrame, meta: GridMeta, orders: DataFrame | None = None) -> DataFrame:
    """(head, ord, length, n_points, points): a line for each segment, with its first cell's order, from strahler's orders if given.

    A line ends in the cell that the next segment begins with. A head without a cell below has no line.
    """
    segments = cut(stream_segments(links))
    own = segments.join(links, "node").select("head", "place", "node", "to")
    closing = own.groupBy("head").agg(F.max(F.struct("place", "to")).alias("e")).where("e.to IS NOT NULL").select("head", (F.col("e.place") + 1).alias("place"), F.col("e.to").alias("node"))
    at = own.select("head", "place", "node").unionByName(closing)
    at = at.withColumns({"x": meta.x(F.col("node") % meta.width), "y": meta.y(F.expr(f"node div {meta.width}"))})
    lines = at.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("points")).where("size(points) > 1")
    n = F.size("points")
    length = F.aggregate(F.sequence(F.lit(2), n), F.lit(0.0), lambda acc, i: acc + F.hypot(F.element_at("points", i)["x"] - F.element_at("points", i - 1)["x"], F.element_at("points", i)["y"] - F.element_at("points", i - 1)["y"]))
    orders = strahler(links, segments) if orders is None else orders
    return lines.join(orders.select(F.col("node").alias("head"), "ord"), "head").select("head", "ord", length.alias("length"), n.alias("n_points"), "points")


def fill_levels(cells: DataFrame, epsilon: float, block: int = BLOCK) -> DataFrame:
    """(row, col, v, w): the lowest level w >= v at which each cell drains over ways that rise by epsilon a step.

    Water leaves at the grid's edge and beside nodata. Blocks of block x block cells are solved as arrays.
    """
    return from_blocks(fill_blocks(stored(to_blocks(cells, block)), (epsilon,), block), {"v": "z", "w": "filled"}, block)


def fill_depressions(cells: DataFrame, epsilon: float = 1e-5, block: int = BLOCK) -> DataFrame:
    """(row, col, v, filled, depth): levels with a rise of epsilon a step, and the depth of sinks, null outside them.

    Depth is against the level without a rise. Levels are doubles throughout, so that plateaus on high ground keep draining.
    """
    return _with_depth(fill_blocks(stored(to_blocks(cells, block)), (epsilon, 0.0), block), block)


def _with_depth(filled: DataFrame, block: int) -> DataFrame:
    both = from_blocks(filled, {"v": "z", "filled": "filled", "flat": "flat"}, block)
    return both.select("row", "col", "v", "filled", F.when(F.col("flat") > F.col("v"), F.col("flat") - F.col("v")).alias("depth"))


def cell_components(cells: DataFrame, meta: GridMeta, eight: bool = True, block: int = BLOCK) -> DataFrame:
    """(node, root): connected cells of (row, col), eight ways or four; a cell on its own is its own root."""
    held = stored(to_blocks(cells.select("row", "col", F.lit(1.0).alias("v")), block))
    found = from_blocks(component_blocks(held, meta, eight, block), {"root": "label"}, block, present="label")
    return found.select(meta.cell_id().alias("node"), "root")


def connected_flood(cells: DataFrame, meta: GridMeta, level: float, seeds: list[tuple[int, int]]) -> DataFrame:
    """(row, col, depth): cells at or below level that water from seeds (row, col) reaches, eight ways.

    Seeds above the level or without data are left out.
    """
    wet = cut(cells.where(F.col("v") <= level).select("row", "col", "v"))
    parts = cut(cell_components(wet, meta))
    ids = [r * meta.width + c for r, c in seeds if 0 <= r < meta.height and 0 <= c < meta.width]
    reached = parts.where(F.col("node").isin(ids)).select("root").distinct()
    inside = parts.join(F.broadcast(reached), "root", "left_semi")  # as many rows as seeds at most
    return wet.withColumn("node", meta.cell_id()).join(inside.select("node"), "node").select("row", "col", (F.lit(level) - F.col("v")).alias("depth"))


def flood_summary(flood: DataFrame, meta: GridMeta) -> DataFrame:
    area = meta.cell_size**2
    return flood.agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * area).alias("area"), (F.coalesce(F.sum("depth"), F.lit(0.0)) * area).alias("volume"), F.max("depth").alias("max_depth"))


def border_mask(pixels: DataFrame, meta: GridMeta, colour: tuple[int, int, int], tolerance: int = 10) -> DataFrame:
    """(row, col): pixels(row, col, r, g, b) near a colour that connect to the border four ways."""
    near = F.lit(True)
    for name, value in zip("rgb", colour):
        near = near & (F.abs(F.col(name) - value) <= tolerance)
    like = cut(pixels.where(near).select("row", "col"))
    parts = cut(cell_components(like, meta, eight=False))
    placed = parts.select("node", "root", F.expr(f"cast(node div {meta.width} as int)").alias("row"), (F.col("node") % meta.width).cast("int").alias("col"))
    edge = placed.where((F.col("row") == 0) | (F.col("row") == meta.height - 1) | (F.col("col") == 0) | (F.col("col") == meta.width - 1))
    return placed.join(edge.select("root").distinct(), "root", "left_semi").select("row", "col")


def detect_background(pixels: DataFrame, meta: GridMeta, tolerance: int = 6) -> tuple[int, int, int] | None:
    """The colour that three corners or more share within tolerance, white (250 up) or black (5 down), if pixel (8, 8) is within 18."""
    ends = {(0, 0), (0, meta.width - 1), (meta.height - 1, 0), (meta.height - 1, meta.width - 1)}
    held = {(p["row"], p["col"]): (p["r"], p["g"], p["b"]) for p in pixels.where(F.concat_ws(",", "row", "col").isin([f"{r},{c}" for r, c in ends | {(8, 8)}])).collect()}
    close = lambda a, b, t: all(abs(x - y) <= t for x, y in zip(a, b))
    corners = [held[k] for k in sorted(ends) if k in held]
    for colour in corners:
        plain = all(v >= 250 for v in colour) or all(v <= 5 for v in colour)
        if sum(close(colour, other, tolerance) for other in corners) >= 3 and plain and (8, 8) in held and close(held[8, 8], colour, 18):
            return colour
    return None


def run_hydrology(cells: DataFrame, meta: GridMeta, threshold: int = 500, epsilon: float = 1e-5, block: int = BLOCK) -> dict[str, DataFrame]:
    """All products of a terrain: levels and sinks, directions, accumulation, streams with orders, slope, basins.

    Directions and slope are taken from the filled terrain, nodata from the given one. The layers are kept as blocks, from
    which the products by cell are read; streams are cells with an accumulation of threshold or more.
    """
    blocks = drain_blocks(stored(to_blocks(cells, block)), meta, epsilon, block)
    flow = downstream(from_blocks(blocks, {"dir": "dir", "acc": "acc"}, block, least=("acc", threshold)), meta)
    streams = from_blocks(blocks, {"acc": "acc"}, block, least=("acc", threshold)).select(meta.cell_id().alias("node"), "acc")
    links = stream_links(flow, streams, threshold)
    return {
        "blocks": blocks, "filled": _with_depth(blocks, block), "directions": from_blocks(blocks, {"dir": "dir"}, block).withColumn("dir", F.col("dir").cast("int")), "accumulation": from_blocks(blocks, {"acc": "acc"}, block).select(meta.cell_id().alias("node"), "acc"),
        "links": links, "orders": strahler(links), "slope": from_blocks(blocks, {"slope": "slope"}, block), "basins": from_blocks(blocks, {"root": "root"}, block).select(meta.cell_id().alias("node"), "root"),
        "forest": downstream(from_blocks(blocks, {"dir": "dir"}, block), meta),
    }


def walk_upstream(forest: DataFrame, accumulation: DataFrame, start: int, steps: int) -> DataFrame:
    """(step, node): from a cell, again and again the cell flowing in with the largest accumulation, the smallest id of equals.

    Each cell's main inflow is chosen once; each round doubles the steps that are known.
    """
    inflow = forest.where("node <> root").join(accumulation, "node").groupBy("root").agg(F.max(F.struct("acc", (-F.col("node")).alias("back"))).alias("m"))
    jump = cut(inflow.select(F.col("root").alias("node"), (-F.col("m.back")).alias("up")))
    path, known = forest.sparkSession.createDataFrame([(0, start)], "step int, node long"), 1
    while known <= steps:
        further = F.broadcast(path).join(jump, "node").select((F.col("step") + known).alias("step"), F.col("up").alias("node"))  # steps + 1 rows at most
        path = cut(path.unionByName(further).where(F.col("step") <= steps))
        known *= 2
        if known <= steps:
            beyond = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jump = cut(jump.join(beyond, "up").select("node", F.col("next").alias("up")))
    return path


def outlets(basin_sizes: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """basin_sizes(root, n) with the outlet's row, col and place, the basin's area, and whether water leaves the survey there."""
    placed = basin_sizes.withColumns({"row": F.expr(f"cast(root div {meta.width} as int)"), "col": (F.col("root") % meta.width).cast("int")})
    beside = placed.select("root", F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for _, dr, dc in DIRECTIONS])).alias("at")).select("root", "at.row", "at.col")
    closed = beside.join(cells.where("v IS NOT NULL").select("row", "col"), ["row", "col"], "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("n_beside"))
    known = placed.join(closed, "root", "left")
    return known.select("root", "n", (F.col("n") * meta.cell_size**2).alias("area"), meta.x(F.col("col")).alias("easting"), meta.y(F.col("row")).alias("northing"), (F.coalesce("n_beside", F.lit(0)) < len(DIRECTIONS)).alias("truncated"))


def flood_product(cells: DataFrame, meta: GridMeta, level: float, seed: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The depths of connected_flood and their summary; without a seed water stands from the lowest cell."""
    if seed is None:
        low = lowest_cell(cells).first()
        seed = (low["row"], low["col"]) if low else None
    flood = cut(connected_flood(cells, meta, level, [seed] if seed else []))
    return flood, flood_summary(flood, meta)


def catchment(blocks: DataFrame, meta: GridMeta, outlet: int, block: int = BLOCK) -> DataFrame:
    """(label, ring, signed_area, n_corners, points): the outline of the cells of drained blocks whose water passes a cell, label being that cell."""
    from terravela.operators.rings import outline_blocks

    return outline_blocks(catchment_blocks(blocks, meta, outlet, block), meta, block)


def write_products(products: dict[str, DataFrame], cells: DataFrame, meta: GridMeta, folder: str, threshold: int = 500, pour_point: tuple[int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """Write run_hydrology's products below folder; (key, file, n, bytes, sha256) of what was written, which is also stored as manifest.

    Rasters as GeoTIFF, streams and basins as folders of GeoJSON lines in longitude and latitude: streams with their order and
    length; a ring for each outline of the basins of threshold cells or more, with area, outlet and whether they run out of the survey. With a
    pour point (row, col), its catchment too, from the channel within five cells of it. A folder's digest is that of its files' digests in order of name.
    """
    from terravela.operators.rings import outline_blocks
    from terravela.operators.vector import to_geojson
    from terravela.sources.geotiff import write_geotiff

    spark, blocks = cells.sparkSession, products["blocks"]
    place = {"row": F.expr(f"cast(node div {meta.width} as int)"), "col": (F.col("node") % meta.width).cast("int")}
    layer = lambda name: from_blocks(blocks, {"v": name}, block).select("row", "col", F.col("v").cast("double").alias("v"))
    orders = stored(products["orders"].withColumns(place).select("row", "col", F.col("ord").cast("double").alias("v")))
    rasters = {"filled": layer("filled"), "sinks": products["filled"].select("row", "col", F.col("depth").alias("v")), "directions": layer("dir"), "accumulation": layer("acc"), "orders": orders, "slope": layer("slope")}
    for name, raster in rasters.items():
        write_geotiff(raster, meta, f"{folder}/{name}.tif")
    whole = products["filled"].agg(F.count(F.lit(1)).alias("n"), F.count("depth").alias("sunk")).first()
    counts = {name: whole["n"] for name in rasters} | {"sinks": whole["sunk"], "orders": orders.count()}
    lines = stream_lines(products["links"], meta, products["orders"]).select(F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"), F.lit("LineString").alias("kind"), F.struct("ord", F.round("length", 3).alias("length_m")).alias("properties"))
    sizes = stored(products["basins"].groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold))
    facts = stored(outlets(sizes, cells, meta))
    rings = outline_blocks(blocks.select("br", "bc", F.col("root").alias("label")), meta, block).join(facts.withColumnRenamed("root", "label"), "label")
    about = F.struct(F.col("label").alias("basin"), "signed_area", F.col("area").alias("area_m2"), F.round(F.col("area") / 10000, 3).alias("area_ha"), F.round("easting", 3).alias("outlet_easting"), F.round("northing", 3).alias("outlet_northing"), F.col("truncated").alias("truncated_by_survey_edge"))
    shapes = {"streams": lines, "basins": rings.select("points", F.lit("Polygon").alias("kind"), about.alias("properties"))}
    if pour_point is not None:
        accumulation = from_blocks(blocks, {"acc": "acc"}, block)
        snapped = snap_to_channel(accumulation, *pour_point).first()
        if snapped:
            found = catchment(blocks, meta, snapped["row"] * meta.width + snapped["col"], block)
            about = F.struct(F.col("label").alias("outlet"), "signed_area", F.lit(snapped["acc"]).alias("n_cells"), F.lit(snapped["acc"] * meta.cell_size**2).alias("area_m2"))
            shapes["catchment"] = found.select("points", F.lit("Polygon").alias("kind"), about.alias("properties"))
    for name, features in shapes.items():
        held = stored(to_geojson(features, meta.epsg))
        held.write.text(f"{folder}/{name}.geojsonl")
        counts[name] = held.count()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.sha2("content", 256).alias("sha"))
    key = F.regexp_extract("path", r"/([a-z]+)[.](tif|geojsonl)(/|$)", 1)
    digests = files.select(key.alias("key"), "path", "length", "sha").where("key <> ''").groupBy("key").agg(F.sum("length").alias("bytes"), F.array_sort(F.collect_list(F.struct("path", "sha"))).alias("s"))
    sha = F.when(F.col("kind") == "tif", F.col("s")[0]["sha"]).otherwise(F.sha2(F.array_join(F.transform("s", lambda x: x["sha"]), ",").cast("binary"), 256))
    made = spark.createDataFrame([(name, f"{name}.{'tif' if name in rasters else 'geojsonl'}", n, "tif" if name in rasters else "geojsonl") for name, n in counts.items()], "key string, file string, n long, kind string")
    manifest = stored(made.join(digests, "key").select("key", "file", "n", "bytes", sha.alias("sha256")))
    manifest.write.json(f"{folder}/manifest")
    return manifest
