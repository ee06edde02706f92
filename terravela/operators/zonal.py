"""Zonal operators: cells under a polygon, volumes, differences of surfaces, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravela.functions.geometry import point_in_polygon, points
from terravela.operators.grid import GridMeta, assert_aligned

Ring = list[tuple[float, float]]


def ring_window(meta: GridMeta, ring: Ring) -> tuple[int, int, int, int]:
    """First and last row and column of the cells that a ring's extent touches, within the grid."""
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    col = lambda x, up: (-int(-((x - meta.origin_x) / meta.cell_size) // 1) if up else int((x - meta.origin_x) / meta.cell_size // 1))
    row = lambda y, up: (-int(-((meta.origin_y - y) / meta.cell_size) // 1) if up else int((meta.origin_y - y) / meta.cell_size // 1))
    return max(0, row(max(ys), False)), min(meta.height - 1, row(min(ys), True)), max(0, col(min(xs), False)), min(meta.width - 1, col(max(xs), True))


def coverage(meta: GridMeta, ring: Ring, samples: int = 4) -> Column:
    """The share of a cell in a ring: 1 with all corners inside, 0 with none nor the centre, else by sub-cells.

    A thin ring that misses corners and centre counts as 0, a notch between four corners as 1.
    """
    polygon = points(ring)
    inside = lambda dx, dy: point_in_polygon(meta.x(F.col("col"), dx), meta.y(F.col("row"), dy), polygon)
    corners = sum((inside(dx, dy).cast("int") for dx in (0, 1) for dy in (0, 1)), F.lit(0))
    steps = [(i + 0.5) / samples for i in range(samples)]
    share = sum((inside(dx, dy).cast("int") for dx in steps for dy in steps), F.lit(0)) / (samples * samples)
    return F.when(corners == 4, 1.0).when((corners == 0) & ~inside(0.5, 0.5), 0.0).otherwise(share)


def covered_cells(cells: DataFrame, meta: GridMeta, ring: Ring) -> DataFrame:
    """cells in the ring's window with their share f above 0; the window's bounds reach the scan."""
    r0, r1, c0, c1 = ring_window(meta, ring)
    near = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return near.withColumn("f", coverage(meta, ring)).where("f > 0")


def polygon_stats(cells: DataFrame, meta: GridMeta, ring: Ring) -> DataFrame:
    """One row: min, max, coverage-weighted mean, covered and nodata area, and whether all of it has data.

    cells must hold a row, with a null v, for nodata inside the grid if nodata_area is to count it.
    """
    area = meta.cell_size**2
    held = F.col("v").isNotNull()
    out = covered_cells(cells, meta, ring).agg(
        F.min("v").alias("min_v"), F.max("v").alias("max_v"), (F.sum(F.when(held, F.col("v") * F.col("f"))) / F.sum(F.when(held, F.col("f")))).alias("mean_v"),
        F.coalesce(F.sum(F.when(held, F.col("f"))), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~held, F.col("f"))), F.lit(0.0)).alias("void"),
    )
    return out.select("min_v", "max_v", "mean_v", (F.col("held") * area).alias("covered_area"), (F.col("void") * area).alias("nodata_area"), (F.col("void") == 0).alias("complete"))


def plane(coefficients: tuple[float, float, float], meta: GridMeta) -> Column:
    """Height a + b x + c y of a plane at a cell's centre."""
    a, b, c = coefficients
    return a + b * meta.x(F.col("col")) + c * meta.y(F.col("row"))


def cut_fill(cells: DataFrame, meta: GridMeta, ring: Ring, reference: Column | DataFrame, rmse_z: float = 0.0) -> DataFrame:
    """One row of volumes and areas between a surface and a reference within a ring.

    reference: a Column (a constant or plane()), or another grid's cells. Cut is where the surface lies above.
    """
    area = meta.cell_size**2
    inside = covered_cells(cells, meta, ring)
    if isinstance(reference, DataFrame):
        inside = inside.join(reference.select("row", "col", F.col("v").alias("ref")), ["row", "col"], "left")
    else:
        inside = inside.withColumn("ref", reference.cast("double"))
    d, f, held = F.col("v") - F.col("ref"), F.col("f") * area, F.col("v").isNotNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    out = inside.agg(
        total(F.when(d > 0, d * f)).alias("cut"), total(F.when(d < 0, -d * f)).alias("fill"), total(F.when(d > 0, f)).alias("cut_area"), total(F.when(d < 0, f)).alias("fill_area"),
        F.coalesce(F.max(F.when(d > 0, d)), F.lit(0.0)).alias("max_cut"), F.coalesce(F.max(F.when(d < 0, -d)), F.lit(0.0)).alias("max_fill"), total(F.when(d.isNotNull(), f)).alias("measured_area"),
        total(F.when(~held, f)).alias("nodata_area"), total(F.when(held & F.col("ref").isNull(), f)).alias("reference_missing_area"),
    )
    net = F.col("cut") - F.col("fill")
    return out.withColumns({"net": net, "mean_depth": F.when(F.col("measured_area") > 0, net / F.col("measured_area")), "uncertainty": rmse_z * F.col("measured_area")})


def boundary_plane(samples: DataFrame) -> DataFrame:
    """One row (a, b, c, n): least-squares plane a + b x + c y through samples(x, y, v), flat if they lie on a line.

    Fails with fewer than three samples. Sums are taken about the samples' mean.
    """
    means = samples.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("v").alias("mv"), F.count("v").alias("n"))
    centred = samples.where("v IS NOT NULL").crossJoin(F.broadcast(means)).select("mx", "my", "mv", "n", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy"), (F.col("v") - F.col("mv")).alias("dv"))
    product = lambda p, q, name: F.sum(F.col(p) * F.col(q)).alias(name)
    s = centred.groupBy("mx", "my", "mv", "n").agg(product("dx", "dx", "xx"), product("dy", "dy", "yy"), product("dx", "dy", "xy"), product("dx", "dv", "xv"), product("dy", "dv", "yv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    flat = F.abs(det) < 1e-9
    b = F.when(flat, 0.0).otherwise((F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det)
    c = F.when(flat, 0.0).otherwise((F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det)
    fitted = s.select(b.alias("b"), c.alias("c"), "n", "mx", "my", "mv")
    enough = F.when(F.col("n") < 3, F.raise_error("a plane needs three samples").cast("double"))
    return fitted.select(F.coalesce(enough, F.col("mv") - F.col("b") * F.col("mx") - F.col("c") * F.col("my")).alias("a"), "b", "c", "n")


def surface_difference(newer: DataFrame, older: DataFrame, meta: GridMeta, other: GridMeta | None = None) -> DataFrame:
    """One row of what rose and dropped between two aligned grids, over the cells that both have."""
    assert_aligned(meta, other or meta)
    area = meta.cell_size**2
    both = newer.where("v IS NOT NULL").join(older.where("v IS NOT NULL").select("row", "col", F.col("v").alias("old")), ["row", "col"]).withColumn("d", F.col("v") - F.col("old"))
    d = F.col("d")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return both.agg(total(F.when(d > 0, d)).alias("up"), total(F.when(d < 0, -d)).alias("down"), F.min(d).alias("min_d"), F.max(d).alias("max_d"), F.avg(d).alias("mean_d"), F.count(d).alias("n_cells")).select((F.col("up") * area).alias("gained"), (F.col("down") * area).alias("lost"), "min_d", "max_d", "mean_d", "n_cells")


def maxima_gap(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """One row: the difference of two grids' maxima, and beside it the largest difference of one cell."""
    gap = upper.agg(F.max("v").alias("top")).crossJoin(lower.agg(F.max("v").alias("base"))).select((F.col("top") - F.col("base")).alias("difference_of_maxima"))
    both = upper.join(lower.select("row", "col", F.col("v").alias("low")), ["row", "col"]).agg(F.max(F.col("v") - F.col("low")).alias("maximum_difference"))
    return gap.crossJoin(both)


def resample(cells: DataFrame, meta: GridMeta, target: float) -> tuple[DataFrame, GridMeta]:
    """Area-weighted means on cells of a larger size; a finer target is refused, an equal one returns the grid.

    Each source cell goes to the few target cells that it overlaps, weighted by the overlap; nodata has no weight.
    """
    if target < meta.cell_size * (1 - 1e-12):
        raise ValueError("resampling to a finer grid would invent data")
    if abs(target - meta.cell_size) <= 1e-12:
        return cells, meta
    k = meta.cell_size / target
    width, height = max(1, int(meta.width * k + 0.5)), max(1, int(meta.height * k + 0.5))

    def parts(i: Column, n: int) -> Column:
        a, b = i * k, (i + 1) * k
        span = F.sequence(F.floor(a), F.greatest(F.floor(a), F.ceil(b - 1e-12) - 1))
        return F.filter(F.transform(span, lambda j: F.struct(j.cast("int").alias("at"), (F.least(j + 1, b) - F.greatest(j, a)).alias("w"))), lambda p: (p["w"] > 1e-12) & (p["at"] < n))

    spread = cells.where("v IS NOT NULL").select("v", F.explode(parts(F.col("row"), height)).alias("r"), F.col("col")).select("v", "r", F.explode(parts(F.col("col"), width)).alias("c"))
    w = F.col("r.w") * F.col("c.w")
    out = spread.groupBy(F.col("r.at").alias("row"), F.col("c.at").alias("col")).agg((F.sum(F.col("v") * w) / F.sum(w)).alias("v"))
    return out, GridMeta(width, height, target, meta.origin_x, meta.origin_y, meta.nodata, meta.epsg)


def block_means(cells: DataFrame, meta: GridMeta, target_width: int) -> tuple[DataFrame, int, int]:
    """Means over blocks of whole cells, target_width blocks across; nodata left out. Returns the cells, width and height."""
    target_height = max(1, int(meta.height / meta.width * target_width + 0.5))

    def blocks(i: Column, n: int, targets: int) -> Column:
        size = n / targets
        low = F.greatest(F.lit(0), F.floor((i - 1) / size).cast("int") - 1)
        near = F.sequence(low, F.least(F.lit(targets - 1), F.floor((i + 1) / size).cast("int") + 1))
        return F.filter(near, lambda t: (F.floor(t * size) <= i) & (i < F.least(F.lit(n), F.greatest(F.floor(t * size) + 1, F.floor((t + 1) * size)))))

    spread = cells.where("v IS NOT NULL").select("v", "col", F.explode(blocks(F.col("row"), meta.height, target_height)).alias("trow")).select("v", "trow", F.explode(blocks(F.col("col"), meta.width, target_width)).alias("tcol"))
    return spread.groupBy(F.col("trow").alias("row"), F.col("tcol").alias("col")).agg(F.avg("v").alias("v")), target_width, target_height
