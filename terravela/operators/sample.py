"""Heights at points: spot levels, profiles, levelling grids, and what follows from ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravela.functions.geometry import point_in_polygon, points
from terravela.operators.grid import GridMeta
from terravela.plans.lineage import cut


def spot_levels(places: DataFrame, cells: DataFrame, meta: GridMeta) -> DataFrame:
    """places(id, x, y, ...) with elevation, bilinear between four cell centres; null if one of them is missing.

    Each place asks for its four cells; the answer is one join on (row, col) and one aggregate by id, which must be unique.
    """
    fx, fy = (F.col("x") - meta.origin_x) / meta.cell_size - 0.5, (meta.origin_y - F.col("y")) / meta.cell_size - 0.5
    c0, r0 = F.floor(fx), F.floor(fy)
    tx, ty = fx - c0, fy - r0
    corner = lambda dr, dc, w: F.struct((r0 + dr).cast("int").alias("row"), (c0 + dc).cast("int").alias("col"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - tx) * (1 - ty)), corner(0, 1, tx * (1 - ty)), corner(1, 0, (1 - tx) * ty), corner(1, 1, tx * ty))
    asked = places.select("id", F.explode(corners).alias("q")).select("id", "q.row", "q.col", "q.w")
    found = asked.join(cells.where("v IS NOT NULL").select("row", "col", "v"), ["row", "col"]).groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias("z"), F.count("v").alias("n"))
    return places.join(found, "id", "left").select(*places.columns, F.when(F.col("n") == 4, F.col("z")).alias("elevation"))


def profile_points(spark: SparkSession, line: list[tuple[float, float]], spacing: float) -> DataFrame:
    """(id, seq, chainage, x, y): each segment in round(length / spacing) equal steps, one at least; shared vertices once."""
    rows, done, seq = [], 0.0, 0
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(line, line[1:])):
        length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        steps = max(1, int(length / spacing + 0.5))
        rows.append((i, x0, y0, x1, y1, steps, done, length, seq))
        done, seq = done + length, seq + steps
    segments = spark.createDataFrame(rows, "i int, x0 double, y0 double, x1 double, y1 double, steps int, done double, length double, first int")
    t = F.col("k") / F.col("steps")
    out = segments.withColumn("k", F.explode(F.sequence(F.when(F.col("i") == 0, 0).otherwise(1), F.col("steps"))))
    return out.select((F.col("first") + F.col("k")).cast("long").alias("id"), (F.col("first") + F.col("k")).alias("seq"), (F.col("done") + t * F.col("length")).alias("chainage"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def with_slopes(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A profile with slope_percent from the sample before: null at the first, beside a hole, or without a run."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("seq")
    rise, run = F.col("elevation") - F.lag("elevation").over(w), F.col("chainage") - F.lag("chainage").over(w)
    return profile.withColumns({"rise": rise, "slope_percent": F.when(run > 0, rise / run * 100)})


def profile_summary(profile: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Length, extremes, gain and loss between neighbouring samples with data, grade, steepest slope, and holes.

    grade is from the first to the last sample with data, over the whole length.
    """
    ends = lambda f: f(F.when(F.col("elevation").isNotNull(), F.struct("seq", "elevation")))
    s = with_slopes(profile, by).groupBy(*(by or [])).agg(
        F.max("chainage").alias("length"), F.min("elevation").alias("min_elevation"), F.max("elevation").alias("max_elevation"), F.coalesce(F.sum(F.when(F.col("rise") > 0, F.col("rise"))), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.when(F.col("rise") < 0, -F.col("rise"))), F.lit(0.0)).alias("loss"), F.max(F.abs("slope_percent")).alias("max_slope"), F.sum(F.col("elevation").isNull().cast("long")).alias("n_without_data"), ends(F.min).alias("first"), ends(F.max).alias("last"),
    )
    return s.withColumn("grade_percent", F.when(F.col("length") > 0, (F.col("last.elevation") - F.col("first.elevation")) / F.col("length") * 100)).drop("first", "last")


def measured_summary(profile: DataFrame) -> DataFrame:
    """As shown beside a measured line: holes are left out first, so that gain and loss bridge them; grade is the range over the length."""
    held = profile.where("elevation IS NOT NULL")
    s = profile_summary(held).select("min_elevation", "max_elevation", "gain", "loss")
    length = profile.agg(F.max("chainage").alias("length"))
    return s.crossJoin(length).withColumn("grade_percent", F.when(F.col("length") > 0, (F.col("max_elevation") - F.col("min_elevation")) / F.col("length") * 100))


def grid_levels(spark: SparkSession, cells: DataFrame, meta: GridMeta, ring: list[tuple[float, float]], spacing: float, max_points: int = 250_000) -> DataFrame:
    """(id, x, y, elevation) at whole multiples of spacing inside a ring; nodes without data have a null.

    Refuses more than max_points nodes in the ring's extent, naming a spacing that would do.
    """
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    first = lambda v: -int(-v / spacing // 1)
    x0, x1, y0, y1 = first(min(xs)), int(max(xs) / spacing // 1), first(min(ys)), int(max(ys) / spacing // 1)
    nx, ny = max(0, x1 - x0 + 1), max(0, y1 - y0 + 1)
    if nx * ny > max_points:
        raise ValueError(f"{nx * ny} points at {spacing} m; about {spacing * (nx * ny / max_points) ** 0.5:.2f} m would keep to {max_points}")
    nodes = spark.range(nx * ny).select("id", ((F.col("id") % max(nx, 1) + x0) * spacing).alias("x"), ((F.expr(f"id div {max(nx, 1)}") + y0) * spacing).alias("y"))
    return spot_levels(nodes.where(point_in_polygon(F.col("x"), F.col("y"), points(ring))), cells, meta)


def densify(spark: SparkSession, line: list[tuple[float, float]], spacing: float, least: int = 2, most: int = 512) -> DataFrame:
    """(seq, distance, x, y): a line at even distances, between least and most points with both ends."""
    ends = [0.0]
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        ends.append(ends[-1] + ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5)
    n = min(most, max(least, int(ends[-1] / spacing // 1) + 1))
    segments = spark.createDataFrame([(a, b, *p, *q, i == len(ends) - 2) for i, (a, b, p, q) in enumerate(zip(ends, ends[1:], line, line[1:]))], "a double, b double, x0 double, y0 double, x1 double, y1 double, last boolean")
    steps = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") / (n - 1) * ends[-1]).alias("distance"))
    placed = steps.join(F.broadcast(segments), (F.col("distance") >= F.col("a")) & ((F.col("distance") < F.col("b")) | F.col("last")))
    t = F.when(F.col("b") > F.col("a"), (F.col("distance") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(0.0)
    return placed.select("seq", "distance", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def densify_lines(vertices: DataFrame, spacing: float, least: int = 2, most: int = 512) -> DataFrame:
    """(line, seq, distance, x, y): each of lines(line, seq, x, y) at even distances, as densify does for one line; lines of one place or none are left out.

    A stretch draws its own points, so that no line is gathered; a point where two stretches meet belongs to the later one.
    """
    w = Window.partitionBy("line").orderBy("seq")
    stretches = vertices.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 IS NOT NULL").withColumn("len", F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))).where("len > 0")
    whole = Window.partitionBy("line")
    placed = stretches.withColumns({"b": F.sum("len").over(w), "total": F.sum("len").over(whole), "last": F.max("seq").over(whole) == F.col("seq")}).withColumn("a", F.col("b") - F.col("len"))
    n = F.least(F.lit(most), F.greatest(F.lit(least), (F.floor(F.col("total") / spacing) + 1).cast("int"))).cast("long")
    step = placed.withColumn("n", n).withColumn("gap", F.col("total") / (F.col("n") - 1))
    # One more on either side, as rounding may move a point past a vertex; the filter decides.
    first, last = F.greatest(F.floor(F.col("a") / F.col("gap")) - 1, F.lit(0)), F.least(F.ceil(F.col("b") / F.col("gap")) + 1, F.col("n") - 1)
    drawn = step.select("*", F.explode(F.sequence(first, last)).alias("k")).withColumn("distance", F.col("k") / (F.col("n") - 1) * F.col("total"))
    kept = drawn.where((F.col("distance") >= F.col("a")) & ((F.col("distance") < F.col("b")) | (F.col("last") & (F.col("k") == F.col("n") - 1))))
    t = (F.col("distance") - F.col("a")) / F.col("len")
    return kept.select("line", F.col("k").alias("seq"), "distance", (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))


def gaps(values: DataFrame, column: str, digits: int) -> DataFrame:
    """(v, gap): rounded differences of consecutive distinct values.

    Values are dealt out by ranges; only the last value of each range crosses to the next, so that no task sees all.
    """
    distinct = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).distinct()
    dealt = cut(distinct.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    last = dealt.groupBy("part").agg(F.max("v").alias("last"))  # a row for each partition
    entry = last.withColumn("entry", F.lag("last").over(Window.orderBy("part"))).drop("last")
    before = F.coalesce(F.lag("v").over(Window.partitionBy("part").orderBy("v")), F.col("entry"))
    return dealt.join(F.broadcast(entry), "part").withColumn("gap", F.round(F.col("v") - before, digits)).where("gap IS NOT NULL").select("v", "gap")


def modal_gap(values: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """One row (gap, n): the most frequent gap, the smallest of equals; no row with fewer than two distinct values."""
    return gaps(values, column, digits).groupBy("gap").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gap").limit(1)


def first_gap(values: DataFrame, column: str) -> DataFrame:
    """One row (gap): between the two smallest distinct values."""
    two = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).distinct().orderBy("v").limit(2)
    return two.agg((F.max("v") - F.min("v")).alias("gap"), F.count("v").alias("n")).where("n = 2").select("gap")


def column_profile(rows: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """A row for each text or number column: numeric (90 % or more parse), count, min, max, mean, and spacing.

    spacing is the modal gap if it makes up over half of a number of distinct values between 2 and 4000, exclusive.
    Blank cells are null, not 0.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("text")) for c in columns])).alias("cell")).select("cell.name", "cell.text")
    long = long.withColumn("v", F.col("text").try_cast("double"))
    base = long.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_numbers"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"))
    distinct = long.where("v IS NOT NULL").select("name", "v").distinct()
    sizes = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n_distinct"))
    few = distinct.join(F.broadcast(sizes.where("n_distinct > 2 AND n_distinct < 4000").select("name")), "name")
    gap = few.withColumn("gap", F.round(F.col("v") - F.lag("v").over(Window.partitionBy("name").orderBy("v")), digits)).where("gap IS NOT NULL").groupBy("name", "gap").agg(F.count(F.lit(1)).alias("n"))
    best = gap.groupBy("name").agg(F.max(F.struct("n", (-F.col("gap")).alias("back"))).alias("best"))
    out = base.join(sizes, "name", "left").join(best, "name", "left")
    return out.select("name", "n_rows", "n_numbers", (F.col("n_numbers") >= 0.9 * F.col("n_rows")).alias("is_numeric"), "min_v", "max_v", "mean_v", F.when(F.col("best.n") > 0.5 * F.col("n_distinct"), -F.col("best.back")).alias("spacing"))
