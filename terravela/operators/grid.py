"""Grids: a description and a DataFrame of cells (row INT, col INT, v DOUBLE), row 0 in the north, null v or no row for nodata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elevations outside these limits (exclusive) aren't physical; the usual nodata value.
LOWEST, HIGHEST, NODATA = -500.0, 9000.0, -99999.0


@dataclass(frozen=True)
class GridMeta:
    width: int
    height: int
    cell_size: float = 1.0
    origin_x: float = 0.0
    origin_y: float = 0.0
    nodata: float = NODATA
    epsg: int | None = None

    def x(self, col: Column, centre: float = 0.5) -> Column:
        """Easting of a cell's centre (0.5) or left edge (0)."""
        return self.origin_x + (col + centre) * self.cell_size

    def y(self, row: Column, centre: float = 0.5) -> Column:
        return self.origin_y - (row + centre) * self.cell_size

    def col(self, x: Column) -> Column:
        return F.floor((x - self.origin_x) / self.cell_size).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((self.origin_y - y) / self.cell_size).cast("int")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north."""
        return self.origin_x, self.origin_y - self.height * self.cell_size, self.origin_x + self.width * self.cell_size, self.origin_y

    def cell_id(self, row: str = "row", col: str = "col") -> Column:
        return F.col(row).cast("long") * self.width + F.col(col)


def is_elevation(v: Column) -> Column:
    return F.coalesce((v > LOWEST) & (v < HIGHEST) & ~F.isnan(v), F.lit(False))


def is_nodata(v: Column, nodata: float = NODATA) -> Column:
    return v.isNull() | F.isnan(v) | (v == nodata)


def with_null_nodata(cells: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Nodata values as nulls; other operators take a null or absent cell as nodata."""
    return cells.withColumn("v", F.when(~is_nodata(F.col("v"), nodata), F.col("v")))


def dense(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """(row, col) of every cell of a grid."""
    cells = spark.range(meta.width * meta.height)
    return cells.select(F.expr(f"cast(id div {meta.width} as int)").alias("row"), (F.col("id") % meta.width).cast("int").alias("col"))


def stats(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """One row: min, max, mean, n_valid and valid_fraction of all cells of the grid; nulls and 0 without data."""
    return cells.agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"), F.count("v").alias("n_valid")).withColumn("valid_fraction", F.col("n_valid") / float(meta.width * meta.height))


def assert_aligned(a: GridMeta, b: GridMeta) -> None:
    """Fail with every difference if two grids don't share cells (to a thousandth of a cell)."""
    near = a.cell_size / 1000
    problems = [f"{name}: {x} and {y}" for name, x, y, ok in (
        ("width", a.width, b.width, a.width == b.width), ("height", a.height, b.height, a.height == b.height), ("cell size", a.cell_size, b.cell_size, abs(a.cell_size - b.cell_size) <= near),
        ("origin x", a.origin_x, b.origin_x, abs(a.origin_x - b.origin_x) <= near), ("origin y", a.origin_y, b.origin_y, abs(a.origin_y - b.origin_y) <= near), ("crs", a.epsg, b.epsg, a.epsg == b.epsg or None in (a.epsg, b.epsg)),
    ) if not ok]
    if problems:
        raise ValueError("grids aren't aligned: " + "; ".join(problems))


def refuse_implausible(cells: DataFrame, meta: GridMeta) -> None:
    """Fail unless the grid is in a WGS84 UTM zone and its elevations can be a survey's."""
    if meta.epsg is None or not (32601 <= meta.epsg <= 32660 or 32701 <= meta.epsg <= 32760):
        raise ValueError(f"EPSG {meta.epsg} is no WGS84 UTM zone")
    low, high = cells.agg(F.min("v"), F.max("v")).first()
    if low is not None and (low < LOWEST or high - low > HIGHEST):
        raise ValueError(f"elevations from {low} to {high} aren't plausible")


def percentile_rank(cells: DataFrame, shares: list[float], column: str = "v", bins: int = 4096) -> DataFrame:
    """(share, v): the value at place floor(n * share), from 0, of the sorted values; exact.

    A histogram finds the bin that holds each place; only the few bins that do are sorted, so that no
    step orders all values in one task.
    """
    values = cells.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return cells.sparkSession.createDataFrame([], "share double, v double")
    width = (high - low) / bins or 1.0
    binned = values.withColumn("bin", F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)))
    sizes, before, wanted = dict(binned.groupBy("bin").count().collect()), 0, []
    starts = {}
    for b in sorted(sizes):
        starts[b], before = before, before + sizes[b]
    for share in shares:
        place = min(int(n * share), n - 1)
        b = max(k for k, start in starts.items() if start <= place)
        wanted.append((share, b, place - starts[b] + 1))
    from pyspark.sql import Window

    ask = cells.sparkSession.createDataFrame(wanted, "share double, bin long, place int")
    ranked = binned.where(F.col("bin").isin([b for _, b, _ in wanted])).groupBy("bin", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.withColumn("upto", F.sum("n").over(Window.partitionBy("bin").orderBy("v")))
    return ranked.join(F.broadcast(ask), "bin").where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))).select("share", "v")
