"""Operators on a cell and its eight neighbours.

A cell sends its value to the cells around it and one map-side combined aggregate gathers them, so that a
stencil costs one shuffle however many of its neighbours it reads and holes need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravela.operators.grid import GridMeta

#: Directions 0 to 7 as (name, row step, column step), clockwise from east.
DIRECTIONS = (("e", 0, 1), ("se", 1, 1), ("s", 1, 0), ("sw", 1, -1), ("w", 0, -1), ("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1))


def neighbours(cells: DataFrame) -> DataFrame:
    """(row, col, v, e, se, s, sw, w, nw, n, ne) for each cell with data; null for a neighbour without."""
    cells = cells.where(F.col("v").isNotNull()).select("row", "col", "v")
    sent = [F.struct(F.col("row").alias("row"), F.col("col").alias("col"), F.lit(-1).alias("k"))]
    sent += [F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(k).alias("k")) for k, (_, dr, dc) in enumerate(DIRECTIONS)]
    spread = cells.select("v", F.explode(F.array(*sent)).alias("to"))
    gathered = spread.groupBy(F.col("to.row").alias("row"), F.col("to.col").alias("col")).agg(F.max(F.when(F.col("to.k") == -1, F.col("v"))).alias("v"), *[F.max(F.when(F.col("to.k") == k, F.col("v"))).alias(name) for k, (name, _, _) in enumerate(DIRECTIONS)])
    return gathered.where(F.col("v").isNotNull())


def d8_direction(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """(row, col, dir): the direction of the steepest drop per distance, the first of equals; -1 if nothing is lower."""
    drops = [(F.col("v") - F.col(name)) / (cell_size * (2**0.5 if dr and dc else 1.0)) for name, dr, dc in DIRECTIONS]
    best = F.greatest(*drops)
    out = F.when(best.isNull() | (best <= 0), -1)
    for k, drop in enumerate(drops):
        out = out.when(drop == best, k)
    return neighbours(cells).select("row", "col", out.cast("int").alias("dir"))


def downstream(directions: DataFrame, meta: GridMeta) -> DataFrame:
    """(node, root) with a cell's id and its downstream cell's, its own for an outlet or a way out of the grid."""
    step = lambda k: F.create_map(*[F.lit(x) for i, d in enumerate(DIRECTIONS) for x in (i, d[k])])[F.col("dir")]
    to = F.struct((F.col("row") + step(1)).alias("row"), (F.col("col") + step(2)).alias("col"))
    inside = to["row"].between(0, meta.height - 1) & to["col"].between(0, meta.width - 1)
    return directions.select(meta.cell_id().alias("node"), F.when((F.col("dir") >= 0) & inside, to["row"].cast("long") * meta.width + to["col"]).otherwise(meta.cell_id()).alias("root"))


def _clamped(meta: GridMeta) -> dict[str, Column]:
    """Neighbours with the grid's edge repeated beyond it and the centre in place of nodata."""

    names = {(r, c): n for n, r, c in DIRECTIONS} | {(0, 0): "v"}

    def at(dr: int, dc: int) -> Column:
        past_row = {-1: F.col("row") == 0, 0: F.lit(False), 1: F.col("row") == meta.height - 1}[dr]
        past_col = {-1: F.col("col") == 0, 0: F.lit(False), 1: F.col("col") == meta.width - 1}[dc]
        value = F.when(past_row & past_col, F.col("v")).when(past_row, F.col(names[0, dc])).when(past_col, F.col(names[dr, 0])).otherwise(F.col(names[dr, dc]))
        return F.coalesce(value, F.col("v"))

    return {name: at(dr, dc) for name, dr, dc in DIRECTIONS}


def _gradient(n: dict[str, Column], cell_size: float) -> tuple[Column, Column]:
    """Horn's weighted differences to the east and to the south."""
    east = (n["ne"] + 2 * n["e"] + n["se"] - n["nw"] - 2 * n["w"] - n["sw"]) / (8 * cell_size)
    south = (n["sw"] + 2 * n["s"] + n["se"] - n["nw"] - 2 * n["n"] - n["ne"]) / (8 * cell_size)
    return east, south


def slope_degrees(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """(row, col, slope): Horn's slope in degrees; beyond an edge the edge repeats, nodata counts as the centre."""
    east, south = _gradient(_clamped(meta), meta.cell_size)
    return neighbours(cells).select("row", "col", F.degrees(F.atan(F.hypot(east, south))).alias("slope"))


def _lit(east: Column, south: Column, z_factor: float, azimuth: float, altitude: float) -> Column:
    slope = F.atan(z_factor * F.hypot(east, south))
    towards = F.radians(F.lit(azimuth)) - F.atan2(south, -east)
    zenith = F.radians(F.lit(90.0 - altitude))
    return F.cos(zenith) * F.cos(slope) + F.sin(zenith) * F.sin(slope) * F.cos(towards)


def hillshade(cells: DataFrame, meta: GridMeta, z_factor: float = 2.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(row, col, shade) from 0.55 to 1, edges repeated and nodata counted as the centre."""
    lit = _lit(*_gradient(_clamped(meta), meta.cell_size), z_factor, azimuth, altitude)
    return neighbours(cells).select("row", "col", (0.55 + 0.45 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), lit))).alias("shade"))


def hillshade_inner(cells: DataFrame, meta: GridMeta, z_factor: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(row, col, shade): 0.55 plus 0.6 of the light, full light where a neighbour is missing or outside."""
    whole = F.lit(True)
    for name, _, _ in DIRECTIONS:
        whole = whole & F.col(name).isNotNull()
    lit = _lit(*_gradient({n: F.col(n) for n, _, _ in DIRECTIONS}, meta.cell_size), z_factor, azimuth, altitude)
    return neighbours(cells).select("row", "col", (0.55 + 0.6 * F.when(whole, F.greatest(F.lit(0.0), lit)).otherwise(1.0)).alias("shade"))


def open_sides(cells: DataFrame) -> DataFrame:
    """(row, col, n_open): how many of the eight neighbours are nodata or outside; above 0 water can leave."""
    missing = sum((F.col(n).isNull().cast("int") for n, _, _ in DIRECTIONS), F.lit(0))
    return neighbours(cells).select("row", "col", missing.alias("n_open"))
