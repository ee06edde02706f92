"""Rings and lines, arrays of struct<x, y>, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(coordinates: list[tuple[float, float]]) -> Column:
    """A literal ring or line."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in coordinates])


def rotated(ring: Column) -> Column:
    """The ring beginning with its second point: zipped with the ring it gives the edges, the closing one too."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for counter-clockwise; closed implicitly."""
    return _summed(F.zip_with(ring, rotated(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def polygon_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def polygon_perimeter(ring: Column) -> Column:
    return _summed(F.zip_with(ring, rotated(ring), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def path_length(line: Column) -> Column:
    """Length of an open line, 0 with fewer than two points."""
    rest, body = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
    return _summed(F.zip_with(body, rest, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def point_in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule, an edge counting for its lower end only, so that points on a boundary fall to one side."""
    crossed = F.zip_with(ring, rotated(ring), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]))
    return F.aggregate(crossed, F.lit(False), lambda acc, hit: acc != F.coalesce(hit, F.lit(False)))


def bounds(ring: Column) -> Column:
    """Struct of a ring's extent."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def outer_first(rings: Column, area: str = "signed_area") -> Column:
    """A polygon's rings, an array of structs, by signed area, largest first, so that outer rings come before holes."""
    return F.array_sort(rings, lambda a, b: F.when(a[area] > b[area], -1).when(a[area] < b[area], 1).otherwise(0))
