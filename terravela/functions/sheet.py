"""Map sheets as Column expressions: fitting an extent on a page, scale bars, index contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of scale bars in metres, points in an inch and metres in one.
BARS, POINTS, INCH = (10, 20, 25, 50, 100, 200, 250, 500, 1000), 72, 0.0254


def page_fit(min_x: Column, min_y: Column, max_x: Column, max_y: Column, width: float, height: float, pad: float = 10.0) -> Column:
    """struct<scale, off_x, off_y>: page points a metre, one for both axes, and the margins that centre the extent."""
    scale = F.least((width - pad * 2) / (max_x - min_x), (height - pad * 2) / (max_y - min_y))
    return F.struct(scale.alias("scale"), ((width - (max_x - min_x) * scale) / 2).alias("off_x"), ((height - (max_y - min_y) * scale) / 2).alias("off_y"))


def scale_bar(scale: Column, width: float) -> Column:
    """Metres of the first bar that is longer than 0.6 of a quarter of the page, 100 if none is."""
    fits = F.filter(F.array(*[F.lit(b) for b in BARS]), lambda b: b * scale > width / 4 * 0.6)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(100))


def scale_ratio(scale: Column) -> Column:
    """The n of 1:n, for page points a metre."""
    return F.floor(1 / (scale / POINTS * INCH) + 0.5).cast("long")


def is_index(elevation: Column, interval: float = 0.5) -> Column:
    """Is a contour one of every fifth, which are drawn heavier? False without an elevation."""
    return F.coalesce(F.abs(elevation % (interval * 5)) < interval / 4, F.lit(False))


def contour_sheet(lines: DataFrame, width: float, height: float, interval: float = 0.5) -> DataFrame:
    """One row of a sheet of lines(elevation, points): extent, fit, bar, ratio, height range, lines and index lines."""
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    s = lines.agg(
        F.min(F.array_min(x)).alias("min_x"), F.min(F.array_min(y)).alias("min_y"), F.max(F.array_max(x)).alias("max_x"), F.max(F.array_max(y)).alias("max_y"), F.min("elevation").alias("lowest"), F.max("elevation").alias("highest"),
        F.count(F.lit(1)).alias("n_lines"), F.count_if(is_index(F.col("elevation"), interval)).alias("n_index"),
    )
    s = s.withColumn("fit", page_fit(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), width, height))
    return s.select(*[c for c in s.columns if c != "fit"], "fit.scale", "fit.off_x", "fit.off_y", scale_bar(F.col("fit.scale"), width).alias("bar"), scale_ratio(F.col("fit.scale")).alias("ratio"))
