"""Agreement of masks and networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravela.operators.focal import open_sides
from terravela.operators.grid import percentile_rank


def confusion(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """One row of counts and rates for two sets of (row, col); a rate without a denominator is 1."""
    a, b = ours.select("row", "col").distinct().withColumn("a", F.lit(1)), reference.select("row", "col").distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["row", "col"], "full_outer")
    n = lambda x, y: F.coalesce(F.sum((F.col("a").isNotNull() == x).cast("long") * (F.col("b").isNotNull() == y).cast("long")), F.lit(0))
    counted = both.agg(n(True, True).alias("both"), n(True, False).alias("only_ours"), n(False, True).alias("only_reference"))
    rate = lambda top, *rest: F.when(sum(rest, top) == 0, 1.0).otherwise(top / sum(rest, top))
    hit, extra, missed = F.col("both"), F.col("only_ours"), F.col("only_reference")
    return counted.withColumns({"iou": rate(hit, extra, missed), "precision": rate(hit, extra), "recall": rate(hit, missed)})


def chamfer_offsets(tolerance: float, cell_size: float) -> list[tuple[int, int]]:
    """Steps whose 3-4 chamfer distance, in thirds of a cell, is within tolerance."""
    reach = int(tolerance / cell_size) + 1
    third = lambda r, c: (3 * max(abs(r), abs(c)) + min(abs(r), abs(c))) / 3 * cell_size
    return [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if third(r, c) <= tolerance + 1e-12]


def within(cells: DataFrame, others: DataFrame, tolerance: float, cell_size: float) -> DataFrame:
    """The cells with one of the others within tolerance, by chamfer distance: an equi-join on the few offsets in reach."""
    steps = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in chamfer_offsets(tolerance, cell_size)]))
    reach = others.select(steps.alias("to")).select("to.row", "to.col").distinct()
    return cells.join(reach, ["row", "col"], "left_semi")


def network_agreement(ours: DataFrame, reference: DataFrame, tolerance: float, cell_size: float = 1.0) -> DataFrame:
    """One row: precision, recall and F1 of two networks within a tolerance; 0 where there is nothing to count."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(ours, "n_ours").crossJoin(n(reference, "n_reference")).crossJoin(n(within(ours, reference, tolerance, cell_size), "ours_near")).crossJoin(n(within(reference, ours, tolerance, cell_size), "reference_near"))
    rate = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    p, r = F.col("precision"), F.col("recall")
    return counts.withColumns({"precision": rate("ours_near", "n_ours"), "recall": rate("reference_near", "n_reference")}).withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def threshold_sweep(accumulation: DataFrame, reference: DataFrame, thresholds: list[int], tolerance: float, cell_size: float = 1.0) -> DataFrame:
    """(threshold, precision, recall, f1, best): agreement of the streams of each threshold; best is the first with the highest F1."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    streams = accumulation.withColumn("threshold", t).where("acc >= threshold").select("threshold", "row", "col")
    steps = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in chamfer_offsets(tolerance, cell_size)]))
    near_ref = reference.select(steps.alias("to")).select("to.row", "to.col").distinct().withColumn("near", F.lit(1))
    p = streams.join(near_ref, ["row", "col"], "left").groupBy("threshold").agg((F.count("near") / F.count(F.lit(1))).alias("precision"))
    near_ours = streams.select("threshold", steps.alias("to")).select("threshold", "to.row", "to.col").distinct()
    n = reference.count()
    r = near_ours.join(reference.select("row", "col").distinct(), ["row", "col"]).groupBy("threshold").agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias("recall"))
    every = accumulation.sparkSession.createDataFrame([(i, x) for i, x in enumerate(thresholds)], "place int, threshold int")
    joined = every.join(p, "threshold", "left").join(r, "threshold", "left").fillna(0.0, ["precision", "recall"])
    a, b = F.col("precision"), F.col("recall")
    scored = joined.withColumn("f1", F.when(a + b == 0, 0.0).otherwise(2 * a * b / (a + b)))
    top = scored.agg(F.max(F.struct("f1", (-F.col("place")).alias("back"))).alias("top"))
    return scored.crossJoin(top).select("threshold", "precision", "recall", "f1", (-F.col("top.back") == F.col("place")).alias("best"))


def boundary_enrichment(ours: DataFrame, reference: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: the share of disputed cells beside an open side, the share of all cells beside one, and their ratio."""
    edge = open_sides(cells).select("row", "col", (F.col("n_open") > 0).alias("edge"))
    disputed = ours.select("row", "col").exceptAll(reference.select("row", "col")).union(reference.select("row", "col").exceptAll(ours.select("row", "col"))).withColumn("d", F.lit(True))
    share = lambda cond: F.sum((cond & F.col("edge")).cast("long")) / F.sum(cond.cast("long"))
    out = edge.join(disputed, ["row", "col"], "left").agg(share(F.coalesce("d", F.lit(False))).alias("disputed_share"), share(F.lit(True)).alias("base_share"))
    return out.withColumn("enrichment", F.col("disputed_share") / F.col("base_share"))


def best_match(candidates: DataFrame, key: str, other: str, score: str) -> DataFrame:
    """For each key the other with the highest score, the smallest of equals."""
    return candidates.groupBy(key).agg(F.max(F.struct(score, (-F.col(other)).alias("back"))).alias("b")).select(key, (-F.col("b.back")).alias(other), F.col(f"b.{score}").alias(score))


def rate(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom == 0, empty).otherwise(top / bottom)


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """(value, n): the values of a column, such as the orders of a network, and how many rows have each."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def delta_summary(deltas: DataFrame, column: str, within: float) -> DataFrame:
    """One row (n, worst, median, n_within) of differences that aren't null; the median is the value at place n div 2, from 0, found exactly without sorting all."""
    held = deltas.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    middle = percentile_rank(held, [0.5]).select(F.col("v").alias("median"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("worst"), F.count(F.when(F.col("v") <= within, 1)).alias("n_within")).join(middle, how="left").select("n", "worst", "median", "n_within")
