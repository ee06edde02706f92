"""Steps whose time or memory grew faster than their tables."""

import numpy as np
from pyspark.sql import functions as F

from terravela.functions import geodesy
from terravela.operators import vector


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_thinned_together_keep_the_same_points():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 3, 40, 0, 500, 5, 900]
    points = np.concatenate([np.column_stack([np.cumsum(rng.integers(0, 3, n)), rng.integers(0, 5, n)]) for n in sizes]).astype(float)
    points[60] = points[61]
    points[100, 1] = np.nan
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for tolerance in (0.0, 0.8, 3.0):
        want = [vector.thin(points[a:b], tolerance) if b - a > 2 else np.ones(b - a, bool) for a, b in zip(offsets, offsets[1:])]
        assert (vector.thin_lines(points[:, 0], points[:, 1], offsets, tolerance) == np.concatenate(want)).all()
    runs = list(vector._line_runs(offsets, 45))
    assert runs[0][0] == 0 and runs[-1][1] == len(sizes) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_contours_thin_once_and_without_objects(spark):
    line = lambda *p: [{"x": 300000.0 + x, "y": 2500000.0 + y} for x, y in p]
    rows = [(1, 0, line((0, 0), (1, 0.01), (2, 0), (3, 9))), (2, 0, line((0, 0))), (3, 0, None), (4, 0, line((5, 5), (6, 6)))]
    shapes = spark.createDataFrame(rows, "rec long, part int, points array<struct<x:double,y:double>>")
    held = spark.createDataFrame([(k, f"{k} m") for k in range(1, 5)], "rec long, height string")
    out = vector.contours(shapes, held, "height", 32643)
    plan = _plan(out)
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    assert sorted((r["elevation"], r["n_before"], r["n_after"]) for r in out.collect()) == [(1.0, 4, 3), (4.0, 2, 2)]
    lon, lat = geodesy.utm_to_lon_lat(F.col("p.x"), F.col("p.y"), F.lit(43), F.lit(True))
    whole = shapes.where("rec = 1")
    got = whole.select(F.inline(geodesy.utm_points_to_lon_lat(F.col("points"), F.lit(43), F.lit(True)))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in whole.select(F.explode("points").alias("p")).select(lon, lat).collect()]


def test_grants_are_made_in_bounded_tasks_and_never_shuffled(spark, tmp_path, monkeypatch):
    from terravela.plans import catalogue_queries, inputs, site_queries

    customers = [(k, n) for k in range(0, 2000, 10) for n in ([1, 2] if k % 50 == 0 else [k // 10 % 3])] + [(70, 1), (70, 1), (None, 1), (80, None)]
    suppliers = [(k, n) for k in range(100) for n in ([1, 2] if k % 5 == 0 else [k % 3])] + [(None, 1), (3, None)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    want = sorted({(u, s) for u, a in customers for s, b in suppliers if u is not None and s is not None and a is not None and a == b and u % 7 == s % 7})
    monkeypatch.setattr(inputs, "PAIRS_IN_TASK", 100)
    got = inputs.grants(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 400 and sum(sizes) == len(want) > 1000
    removed = site_queries.grants_removed(spark, str(tmp_path)).collect()
    assert sorted((r["user_id"], r["site_id"]) for r in removed if r["part"] == "held") == [p for p in want if p[1] % 2]
    assert sorted((r["user_id"], r["site_id"]) for r in removed if r["part"] == "log") == [p for p in want if p[1] % 2 == 0]
    added = catalogue_queries.grant_insert_missing(spark, str(tmp_path))
    assert sorted(map(tuple, added.collect())) == [p for p in want if p[0] % 3 or p[0] % 2 == 0]


def test_totals_of_visible_sites_need_no_row_for_each(spark):
    from terravela.operators import catalogue as c

    sites = spark.createDataFrame([(k, k % 2, k % 5 != 0) for k in range(1, 13)], "id long, client_id long, is_published boolean")
    users = spark.createDataFrame([(1, "client", 0, True), (2, "client", 1, True), (3, "client", 1, True), (4, "client", 2, True), (5, "client", 0, False), (6, "owner", None, True), (7, "client", 0, True)], "id long, role string, client_id long, is_active boolean")
    grants = spark.createDataFrame([(2, 3), (2, 3), (2, 4), (2, 5), (3, 2), (9, 1)], "user_id long, site_id long")
    got = c.visible_totals(sites, grants, users)
    want = c.visible_by_user(sites, grants, users).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("site_id").alias("ids"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4


def test_lines_are_drawn_in_the_grid_only(spark):
    from terravela.operators.grid import GridMeta

    rng = np.random.default_rng(5)
    ends = rng.integers(-12, 25, (300, 4))
    ends[0], ends[1], ends[2] = (-5, 3, -5, 3), (4, 3, 4, 3), (5, -1_000_000_000, 5, 1_000_000_000)
    height, width = 9, 13
    want = set()
    for c0, r0, c1, r1 in ends.tolist():
        n = max(abs(c1 - c0), abs(r1 - r0))
        sign = lambda v: (v > 0) - (v < 0)
        for k in range(n + 1) if n < 1000 else ():
            col, row = (a + sign(b - a) * ((2 * k * abs(b - a) + n) // (2 * n) if n else 0) for a, b in ((c0, c1), (r0, r1)))
            if 0 <= row < height and 0 <= col < width:
                want.add((row, col))
    want |= {(row, 5) for row in range(height)}
    row, col = vector.line_cells(*ends.T.astype(np.int64), height, width)
    assert set(zip(row.tolist(), col.tolist())) == want
    rows = [(k, seq, float(a) + 0.5, height - float(b) - 0.5) for k, e in enumerate(ends[3:60].tolist()) for seq, (a, b) in enumerate((e[:2], e[2:]))]
    drawn = vector.rasterize_lines(spark.createDataFrame(rows, "line long, seq int, x double, y double"), GridMeta(width, height, 1.0, 0.0, float(height)))
    row, col = vector.line_cells(*ends[3:60].T.astype(np.int64), height, width)
    assert sorted(map(tuple, drawn.collect())) == sorted(set(zip(row.tolist(), col.tolist())))


def test_lines_are_thinned_without_a_call_for_each(spark):
    rng = np.random.default_rng(8)
    rows = [(k, 2 * j, float(j), float(v)) for k in range(40) for j, v in enumerate(rng.integers(0, 6, int(rng.integers(1, 90))))]
    frame = spark.createDataFrame(rows, "line long, seq long, x double, y double")
    want = []
    for k in range(40):
        points = np.array([r[2:] for r in rows if r[0] == k])
        held = vector.thin(points, 1.5) if len(points) > 2 else np.ones(len(points), bool)
        want += [r for r, h in zip([r for r in rows if r[0] == k], held) if h]
    for in_task in (1_000_000, 20):  # rows that repeat count once
        out = vector.simplify_lines(frame.unionByName(frame.where("seq % 6 = 0")), 1.5, in_task)
        assert sorted(map(tuple, out.collect())) == sorted(want)
        assert "FlatMapGroups" not in _plan(out)
    batches = list(spark.createDataFrame([(*r[:1], None, *r[1:], True) for r in rows], "line long, from long, seq long, x double, y double, own boolean").orderBy("line", "seq").toArrow().to_batches(max_chunksize=7))
    got = [tuple(r.values()) for b in vector._thin_sorted(1.5, 30)(iter(batches)) for r in b.to_pylist()]
    assert got == want
