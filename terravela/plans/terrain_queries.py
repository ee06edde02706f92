"""Queries on grids, flow networks and vectors, with SQL for the oracle where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravela.functions import encode, geodesy, geometry
from terravela.operators import compare, flow, focal, grid, sample, tiles, vector, zonal
from terravela.operators.blocks import to_blocks
from terravela.operators.grid import GridMeta
from terravela.plans.inputs import D8_SQL, META, OFFSETS_SQL, PLACED, RAGGED_SQL, SIDE, WALK_SQL, dem, dem_sql, ragged, table
from terravela.plans.lineage import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SQUARE = [(10.0, 20.0), (30.0, 20.0), (30.0, 40.0), (10.0, 40.0)]
SKEW = [(10.3, 20.2), (41.7, 13.1), (33.4, 30.6), (47.9, 52.4), (12.2, 44.8)]
LINE = [(5.25, 50.0), (40.0, 21.5), (60.5, 33.25)]
OUTLET = 32 * SIDE + 63


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the grid, a null v outside the circle."""
    return grid.dense(spark, META).join(ragged(dem(spark, sf_dir)), ["row", "col"], "left")


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(focal.downstream(focal.d8_direction(dem(spark, sf_dir)), META))


def _accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.accumulate(_forest(spark, sf_dir)).selectExpr(f"cast(node div {SIDE} as int) AS row", f"cast(node % {SIDE} as int) AS col", "acc", "node")


def _streams(spark: SparkSession, sf_dir: str, threshold: int = 8) -> DataFrame:
    forest = _forest(spark, sf_dir)
    return flow.stream_links(forest, flow.accumulate(forest), threshold)


def ring_sql(ring: list[tuple[float, float]], name: str = "edges") -> str:
    rows = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(ring, ring[1:] + ring[:1]))
    return f"{name}(ax, ay, bx, yb) AS (VALUES {rows})"


def coverage_sql(ring: list[tuple[float, float]]) -> str:
    """CTEs up to cov(r, c, f): the share of each cell of the grid in the ring."""
    return f"""{ring_sql(ring)},
        cells AS (SELECT CAST(i // {SIDE} AS INT) AS r, CAST(i % {SIDE} AS INT) AS c FROM range({SIDE * SIDE}) t(i)),
        spots AS (SELECT * FROM (SELECT unnest([0.0, 1.0]) AS dx), (SELECT unnest([0.0, 1.0]) AS dy)
            UNION ALL SELECT 0.5, 0.5 UNION ALL SELECT * FROM (SELECT unnest([0.125, 0.375, 0.625, 0.875]) AS dx), (SELECT unnest([0.125, 0.375, 0.625, 0.875]) AS dy)),
        hits AS (SELECT r, c, dx, dy, count(*) FILTER ((ay > {SIDE} - r - dy) <> (yb > {SIDE} - r - dy) AND c + dx < (bx - ax) * ({SIDE} - r - dy - ay) / (yb - ay) + ax) % 2 AS inside FROM cells, spots, edges GROUP BY ALL),
        sums AS (SELECT r, c, sum(inside) FILTER (dx IN (0, 1)) AS corners, sum(inside) FILTER (dx = 0.5) AS centre, sum(inside) FILTER (dx IN (0.125, 0.375, 0.625, 0.875)) AS subs FROM hits GROUP BY r, c),
        cov AS (SELECT r, c, CASE WHEN corners = 4 THEN 1.0 WHEN corners = 0 AND centre = 0 THEN 0.0 ELSE subs / 16.0 END AS f FROM sums)"""


@query(f"WITH {dem_sql()}, {RAGGED_SQL} SELECT min(z) AS min_v, max(z) AS max_v, round(avg(z), 6) AS mean_v, count(z) AS n_valid, round(count(z) / {SIDE * SIDE}.0, 6) AS valid_fraction FROM rag")
def grid_stats(spark, sf_dir):
    return rounded(grid.stats(ragged(dem(spark, sf_dir)), META))


@query(f"WITH {dem_sql()}, {D8_SQL} SELECT r AS row, c AS col, CAST(dir AS INT) AS dir FROM d8")
def d8_direction(spark, sf_dir):
    return focal.d8_direction(dem(spark, sf_dir))


@query(f"WITH {dem_sql()}, {D8_SQL} SELECT CAST(CASE WHEN dir < 0 THEN 0 ELSE pow(2, dir) END AS INT) AS code, count(*) AS n FROM d8 GROUP BY 1")
def d8_esri_codes(spark, sf_dir):
    return focal.d8_direction(dem(spark, sf_dir)).groupBy(encode.esri_code(F.col("dir")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL} SELECT CAST(cur // {SIDE} AS INT) AS row, CAST(cur % {SIDE} AS INT) AS col, count(*) AS acc FROM walk GROUP BY cur")
def flow_accumulation(spark, sf_dir):
    return _accumulation(spark, sf_dir).select("row", "col", "acc")


@query(f"WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL} SELECT CAST(w.node AS BIGINT) AS node, CAST(w.cur AS BIGINT) AS root FROM walk w JOIN down d ON d.node = w.cur WHERE d.root = d.node")
def basin_labels(spark, sf_dir):
    return flow.basins(_forest(spark, sf_dir)).select("node", "root")


@query(f"WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL} SELECT CAST(w.cur AS BIGINT) AS root, count(*) AS n FROM walk w JOIN down d ON d.node = w.cur WHERE d.root = d.node GROUP BY 1 HAVING count(*) >= 20")
def basin_sizes(spark, sf_dir):
    return flow.basins(_forest(spark, sf_dir)).groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query(f"WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL} SELECT CAST(node AS BIGINT) AS node FROM walk WHERE cur = {OUTLET}")
def watershed(spark, sf_dir):
    return flow.watershed(_forest(spark, sf_dir), OUTLET)


@query(f"WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL}, acc AS (SELECT cur // {SIDE} AS r, cur % {SIDE} AS c, count(*) AS acc FROM walk GROUP BY cur) SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, acc FROM acc WHERE r BETWEEN 25 AND 35 AND c BETWEEN 45 AND 55 ORDER BY acc DESC, r, c LIMIT 1")
def snap_to_channel(spark, sf_dir):
    return flow.snap_to_channel(_accumulation(spark, sf_dir), 30, 50, 5)


@query(f"WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL} SELECT CAST(cur // {SIDE} AS INT) AS row, CAST(cur % {SIDE} AS INT) AS col FROM walk GROUP BY cur HAVING count(*) >= 8")
def stream_cells(spark, sf_dir):
    return _accumulation(spark, sf_dir).where("acc >= 8").select("row", "col")


@query(f"WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL}, acc AS (SELECT cur, count(*) AS n FROM walk GROUP BY cur) SELECT CAST(sum(acc.n) AS BIGINT) AS at_outlets, (SELECT count(*) FROM dem) AS n_cells FROM acc JOIN down d ON d.node = acc.cur AND d.root = d.node")
def flow_conservation(spark, sf_dir):
    forest = _forest(spark, sf_dir)
    return flow.accumulate(forest).join(forest, "node").agg(F.sum(F.when(F.col("root") == F.col("node"), F.col("acc"))).alias("at_outlets"), F.count(F.lit(1)).alias("n_cells"))


def _orders_sql(threshold: int = 8, terrain: str = dem_sql(), name: str = "dem") -> str:
    """CTEs up to orders(node, ord) of the terrain that CTE name of terrain holds: orders rise from 1 until none changes, each row replaced by its key."""
    return f"""{terrain}, {re.sub(r"\bdem\b", name, D8_SQL)}, {WALK_SQL}, acc AS (SELECT cur AS node, count(*) AS acc FROM walk GROUP BY cur), st AS (SELECT node FROM acc WHERE acc >= {threshold}),
        links AS (SELECT d.node, CASE WHEN d.root <> d.node AND d.root IN (SELECT node FROM st) THEN d.root END AS nxt FROM down d JOIN st USING (node)),
        orders(node, ord) USING KEY (node) AS (SELECT node, 1 FROM st UNION
            SELECT n.node, n.ord FROM (SELECT nxt AS node, CASE WHEN count(*) FILTER (o = m) > 1 THEN any_value(m) + 1 ELSE any_value(m) END AS ord FROM (SELECT l.nxt, q.ord AS o, max(q.ord) OVER (PARTITION BY l.nxt) AS m FROM links l JOIN recurring.orders q ON q.node = l.node WHERE l.nxt IN (SELECT k.nxt FROM orders e JOIN links k ON k.node = e.node)) GROUP BY nxt) n JOIN recurring.orders p ON p.node = n.node WHERE n.ord > p.ord)"""


@query(f"WITH RECURSIVE {_orders_sql()} SELECT CAST(node AS BIGINT) AS node, CAST(ord AS INT) AS ord FROM orders")
def strahler_order(spark, sf_dir):
    return flow.strahler(_streams(spark, sf_dir))


@query(f"""WITH RECURSIVE {_orders_sql()}, n_in AS (SELECT nxt AS node, count(*) AS n FROM links WHERE nxt IS NOT NULL GROUP BY 1),
    run(head, node, k, length) AS (SELECT l.node, l.node, 1, 0.0::DOUBLE FROM links l LEFT JOIN n_in USING (node) WHERE coalesce(n, 0) <> 1
        UNION ALL SELECT r.head, l.nxt, r.k + 1, r.length + sqrt((l.node // {SIDE} - l.nxt // {SIDE}) ** 2 + (l.node % {SIDE} - l.nxt % {SIDE}) ** 2) FROM run r JOIN links l ON l.node = r.node LEFT JOIN n_in ON n_in.node = r.node WHERE l.nxt IS NOT NULL AND (r.k = 1 OR n_in.n = 1))
    SELECT CAST(head AS BIGINT) AS head, CAST(any_value(o.ord) AS INT) AS ord, round(max(length), 6) AS length, CAST(max(k) AS INT) AS n_points FROM run JOIN orders o ON o.node = head GROUP BY head HAVING max(k) > 1""")
def stream_segments(spark, sf_dir):
    return rounded(flow.stream_lines(_streams(spark, sf_dir), META).select("head", "ord", "length", "n_points"))


@query(f"""WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL}, acc AS (SELECT cur AS node, count(*) AS acc FROM walk GROUP BY cur), st AS (SELECT node FROM acc WHERE acc >= 8),
    links AS (SELECT d.node, CASE WHEN d.root <> d.node AND d.root IN (SELECT node FROM st) THEN d.root END AS nxt FROM down d JOIN st USING (node)), n_in AS (SELECT nxt AS node, count(*) AS n FROM links WHERE nxt IS NOT NULL GROUP BY 1)
    SELECT count(*) FILTER (coalesce(n, 0) <> 1 AND nxt IS NOT NULL) AS n_segments, round(sum(CASE WHEN nxt IS NULL THEN 0 ELSE sqrt((l.node // {SIDE} - nxt // {SIDE}) ** 2 + (l.node % {SIDE} - nxt % {SIDE}) ** 2) END), 6) AS length FROM links l LEFT JOIN n_in USING (node)""")
def channel_totals(spark, sf_dir):
    return rounded(flow.channel_totals(flow.stream_lines(_streams(spark, sf_dir), META)))


@query(f"""WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL}, b AS (SELECT w.cur AS root, count(*) AS n FROM walk w JOIN down d ON d.node = w.cur WHERE d.root = d.node GROUP BY 1 HAVING count(*) >= 20),
    k AS (SELECT a.r * {SIDE} + a.c AS root, count(z.z) < 8 AS truncated FROM dem a CROSS JOIN off o LEFT JOIN dem z ON z.r = a.r + o.dr AND z.c = a.c + o.dc GROUP BY 1)
    SELECT CAST(root AS BIGINT) AS root, n, CAST(n AS DOUBLE) AS area, root % {SIDE} + 0.5::DOUBLE AS easting, {SIDE} - root // {SIDE} - 0.5::DOUBLE AS northing, truncated FROM b JOIN k USING (root)""")
def basin_outlets(spark, sf_dir):
    sizes = flow.basins(_forest(spark, sf_dir)).groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return flow.outlets(sizes, dem(spark, sf_dir), META)


@query(f"""WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL}, acc AS (SELECT cur AS node, count(*) AS acc FROM walk GROUP BY cur),
    main AS (SELECT d.root, d.node FROM down d JOIN acc USING (node) WHERE d.node <> d.root QUALIFY row_number() OVER (PARTITION BY d.root ORDER BY acc DESC, d.node) = 1),
    up(step, node) AS (SELECT 0, (SELECT node FROM acc ORDER BY acc DESC, node LIMIT 1) UNION ALL SELECT step + 1, m.node FROM up u JOIN main m ON m.root = u.node WHERE step < 12) SELECT step, CAST(node AS BIGINT) AS node FROM up""")
def upstream_walk(spark, sf_dir):
    forest = _forest(spark, sf_dir)
    accumulation = cut(flow.accumulate(forest))
    start = accumulation.orderBy(F.desc("acc"), "node").first()["node"]
    return flow.walk_upstream(forest, accumulation, start, 12)


def _levels_sql(epsilon: float, name: str) -> str:
    """CTE name(r, c, w): levels fall from infinity until none does."""
    around = "(VALUES (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)) o(dr, dc)"
    return f"""{name}(r, c, w) USING KEY (r, c) AS (SELECT a.r, a.c, CASE WHEN count(b.z) < 8 THEN any_value(a.z) ELSE 'inf'::DOUBLE END FROM dem a CROSS JOIN {around} LEFT JOIN dem b ON b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY a.r, a.c UNION
        SELECT n.r, n.c, n.w FROM (SELECT d.r, d.c, min(greatest(d.z, p.w + {epsilon!r}::DOUBLE)) AS w FROM {name} p CROSS JOIN {around} JOIN dem d ON d.r = p.r + o.dr AND d.c = p.c + o.dc WHERE p.w < 'inf'::DOUBLE GROUP BY d.r, d.c) n JOIN recurring.{name} q ON q.r = n.r AND q.c = n.c WHERE n.w < q.w)"""


_FILL_SQL = f"{dem_sql()}, {_levels_sql(1e-5, 'up')}, {_levels_sql(0.0, 'flat')}, filled AS (SELECT dem.r, dem.c, z, up.w AS filled, CASE WHEN flat.w > z THEN flat.w - z END AS depth FROM dem JOIN up USING (r, c) JOIN flat USING (r, c))"


@query(f"WITH RECURSIVE {_FILL_SQL} SELECT r AS row, c AS col, round(z, 4) AS v, round(filled, 4) AS filled, round(depth, 4) AS depth FROM filled")
def fill_depressions(spark, sf_dir):
    return rounded(flow.fill_depressions(dem(spark, sf_dir), block=32), 4)


@query(f"WITH RECURSIVE {_FILL_SQL} SELECT count(depth) AS n_sinks, max(depth) AS max_depth, sum(depth) AS volume FROM filled")
def sink_depth(spark, sf_dir):
    return flow.fill_depressions(dem(spark, sf_dir), block=32).agg(F.count("depth").alias("n_sinks"), F.max("depth").alias("max_depth"), F.sum("depth").alias("volume"))


@query(f"""WITH RECURSIVE {_orders_sql(40, f"{_FILL_SQL}, lev AS (SELECT r, c, filled AS z FROM filled)", "lev")} SELECT CAST(ord AS INT) AS ord, count(*) AS n_cells FROM orders GROUP BY 1""")
def hydrology_products(spark, sf_dir):
    products = flow.run_hydrology(dem(spark, sf_dir), META, threshold=40)
    return products["orders"].groupBy("ord").agg(F.count(F.lit(1)).alias("n_cells"))



@query(f"""WITH RECURSIVE {dem_sql()}, wet AS (SELECT r, c, z FROM dem WHERE z <= 1500),
    reach(r, c) AS (SELECT r, c FROM wet WHERE r = (SELECT r FROM dem ORDER BY z, r, c LIMIT 1) AND c = (SELECT c FROM dem ORDER BY z, r, c LIMIT 1)
        UNION SELECT w.r, w.c FROM reach p, {OFFSETS_SQL.split(' AS (')[0].replace('off(k, dr, dc)', '(VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) off(k, dr, dc)')} JOIN wet w ON w.r = p.r + dr AND w.c = p.c + dc)
    SELECT count(*) AS n_cells, CAST(count(*) AS DOUBLE) AS area, sum(1500 - z) AS volume, max(1500 - z) AS max_depth FROM reach JOIN dem USING (r, c)""")
def connected_flood(spark, sf_dir):
    return flow.flood_product(cut(dem(spark, sf_dir)), META, 1500.0)[1]


def _gradient_sql(source: str) -> str:
    """CTEs up to grad(r, c, z, gx, gy) with edges repeated and nodata as the centre."""
    at = lambda dr, dc, n: f"LEFT JOIN {source} {n} ON {n}.r = greatest(0, least({SIDE - 1}, m.r + {dr})) AND {n}.c = greatest(0, least({SIDE - 1}, m.c + {dc}))"
    names = {"ne": (-1, 1), "e": (0, 1), "se": (1, 1), "nw": (-1, -1), "w": (0, -1), "sw": (1, -1), "n": (-1, 0), "s": (1, 0)}
    v = {n: f"coalesce({n}.z, m.z)" for n in names}
    return f"""grad AS (SELECT m.r, m.c, ({v['ne']} + 2 * {v['e']} + {v['se']} - {v['nw']} - 2 * {v['w']} - {v['sw']}) / 8 AS gx, ({v['sw']} + 2 * {v['s']} + {v['se']} - {v['nw']} - 2 * {v['n']} - {v['ne']}) / 8 AS gy
        FROM {source} m {' '.join(at(dr, dc, n) for n, (dr, dc) in names.items())})"""


@query(f"WITH {dem_sql()}, {RAGGED_SQL}, {_gradient_sql('rag')} SELECT r AS row, c AS col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM grad")
def slope_degrees(spark, sf_dir):
    return rounded(focal.slope_degrees(ragged(dem(spark, sf_dir)), META))


@query(f"""WITH {dem_sql()}, {RAGGED_SQL}, {_gradient_sql('rag')}, s AS (SELECT r, c, atan(2 * sqrt(gx * gx + gy * gy)) AS slope, atan2(gy, -gx) AS aspect FROM grad)
    SELECT r AS row, c AS col, round(0.55 + 0.45 * greatest(0, least(1, cos(pi() / 4) * cos(slope) + sin(pi() / 4) * sin(slope) * cos(radians(315) - aspect))), 6) AS shade FROM s""")
def hillshade(spark, sf_dir):
    return rounded(focal.hillshade(ragged(dem(spark, sf_dir)), META))


@query(f"""WITH {dem_sql()}, {RAGGED_SQL}, {_gradient_sql('rag')}, {OFFSETS_SQL}, k AS (SELECT a.r, a.c, count(b.z) AS n FROM rag a CROSS JOIN off o LEFT JOIN rag b ON b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY ALL),
    s AS (SELECT r, c, n, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(gy, -gx) AS aspect FROM grad JOIN k USING (r, c))
    SELECT r AS row, c AS col, round(0.55 + 0.6 * CASE WHEN n < 8 THEN 1 ELSE greatest(0, cos(pi() / 4) * cos(slope) + sin(pi() / 4) * sin(slope) * cos(radians(315) - aspect)) END, 6) AS shade FROM s""")
def hillshade_inner(spark, sf_dir):
    return rounded(focal.hillshade_inner(ragged(dem(spark, sf_dir)), META))


@query(f"WITH {dem_sql()}, {RAGGED_SQL}, {OFFSETS_SQL} SELECT a.r AS row, a.c AS col, CAST(8 - count(b.z) AS INT) AS n_open FROM rag a CROSS JOIN off o LEFT JOIN rag b ON b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY 1, 2")
def open_sides(spark, sf_dir):
    return focal.open_sides(ragged(dem(spark, sf_dir)))


@query(f"WITH {dem_sql()}, o AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS k, count(*) OVER () AS n FROM dem) SELECT s AS share, z AS v FROM o, (SELECT unnest([0.02, 0.5, 0.98]::DOUBLE[]) AS s) WHERE k = CAST(floor(n * s) AS BIGINT)")
def percentile_clip(spark, sf_dir):
    return grid.percentile_rank(dem(spark, sf_dir), [0.02, 0.5, 0.98])


def _ramp_sql(t: str, k: int) -> str:
    stops = encode.ELEVATION_RAMP
    return "CASE " + " ".join(f"WHEN {t} BETWEEN {a[0]} AND {b[0]} THEN CAST(floor({a[k]} + ({b[k] - a[k]}) * (({t} - {a[0]}) / {b[0] - a[0]}::DOUBLE) + 0.5) AS INT)" for a, b in zip(stops, stops[1:])) + " END"


@query(f"WITH {dem_sql()}, e AS (SELECT r, c, greatest(0, least(1, (z - 200) / 2800.0::DOUBLE)) AS t FROM dem) SELECT r AS row, c AS col, {_ramp_sql('t', 1)} AS red, {_ramp_sql('t', 2)} AS green, {_ramp_sql('t', 3)} AS blue FROM e")
def colour_ramp(spark, sf_dir):
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - 200) / 2800.0))
    return dem(spark, sf_dir).withColumn("x", encode.ramp(t)).select("row", "col", F.col("x.r").alias("red"), F.col("x.g").alias("green"), F.col("x.b").alias("blue"))


@query(f"""WITH {dem_sql()}, {RAGGED_SQL}, p AS (SELECT z, r, c, CAST(floor(r / 1.5) AS INT) + dr AS tr, CAST(floor(c / 1.5) AS INT) + dc AS tc FROM rag, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc)),
    w AS (SELECT tr, tc, z, (least((tr + 1) * 1.5, r + 1) - greatest(tr * 1.5, r)) * (least((tc + 1) * 1.5, c + 1) - greatest(tc * 1.5, c)) AS w FROM p WHERE least((tr + 1) * 1.5, r + 1) > greatest(tr * 1.5, r) AND least((tc + 1) * 1.5, c + 1) > greatest(tc * 1.5, c))
    SELECT tr AS row, tc AS col, round(sum(z * w) / sum(w), 6) AS v FROM w WHERE tr < 43 AND tc < 43 GROUP BY 1, 2""")
def resample_area(spark, sf_dir):
    return rounded(zonal.resample(ragged(dem(spark, sf_dir)), META, 1.5)[0])


@query(f"""WITH {dem_sql()}, t AS (SELECT i AS k, CAST(floor(i * (64 / 10.0::DOUBLE)) AS INT) AS a, least(64, greatest(CAST(floor(i * (64 / 10.0::DOUBLE)) AS INT) + 1, CAST(floor((i + 1) * (64 / 10.0::DOUBLE)) AS INT))) AS b FROM range(10) x(i))
    SELECT CAST(y.k AS INT) AS row, CAST(x.k AS INT) AS col, round(avg(z), 6) AS v FROM dem JOIN t y ON r >= y.a AND r < y.b JOIN t x ON c >= x.a AND c < x.b GROUP BY 1, 2""")
def downsample_block(spark, sf_dir):
    return rounded(zonal.block_means(dem(spark, sf_dir), META, 10)[0])


def _bilinear_sql(places: str) -> str:
    """CTEs up to spot(id, z) for a relation places(id, x, y) over rag."""
    return f"""q AS (SELECT id, floor(x - 0.5) AS c0, floor({SIDE} - y - 0.5) AS r0, x - 0.5 - floor(x - 0.5) AS tx, {SIDE} - y - 0.5 - floor({SIDE} - y - 0.5) AS ty FROM {places}),
        corner AS (SELECT id, r0 + dr AS r, c0 + dc AS c, CASE WHEN dc = 1 THEN tx ELSE 1 - tx END * CASE WHEN dr = 1 THEN ty ELSE 1 - ty END AS w FROM q, (SELECT unnest([0, 1]) AS dr), (SELECT unnest([0, 1]) AS dc)),
        spot AS (SELECT id, CASE WHEN count(z) = 4 THEN sum(z * w) END AS z FROM corner LEFT JOIN rag USING (r, c) GROUP BY id)"""


@query(f"WITH {dem_sql()}, {RAGGED_SQL}, pp AS (SELECT DISTINCT l_partkey % 6400 * 6400 + l_suppkey * 37 % 6400 AS id, l_partkey % 6400 / 100.0::DOUBLE AS x, l_suppkey * 37 % 6400 / 100.0::DOUBLE AS y FROM lineitem), {_bilinear_sql('pp')} SELECT id, round(z, 6) AS elevation FROM spot")
def spot_level(spark, sf_dir):
    """Levels at all places that lines name; a place's id is its own."""
    places = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 6400 * 6400 + l_suppkey * 37 % 6400 AS id", "l_partkey % 6400 / 100.0D AS x", "l_suppkey * 37 % 6400 / 100.0D AS y").distinct()
    return rounded(sample.spot_levels(places, ragged(dem(spark, sf_dir)), META).select("id", "elevation"))


def _line_sql() -> str:
    """CTE places(id, chainage, x, y) of the profile line at 2.5 m."""
    rows, done, seq = [], 0.0, 0
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(LINE, LINE[1:])):
        length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        steps = max(1, int(length / 2.5 + 0.5))
        rows.append(f"({0 if i == 0 else 1}, {x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE, {steps}, {done!r}::DOUBLE, {length!r}::DOUBLE, {seq})")
        done, seq = done + length, seq + steps
    return f"seg(k0, x0, y0, x1, y1, n, done, len, f) AS (VALUES {', '.join(rows)}), places AS (SELECT CAST(f + k AS BIGINT) AS id, done + k / n * len AS chainage, x0 + k / n * (x1 - x0) AS x, y0 + k / n * (y1 - y0) AS y FROM (SELECT *, unnest(range(k0, n + 1)) AS k FROM seg))"


_PROFILE_SQL = f"{dem_sql()}, {RAGGED_SQL}, {_line_sql()}, {_bilinear_sql('places')}, prof AS (SELECT id, chainage, x, y, z, z - lag(z) OVER (ORDER BY id) AS rise, chainage - lag(chainage) OVER (ORDER BY id) AS run FROM places JOIN spot USING (id))"


def _profile(spark, sf_dir):
    return sample.spot_levels(sample.profile_points(spark, LINE, 2.5), ragged(dem(spark, sf_dir)), META)


@query(f"WITH {_PROFILE_SQL} SELECT id, round(chainage, 6) AS chainage, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS elevation, round(CASE WHEN run > 0 THEN rise / run * 100 END, 6) AS slope_percent FROM prof")
def profile(spark, sf_dir):
    return rounded(sample.with_slopes(_profile(spark, sf_dir)).select("id", "chainage", "x", "y", "elevation", "slope_percent"))


@query(f"""WITH {_PROFILE_SQL} SELECT round(max(chainage), 6) AS length, round(min(z), 6) AS min_elevation, round(max(z), 6) AS max_elevation, round(coalesce(sum(rise) FILTER (rise > 0), 0), 6) AS gain, round(coalesce(-sum(rise) FILTER (rise < 0), 0), 6) AS loss,
    round(max(abs(rise / run * 100)), 6) AS max_slope, count(*) FILTER (z IS NULL) AS n_without_data, round((arg_max(z, id) - arg_min(z, id)) / max(chainage) * 100, 6) AS grade_percent FROM prof""")
def profile_summary(spark, sf_dir):
    return rounded(sample.profile_summary(_profile(spark, sf_dir)))


@query(f"""WITH {_PROFILE_SQL}, held AS (SELECT id, z, z - lag(z) OVER (ORDER BY id) AS d FROM prof WHERE z IS NOT NULL)
    SELECT round(min(z), 6) AS min_elevation, round(max(z), 6) AS max_elevation, round(coalesce(sum(d) FILTER (d > 0), 0), 6) AS gain, round(coalesce(-sum(d) FILTER (d < 0), 0), 6) AS loss, round((SELECT max(chainage) FROM prof), 6) AS length, round((max(z) - min(z)) / (SELECT max(chainage) FROM prof) * 100, 6) AS grade_percent FROM held""")
def measured_summary(spark, sf_dir):
    return rounded(sample.measured_summary(_profile(spark, sf_dir)))


def _supplier_line(spark, sf_dir):
    """(line, seq, x, y): for each supplier the places of its nation, its balance and its number."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line", "cast(s_nationkey as double) AS n", "cast(round(s_acctbal) % 50 as double) AS b")
    return s.select("line", F.posexplode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.col("n")), (F.col("n") + 7, F.lit(3.5)), (F.col("n") + 20, F.col("b")))])).alias("seq", "p")).select("line", "seq", "p.x", "p.y")


@query("""WITH s AS (SELECT s_suppkey AS line, s_nationkey::DOUBLE AS n, (round(s_acctbal) % 50)::DOUBLE AS b FROM supplier),
    v AS (SELECT line, 0 AS seq, 0.0::DOUBLE AS x, n AS y FROM s UNION ALL SELECT line, 1, n + 7, 3.5 FROM s UNION ALL SELECT line, 2, n + 20, b FROM s),
    e AS (SELECT line, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY line ORDER BY seq)),
    m AS (SELECT *, sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) OVER (PARTITION BY line ORDER BY seq) AS b, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM e WHERE x1 IS NOT NULL), t AS (SELECT line, max(b) AS total FROM m GROUP BY 1),
    k AS (SELECT line, total, i AS seq, i / (n - 1) * total AS distance FROM (SELECT *, CAST(least(512, greatest(2, floor(total / 1.5) + 1)) AS BIGINT) AS n FROM t), LATERAL (SELECT unnest(range(n)) AS i)),
    p AS (SELECT k.line, k.seq, distance, x0, y0, x1, y1, (distance - (b - len)) / len AS t FROM k JOIN m ON m.line = k.line AND distance >= m.b - m.len AND (distance < m.b OR m.seq = 1) QUALIFY row_number() OVER (PARTITION BY k.line, k.seq ORDER BY m.seq DESC) = 1)
    SELECT line, CAST(seq AS BIGINT) AS seq, round(distance, 6) AS distance, round(x0 + t * (x1 - x0), 6) AS x, round(y0 + t * (y1 - y0), 6) AS y FROM p""")
def densified_line(spark, sf_dir):
    return rounded(sample.densify_lines(_supplier_line(spark, sf_dir), 1.5))


@query(f"""WITH {dem_sql()}, {RAGGED_SQL}, {ring_sql(SKEW)}, g AS (SELECT x * 2.5::DOUBLE AS x, y * 2.5::DOUBLE AS y FROM (SELECT unnest(range(5, 20)) AS x), (SELECT unnest(range(6, 21)) AS y)),
    k AS (SELECT x, y FROM g, edges GROUP BY x, y HAVING count(*) FILTER ((ay > y) <> (yb > y) AND x < (bx - ax) * (y - ay) / (yb - ay) + ax) % 2 = 1), places AS (SELECT row_number() OVER (ORDER BY y, x) AS id, x, y FROM k), {_bilinear_sql('places')}
    SELECT x, y, round(z, 6) AS elevation FROM places JOIN spot USING (id)""")
def grid_levels(spark, sf_dir):
    return rounded(sample.grid_levels(spark, ragged(dem(spark, sf_dir)), META, SKEW, 2.5).select("x", "y", "elevation"))


@query(f"""WITH {dem_sql()}, {RAGGED_SQL}, {coverage_sql(SKEW)}, x AS (SELECT z, f FROM cov LEFT JOIN rag USING (r, c) WHERE f > 0)
    SELECT min(z) AS min_v, max(z) AS max_v, round(sum(z * f) / sum(f) FILTER (z IS NOT NULL), 6) AS mean_v, sum(f) FILTER (z IS NOT NULL) AS covered_area, coalesce(sum(f) FILTER (z IS NULL), 0) AS nodata_area, count(*) FILTER (z IS NULL) = 0 AS complete FROM x""")
def polygon_stats(spark, sf_dir):
    return rounded(zonal.polygon_stats(_whole(spark, sf_dir), META, SKEW))


_CUT_SQL = """SELECT round(coalesce(sum(d * f) FILTER (d > 0), 0), 6) AS cut, round(coalesce(-sum(d * f) FILTER (d < 0), 0), 6) AS fill, coalesce(sum(f) FILTER (d > 0), 0) AS cut_area, coalesce(sum(f) FILTER (d < 0), 0) AS fill_area,
    round(coalesce(max(d) FILTER (d > 0), 0), 6) AS max_cut, round(coalesce(max(-d) FILTER (d < 0), 0), 6) AS max_fill, coalesce(sum(f) FILTER (d IS NOT NULL), 0) AS measured_area, coalesce(sum(f) FILTER (z IS NULL), 0) AS nodata_area,
    coalesce(sum(f) FILTER (z IS NOT NULL AND ref IS NULL), 0) AS reference_missing_area, round(sum(d * f), 6) AS net, round(sum(d * f) / sum(f) FILTER (d IS NOT NULL), 6) AS mean_depth, round(0.04 * sum(f) FILTER (d IS NOT NULL), 6) AS uncertainty FROM x"""


@query(f"WITH {dem_sql()}, {RAGGED_SQL}, {coverage_sql(SKEW)}, x AS (SELECT z, f, 1500.0 + 2 * (c + 0.5) - 3 * ({SIDE} - r - 0.5) AS ref, z - (1500.0 + 2 * (c + 0.5) - 3 * ({SIDE} - r - 0.5)) AS d FROM cov LEFT JOIN rag USING (r, c) WHERE f > 0) {_CUT_SQL}")
def cut_fill_plane(spark, sf_dir):
    return rounded(zonal.cut_fill(_whole(spark, sf_dir), META, SKEW, zonal.plane((1500.0, 2.0, -3.0), META), 0.04))


_OLD, _NEW = "l_linestatus = 'F'", "l_linestatus = 'O'"


@query(f"WITH {dem_sql('dem', SIDE, _NEW)}, {dem_sql('old', SIDE, _OLD)}, {coverage_sql(SQUARE)}, x AS (SELECT dem.z, f, old.z AS ref, dem.z - old.z AS d FROM cov LEFT JOIN dem USING (r, c) LEFT JOIN old USING (r, c) WHERE f > 0) {_CUT_SQL}")
def cut_fill_surface(spark, sf_dir):
    whole = grid.dense(spark, META).join(dem(spark, sf_dir, where=_NEW), ["row", "col"], "left")
    return rounded(zonal.cut_fill(whole, META, SQUARE, dem(spark, sf_dir, where=_OLD), 0.04))


@query(f"""WITH {dem_sql()}, b AS (SELECT c + 0.5 AS x, {SIDE} - r - 0.5 AS y, z FROM dem WHERE r IN (5, 50) OR c IN (7, 60)), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM b),
    s AS (SELECT sum((x - mx) ** 2) AS xx, sum((y - my) ** 2) AS yy, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz, count(*) AS n FROM b, m)
    SELECT round(mz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * mx - (yz * xx - xz * xy) / (xx * yy - xy * xy) * my, 6) AS a, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 6) AS b, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 6) AS c, n FROM s, m""")
def boundary_plane(spark, sf_dir):
    edge = dem(spark, sf_dir).where("row IN (5, 50) OR col IN (7, 60)")
    return rounded(zonal.boundary_plane(edge.select(META.x(F.col("col")).alias("x"), META.y(F.col("row")).alias("y"), "v")))


@query(f"WITH {dem_sql('a', SIDE, _NEW)}, {dem_sql('b', SIDE, _OLD)}, d AS (SELECT a.z - b.z AS d FROM a JOIN b USING (r, c)) SELECT coalesce(sum(d) FILTER (d > 0), 0) AS gained, coalesce(-sum(d) FILTER (d < 0), 0) AS lost, min(d) AS min_d, max(d) AS max_d, round(avg(d), 6) AS mean_d, count(*) AS n_cells FROM d")
def surface_difference(spark, sf_dir):
    return rounded(zonal.surface_difference(dem(spark, sf_dir, where=_NEW), dem(spark, sf_dir, where=_OLD), META))


@query(f"WITH {dem_sql('a', SIDE, _NEW)}, {dem_sql('b', SIDE, _OLD)} SELECT (SELECT max(z) FROM a) - (SELECT max(z) FROM b) AS difference_of_maxima, (SELECT max(a.z - b.z) FROM a JOIN b USING (r, c)) AS maximum_difference")
def object_height(spark, sf_dir):
    return zonal.maxima_gap(dem(spark, sf_dir, where=_NEW), dem(spark, sf_dir, where=_OLD))


@query(f"""WITH {dem_sql('a', SIDE, _NEW)}, {dem_sql('b', SIDE, _OLD)}, x AS (SELECT * FROM (SELECT r, c, 1 AS a FROM a WHERE z > 1300) FULL JOIN (SELECT r, c, 1 AS b FROM b WHERE z > 1300) USING (r, c)), n AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS "both", count(*) FILTER (b IS NULL) AS only_ours, count(*) FILTER (a IS NULL) AS only_reference FROM x)
    SELECT *, round("both" / ("both" + only_ours + only_reference), 6) AS iou, round("both" / ("both" + only_ours), 6) AS precision, round("both" / ("both" + only_reference), 6) AS recall FROM n""")
def confusion(spark, sf_dir):
    return rounded(compare.confusion(dem(spark, sf_dir, where=_NEW).where("v > 1300"), dem(spark, sf_dir, where=_OLD).where("v > 1300")))


_NEAR = "(3 * greatest(abs(a.r - b.r), abs(a.c - b.c)) + least(abs(a.r - b.r), abs(a.c - b.c))) / 3.0 <= 2"


@query(f"""WITH {dem_sql('p', SIDE, _NEW)}, {dem_sql('q', SIDE, _OLD)}, o AS (SELECT r, c FROM p WHERE z % 100 < 3), f AS (SELECT r, c FROM q WHERE z % 100 < 3),
    n AS (SELECT (SELECT count(*) FROM o) AS n_ours, (SELECT count(*) FROM f) AS n_reference, (SELECT count(*) FROM o a WHERE EXISTS (SELECT 1 FROM f b WHERE {_NEAR})) AS ours_near, (SELECT count(*) FROM f a WHERE EXISTS (SELECT 1 FROM o b WHERE {_NEAR})) AS reference_near)
    SELECT *, round(ours_near / n_ours, 6) AS precision, round(reference_near / n_reference, 6) AS recall, round(2 * (ours_near / n_ours) * (reference_near / n_reference) / (ours_near / n_ours + reference_near / n_reference), 6) AS f1 FROM n""")
def network_agreement(spark, sf_dir):
    return rounded(compare.network_agreement(dem(spark, sf_dir, where=_NEW).where("v % 100 < 3").select("row", "col"), dem(spark, sf_dir, where=_OLD).where("v % 100 < 3").select("row", "col"), 2.0))


_SWEEP = "(3 * greatest(abs(a.r - b.r), abs(a.c - b.c)) + least(abs(a.r - b.r), abs(a.c - b.c))) / 3.0 <= 2"


@query(f"""WITH RECURSIVE {dem_sql()}, {D8_SQL}, {WALK_SQL}, acc AS (SELECT CAST(cur // {SIDE} AS INT) AS r, CAST(cur % {SIDE} AS INT) AS c, count(*) AS acc FROM walk GROUP BY cur), ref AS (SELECT r, c FROM acc WHERE acc >= 12 AND (r + c) % 5 <> 0), t AS (SELECT unnest([2, 4, 8, 12, 16, 24])::INT AS threshold),
    ours AS (SELECT threshold, r, c FROM t JOIN acc ON acc >= threshold),
    p AS (SELECT threshold, count(*) FILTER (EXISTS (SELECT 1 FROM ref b WHERE {_SWEEP})) / count(*) AS precision FROM ours a GROUP BY 1),
    h AS (SELECT threshold, count(*) AS n FROM (SELECT DISTINCT a.threshold, b.r, b.c FROM ours a JOIN ref b ON {_SWEEP}) GROUP BY 1),
    s AS (SELECT t.threshold, coalesce(p.precision, 0) AS precision, coalesce(h.n, 0) / (SELECT greatest(count(*), 1) FROM ref) AS recall FROM t LEFT JOIN p USING (threshold) LEFT JOIN h USING (threshold)),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)
    SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, threshold = (SELECT threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1) AS best FROM f""")
def threshold_sweep(spark, sf_dir):
    accumulation = cut(_accumulation(spark, sf_dir))
    reference = accumulation.where("acc >= 12 AND (row + col) % 5 <> 0").select("row", "col")
    return rounded(compare.threshold_sweep(accumulation, reference, [2, 4, 8, 12, 16, 24], 2.0))


@query(f"""WITH {dem_sql()}, {RAGGED_SQL}, {dem_sql('p', SIDE, _NEW)}, {dem_sql('q', SIDE, _OLD)}, {OFFSETS_SQL},
    a AS (SELECT r, c FROM p WHERE (r - 32) * (r - 32) + (c - 32) * (c - 32) <= 900 AND z > 1300), b AS (SELECT r, c FROM q WHERE (r - 32) * (r - 32) + (c - 32) * (c - 32) <= 900 AND z > 1300),
    e AS (SELECT x.r, x.c, count(y.z) < 8 AS edge, (x.r, x.c) IN (SELECT (r, c) FROM a) <> ((x.r, x.c) IN (SELECT (r, c) FROM b)) AS d FROM rag x CROSS JOIN off o LEFT JOIN rag y ON y.r = x.r + o.dr AND y.c = x.c + o.dc GROUP BY ALL),
    s AS (SELECT count(*) FILTER (edge AND d) / count(*) FILTER (d) AS disputed_share, count(*) FILTER (edge) / count(*) AS base_share FROM e)
    SELECT round(disputed_share, 6) AS disputed_share, round(base_share, 6) AS base_share, round(disputed_share / base_share, 6) AS enrichment FROM s""")
def boundary_enrichment(spark, sf_dir):
    a, b = ragged(dem(spark, sf_dir, where=_NEW)).where("v > 1300").select("row", "col"), ragged(dem(spark, sf_dir, where=_OLD)).where("v > 1300").select("row", "col")
    return rounded(compare.boundary_enrichment(a, b, ragged(dem(spark, sf_dir))))


@query(f"""WITH p AS (SELECT l_orderkey AS line, l_linenumber AS seq, CAST(floor(l_partkey % 700 / 10.0::DOUBLE - 3) AS INT) AS c, CAST(floor({SIDE} - (l_suppkey % 700 / 10.0::DOUBLE - 3)) AS INT) AS r FROM lineitem),
    w AS (SELECT c, r, lead(c) OVER o AS c1, lead(r) OVER o AS r1 FROM p WINDOW o AS (PARTITION BY line ORDER BY seq)), d AS (SELECT DISTINCT *, abs(c1 - c) AS a, abs(r1 - r) AS b, greatest(abs(c1 - c), abs(r1 - r)) AS n FROM w WHERE c1 IS NOT NULL),
    k AS (SELECT *, unnest(range(n + 1)) AS k FROM d), x AS (SELECT r + sign(r1 - r) * CASE WHEN n = 0 THEN 0 ELSE (2 * k * b + n) // (2 * n) END AS row, c + sign(c1 - c) * CASE WHEN n = 0 THEN 0 ELSE (2 * k * a + n) // (2 * n) END AS col FROM k)
    SELECT DISTINCT CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM x WHERE row BETWEEN 0 AND {SIDE - 1} AND col BETWEEN 0 AND {SIDE - 1}""")
def rasterize_lines(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS line", "l_linenumber AS seq", "l_partkey % 700 / 10.0D - 3 AS x", "l_suppkey % 700 / 10.0D - 3 AS y")
    return vector.rasterize_lines(points, META)


def _lines(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS rec", "struct(l_orderkey AS k, l_linenumber AS i, cast(l_orderkey as double) AS x, cast(round(l_extendedprice) % 40 as double) AS y) AS p")
    return p.groupBy("rec").agg(F.array_sort(F.collect_list("p")).alias("p")).select("rec", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS rec, (l_orderkey * 8 + l_linenumber) * 40 + CAST(round(l_extendedprice) % 40 AS BIGINT) AS seq, CAST(l_orderkey AS DOUBLE) AS x, CAST(round(l_extendedprice) % 40 AS DOUBLE) AS y FROM lineitem),
    s AS (SELECT rec, min(seq) AS a, max(seq) AS b FROM p GROUP BY rec
        UNION ALL SELECT rec, unnest([a, k]), unnest([k, b]) FROM (SELECT rec, a, b, list(seq ORDER BY d DESC, seq)[1] AS k, max(d) AS d FROM (
            SELECT rec, a, b, seq, sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) AS d FROM (
                SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM (
                    SELECT s.rec, s.a, s.b, q.seq, e.x - f.x AS dx, e.y - f.y AS dy, q.x - f.x AS px, q.y - f.y AS py FROM s JOIN p f ON f.rec = s.rec AND f.seq = s.a JOIN p e ON e.rec = s.rec AND e.seq = s.b JOIN p q ON q.rec = s.rec AND q.seq > s.a AND q.seq < s.b))) GROUP BY rec, a, b) WHERE d > 5),
    k AS (SELECT rec, count(DISTINCT seq) AS n_after FROM (SELECT rec, a AS seq FROM s UNION ALL SELECT rec, b FROM s) GROUP BY rec)
    SELECT rec, n_before, n_after FROM k JOIN (SELECT l_suppkey AS rec, count(*) AS n_before FROM lineitem GROUP BY 1) USING (rec)""")
def simplify_rdp(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS line", "(l_orderkey * 8 + l_linenumber) * 40 + cast(round(l_extendedprice) % 40 as bigint) AS seq", "cast(l_orderkey as double) AS x", "cast(round(l_extendedprice) % 40 as double) AS y")
    kept = vector.simplify_lines(points, 5.0).groupBy("line").agg(F.count(F.lit(1)).alias("n_after"))
    return points.groupBy("line").agg(F.count(F.lit(1)).alias("n_before")).join(kept, "line").select(F.col("line").alias("rec"), "n_before", "n_after")


@query()
def polygonize(spark, sf_dir):
    return vector.polygonize(dem(spark, sf_dir).where("v > 1500"), META).select("root", "ring", "signed_area", "n_corners")


@query(f"""WITH {dem_sql()}, m AS (SELECT r, c FROM dem WHERE z > 1500), off4(dr, dc) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) SELECT count(*) AS n_edges, (SELECT count(*) FROM m) AS n_cells FROM m a CROSS JOIN off4 o LEFT JOIN m b ON b.r = a.r + o.dr AND b.c = a.c + o.dc WHERE b.r IS NULL""")
def mask_outline(spark, sf_dir):
    mask = dem(spark, sf_dir).where("v > 1500")
    return vector.mask_edges(mask).agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(mask.agg(F.count(F.lit(1)).alias("n_cells")))


@query()
def contours_geojson(spark, sf_dir):
    shapes = _lines(spark, sf_dir).select("rec", F.lit(0).alias("part"), F.transform("points", lambda p: F.struct((p["x"] + 300000).alias("x"), (p["y"] + 2500000).alias("y"))).alias("points"))
    attributes = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS rec", "concat(s_nationkey, ' m') AS height")
    return vector.contours(shapes, attributes, "height", 32643, 5.0).select("elevation", "n_before", "n_after", F.length("feature").alias("n_chars"))



@query(f"""WITH RECURSIVE {dem_sql()}, m AS (SELECT r, c FROM dem WHERE abs(z % 256 - 110) <= 60), off4(dr, dc) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
    reach(r, c) AS (SELECT r, c FROM m WHERE r IN (0, {SIDE - 1}) OR c IN (0, {SIDE - 1}) UNION SELECT m.r, m.c FROM reach p CROSS JOIN off4 o JOIN m ON m.r = p.r + o.dr AND m.c = p.c + o.dc) SELECT r AS row, c AS col FROM reach""")
def border_mask(spark, sf_dir):
    grey = F.col("v") % 256
    return flow.border_mask(dem(spark, sf_dir).select("row", "col", grey.alias("r"), grey.alias("g"), grey.alias("b")), META, (110, 110, 110), 60)


_GEO_SQL = "SELECT c_custkey AS id, 72.0 + c_custkey % 600 / 100.0::DOUBLE AS lon, -60.0 + c_custkey % 1201 / 10.0::DOUBLE AS lat FROM customer"


def _places(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "72.0D + c_custkey % 600 / 100.0D AS lon", "-60.0D + c_custkey % 1201 / 10.0D AS lat")


def utm_forward_sql(source: str, zone: int = 43, north: str = "lat >= 0") -> str:
    g = geodesy
    e, ep = g.E2, g.EP2
    return f"""a AS (SELECT *, radians(lat) AS phi, radians(lon - {zone * 6 - 183}) * cos(radians(lat)) AS a, tan(radians(lat)) ** 2 AS t, {ep!r} * cos(radians(lat)) ** 2 AS cc, {g.A} / sqrt(1 - {e!r} * sin(radians(lat)) ** 2) AS n FROM ({source})),
        m AS (SELECT *, {g.A} * ({1 - e / 4 - 3 * e**2 / 64 - 5 * e**3 / 256!r} * phi - {3 * e / 8 + 3 * e**2 / 32 + 45 * e**3 / 1024!r} * sin(2 * phi) + {15 * e**2 / 256 + 45 * e**3 / 1024!r} * sin(4 * phi) - {35 * e**3 / 3072!r} * sin(6 * phi)) AS m FROM a),
        utm AS (SELECT *, {g.K0} * n * (a + (1 - t + cc) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * {ep!r}) * a ** 5 / 120) + 500000 AS east,
        {g.K0} * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * {ep!r}) * a ** 6 / 720)) + CASE WHEN {north} THEN 0 ELSE 10000000 END AS north FROM m)"""


@query(f"WITH {utm_forward_sql(_GEO_SQL)} SELECT id, round(east, 3) AS east, round(north, 3) AS north FROM utm")
def utm_forward(spark, sf_dir):
    east, north = geodesy.lon_lat_to_utm(F.col("lon"), F.col("lat"), F.lit(43), F.col("lat") >= 0)
    return rounded(_places(spark, sf_dir).select("id", east.alias("east"), north.alias("north")), 3)


@query(f"SELECT id, round(lon, 5) AS lon, round(lat, 5) AS lat FROM ({_GEO_SQL})")
def utm_inverse(spark, sf_dir):
    """There and back: the inverse series returns the coordinates."""
    p = _places(spark, sf_dir)
    east, north = geodesy.lon_lat_to_utm(F.col("lon"), F.col("lat"), F.lit(43), F.col("lat") >= 0)
    p = p.select("id", east.alias("east"), north.alias("north"), (F.col("lat") >= 0).alias("n"))
    lon, lat = geodesy.utm_to_lon_lat(F.col("east"), F.col("north"), F.lit(43), F.col("n"))
    return p.select("id", F.round(lon, 5).alias("lon"), (F.round(lat, 5) + 0.0).alias("lat"))


@query(f"SELECT id, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) + 0 AS y, round(1 / cos(radians(lat)) ** 2, 6) AS inflation, round(156543.03392 * cos(radians(lat)) / 65536, 6) AS metres_per_pixel FROM ({_GEO_SQL})")
def mercator(spark, sf_dir):
    x, y = geodesy.lon_lat_to_mercator(F.col("lon"), F.col("lat"))
    return _places(spark, sf_dir).select("id", F.round(x, 3).alias("x"), (F.round(y, 3) + 0.0).alias("y"), F.round(geodesy.mercator_area_inflation(F.col("lat")), 6).alias("inflation"), F.round(geodesy.metres_per_pixel(F.col("lat"), F.lit(16)), 6).alias("metres_per_pixel"))


_FX, _FY = "(lon + 180) / 360 * 16384", "(1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384"


@query(f"SELECT id, CAST(floor({_FX}) AS BIGINT) AS x, CAST(floor({_FY}) AS BIGINT) AS y, CAST(floor(({_FX} - floor({_FX})) * 256) AS INT) AS px, CAST(floor(({_FY} - floor({_FY})) * 256) AS INT) AS py FROM ({_GEO_SQL})")
def tile_for(spark, sf_dir):
    return _places(spark, sf_dir).withColumn("t", geodesy.tile_for(F.col("lon"), F.col("lat"), F.lit(14))).select("id", "t.x", "t.y", "t.px", "t.py")


@query(f"""SELECT id, CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x0, CAST(floor((lon + 0.301 + 180) / 360 * 4096) AS BIGINT) AS x1, CAST(floor((1 - asinh(tan(radians(lat + 0.203))) / pi()) / 2 * 4096) AS BIGINT) AS y0, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y1,
    coalesce((SELECT max(z) FROM range(25) t(z) WHERE 0.301 / 360 * 256 * pow(2, z) <= 500 + id), 0)::INT AS zoom FROM ({_GEO_SQL})""")
def tile_range(spark, sf_dir):
    p = _places(spark, sf_dir).withColumn("s", geodesy.tile_range(F.col("lon"), F.col("lat"), F.col("lon") + 0.301, F.col("lat") + 0.203, F.lit(12)))
    return p.select("id", "s.x0", "s.x1", "s.y0", "s.y1", geodesy.native_zoom(F.lit(0.0), F.lit(0.301), 500 + F.col("id")).alias("zoom"))


@query(f"""WITH t AS (SELECT id, lon, lat, floor((lon + 180) / 360 * 16384) AS x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 16384) AS y FROM ({_GEO_SQL}))
    SELECT id, round(x / 16384 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 16384)))), 6) AS south, round((x + 1) / 16384 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 16384)))), 6) AS north FROM t""")
def tile_bounds(spark, sf_dir):
    p = _places(spark, sf_dir).withColumn("t", geodesy.tile_for(F.col("lon"), F.col("lat"), F.lit(14)))
    b = geodesy.tile_bounds(F.col("t.x"), F.col("t.y"), F.lit(14))
    return rounded(p.withColumn("b", b).select("id", "b.*"))


@query(f"WITH {dem_sql()}, e AS (SELECT r, c, CAST(floor((z / 7 + 10000) * 10 + 0.5) AS INT) AS v FROM dem) SELECT r AS row, c AS col, v // 65536 AS red, v // 256 % 256 AS green, v % 256 AS blue, round(-10000 + v * 0.1::DOUBLE, 6) AS metres FROM e")
def terrain_rgb_roundtrip(spark, sf_dir):
    x = dem(spark, sf_dir).withColumn("e", encode.encode_elevation(F.col("v") / 7))
    return x.select("row", "col", F.col("e.r").alias("red"), F.col("e.g").alias("green"), F.col("e.b").alias("blue"), F.round(encode.decode_mapbox(F.col("e.r"), F.col("e.g"), F.col("e.b")), 6).alias("metres"))


def _pixels(spark, sf_dir, zoom: int = 15) -> tuple[DataFrame, DataFrame]:
    over = cut(tiles.tiles_over(spark, tiles.lon_lat_box(spark, PLACED), range(zoom, zoom + 1)))
    return over, tiles.terrain_tiles(ragged(dem(spark, sf_dir)), over, PLACED)


def _drawn(spark, sf_dir, zoom: int = 15, **options) -> DataFrame:
    over = tiles.tiles_over(spark, tiles.lon_lat_box(spark, PLACED), range(zoom, zoom + 1))
    return tiles.draw_tiles(to_blocks(ragged(dem(spark, sf_dir))), over, PLACED, **options)


@query()
def tile_pyramid(spark, sf_dir):
    return _drawn(spark, sf_dir, hole=(1, 134, 160)).select("z", "x", "y", "n_pixels")


#: Tiles at zoom 15 around the placed grid; those off it have no pixel.
_TILES_SQL = "SELECT x, y, px, py, (x + (px + 0.5::DOUBLE) / 256) / 32768 * 360 - 180 AS lon, degrees(atan((exp(m) - exp(-m)) / 2)) AS lat FROM (SELECT *, pi() * (1 - 2 * (y + (py + 0.5::DOUBLE) / 256) / 32768) AS m FROM (SELECT unnest(range(23031, 23037)) AS x), (SELECT unnest(range(14270, 14276)) AS y), (SELECT unnest(range(256)) AS px), (SELECT unnest(range(256)) AS py))"


@query(f"""WITH {dem_sql()}, {RAGGED_SQL}, {utm_forward_sql(_TILES_SQL)}, p AS (SELECT x, y, CAST(floor(({PLACED.origin_y} - north) / {PLACED.cell_size}) AS INT) AS r, CAST(floor((east - {PLACED.origin_x}) / {PLACED.cell_size}) AS INT) AS c FROM utm)
    SELECT count(DISTINCT (x, y)) AS n_tiles, CAST(0 AS BIGINT) AS n_empty FROM p JOIN rag USING (r, c)""")
def tile_summary(spark, sf_dir):
    return tiles.summary(_drawn(spark, sf_dir, keep_empty=False)).select("n_tiles", "n_empty")


@query()
def dem_sampler(spark, sf_dir):
    _, pixels = _pixels(spark, sf_dir)
    places = ragged(dem(spark, sf_dir)).select(PLACED.cell_id().alias("id"), PLACED.x(F.col("col")).alias("e"), PLACED.y(F.col("row")).alias("n"))
    lon, lat = geodesy.utm_to_lon_lat(F.col("e"), F.col("n"), F.lit(43), F.lit(True))
    return rounded(tiles.elevation_at(places.select("id", lon.alias("lon"), lat.alias("lat")), pixels, 15).select("id", "elevation"), 3)


@query("WITH v AS (SELECT DISTINCT round(l_discount * 100) AS v FROM lineitem), g AS (SELECT round(v - lag(v) OVER (ORDER BY v), 3) AS gap FROM v) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 1")
def modal_gap(spark, sf_dir):
    return sample.modal_gap(table(spark, sf_dir, "lineitem").selectExpr("round(l_discount * 100) AS v"), "v")


@query("WITH v AS (SELECT DISTINCT l_quantity AS v FROM lineitem ORDER BY v LIMIT 2) SELECT max(v) - min(v) AS gap FROM v")
def first_gap(spark, sf_dir):
    return sample.first_gap(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("""WITH l AS (SELECT unnest(['l_quantity', 'l_discount', 'l_returnflag', 'l_shipmark']) AS name, unnest([CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), l_returnflag, CASE WHEN l_linenumber = 1 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END]) AS t FROM lineitem),
    v AS (SELECT name, t, try_cast(t AS DOUBLE) AS v FROM l), d AS (SELECT DISTINCT name, v FROM v WHERE v IS NOT NULL), n AS (SELECT name, count(*) AS nd FROM d GROUP BY 1),
    g AS (SELECT name, gap, count(*) AS c FROM (SELECT name, round(v - lag(v) OVER (PARTITION BY name ORDER BY v), 4) AS gap FROM d) WHERE gap IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT name, gap, c FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY c DESC, gap) = 1)
    SELECT v.name, count(*) AS n_rows, count(v.v) AS n_numbers, count(v.v) >= 0.9 * count(*) AS is_numeric, min(v.v) AS min_v, max(v.v) AS max_v, round(avg(v.v), 4) AS mean_v, CASE WHEN any_value(m.c) > 0.5 * any_value(n.nd) AND any_value(n.nd) > 2 AND any_value(n.nd) < 4000 THEN any_value(m.gap) END AS spacing
    FROM v LEFT JOIN n USING (name) LEFT JOIN m USING (name) GROUP BY v.name""")
def csv_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipmark", F.when(F.col("l_linenumber") == 1, "x").otherwise(F.col("l_linenumber").cast("string")))
    return rounded(sample.column_profile(rows, ["l_quantity", "l_discount", "l_returnflag", "l_shipmark"]), 4)


@query("WITH n AS (SELECT l_linenumber % 8 AS cls, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(cls AS INT) AS cls, n, round(n / sum(n) OVER (), 6) AS share FROM n")
def las_class_histogram(spark, sf_dir):
    from terravela.sources.survey_files import class_histogram

    return rounded(class_histogram(table(spark, sf_dir, "lineitem").selectExpr("l_linenumber % 8 AS cls")))


@query("WITH p AS (SELECT c_nationkey AS k, c_custkey AS id, c_custkey % 97 * 1.5::DOUBLE AS x, c_custkey % 89 * 2.5::DOUBLE AS y FROM customer), a AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, lead(x) OVER w IS NULL AS closing FROM p WINDOW w AS (PARTITION BY k ORDER BY id)) SELECT k, round(abs(sum(x * ny - nx * y)) / 2, 4) AS area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 4) AS perimeter, round(coalesce(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) FILTER (NOT closing), 0), 4) AS length FROM a GROUP BY k")
def ring_measures(spark, sf_dir):
    p = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k", "struct(c_custkey AS id, c_custkey % 97 * 1.5D AS x, c_custkey % 89 * 2.5D AS y) AS p")
    ring = p.groupBy("k").agg(F.array_sort(F.collect_list("p")).alias("r"))
    return rounded(ring.select("k", geometry.polygon_area(F.col("r")).alias("area"), geometry.polygon_perimeter(F.col("r")).alias("perimeter"), geometry.path_length(F.col("r")).alias("length")), 4)


@query("""WITH v AS (SELECT abs(round(l_extendedprice / l_quantity - 1000 - l_partkey % 100, 2)) AS v FROM lineitem), s AS (SELECT count(*) AS n, max(v) AS worst, count(*) FILTER (v <= 50) AS n_within, list_sort(list(v)) AS l FROM v)
    SELECT n, round(worst, 6) AS worst, round(l[n // 2 + 1], 6) AS median, n_within FROM s""")
def delta_summary(spark, sf_dir):
    deltas = table(spark, sf_dir, "lineitem").selectExpr("abs(round(l_extendedprice / l_quantity - 1000 - l_partkey % 100, 2)) AS v")
    return rounded(compare.delta_summary(deltas, "v", 50.0))
