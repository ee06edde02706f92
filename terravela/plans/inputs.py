"""Grids, catalogues and events derived from the test tables, in Spark and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravela.operators.catalogue import SITE_ROWS
from terravela.operators.grid import GridMeta
from terravela.plans.lineage import broadcast_below

#: Pairs of a user and a site that one task makes, some tens of MB where they are sorted or hashed.
PAIRS_IN_TASK = 500_000
SIDE = 64
META = GridMeta(SIDE, SIDE, 1.0, 0.0, float(SIDE), epsg=32643)
#: The same cells placed in UTM zone 43 north, for tiles.
PLACED = GridMeta(SIDE, SIDE, 10.0, 300000.0, 2500640.0, epsg=32643)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str, side: int = SIDE, where: str = "true") -> DataFrame:
    """(row, col, v): a ramp down to the east with integer relief from prices."""
    cells = table(spark, sf_dir, "lineitem").where(where).selectExpr(f"cast(l_orderkey % {side} as int) AS row", f"cast(l_partkey % {side} as int) AS col", "cast(round(l_extendedprice * 100) as bigint) AS p")
    out = cells.groupBy("row", "col").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    return out.selectExpr("row", "col", f"cast(40 * ({side - 1} - col) + (p div n) % 1000 as double) AS v")


def ragged(cells: DataFrame) -> DataFrame:
    """Without the cells outside a circle, for edges of nodata."""
    return cells.where("(row - 32) * (row - 32) + (col - 32) * (col - 32) <= 900")


def dem_sql(name: str = "dem", side: int = SIDE, where: str = "true") -> str:
    return f"""{name} AS (SELECT r, c, CAST(40 * ({side - 1} - c) + (sum(p) // count(*)) % 1000 AS DOUBLE) AS z FROM
        (SELECT CAST(l_orderkey % {side} AS INT) AS r, CAST(l_partkey % {side} AS INT) AS c, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem WHERE {where}) GROUP BY r, c)"""


RAGGED_SQL = "rag AS (SELECT * FROM dem WHERE (r - 32) * (r - 32) + (c - 32) * (c - 32) <= 900)"
OFFSETS_SQL = "off(k, dr, dc) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1))"
#: Direction and downstream cell of each cell of `dem`.
D8_SQL = f"""{OFFSETS_SQL},
    drop AS (SELECT a.r, a.c, o.k, (a.z - b.z) / CASE WHEN o.dr <> 0 AND o.dc <> 0 THEN sqrt(2.0) ELSE 1.0 END AS s FROM dem a, off o JOIN dem b ON b.r = a.r + o.dr AND b.c = a.c + o.dc),
    best AS (SELECT r, c, k FROM drop WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY s DESC, k) = 1),
    d8 AS (SELECT dem.r, dem.c, coalesce(best.k, -1) AS dir FROM dem LEFT JOIN best USING (r, c)),
    down AS (SELECT d8.r * {SIDE} + d8.c AS node, CASE WHEN dir < 0 THEN d8.r * {SIDE} + d8.c ELSE (d8.r + o.dr) * {SIDE} + d8.c + o.dc END AS root FROM d8 LEFT JOIN off o ON o.k = d8.dir)"""
WALK_SQL = "walk(node, cur) AS (SELECT node, node FROM down UNION ALL SELECT w.node, d.root FROM walk w JOIN down d ON d.node = w.cur WHERE d.root <> d.node)"


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) AS id", "lower(n_name) AS slug", "n_name AS name", "true AS is_active")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "cast(s_nationkey as bigint) AS client_id", "concat('site-', s_suppkey) AS slug", "s_name AS name", "s_acctbal >= 0 AS is_published")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = "c_custkey % 50 = 0"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat(lower(replace(c_name, '#', '.')), '@example.com') AS email", "c_name AS full_name", f"if({owner}, 'owner', 'client') AS role", f"if({owner}, null, cast(c_nationkey as bigint)) AS client_id", "c_acctbal > -500 AS is_active")


def grant_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ks): every tenth customer with its nations."""
    return table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").groupBy(F.col("c_custkey").alias("user_id")).agg(F.collect_set("c_nationkey").alias("ks"))


def grant_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, ks): suppliers with their nations."""
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey").alias("site_id")).agg(F.collect_set("s_nationkey").alias("ks"))


def expand_grants(users: DataFrame, sites: DataFrame) -> DataFrame:
    """(user_id, site_id): some sites of a user's nations for each user, no pair twice, by user_id in tasks of about PAIRS_IN_TASK pairs.

    Pairs grow with users times sites, so that they are never gathered or made distinct: of several common nations the
    least makes the pair. What only users or only sites decide is best decided before.
    """
    held = lambda df, key, several: df.select(key, (F.col(key) % 7).alias("m"), F.explode("ks").alias("k"), F.when(F.size("ks") > 1, F.col("ks")).alias(several))
    counts = lambda df, key, name: held(df, key, "several").groupBy("k", "m").agg(F.count(F.lit(1)).alias(name))
    n = counts(users, "user_id", "nu").join(counts(sites, "site_id", "ns"), ["k", "m"]).agg(F.sum(F.col("nu") * F.col("ns"))).first()[0] or 0
    dealt = users.repartition(max(1, -(-n // PAIRS_IN_TASK)), "user_id")
    pairs = held(dealt, "user_id", "us").join(broadcast_below(held(sites, "site_id", "ss"), SITE_ROWS), ["k", "m"])
    return pairs.where("us IS NULL OR ss IS NULL OR array_min(array_intersect(us, ss)) = k").select("user_id", "site_id")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer has grants for some suppliers of the same nation."""
    return expand_grants(grant_users(spark, sf_dir), grant_sites(spark, sf_dir))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("site_id"))
    kinds = "array('report', 'drawing', 'photo', 'lidar', 'uav_dgps', 'control_area', 'other')"
    mimes = "array('application/pdf', 'image/webp', 'image/png', 'text/csv', 'text/html')"
    return table(spark, sf_dir, "part").join(held, "p_partkey").selectExpr("p_partkey AS id", "site_id", f"{kinds}[length(p_type) % 7] AS category", "p_name AS title", "concat('sites/', site_id, if(p_partkey % 97 = 0, '/../', '/'), p_partkey) AS storage_key", f"{mimes}[p_size % 5] AS mime_type", "p_size % 7 <> 0 AS is_published", "p_size AS sort_order")


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS site_id", "year(l_shipdate) AS y", "to_date(l_shipdate) AS d").groupBy("site_id", "y").agg(F.min("d").alias("flown_on")).selectExpr("site_id * 10000 + y AS id", "site_id", "flown_on")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS actor_id", "event_type AS action", "ts AS created_at")


CATALOGUE_SQL = """clients AS (SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS slug, n_name AS name FROM nation),
    sites AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS client_id, 'site-' || s_suppkey AS slug, s_name AS name, s_acctbal >= 0 AS is_published FROM supplier),
    users AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.com' AS email, c_name AS full_name, CASE WHEN c_custkey % 50 = 0 THEN 'owner' ELSE 'client' END AS role,
        CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS client_id, c_acctbal > -500 AS is_active FROM customer),
    grants AS (SELECT DISTINCT c_custkey AS user_id, s_suppkey AS site_id FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7 WHERE c_custkey % 10 = 0),
    held AS (SELECT l_partkey AS p_partkey, min(l_suppkey) AS site_id FROM lineitem GROUP BY 1),
    assets AS (SELECT p_partkey AS id, site_id, ['report', 'drawing', 'photo', 'lidar', 'uav_dgps', 'control_area', 'other'][length(p_type) % 7 + 1] AS category, p_name AS title,
        'sites/' || site_id || CASE WHEN p_partkey % 97 = 0 THEN '/../' ELSE '/' END || p_partkey AS storage_key, ['application/pdf', 'image/webp', 'image/png', 'text/csv', 'text/html'][p_size % 5 + 1] AS mime_type,
        p_size % 7 <> 0 AS is_published, p_size AS sort_order FROM part JOIN held USING (p_partkey)),
    surveys AS (SELECT l_suppkey * 10000 + year(l_shipdate) AS id, l_suppkey AS site_id, min(CAST(l_shipdate AS DATE)) AS flown_on FROM lineitem GROUP BY 1, 2),
    changes AS (SELECT event_id AS id, user_id AS actor_id, event_type AS action, ts AS created_at FROM events)"""
