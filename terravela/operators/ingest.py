"""From a delivered folder to a published site: files and their roles, manifests, descriptions, guards of paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravela.functions.geodesy import box_hectares
from terravela.functions.text import grouped_digits
from terravela.operators.quality import TILE_TEMPLATE, extension

#: Extensions of sidecars that place a raster, and of what a folder is searched for.
WORLD_FILES, RASTERS, PICTURES = ("tfw", "pgw", "jgw", "wld"), ("tif", "tiff"), ("jpg", "jpeg", "png")
KINDS = {"shp": "shapefile", "csv": "grid", "las": "cloud", "laz": "cloud"}
#: How names tell a file's role, and which layer a map opens on.
TERRAIN_NAME, SURFACE_NAME, ORTHO_NAME = r"(?i)dtm|terrain|bare.?earth", r"(?i)dsm|dem|surface", r"(?i)ortho|mosaic|rgb"
SAFE_FILE = r"^[a-z0-9][a-z0-9._-]*\.(webp|png|jpg|jpeg|json|geojson)$"
HEIGHT_FIELD = re.compile(r"^(elev|elevation|contour|height|z|level)$", re.IGNORECASE)
USER_FIELDS = ("id", "email", "fullName", "role", "passwordHash")
LAYERS = "array<struct<key:string,kind:string,title:string,file:string,tiles:string,minZoom:int,maxZoom:int,bounds:array<double>,featureCount:long,elevation:struct<min:double,max:double>,downsampledFrom:array<int>,encoding:string>>"


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def survey_files(files: DataFrame) -> DataFrame:
    """files(path, ...) with a kind: elevation (or imagery, by its header), picture, shapefile, grid, cloud or skipped.

    A raster counts only with a world file and a .prj beside it, else it is skipped. Files below a name that begins
    with a dot and other extensions are left out.
    """
    seen = files.where(~F.col("path").rlike(r"(^|/)\.[^/]")).withColumns({"_ext": extension(F.col("path")), "_stem": _stem(F.col("path"))})
    sidecars = seen.where(F.col("_ext").isin(*WORLD_FILES, "prj")).groupBy("_stem").agg(F.bool_or(F.col("_ext") == "prj").alias("_prj"), F.bool_or(F.col("_ext") != "prj").alias("_world"))
    wanted = seen.where(F.col("_ext").isin(*RASTERS, *PICTURES, *KINDS)).join(sidecars, "_stem", "left")
    placed = F.coalesce(F.col("_prj") & F.col("_world"), F.lit(False))
    other = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.when(F.col("_ext").isin(*RASTERS), F.when(placed, "elevation").otherwise("skipped")).when(F.col("_ext").isin(*PICTURES), F.when(placed, "picture").otherwise("skipped")).otherwise(F.try_element_at(other, "_ext"))
    return wanted.select(*files.columns, kind.alias("kind"))


def pick_roles(files: DataFrame, site: str = "site") -> DataFrame:
    """files(site, path, kind, size) -> (site, role, path): a site's terrain and surface model, orthomosaic and largest cloud.

    The terrain model is the first elevation file of such a name; the surface model the first of its names among the rest,
    or without a terrain model simply the first; the orthomosaic the first of its names, else the first picture. Files
    are in order of path.
    """
    name = F.element_at(F.split("path", "/"), -1)
    first = lambda df, role: df.groupBy(site).agg(F.min_by("path", "_order").alias("path")).select(site, F.lit(role).alias("role"), "path")
    dems, pictures = files.where("kind = 'elevation'"), files.where("kind IN ('picture', 'imagery')")
    terrain = first(dems.where(name.rlike(TERRAIN_NAME)).withColumn("_order", F.struct("path")), "terrain")
    rest = dems.join(terrain.select(site, F.col("path").alias("_taken")), site, "left").where("_taken IS NULL OR path <> _taken")
    named = rest.withColumn("_rank", F.when(name.rlike(SURFACE_NAME), 0).when(F.col("_taken").isNull(), 1)).where("_rank IS NOT NULL")
    surface = first(named.withColumn("_order", F.struct("_rank", "path")), "surface")
    ortho = first(pictures.withColumn("_order", F.struct((~name.rlike(ORTHO_NAME)).cast("int").alias("_rank"), "path")), "ortho")
    cloud = first(files.where("kind = 'cloud'").withColumn("_order", F.struct((-F.col("size")).alias("_rank"), "path")), "cloud")
    return terrain.unionByName(surface).unionByName(ortho).unionByName(cloud)


def height_field(fields: list[tuple[str, str]]) -> str | None:
    """Of a table's fields (name, type) the first named like a height, else the first number."""
    return next((n for n, _ in fields if HEIGHT_FIELD.match(n)), next((n for n, t in fields if t in ("N", "F", "double", "float", "int", "bigint")), None))


def parse_users(source: DataFrame, column: str = "json", where: str = "users") -> DataFrame:
    """(id, email, full_name, role, client_id, password_hash) from a JSON array of users in each row; fails on a missing field.

    Emails are lower case; any role but admin is client; an admin has no client.
    """
    shape = "array<struct<id:string,email:string,fullName:string,role:string,clientId:string,passwordHash:string>>"
    u = source.select(F.posexplode(F.from_json(F.col(column), shape)).alias("i", "u"))
    lacks = [F.when(F.coalesce(F.col(f"u.{f}"), F.lit("")) == "", F.raise_error(F.concat(F.lit(f"{where}: user "), F.col("i").cast("string"), F.lit(f' is missing "{f}"'))).cast("string")) for f in USER_FIELDS]
    sound = u.withColumn("id", F.coalesce(*lacks, F.col("u.id")))
    admin = F.col("u.role") == "admin"
    return sound.select("id", F.lower("u.email").alias("email"), F.col("u.fullName").alias("full_name"), F.when(admin, "admin").otherwise("client").alias("role"), F.when(~admin, F.col("u.clientId")).alias("client_id"), F.col("u.passwordHash").alias("password_hash"))


def site_paths(spark: SparkSession, sites: dict[str, dict[str, str]]) -> DataFrame:
    """(site, role, path) of a configuration {site: {role: path}}."""
    return spark.createDataFrame([(s, r, p) for s, roles in sites.items() for r, p in roles.items()], "site string, role string, path string")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(site, layers) of manifest files; one that can't be read, or without a list of layers, has no row."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", f"site string, layers {LAYERS}").alias("m"))
    return held.where("m.layers IS NOT NULL").select("m.site", "m.layers")


def is_safe_layer(layer: Column) -> Column:
    """Can an address be built for a layer: a template of the served shape for pyramids, a plain file name for others?"""
    pyramid = layer["kind"].isin("tiles", "dem")
    return F.when(pyramid, F.coalesce(layer["tiles"].rlike(TILE_TEMPLATE), F.lit(False))).otherwise(F.coalesce(layer["file"].rlike(SAFE_FILE), F.lit(False)))


def safe_layers(manifests: DataFrame) -> DataFrame:
    """manifests(site, layers) without the layers for which no address can be built."""
    return manifests.withColumn("layers", F.filter("layers", is_safe_layer))


def declared_tiles(paths: DataFrame, layers: DataFrame, path: str = "path") -> DataFrame:
    """Rows of paths whose path is a tile, tiles/<key>/<z>/<x>/<y>.<webp or png>, of a pyramid among layers(key, kind)."""
    tile = paths.where(F.col(path).rlike(r"^tiles/[a-z0-9][a-z0-9-]*/[0-9]{1,2}/[0-9]{1,9}/[0-9]{1,9}\.(webp|png)$"))
    keys = layers.where(F.col("kind").isin("tiles", "dem")).select(F.col("key").alias("_key")).distinct()
    return tile.join(keys, F.split(tile[path], "/")[1] == F.col("_key"), "left_semi")


def layer_group(kind: Column) -> Column:
    return F.when(kind == "vector", "Vectors").when(kind == "dem", "Terrain").otherwise("Imagery and models")


def opening_layers(layers: DataFrame, site: str = "site") -> DataFrame:
    """layers(site, ord, key, kind) with their group and whether a map opens with them shown.

    Shown are all vectors and one other: the first tiled layer named like an orthomosaic, else the first tiles or raster.
    """
    rank = F.when((F.col("kind") == "tiles") & F.col("key").rlike(ORTHO_NAME), 0).when(F.col("kind").isin("tiles", "raster"), 1)
    first = layers.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy(site).agg(F.min(F.struct("_rank", "ord")).alias("_first")).select(site, F.col("_first.ord").alias("_opens"))
    shown = (F.col("kind") == "vector") | (F.coalesce(F.col("ord") == F.col("_opens"), F.lit(False)))
    return layers.join(first, site, "left").select(*layers.columns, layer_group(F.col("kind")).alias("group"), shown.alias("shown"))


def site_facts(layers: DataFrame, site: str = "site") -> DataFrame:
    """A row for each site of layers(site, ord, key, kind, bounds, featureCount, elevation): what its manifest measures.

    The area is that of all footprints' common box, in hectares. Of layers of a kind the first counts.
    """
    b = lambda i, f: f(F.get("bounds", i))
    first = lambda cond, value: F.min(F.when(cond, F.struct("ord", value.alias("v"))))["v"]
    height = F.col("elevation").isNotNull()
    surface, terrain, vector = F.col("key").rlike("(?i)dsm|surface") & height, F.col("key").rlike("(?i)dtm|terrain") & height, F.col("kind") == "vector"
    out = layers.groupBy(site).agg(
        b(0, F.min).alias("west"), b(1, F.min).alias("south"), b(2, F.max).alias("east"), b(3, F.max).alias("north"), first(surface, F.col("elevation")).alias("dsm"), first(terrain, F.col("elevation")).alias("dtm"),
        first(vector, F.col("featureCount")).alias("n_contours"), first(vector, F.col("elevation")).alias("contours"), F.count(F.lit(1)).alias("n_layers"), F.count_if(F.col("kind").isin("tiles", "dem")).alias("n_tiled"),
    )
    return out.withColumn("hectares", box_hectares(F.col("west"), F.col("south"), F.col("east"), F.col("north")))


def summary_sentence(dsm: Column, dtm: Column, n_contours: Column, interval: Column, grid_points: Column, grid_spacing: Column, lidar_points: Column) -> Column:
    """What was measured at a site as one sentence, null if nothing was; ranges are structs <min, max>, absent parts null."""
    n = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    bits = F.array_compact(F.array(
        F.when(dsm.isNotNull() & dtm.isNotNull(), F.concat(F.lit("surface and terrain models spanning "), n(dtm["min"]), F.lit(" to "), n(dsm["max"]), F.lit(" m"))).when(dtm.isNotNull(), F.concat(F.lit("a terrain model spanning "), n(dtm["min"]), F.lit(" to "), n(dtm["max"]), F.lit(" m"))),
        F.when(n_contours > 0, F.concat(n_contours.cast("string"), F.lit(" "), F.coalesce(F.concat(n(interval), F.lit(" m ")), F.lit("")), F.lit("contour lines"))),
        F.when(grid_points > 0, F.concat(F.lit("a "), F.coalesce(F.concat(n(grid_spacing), F.lit(" ")), F.lit("")), F.lit("m elevation grid"))),
        F.when(lidar_points > 0, F.concat(F.lit("a "), F.format_string("%.1f", F.round(lidar_points / 1e6, 1)), F.lit(" million point LiDAR cloud"))),
    ))
    listed = F.when(F.size(bits) == 1, bits[0]).otherwise(F.concat(F.array_join(F.slice(bits, 1, F.greatest(F.size(bits) - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(bits, -1)))
    return F.when(F.size(bits) > 0, F.concat(F.lit("Processed survey deliverables for this site: "), listed, F.lit(".")))


def describe_points(rows: DataFrame, by: list[str], height: str = "z") -> DataFrame:
    """(by..., description): how many surveyed points there are and, where heights are numbers, their range."""
    v = F.col(height).try_cast("double")
    v = F.when(~F.isnan(v), v)
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
    reach = F.coalesce(F.format_string(", %.2f to %.2f m", F.round("low", 2), F.round("high", 2)), F.lit(""))
    return s.select(*by, F.concat(grouped_digits(F.col("n")), F.lit(" surveyed points"), F.when(F.col("low").isNull(), "").otherwise(reach), F.lit(".")).alias("description"))


def catalogue_json(site: DataFrame, surveys: DataFrame, assets: DataFrame) -> DataFrame:
    """(site_id, json): a site's catalogue with its latest survey and its assets in order."""
    latest = surveys.groupBy("site_id").agg(F.max_by(F.struct("id", "flown_on"), F.struct("flown_on", "id")).alias("survey"))
    listed = assets.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "title", "id", "category", "storage_key"))).alias("assets"))
    whole = site.select(F.col("id").alias("site_id"), F.struct("id", "slug", "name").alias("site")).join(latest, "site_id", "left").join(listed, "site_id", "left")
    return whole.select("site_id", F.to_json(F.struct("site", "survey", F.coalesce("assets", F.array().cast(listed.schema["assets"].dataType)).alias("assets"))).alias("json"))


def untouched(before: DataFrame, touched: DataFrame, key: str = "key") -> DataFrame:
    """Keys held before that a run didn't write."""
    return before.select(key).distinct().join(touched.select(key), key, "left_anti")


def below_floors(scores: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(name, metric, value, floor): figures of scores(name, metric, value) below the floor of their metric, or without a value."""
    floor = F.try_element_at(F.create_map(*[F.lit(x) for pair in floors.items() for x in pair]), "metric")
    held = scores.withColumn("floor", floor).where("floor IS NOT NULL AND (value IS NULL OR value < floor)")
    return held.select("name", "metric", "value", "floor")


def refuse_below(scores: DataFrame, floors: dict[str, float]) -> None:
    """Fail with the figures that fell below their floors, a dozen of them."""
    failures = below_floors(scores, floors).orderBy("name", "metric").limit(12).collect()
    if failures:
        raise ValueError("; ".join(f"{r['name']} {r['metric']} {r['value']} is below {r['floor']}" for r in failures))


def publish(assets: DataFrame, produced: DataFrame, site_prefix: Column, scope: Column) -> DataFrame:
    """The assets after a site was published again: produced rows take their natural keys' places, rows in scope not produced are retired.

    Fails on any fault of the produced rows before anything changes; the caller writes the result and swaps a pointer.
    """
    from terravela.operators.catalogue import publish_errors, retire_missing, upsert

    faults = publish_errors(produced, site_prefix).limit(12).collect()
    if faults:
        raise ValueError("; ".join(f"{r['storage_key']}: {r['error']}" for r in faults))
    return retire_missing(upsert(assets, produced, ["storage_key"]), produced, ["storage_key"], scope)
