"""Guards over delivered files and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mark a sample copied among deliverables, and the words that excuse a file from naming a projection.
SAMPLE_MARKERS = ("Gezira", "demonstration purposes", "Sample Deliverable", "representative sample")
NOT_A_DELIVERABLE = "not a survey deliverable"
#: How files of a kind begin, as hexadecimal digits at a place from 0.
MAGIC = {"pdf": ((0, "255044462D"),), "webp": ((0, "52494646"), (8, "57454250")), "png": ((0, "89504E47"),), "jpg": ((0, "FFD8"),), "jpeg": ((0, "FFD8"),), "las": ((0, "4C415346"),), "laz": ((0, "4C415346"),)}
TILE_TEMPLATE = r"^tiles/([a-z0-9][a-z0-9-]*)/\{z\}/\{x\}/\{y\}\.(webp|png)$"


def duplicates(files: DataFrame, content: str = "content", place: str = "site") -> DataFrame:
    """(digest, n_sites, n_files): contents found in several places; copies within one place don't count."""
    hashed = files.select(F.sha2(F.col(content), 256).alias("digest"), place)
    by_site = hashed.groupBy("digest", place).agg(F.count(F.lit(1)).alias("n"))
    return by_site.groupBy("digest").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("n").alias("n_files")).where("n_sites > 1")


def stubs(files: DataFrame, least: int = 1024, size: str = "size") -> DataFrame:
    """Files too small to be a deliverable."""
    return files.where(F.col(size) < least)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def matches_extension(name: Column, content: Column) -> Column:
    """Does a file begin as its extension claims? Null for an extension without a rule."""
    out = None
    for kind, marks in MAGIC.items():
        ok = F.lit(True)
        for at, digits in marks:
            ok = ok & (F.hex(F.substring(content, at + 1, len(digits) // 2)) == digits)
        out = F.when(extension(name) == kind, ok) if out is None else out.when(extension(name) == kind, ok)
    return out


def mismatched(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    return files.where(~matches_extension(F.col(name), F.col(content)))


def contaminated(files: DataFrame, text: str = "text", markers: tuple[str, ...] = SAMPLE_MARKERS) -> DataFrame:
    """files with the markers that their text holds, those with any."""
    hits = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.col(text), m))
    return files.withColumn("markers", hits).where(F.size("markers") > 0)


def without_projection(files: DataFrame, text: str = "text", word: str = "UTM", excuse: str = NOT_A_DELIVERABLE) -> DataFrame:
    """Files that neither name a projection nor say that they are no deliverable."""
    return files.where(~F.col(text).contains(word) & ~F.col(text).contains(excuse))


def manifest_problems(layers: DataFrame, tiles: DataFrame, files: DataFrame) -> DataFrame:
    """(key, problem) of layers(key, title, kind, tiles, file, min_zoom, max_zoom, encoding) against tiles(key, z) and files(file) there are."""
    zooms = tiles.groupBy("key").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    there = files.select("file").distinct().withColumn("there", F.lit(True))
    x = layers.join(zooms, "key", "left").join(there, "file", "left")
    named, tiled, filed = F.regexp_extract("tiles", TILE_TEMPLATE, 1), F.col("kind").isin("tiles", "dem"), F.col("kind").isin("raster", "vector")
    shaped = F.col("tiles").rlike(TILE_TEMPLATE)
    faults = F.array(
        F.when(F.coalesce("title", F.lit("")) == "", "no title"), F.when(~(tiled | filed), F.concat(F.lit("unknown kind "), F.col("kind"))), F.when(tiled & F.col("tiles").isNull(), "needs a tiles template"),
        F.when(tiled & F.col("tiles").isNotNull() & ~shaped, "template of a shape that isn't served"), F.when(tiled & shaped & (named != F.col("key")), F.concat(F.lit("template points at "), named)),
        F.when(tiled & shaped & F.col("z0").isNull(), "no tiles"), F.when(tiled & shaped & ((F.col("z0") != F.col("min_zoom")) | (F.col("z1") != F.col("max_zoom"))), F.format_string("says z%d-%d, has z%d-%d", "min_zoom", "max_zoom", "z0", "z1")),
        F.when((F.col("kind") == "dem") & F.col("encoding").isNull(), "a dem needs an encoding"), F.when(filed & F.col("file").isNull(), "needs a file"), F.when(filed & F.col("file").isNotNull() & F.col("there").isNull(), "file is missing"),
    )
    return x.select("key", F.explode(F.array_compact(faults)).alias("problem"))


#: Order of layers by kind.
KIND_RANK = {"raster": 0, "tiles": 1, "dem": 2, "vector": 3}


def upsert_layers(layers: DataFrame, fresh: DataFrame) -> DataFrame:
    """layers(key, ord, ...) with fresh ones in place of those with their keys, new ones at the end in their own order."""
    last = layers.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    old, new = layers.select("key", F.col("ord").alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in layers.columns if c not in ("key", "ord")]), fresh.withColumn("_new", F.lit(True))
    both = old.join(new, "key", "full_outer").crossJoin(F.broadcast(last))
    columns = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in layers.columns if c not in ("key", "ord")]
    return both.select("key", F.coalesce("_old", F.col("last") + 1 + F.col("ord")).alias("ord"), *columns)


def kind_rank(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KIND_RANK.items() for x in p]), kind), F.lit(len(KIND_RANK)))


def discover_assets(files: DataFrame, categories: dict[str, str], types: dict[str, str]) -> DataFrame:
    """files(path) as assets: category by folder, type by extension, others left out; sort_order from 1 by name in a folder."""
    from pyspark.sql import Window

    lookup = lambda d, key: F.try_element_at(F.create_map(*[F.lit(x) for p in d.items() for x in p]), key)
    folder, name = F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)
    found = files.select("path", folder.alias("folder"), name.alias("name")).withColumns({"category": lookup(categories, F.lower("folder")), "mime_type": lookup(types, extension(F.col("name")))})
    return found.where("category IS NOT NULL AND mime_type IS NOT NULL").withColumn("sort_order", F.row_number().over(Window.partitionBy("folder").orderBy("name", "path")))
