"""One call from a folder of survey files to tiles, terrain products, contours and a published list of layers."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravela.functions.geodesy import METRES_PER_PIXEL_0
from terravela.operators import flow, tiles, vector
from terravela.operators.blocks import to_blocks
from terravela.operators.grid import GridMeta, refuse_implausible, with_null_nodata
from terravela.operators.ingest import height_field
from terravela.plans.lineage import stored
from terravela.sources.geotiff import raster_class, read_meta
from terravela.sources.published import publish_version
from terravela.sources.survey_files import dbf_header, register

LAYER = "site string, ord int, key string, kind string, place string, min_zoom int, max_zoom int, n long, bytes long"


def deepest_zoom(meta: GridMeta, latitude: float, most: int = 21) -> int:
    """The zoom at which a pixel is no larger than a cell, most at the deepest."""
    return max(0, min(most, math.ceil(math.log2(METRES_PER_PIXEL_0 * math.cos(math.radians(latitude)) / meta.cell_size))))


def prepare_site(spark: SparkSession, folder: str, out: str, site: str, levels: int = 6, threshold: int = 500, tolerance: float = 0.15) -> DataFrame:
    """Prepare the files of folder below out and publish their layers; returns the layers (LAYER) of the new version.

    Of each elevation raster a tile pyramid of `levels` zooms above the deepest, and of the first by name its terrain products; of each shapefile
    with attributes beside it contours, in the first raster's zone. Imagery and other files are listed. Everything is written below a folder
    of the run's own, and the layers are published last, so that a run that fails changes nothing that readers see. A site's files are few;
    only their names and headers reach the driver.
    """
    register(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    files = stored(listed.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("low", F.lower("name")))
    kinds = {r["path"]: r for r in raster_class(files.where(F.col("low").rlike("[.](tif|tiff|png)$")).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))).collect()}
    run, layers = f"{out.rstrip('/')}/runs/{uuid.uuid4().hex}", []
    key = lambda path: re.sub(r"[^a-z0-9]+", "-", path.rpartition("/")[2].rpartition(".")[0].lower()).strip("-")
    add = lambda *row: layers.append((site, len(layers), *row))
    epsg = None
    for path in sorted(p for p, r in kinds.items() if r["kind"] == "elevation"):
        meta = read_meta(path)
        cells = stored(with_null_nodata(spark.read.format("geotiff").load(path), meta.nodata))
        refuse_implausible(cells, meta)
        box = tiles.lon_lat_box(spark, meta)
        deepest = deepest_zoom(meta, (box[1] + box[3]) / 2)
        zooms = tiles.zoom_range(deepest, levels)
        drawn = tiles.draw_tiles(stored(to_blocks(cells, 512)), tiles.tiles_over(spark, box, zooms), meta)
        made = tiles.write_tiles(drawn, f"{run}/tiles/{key(path)}").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
        add(key(path), "elevation", f"{run}/tiles/{key(path)}", zooms[0], zooms[-1], made["n"], made["bytes"])
        if epsg is None:
            epsg = meta.epsg
            products = flow.write_products(flow.run_hydrology(cells, meta, threshold), cells, meta, f"{run}/terrain", threshold)
            for r in products.orderBy("key").collect():
                add(f"terrain-{r['key']}", "product", f"{run}/terrain/{r['file']}", None, None, r["n"], r["bytes"])
    names = {r["low"]: re.sub("^file:/*", "/", r["path"]) for r in files.where(F.col("low").rlike("[.](shp|dbf)$")).collect()}
    for low in sorted(n for n in names if n.endswith(".shp") and n[:-3] + "dbf" in names and epsg is not None):
        attributes = names[low[:-3] + "dbf"]
        height = height_field([(name, kind) for name, kind, _, _ in dbf_header(attributes)[3]])
        if height is not None:
            lines = vector.contours(spark.read.format("shp").load(names[low]), spark.read.format("dbf").load(attributes), height, epsg, tolerance)
            lines = stored(lines)
            lines.select("feature").write.text(f"{run}/vectors/{key(low)}.geojsonl")
            add(key(low), "contours", f"{run}/vectors/{key(low)}.geojsonl", None, None, lines.count(), None)
    for path in sorted(p for p, r in kinds.items() if r["kind"] == "imagery"):
        add(key(path), "imagery", path, None, None, None, None)
    publish_version({"layers": spark.createDataFrame(layers, LAYER), "files": files.select("path", "length")}, out)
    return spark.createDataFrame(layers, LAYER)
