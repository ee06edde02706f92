"""Catalogue tables over JDBC, and delivered files by the keys that a viewer may read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravela.operators.catalogue import key_within


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, timeout: int = 6, **options: str) -> DataFrame:
    """A table, read in `parts` ranges of a numeric key where one is given; a statement ends after `timeout` seconds and Spark tries its task again."""
    held = {"url": url, "dbtable": table, "queryTimeout": str(timeout), **options}
    if key is not None and bounds is not None:
        held |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**held).load()


def read_files(spark: SparkSession, root: str, assets: DataFrame, prefix: str = "") -> DataFrame:
    """(storage_key, content) of the files below root that assets(storage_key) name; keys that lead out of the prefix are left out."""
    keys = assets.where(key_within(F.col("storage_key"), F.lit(prefix))).select("storage_key").distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + root.replace("file://", "").rstrip("/") + "/", "")
    return files.select(place.alias("storage_key"), "content").join(keys, "storage_key", "left_semi")
