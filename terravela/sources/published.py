"""Tables published in versions: a version is written whole, then a small pointer file is renamed to name it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from terravela.sources.files import exists, read_bytes, resolve, write_bytes


def current_version(root: str) -> str | None:
    """The version that readers see, None before the first."""
    return json.loads(read_bytes(f"{root}/_current"))["version"] if exists(f"{root}/_current") else None


def publish_version(tables: dict[str, DataFrame], root: str, base: str | None = None) -> str:
    """Write tables as a new version below root and point to it; returns its name.

    Until the pointer is renamed, which is one step on local and shared disks, readers see the former version, and a run
    that fails leaves it so; what a failed run wrote stays unseen and may be deleted. With base, the version that the tables were made from,
    a version that was published meanwhile is an error and stays.
    """
    version = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{root}/versions/{version}/{name}")
    if base is not None and current_version(root) != base:
        raise ValueError(f"{root}: another version was published since {base}")
    pointer = f"{root}/_next-{version}"
    write_bytes(pointer, json.dumps({"version": version, "tables": sorted(tables)}).encode())
    store, inner = resolve(pointer)
    store.move(inner, resolve(f"{root}/_current")[1])
    return version


def read_published(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of the current version, or of a former one by name."""
    version = version or current_version(root)
    if version is None:
        raise ValueError(f"{root}: nothing was published")
    return spark.read.parquet(f"{root}/versions/{version}/{table}")
