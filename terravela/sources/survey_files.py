"""Data sources for survey formats: saga (cells), dbf (attribute rows), shp (lines or points), las (header or sampled points)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terravela.operators.grid import GridMeta
from terravela.sources.files import exists, read_bytes, resolve, size

#: numpy's names of a SAGA grid's data formats; shape types.
SAGA_TYPES = {"FLOAT": "f4", "DOUBLE": "f8", "SHORTINT": "i2", "INTEGER": "i4", "BYTE": "u1"}
LINE_TYPES, POINT_TYPES = (3, 13, 23, 5, 15, 25), (1, 11, 21)
#: Points of a LAS batch; points nearer than so many bytes are read with what lies between.
LAS_POINTS, NEAR_BYTES = 50_000, 512
#: A whole projected file is one partition below this many bytes.
PART_BYTES = 64 << 20


class _Records(InputPartition):
    """Records of a shapefile, with the index that tells their places; end -1 for all, without one."""

    def __init__(self, first: int, end: int, index: str):
        super().__init__((first, end))
        self.first, self.end, self.index = first, end, index


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


def _ranges(n: int, width: int) -> list[InputPartition]:
    step = max(1, PART_BYTES // max(1, width))
    return [_Range(i, min(n, i + step)) for i in range(0, n, step)]


def saga_header(path: str) -> tuple[GridMeta, dict[str, str]]:
    """Description and raw fields of an .sgrd file; its origin is the centre of the lower left cell."""
    fields = {k.strip().upper(): v.strip() for k, _, v in (line.partition("=") for line in read_bytes(path).decode("utf-8", "replace").splitlines()) if v}
    width, height, cell = int(fields["CELLCOUNT_X"]), int(fields["CELLCOUNT_Y"]), float(fields["CELLSIZE"])
    west, south = float(fields["POSITION_XMIN"]) - cell / 2, float(fields["POSITION_YMIN"]) - cell / 2
    return GridMeta(width, height, cell, west, south + height * cell, float(fields.get("NODATA_VALUE", "-99999").split(";")[0])), fields


class _SagaReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        meta, fields = saga_header(self.path)
        return _ranges(meta.height, meta.width * np.dtype(SAGA_TYPES[fields["DATAFORMAT"].upper()]).itemsize)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        meta, fields = saga_header(self.path)
        order = ">" if fields.get("BYTEORDER_BIG", "FALSE").upper() == "TRUE" else "<"
        dtype = np.dtype(SAGA_TYPES[fields["DATAFORMAT"].upper()]).newbyteorder(order)
        skip, line = int(fields.get("DATAFILE_OFFSET", "0")), meta.width * dtype.itemsize
        top_down = fields.get("TOPTOBOTTOM", "FALSE").upper() == "TRUE"
        for k in range(partition.first, partition.end):
            raw = np.frombuffer(read_bytes(re.sub(r"\.sgrd$", ".sdat", self.path), skip + k * line, line), dtype)
            values = raw.astype(np.float64)
            void = np.isnan(values) | (raw == dtype.type(meta.nodata))
            values = values * float(fields.get("Z_FACTOR", "1")) + float(fields.get("Z_OFFSET", "0"))
            row = k if top_down else meta.height - 1 - k
            yield pa.RecordBatch.from_arrays([pa.array(np.full(meta.width, row, np.int32)), pa.array(np.arange(meta.width, dtype=np.int32)), pa.array(values, mask=void)], ["row", "col", "v"])


class Saga(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saga"

    def schema(self) -> str:
        return "row int, col int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _SagaReader(self.options["path"])


def dbf_header(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, bytes before them, bytes of each, and fields as (name, type, place, length)."""
    head = read_bytes(path, 0, 32)
    n, begin, width = struct.unpack("<IHH", head[4:12])
    fields, at = [], 1
    for raw in (lambda b: [b[i : i + 32] for i in range(0, len(b) - 31, 32)])(read_bytes(path, 32, begin - 33)):
        if raw[0] == 0x0D:
            break
        name = raw[:11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(raw[11]), at, raw[16]))
        at += raw[16]
    return n, begin, width, fields


class _DbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        n, _, width, _ = dbf_header(self.path)
        return _ranges(n, width)

    def read(self, partition: _Range) -> Iterator[tuple]:
        _, begin, width, fields = dbf_header(self.path)
        data = read_bytes(self.path, begin + partition.first * width, (partition.end - partition.first) * width)
        for i in range(partition.end - partition.first):
            row: list = [partition.first + i]
            for _, kind, at, length in fields:
                text = data[i * width + at : i * width + at + length].decode("latin-1").strip()
                value: object = text
                if kind in "NF":
                    try:
                        value = float(text)
                    except ValueError:
                        value = None  # an empty number is null, not 0
                row += [value, text]
            yield tuple(row)


class Dbf(DataSource):
    """Rows (rec, name, name__raw, ...): N and F fields as numbers, each field's text beside it. Deletion marks are passed over."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> str:
        fields = dbf_header(self.options["path"])[3]
        return "rec int, " + ", ".join(f"`{name}` {'double' if kind in 'NF' else 'string'}, `{name}__raw` string" for name, kind, _, _ in fields)

    def reader(self, schema) -> DataSourceReader:
        return _DbfReader(self.options["path"])


class _ShpReader(DataSourceReader):
    def __init__(self, path: str, points: bool, part_bytes: int):
        self.path, self.points, self.part_bytes = path, points, part_bytes

    def partitions(self) -> list[InputPartition]:
        """Ranges of records by the index beside the file; without one the records can only be found one after another."""
        index = re.sub(r"(?i)[.]shp$", lambda m: ".SHX" if m[0].isupper() else ".shx", self.path)
        if index == self.path or not exists(index):
            return [_Records(0, -1, "")]
        n = (size(index) - 100) // 8
        step = max(1, -(-n // max(1, -(-size(self.path) // self.part_bytes))))
        return [_Records(i, min(n, i + step), index) for i in range(0, n, step)]

    def read(self, partition: _Records) -> Iterator[pa.RecordBatch]:
        store, inner = resolve(self.path)
        with store.open_input_file(inner) as f:
            at = self._one_by_one(f) if partition.end < 0 else self._indexed(f, partition)
            rows, held = [], 0
            for rec, content in at:
                rows += self._shapes(rec, content)
                held += len(content)
                if held > 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
            yield self._batch(rows)

    def _one_by_one(self, f) -> Iterator[tuple[int, bytes]]:
        at, rec, total = 100, 0, f.size()
        while at + 8 <= total:
            f.seek(at)
            length = struct.unpack(">I", f.read(8)[4:])[0] * 2
            yield rec, f.read(length)
            at, rec = at + 8 + length, rec + 1

    def _indexed(self, f, partition: _Records) -> Iterator[tuple[int, bytes]]:
        places = np.frombuffer(read_bytes(partition.index, 100 + 8 * partition.first, 8 * (partition.end - partition.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        for rec, (at, length) in enumerate(places.tolist(), partition.first):
            f.seek(at + 8)
            yield rec, f.read(length)

    def _shapes(self, rec: int, data: bytes) -> list[tuple[int, int | None, np.ndarray | None]]:
        kind = struct.unpack("<i", data[:4])[0]
        if self.points:
            return [(rec, 0, np.frombuffer(data, "<f8", 2, 4).reshape(1, 2))] if kind in POINT_TYPES else [(rec, None, None)]
        if kind not in LINE_TYPES:
            return [(rec, None, None)]
        parts, n = struct.unpack("<ii", data[36:44])
        begin = [*struct.unpack(f"<{parts}i", data[44 : 44 + 4 * parts]), n]
        xy = np.frombuffer(data, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
        return [(rec, p, xy[begin[p] : begin[p + 1]]) for p in range(parts)]

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        shapes = [r[2] for r in rows]
        xy = np.concatenate([np.zeros((0, 2)), *[x for x in shapes if x is not None]])
        points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], ["x", "y"])
        ends = np.cumsum([0 if x is None else len(x) for x in shapes])
        offsets = pa.array([0, *ends.tolist()], pa.int32(), mask=np.array([x is None for x in shapes] + [False])) if rows else pa.array([0], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(offsets, points)], ["rec", "part", "points"])


class Shapefile(DataSource):
    """Rows (rec, part, points): lines and polygons by part, or option geometry=point; null for another type, so that rec keeps its place.

    With an index (.shx) beside it the file is read in several tasks, of about option part_bytes (32 MB) each.
    """

    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        return "rec int, part int, points array<struct<x:double,y:double>>"

    def reader(self, schema) -> DataSourceReader:
        return _ShpReader(self.options["path"], self.options.get("geometry") == "point", int(self.options.get("part_bytes", 32 << 20)))


def las_header(path: str) -> dict:
    data = read_bytes(path, 0, 375)
    if data[:4] != b"LASF":
        raise ValueError(f"{path}: not a LAS file")
    major, minor = data[24], data[25]
    offset = struct.unpack("<I", data[96:100])[0]
    kind, length, count = struct.unpack("<BHI", data[104:111])
    if (major, minor) >= (1, 4) and len(data) >= 255:
        count = struct.unpack("<Q", data[247:255])[0] or count
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack("<6d", data[179:227])
    return {"version": f"{major}.{minor}", "software": data[58:90].split(b"\0")[0].decode("latin-1").strip(), "format": kind & 63, "offset": offset, "length": length, "count": count, "min_x": min_x, "max_x": max_x, "min_y": min_y, "max_y": max_y, "min_z": min_z, "max_z": max_z}


class _LasReader(DataSourceReader):
    def __init__(self, path: str, mode: str, most: int):
        self.path, self.mode, self.most = path, mode, most

    def partitions(self) -> list[InputPartition]:
        h = las_header(self.path)
        return [_Range(0, 1)] if self.mode == "header" else _ranges(h["count"], h["length"])

    def read(self, partition: _Range) -> Iterator[tuple]:
        h = las_header(self.path)
        if self.mode == "header":
            yield tuple(h[k] for k in ("version", "software", "format", "count", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z"))
            return
        step = max(1, h["count"] // self.most)
        first, width = -(-partition.first // step) * step, h["length"]
        store, inner = resolve(self.path)
        with store.open_input_file(inner) as f:
            for i in range(first, partition.end, step * LAS_POINTS):
                idx = np.arange(i, min(partition.end, i + step * LAS_POINTS), step)
                if step * width <= NEAR_BYTES:  # points so near that reading what lies between costs less than seeking
                    f.seek(h["offset"] + i * width)
                    cls = np.frombuffer(f.read((int(idx[-1]) - i) * width + 16), np.uint8)[15 :: step * width]
                else:
                    cls = np.array([self._at(f, h["offset"] + int(k) * width + 15) for k in idx], np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array((cls & 31).astype(np.int32))], ["idx", "cls"])

    def _at(self, f, place: int) -> int:
        f.seek(place)
        return f.read(1)[0]


class Las(DataSource):
    """mode=header (one row) or mode=points: (idx, cls) of every k-th point, k so that about `sample` (200 000) are read."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        if self.options.get("mode", "header") == "header":
            return "version string, software string, format int, count long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"
        return "idx long, cls int"

    def reader(self, schema) -> DataSourceReader:
        return _LasReader(self.options["path"], self.options.get("mode", "header"), int(self.options.get("sample", 200_000)))


def register(spark: SparkSession) -> None:
    from terravela.sources.geotiff import GeoTiff

    for source in (GeoTiff, Saga, Dbf, Shapefile, Las):
        spark.dataSource.register(source)


#: What LAS classes stand for.
LAS_CLASSES = {0: "Created, never classified", 1: "Unclassified", 2: "Ground", 3: "Low vegetation", 4: "Medium vegetation", 5: "High vegetation", 6: "Building", 7: "Low point (noise)", 9: "Water", 10: "Rail", 11: "Road surface", 12: "Overlap", 18: "High noise"}


def point_density(headers: DataFrame) -> DataFrame:
    """LAS headers with the area of their boxes and the points on a square unit of it, null for a box without area."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return headers.withColumn("area", area).withColumn("density", F.when(F.col("area") > 0, F.col("count") / F.col("area")))


def class_name(cls: Column) -> Column:
    """A class's name, `Reserved (n)` for others."""
    names = F.create_map(*[F.lit(x) for pair in LAS_CLASSES.items() for x in pair])
    return F.coalesce(names[cls], F.concat(F.lit("Reserved ("), cls.cast("string"), F.lit(")")))


def class_histogram(points: DataFrame) -> DataFrame:
    """(cls, n, share) of point classes, most frequent first."""
    counts = points.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(counts.agg(F.sum("n").alias("total"))).select("cls", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "cls")


def world_file(spark: SparkSession, path: str) -> DataFrame:
    """One row (cell_size, origin_x, origin_y) of a six-line world file, its origin at the upper left corner; a rotation is refused."""
    lines = spark.read.text(path, wholetext=True).select(F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double")).alias("v"))
    v = lambda i: F.col("v")[i]
    rotated = F.when((v(1) != 0) | (v(2) != 0), F.raise_error("a rotated world file").cast("double"))
    return lines.select(F.coalesce(rotated, v(0)).alias("cell_size"), (v(4) - v(0) / 2).alias("origin_x"), (v(5) - v(3) / 2).alias("origin_y"))


def projection(spark: SparkSession, path: str) -> DataFrame:
    """One row (zone, northern) of a .prj file; fails unless it names a UTM zone."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?i)UTM_zone_(\d+)([NS])", 1).alias("z"), F.upper(F.regexp_extract("value", r"(?i)UTM_zone_(\d+)([NS])", 2)).alias("h"))
    return found.select(F.when(F.col("z") == "", F.raise_error("no UTM zone in the projection").cast("int")).otherwise(F.col("z").try_cast("int")).alias("zone"), (F.col("h") == "N").alias("northern"))


def csv_grid(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of a CSV with columns X, Y and the first that holds ELEV or is Z, in any case; rows without a number in z are left out."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.strip().upper(): c for c in raw.columns}
    z = next((c for n, c in names.items() if "ELEV" in n or n == "Z"), None)
    if z is None or "X" not in names or "Y" not in names:
        raise ValueError(f"{path}: no columns X, Y and ELEV or Z")
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    return raw.select(number(names["X"]).alias("x"), number(names["Y"]).alias("y"), number(z).alias("z")).where("z IS NOT NULL AND NOT isnan(z)")


def csv_preview(spark: SparkSession, path: str, most: int = 50_000) -> tuple[DataFrame, bool]:
    """The first rows of a CSV and whether there are more."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return raw.limit(most), raw.limit(most + 1).count() > most


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(elevation, coordinates) of a feature collection's lines with a finite elevation."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<elevation:double>>>"
    f = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f")).where("f.geometry.type = 'LineString' AND f.properties.elevation IS NOT NULL AND NOT isnan(f.properties.elevation)")
    return f.select(F.col("f.properties.elevation").alias("elevation"), F.from_json("f.geometry.coordinates", "array<array<double>>").alias("coordinates"))
