"""GeoTIFF: a data source of cells, a partition for each run of strips, and a writer.

spark.read.format("geotiff").load(path) gives (row, col, v); the description comes from read_meta(path).
Classic strip files in either byte order, plain or LZW, with samples of one kind are read, one sample at a time; others are refused by name.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from terravela.operators.grid import NODATA, GridMeta
from terravela.sources.files import read_bytes, resolve, write_bytes

#: TIFF tags, the bytes of a field's types, and numpy's name of (sample format, bits).
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE, FORMAT, SCALE, TIE, GEO, NO_DATA = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 339, 33550, 33922, 34735, 42113
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
DTYPES = {(3, 32): "f4", (3, 64): "f8", (2, 16): "i2", (2, 32): "i4", (1, 16): "u2", (1, 8): "u1"}


@dataclass
class Layout:
    meta: GridMeta
    order: str
    dtype: str
    compression: int
    predictor: int
    rows_per_strip: int
    strips: list[tuple[int, int]]
    samples: int = 1
    planar: bool = False


def lzw_decode(data: bytes, expected: int) -> bytes:
    """TIFF's LZW: codes from the high bit down, a bit longer one code before the table is full."""
    out, table, width, buffer, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        buffer, bits = buffer << 8 | byte, bits + 8
        while bits >= width:
            code = buffer >> (bits - width) & (1 << width) - 1
            bits -= width
            buffer &= (1 << bits) - 1
            if code == 257 or len(out) >= expected:
                return bytes(out[:expected])
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("damaged LZW data")
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out[:expected])


def read_tags(path: str) -> tuple[str, dict]:
    """The byte order of a classic TIFF, and its first image's fields by tag."""
    head = read_bytes(path, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError(f"{path}: not a classic TIFF")
    at = struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + "H", read_bytes(path, at, 2))[0]
    raw, tags = read_bytes(path, at + 2, 12 * n), {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", raw[12 * i : 12 * i + 8])
        if kind not in FIELDS:
            continue
        length = FIELDS[kind][0] * count
        value = raw[12 * i + 8 : 12 * i + 8 + length] if length <= 4 else read_bytes(path, struct.unpack(order + "I", raw[12 * i + 8 : 12 * i + 12])[0], length)
        tags[tag] = value.split(b"\0")[0].decode() if kind == 2 else struct.unpack(order + FIELDS[kind][1] * count, value)
    return order, tags


def raster_class(files: DataFrame) -> DataFrame:
    """files(path) -> (path, width, height, samples, bits, kind), from the files' first bytes and fields only.

    kind is elevation for a TIFF of one floating-point sample, imagery for other TIFF and for PNG images, and null for what is neither.
    """

    def look(path: str) -> tuple:
        try:
            if (head := read_bytes(path, 0, 26))[:8] == b"\x89PNG\r\n\x1a\n":
                width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
                return path, width, height, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour), bits, "imagery"
            _, tags = read_tags(path)
            samples, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (1,))[0]
            kind = "elevation" if samples == 1 and tags.get(FORMAT, (1,))[0] == 3 else "imagery"
            return path, tags[WIDTH][0], tags[HEIGHT][0], samples, bits, kind
        except (OSError, ValueError, KeyError, struct.error):
            return path, None, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "width", "height", "samples", "bits", "kind"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows = [look(p) for p in batch.column(0).to_pylist() if p is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return files.select("path").mapInArrow(run, "path string, width int, height int, samples int, bits int, kind string")


def read_layout(path: str) -> Layout:
    order, tags = read_tags(path)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    refusals = [
        ("tiled", TILE in tags), ("samples of several kinds", len({*tags.get(BITS, ()), 0}) > 2 or len({*tags.get(FORMAT, ()), 0}) > 2), ("its compression", one(COMPRESSION, 1) not in (1, 5)), ("its predictor", one(PREDICTOR, 1) not in (1, 2)),
        ("no georeference", SCALE not in tags or TIE not in tags), ("cells that aren't square", SCALE in tags and abs(tags[SCALE][0] - tags[SCALE][1]) > 1e-9 * tags[SCALE][0]),
        ("its samples", (one(FORMAT, 1), one(BITS, 8)) not in DTYPES), ("a predictor on samples of several bytes", one(PREDICTOR, 1) == 2 and one(BITS, 8) != 8),
    ]
    if wrong := [name for name, bad in refusals if bad]:
        raise ValueError(f"{path}: can't be read because of " + ", ".join(wrong))
    keys = tags.get(GEO, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == 3072), None)
    try:
        nodata = float(tags[NO_DATA]) if NO_DATA in tags else NODATA
    except ValueError:
        nodata = math.nan
    cell, tie = tags[SCALE][0], tags[TIE]
    meta = GridMeta(one(WIDTH), one(HEIGHT), cell, tie[3] - tie[0] * cell, tie[4] + tie[1] * cell, nodata if math.isfinite(nodata) else math.nan, epsg)
    return Layout(meta, order, DTYPES[one(FORMAT, 1), one(BITS, 8)], one(COMPRESSION, 1), one(PREDICTOR, 1), min(one(ROWS, one(HEIGHT)), one(HEIGHT)), list(zip(tags[OFFSETS], tags[COUNTS])), one(SAMPLES, 1), one(PLANAR, 1) == 2)


def read_meta(path: str) -> GridMeta:
    return read_layout(path).meta


def read_strip(path: str, layout: Layout, k: int, sample: int = 0) -> np.ndarray:
    """The rows of a strip's sample as doubles, NaN for nodata. Samples lie side by side in a strip or, if planar, in strips of their own."""
    held = 1 if layout.planar else layout.samples
    offset, length = layout.strips[k + (sample * -(-layout.meta.height // layout.rows_per_strip) if layout.planar else 0)]
    rows = min(layout.rows_per_strip, layout.meta.height - k * layout.rows_per_strip)
    dtype = np.dtype(layout.dtype).newbyteorder(layout.order)
    data, expected = read_bytes(path, offset, length), rows * layout.meta.width * dtype.itemsize * held
    if layout.compression == 5:
        data = lzw_decode(data, expected)
    grid = np.frombuffer(data[:expected], dtype).reshape(rows, layout.meta.width, held)
    if layout.predictor == 2:
        grid = np.cumsum(grid, axis=1, dtype=np.uint8)
    values = grid[..., 0 if layout.planar else sample].astype(np.float64)
    nodata = np.float32(layout.meta.nodata) if layout.dtype == "f4" else layout.meta.nodata
    values[values == nodata] = np.nan
    return values


class _Strips(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, cells_per_part: int, first_row: int, last_row: int, sample: int):
        self.path, self.cells, self.first_row, self.last_row, self.sample = path, cells_per_part, first_row, last_row, sample

    def partitions(self) -> list[InputPartition]:
        layout = read_layout(self.path)
        if not 0 <= self.sample < layout.samples:
            raise ValueError(f"{self.path}: has {layout.samples} samples")
        step = max(1, self.cells // max(1, layout.meta.width * layout.rows_per_strip))
        begin, n = self.first_row // layout.rows_per_strip, min(-(-layout.meta.height // layout.rows_per_strip), self.last_row // layout.rows_per_strip + 1)
        return [_Strips(i, min(n, i + step)) for i in range(begin, n, step)]

    def read(self, partition: _Strips) -> Iterator[pa.RecordBatch]:
        layout = read_layout(self.path)
        for k in range(partition.first, partition.end):
            values = read_strip(self.path, layout, k, self.sample)
            for i in range(0, len(values), max(1, (1 << 20) // max(1, layout.meta.width))):
                part = values[i : i + max(1, (1 << 20) // max(1, layout.meta.width))]
                first = k * layout.rows_per_strip + i
                top, end = max(0, self.first_row - first), self.last_row - first + 1
                part, first = part[top : max(top, end)], first + top
                r, c = np.divmod(np.arange(part.size, dtype=np.int32), layout.meta.width)
                yield pa.RecordBatch.from_arrays([pa.array(r + first, pa.int32()), pa.array(c, pa.int32()), pa.array(part.ravel(), mask=np.isnan(part.ravel()))], ["row", "col", "v"])


class GeoTiff(DataSource):
    """Reading: option cells_per_part, about how many cells a partition reads (default 4 million); first_row and last_row read the strips of these rows only;
    sample is the sample to read of several (default 0).

    Writing: (row, col, v) strip by strip, with the grid's description as options; write_geotiff deals cells out and gives them.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("cells_per_part", 4_000_000)), int(self.options.get("first_row", 0)), int(self.options.get("last_row", 1 << 40)), int(self.options.get("sample", 0)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def tiff_header(meta: GridMeta, strips: int, rows: int) -> tuple[bytes, list[int]]:
    """Header of an uncompressed little-endian float file and the offsets of its strips."""
    nodata = f"{meta.nodata:g}".encode() + b"\0"
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, meta.epsg or 32643)
    counts = [min(rows, meta.height - k * rows) * meta.width * 4 for k in range(strips)]
    fields = [(WIDTH, 4, (meta.width,)), (HEIGHT, 4, (meta.height,)), (BITS, 3, (32,)), (COMPRESSION, 3, (1,)), (262, 3, (1,)), (OFFSETS, 4, counts), (SAMPLES, 3, (1,)), (ROWS, 4, (rows,)), (COUNTS, 4, counts), (284, 3, (1,)), (FORMAT, 3, (3,)), (SCALE, 12, (meta.cell_size, meta.cell_size, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, meta.origin_x, meta.origin_y, 0.0)), (GEO, 3, keys), (NO_DATA, 2, nodata)]
    at = 8 + 2 + 12 * len(fields) + 4
    sizes = [FIELDS[kind][0] * len(values) for _, kind, values in fields]
    begin = at + sum(s + s % 2 for s in sizes if s > 4)
    offsets = [begin + sum(counts[:k]) for k in range(strips)]
    if begin + sum(counts) >= 1 << 32:
        raise ValueError("a classic TIFF can't hold this grid")
    entries, extra = b"", b""
    for (tag, kind, values), length in zip(fields, sizes):
        values = offsets if tag == OFFSETS else values
        data = values if kind == 2 else struct.pack("<" + FIELDS[kind][1] * len(values), *values)
        if length <= 4:
            held = data.ljust(4, b"\0")
        else:
            held, extra = struct.pack("<I", at + len(extra)), extra + data + b"\0" * (length % 2)
        entries += struct.pack("<HHI", tag, kind, len(values)) + held
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra, offsets


@dataclass
class _Written(WriterCommitMessage):
    strips: list[int]


class _Writer(DataSourceArrowWriter):
    """Strips have known offsets: on a local or shared disk tasks write them in place into a file that only the commit gives its name.

    A task that runs again writes the same bytes to the same places. In stores without writes in place each strip is a
    file of its own, and the commit reads these one after another into the file.
    """

    def __init__(self, options: dict):
        number = lambda name, default: type(default)(options.get(name, default))
        self.meta = GridMeta(int(options["width"]), int(options["height"]), number("cell_size", 1.0), number("origin_x", 0.0), number("origin_y", 0.0), number("nodata", NODATA), int(options["epsg"]) if options.get("epsg") else None)
        self.rows, self.path = number("rows_per_strip", 256), options["path"]
        self.strips = -(-self.meta.height // self.rows)
        self.header, self.offsets = tiff_header(self.meta, self.strips, self.rows)
        self.local = "://" not in self.path or self.path.startswith("file:")
        self.inner = resolve(self.path)[1]
        self.temporary = f"{self.inner if self.local else self.path}.{uuid.uuid4().hex}"

    def _empty(self, k: int) -> np.ndarray:
        return np.full((min(self.rows, self.meta.height - k * self.rows), self.meta.width), self.meta.nodata, "<f4")

    def _place(self, at: int, data: bytes) -> None:
        os.makedirs(os.path.dirname(self.temporary) or ".", exist_ok=True)
        with open(os.open(self.temporary, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            f.seek(at)
            f.write(data)

    def _put(self, k: int, grid: np.ndarray) -> None:
        if self.local:
            self._place(self.offsets[k], grid.tobytes())
        else:
            write_bytes(f"{self.temporary}/{k}", grid.tobytes())

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        now, grid, done = None, None, []
        for batch in batches:
            row, col, v = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "col", "v"))
            strip = row // self.rows
            edges = np.flatnonzero(np.diff(strip)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(row)]):
                if a == b:
                    continue
                if strip[a] != now:
                    if now is not None:
                        self._put(now, grid)
                    now = int(strip[a])
                    if now in done:
                        raise ValueError("cells must come strip by strip; use write_geotiff")
                    grid = self._empty(now)
                    done.append(now)
                held = ~np.isnan(v[a:b].astype(np.float64))
                grid[row[a:b][held] - now * self.rows, col[a:b][held]] = v[a:b][held]
        if now is not None:
            self._put(now, grid)
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        made = [k for m in messages if m for k in m.strips]
        if len(made) != len(set(made)):
            raise ValueError("a strip lies in several tasks; use write_geotiff")
        for k in sorted(set(range(self.strips)) - set(made)):
            self._put(k, self._empty(k))
        if self.local:
            self._place(0, self.header)
            os.replace(self.temporary, self.inner)
            return
        store, inner = resolve(self.path)
        with store.open_output_stream(inner) as f:
            f.write(self.header)
            for k in range(self.strips):
                f.write(read_bytes(f"{self.temporary}/{k}"))
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        if self.local:
            if os.path.exists(self.temporary):
                os.remove(self.temporary)
        else:
            store, inner = resolve(self.temporary)
            store.delete_dir(inner)


def write_geotiff(cells: DataFrame, meta: GridMeta, path: str, rows_per_strip: int = 256) -> None:
    """Write cells as an uncompressed float GeoTIFF: each strip is put in its place by the task that has its cells; cells outside the grid are left out."""
    cells.sparkSession.dataSource.register(GeoTiff)
    inside = cells.where(F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1)).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("v").cast("double").alias("v"))
    options = {"width": meta.width, "height": meta.height, "cell_size": meta.cell_size, "origin_x": meta.origin_x, "origin_y": meta.origin_y, "nodata": meta.nodata, "rows_per_strip": rows_per_strip} | ({"epsg": meta.epsg} if meta.epsg else {})
    strip = F.floor(F.col("row") / rows_per_strip)
    inside.repartition(strip).sortWithinPartitions(strip).write.format("geotiff").options(**options).mode("append").save(path)
