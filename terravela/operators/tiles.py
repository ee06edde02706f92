"""Tile pyramids: which tiles, what each pixel takes from a grid, Terrain-RGB, encoded images, look-ups."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravela.functions import geodesy as g
from terravela.functions.encode import decode_mapbox, decode_terrarium, encode_elevation
from terravela.operators.blocks import BLOCK, array
from terravela.operators.grid import GridMeta
from terravela.plans.lineage import cut


def lon_lat_box(spark: SparkSession, meta: GridMeta) -> tuple[float, float, float, float]:
    """West, south, east and north of a UTM grid's corners, in degrees."""
    west, south, east, north = meta.bounds
    corners = spark.createDataFrame([(x, y) for x in (west, east) for y in (south, north)], "x double, y double")
    code = F.lit(meta.epsg)
    lon, lat = g.utm_to_lon_lat(F.col("x"), F.col("y"), g.utm_zone(code), g.utm_is_north(code))
    return tuple(corners.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first())


def tiles_over(spark: SparkSession, box: tuple[float, float, float, float], zooms: range) -> DataFrame:
    """(z, x, y) of the tiles over a box at each zoom, gapless."""
    z = spark.createDataFrame([(k,) for k in zooms], "z int")
    span = g.tile_range(*[F.lit(float(v)) for v in box], F.col("z"))
    return z.withColumn("s", span).select("z", F.explode(F.sequence("s.x0", "s.x1")).alias("x"), "s").select("z", "x", F.explode(F.sequence("s.y0", "s.y1")).alias("y"))


def tile_pixels(tiles: DataFrame, meta: GridMeta, size: int = 256) -> DataFrame:
    """(z, x, y, px, py, row, col): the grid's cell, by the nearest centre, under each pixel's centre; pixels off the grid left out."""
    pixels = tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("py")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("px"))
    n = F.pow(F.lit(2.0), F.col("z"))
    lon = (F.col("x") + (F.col("px") + 0.5) / size) / n * 360 - 180
    lat = F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * (F.col("y") + (F.col("py") + 0.5) / size) / n))))
    code = F.lit(meta.epsg)
    east, north = g.lon_lat_to_utm(lon, lat, g.utm_zone(code), g.utm_is_north(code))
    placed = pixels.select("z", "x", "y", "px", "py", meta.row(north).alias("row"), meta.col(east).alias("col"))
    return placed.where(F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1))


def terrain_tiles(cells: DataFrame, tiles: DataFrame, meta: GridMeta, size: int = 256) -> DataFrame:
    """(z, x, y, px, py, r, g, b, a): Terrain-RGB of each pixel with data."""
    drawn = tile_pixels(tiles, meta, size).join(cells.where("v IS NOT NULL").select("row", "col", "v"), ["row", "col"])
    return drawn.withColumn("c", encode_elevation(F.col("v"))).select("z", "x", "y", "px", "py", "c.r", "c.g", "c.b", F.lit(255).alias("a"))


def png(rgba: np.ndarray) -> bytes:
    """A PNG file of height x width x 4 bytes."""
    height, width = rgba.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, width * 4)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def encode_tiles(pixels: DataFrame, tiles: DataFrame | None = None, size: int = 256, hole: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(z, x, y, png, n_pixels): an image for each tile with pixels; with tiles given, for each of those, gapless.

    Pixels without data have the colour hole and alpha 0. A group is one tile's pixels.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((size, size, 4), np.uint8)
        image[..., :3] = hole
        held = pdf[pdf["px"].notna()]
        at = held["py"].astype(int).to_numpy(), held["px"].astype(int).to_numpy()
        for k, name in enumerate("rgba"):
            image[(*at, k)] = held[name].astype(int).to_numpy()
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "x": [pdf["x"].iloc[0]], "y": [pdf["y"].iloc[0]], "png": [png(image)], "n_pixels": [len(held)]})

    source = pixels if tiles is None else tiles.select("z", "x", "y").join(pixels, ["z", "x", "y"], "left")
    return source.groupBy("z", "x", "y").applyInPandas(draw, "z int, x long, y long, png binary, n_pixels long")


def _pixel_cells(z: int, x: int, y: int, meta: GridMeta, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's pixels over the grid, numbered row by row, their places and the rows and columns of the cells under their centres."""
    n, at = 2.0**z, (np.arange(size) + 0.5) / size
    lon = (x + at) / n * 360 - 180
    lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (y + at) / n))))
    zone, south = (meta.epsg - 32600, False) if meta.epsg <= 32660 else (meta.epsg - 32700, True)
    east, north = g.transverse(np, lon[None, :], lat[:, None], zone)
    row = np.floor((meta.origin_y - (north + g.FALSE_NORTHING_SOUTH * south)) / meta.cell_size)
    col = np.floor((east - meta.origin_x) / meta.cell_size)
    held = np.flatnonzero(((row >= 0) & (row < meta.height) & (col >= 0) & (col < meta.width)).ravel())
    return held, row.ravel()[held].astype(np.int64), col.ravel()[held].astype(np.int64)


def draw_tiles(blocks: DataFrame, tiles: DataFrame, meta: GridMeta, size: int = 256, block: int = BLOCK, hole: tuple[int, int, int] = (0, 0, 0), keep_empty: bool = True) -> DataFrame:
    """(z, x, y, png, n_pixels): Terrain-RGB images of blocks(br, bc, z), each pixel the nearest cell's, as terrain_tiles and encode_tiles make them pixel by pixel.

    Each tile finds the blocks under it; a block's samples for its tiles are taken where it lies, so that only the pixels
    that it fills move, packed, to their tile. Pixels without data have the colour hole and alpha 0. With keep_empty every tile has an image.
    """
    if meta.epsg is None or not (32601 <= meta.epsg <= 32660 or 32701 <= meta.epsg <= 32760):
        raise ValueError(f"EPSG {meta.epsg} is no WGS84 UTM zone")

    def under(batches):
        for pdf in batches:
            found = []
            for z, x, y in pdf.itertuples(index=False):
                _, row, col = _pixel_cells(z, x, y, meta, size)
                found += [(z, x, y, int(k) // columns, int(k) % columns) for k in np.unique(row // block * columns + col // block)]
            yield pd.DataFrame(found, columns=["z", "x", "y", "br", "bc"])

    def sample(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                br, bc = batch.column("br")[k].as_py(), batch.column("bc")[k].as_py()
                heights = array(batch.column("data")[k].as_py(), "z", block)
                for t in batch.column("tiles")[k].as_py():
                    at, row, col = _pixel_cells(t["z"], t["x"], t["y"], meta, size)
                    mine = (row // block == br) & (col // block == bc)
                    v = heights[row[mine] - br * block, col[mine] - bc * block]
                    there = ~np.isnan(v)
                    code = np.floor((v[there] + 10000) * 10 + 0.5).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([t["z"]], pa.int32()), pa.array([t["x"]], pa.int64()), pa.array([t["y"]], pa.int64()), pa.array([at[mine][there].astype("<u4").tobytes()], pa.binary()), pa.array([code.tobytes()], pa.binary())], ["z", "x", "y", "at", "code"])

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        image = np.zeros((size * size, 4), np.uint8)
        image[:, :3] = hole
        n = 0
        for at, code in zip(table.column("at").to_pylist(), table.column("code").to_pylist()):
            if at is not None:
                where, value = np.frombuffer(at, "<u4"), np.frombuffer(code, "<u4")
                image[where] = np.stack([value >> 16 & 255, value >> 8 & 255, value & 255, np.full(len(value), 255)], 1)
                n += len(where)
        names = ["z", "x", "y", "png", "n_pixels"]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([key[2].as_py()], pa.int64()), pa.array([png(image.reshape(size, size, 4))], pa.binary()), pa.array([n], pa.int64())], names)

    columns = -(-meta.width // block)
    wanted = tiles.select("z", "x", "y").distinct()
    pairs = wanted.mapInPandas(under, "z int, x long, y long, br int, bc int").groupBy("br", "bc").agg(F.collect_list(F.struct("z", "x", "y")).alias("tiles"))  # the tiles over one block
    taken = pairs.join(blocks.select("br", "bc", F.col("z").alias("data")), ["br", "bc"]).mapInArrow(sample, "z int, x long, y long, at binary, code binary")
    if keep_empty:
        taken = taken.unionByName(wanted.select("z", "x", "y", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("code")))
    return taken.groupBy("z", "x", "y").applyInArrow(draw, "z int, x long, y long, png binary, n_pixels long")


def summary(tiles: DataFrame) -> DataFrame:
    """One row: tiles written, those without a pixel, bytes in all and on average."""
    return tiles.agg(F.count(F.lit(1)).alias("n_tiles"), F.sum((F.col("n_pixels") == 0).cast("long")).alias("n_empty"), F.sum(F.length("png")).alias("bytes"), F.avg(F.length("png")).alias("mean_bytes"))


def elevation_at(places: DataFrame, pixels: DataFrame, zoom: int, encoding: str = "mapbox") -> DataFrame:
    """places(id, lon, lat) with the elevation of the pixel that they fall on; null for no tile, no pixel or alpha 0.

    The places' tiles are found first; pixels(z, x, y, px, py, r, g, b, a) is then read by one join.
    """
    at = places.withColumn("t", g.tile_for(F.col("lon"), F.col("lat"), F.lit(zoom)))
    keyed = at.select(*places.columns, "t.x", "t.y", "t.px", "t.py")
    decode = {"mapbox": decode_mapbox, "terrarium": decode_terrarium}[encoding]
    here = pixels.where((F.col("z") == zoom) & (F.col("a") > 0)).select("x", "y", "px", "py", decode(F.col("r"), F.col("g"), F.col("b")).alias("elevation"))
    return keyed.join(here, ["x", "y", "px", "py"], "left").select(*places.columns, "elevation")


def write_tiles(tiles: DataFrame, folder: str, keep_empty: bool = True) -> DataFrame:
    """Write tiles(z, x, y, png, n_pixels) as folder/z/x/y.png, from the tasks; (z, x, y, bytes) of those written.

    With keep_empty a pyramid stays gapless; without it tiles that hold no pixel aren't written. A tile written twice is the same file.
    """
    from terravela.sources.files import write_bytes

    def run(batches):
        for pdf in batches:
            for z, x, y, data in pdf[["z", "x", "y", "png"]].itertuples(index=False):
                write_bytes(f"{folder}/{z}/{x}/{y}.png", bytes(data))
            yield pd.DataFrame({"z": pdf["z"], "x": pdf["x"], "y": pdf["y"], "bytes": [len(d) for d in pdf["png"]]})

    return cut((tiles if keep_empty else tiles.where("n_pixels > 0")).select("z", "x", "y", "png").mapInPandas(run, "z int, x long, y long, bytes long"))


def read_png(data: bytes) -> np.ndarray | None:
    """Height x width x 4 bytes of an 8-bit RGB or RGBA PNG that isn't interlaced; None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, body = 8, b"", b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        head, body = (data[at + 8 : at + 8 + n], body) if kind == b"IHDR" else (head, body + data[at + 8 : at + 8 + n] if kind == b"IDAT" else body)
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (2, 6) or interlaced:
        return None
    step = 3 if colour == 2 else 4
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out, above = np.empty((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:])):
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = line + above
        else:  # average and Paeth need each pixel's left neighbour
            now = np.zeros_like(line)
            for i in range(len(line)):
                a, b, c = (int(now[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
                guess = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[i] = (int(line[i]) + guess) & 255
        out[y], above = now, now
    image = out.reshape(height, width, step)
    return image if step == 4 else np.concatenate([image, np.full((height, width, 1), 255, np.uint8)], 2)


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """tiles(z, x, y, png) -> (z, x, y, px, py, r, g, b, a): every pixel with alpha; a tile that can't be read has none."""

    def run(batches):
        for pdf in batches:
            for z, x, y, data in pdf.itertuples(index=False):
                image = read_png(bytes(data)) if data is not None else None
                if image is not None:
                    py, px = np.nonzero(image[..., 3])
                    r, g, b, a = image[py, px].T.astype(np.int32)
                    yield pd.DataFrame({"z": z, "x": x, "y": y, "px": px, "py": py, "r": r, "g": g, "b": b, "a": a})

    return tiles.select("z", "x", "y", "png").mapInPandas(run, "z int, x long, y long, px int, py int, r int, g int, b int, a int")


def zoom_range(deepest: int, levels: int = 6) -> range:
    return range(max(0, deepest - levels), deepest + 1)


def clamp_zoom(zoom: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), zoom))
