"""Encodings as Column expressions: terrain tiles, direction codes, colour ramps, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ramps as (position, red, green, blue).
ELEVATION_RAMP = ((0.0, 250, 226, 192), (0.35, 229, 142, 58), (0.65, 180, 83, 9), (1.0, 74, 42, 16))
WEB_ELEVATION_RAMP = ((0.0, 12, 44, 92), (0.3, 22, 120, 160), (0.55, 40, 175, 110), (0.75, 220, 200, 70), (1.0, 210, 90, 55))
NDVI_RAMP = ((0.0, 140, 40, 35), (0.35, 200, 150, 50), (0.6, 150, 190, 60), (1.0, 30, 130, 50))
#: Fixed value: the namespace of stable ids.
NAMESPACE = "9f2b7c4e-1d3a-4b6f-8e21-5c7a9d0b4e13"


def encode_elevation(metres: Column) -> Column:
    """Terrain-RGB: tenths of a metre above -10000 m in 24 bits, as struct<r, g, b>."""
    v = F.floor((metres + 10000) * 10 + 0.5).cast("int")
    return F.struct(F.shiftright(v, 16).bitwiseAND(255).alias("r"), F.shiftright(v, 8).bitwiseAND(255).alias("g"), v.bitwiseAND(255).alias("b"))


def decode_mapbox(r: Column, g: Column, b: Column) -> Column:
    return -10000 + (r * 65536 + g * 256 + b) * 0.1


def decode_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def esri_code(direction: Column) -> Column:
    """2 to the power of a direction from 0 to 7, 0 for none."""
    return F.when(direction < 0, 0).otherwise(F.pow(F.lit(2), direction)).cast("int")


def ramp(t: Column, stops: tuple = ELEVATION_RAMP) -> Column:
    """Piecewise linear colour at t, rounded half up: struct<r, g, b>; beyond the last stop its colour."""

    def channel(k):
        value = None
        for a, b in zip(stops, stops[1:]):
            mixed = F.floor(a[k] + (b[k] - a[k]) * ((t - a[0]) / (b[0] - a[0])) + 0.5).cast("int")
            value = F.when(t.between(a[0], b[0]), mixed) if value is None else value.when(t.between(a[0], b[0]), mixed)
        return value.otherwise(stops[-1][k])

    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


def stable_uuid(*parts: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID (version 5) of the parts joined by slashes."""
    named = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(F.concat_ws("/", *parts), "UTF-8"))
    h = F.substring(F.sha1(named), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    fixed = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return F.concat_ws("-", F.substring(fixed, 1, 8), F.substring(fixed, 9, 4), F.substring(fixed, 13, 4), F.substring(fixed, 17, 4), F.substring(fixed, 21, 12))


def digest16(content: Column) -> Column:
    """First sixteen hexadecimal digits of a SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)
