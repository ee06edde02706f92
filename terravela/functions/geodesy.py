"""Projections and tiles as Column expressions (WGS84, UTM, Web Mercator)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravela.functions.geometry import path_length, polygon_area

#: The WGS84 ellipsoid, UTM's scale and offsets, and the sphere of Web Mercator.
A, FLATTENING, K0, FALSE_EASTING, FALSE_NORTHING_SOUTH, SPHERE = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0, 6378137.0
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
#: Metres in a pixel of a 256-pixel tile at zoom 0 on the equator; metres in a degree for areas.
METRES_PER_PIXEL_0, METRES_PER_DEGREE_X, METRES_PER_DEGREE_Y = 156543.03392, 111320.0, 110540.0


def central_meridian(zone: Column) -> Column:
    return zone * 6 - 183


def utm_zone(epsg: Column) -> Column:
    """Zone of a WGS84 UTM EPSG code, null for any other code."""
    return F.when(epsg.between(32601, 32660), epsg - 32600).when(epsg.between(32701, 32760), epsg - 32700)


def utm_is_north(epsg: Column) -> Column:
    return F.when(epsg.between(32601, 32660), True).when(epsg.between(32701, 32760), False)


def transverse(fn, lon, lat, zone):
    """Easting, and northing from the equator, by the transverse Mercator series; fn is pyspark.sql.functions for columns or numpy for arrays."""
    phi, lam = fn.radians(lat), fn.radians(lon - central_meridian(zone))
    sin, cos, tan = fn.sin(phi), fn.cos(phi), fn.tan(phi)
    n = A / fn.sqrt(1 - E2 * sin * sin)
    t, c, a = tan * tan, EP2 * cos * cos, lam * cos
    m = A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * fn.sin(2 * phi) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * fn.sin(4 * phi) - (35 * E2**3 / 3072) * fn.sin(6 * phi))
    east = K0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * a**5 / 120) + FALSE_EASTING
    return east, K0 * (m + n * tan * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * a**6 / 720))


def lon_lat_to_utm(lon: Column, lat: Column, zone: Column, northern: Column) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series."""
    east, north = transverse(F, lon, lat, zone)
    return east, north + F.when(northern, 0.0).otherwise(FALSE_NORTHING_SOUTH)


def _foot(north: Column, northern: Column) -> Column:
    """Latitude on the central meridian with the same northing."""
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    m = (north - F.when(northern, 0.0).otherwise(FALSE_NORTHING_SOUTH)) / K0
    mu = m / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    return mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)


def _terms(east: Column, sin: Column, cos: Column, tan: Column) -> tuple[Column, Column, Column, Column]:
    root = F.sqrt(1 - E2 * sin * sin)
    return root, tan * tan, EP2 * cos * cos, (east - FALSE_EASTING) / (A / root * K0)


def _beside_foot(phi: Column, cos: Column, tan: Column, root: Column, t: Column, c: Column, d: Column, zone: Column) -> tuple[Column, Column]:
    n, r = A / root, A * (1 - E2) / (root * root * root)
    lat = phi - n * tan / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120) / cos
    return central_meridian(zone) + F.degrees(lon), F.degrees(lat)


def utm_to_lon_lat(east: Column, north: Column, zone: Column, northern: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees by the inverse series."""
    phi = _foot(north, northern)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    return _beside_foot(phi, cos, tan, *_terms(east, sin, cos, tan), zone)


def utm_points_to_lon_lat(points: Column, zone: Column, northern: Column) -> Column:
    """Array of struct<lon, lat> of an array of struct<x, y>, with the doubles of utm_to_lon_lat.

    Expressions inside a lambda aren't shared, so that each step is a pass of its own: written in one, the latitude on the
    central meridian would be computed some hundred times a point.
    """
    feet = F.transform(points, lambda p: F.struct(p["x"].alias("x"), _foot(p["y"], northern).alias("phi")))
    angles = F.transform(feet, lambda p: F.struct(p["x"].alias("x"), p["phi"].alias("phi"), F.sin(p["phi"]).alias("sin"), F.cos(p["phi"]).alias("cos"), F.tan(p["phi"]).alias("tan")))
    terms = F.transform(angles, lambda p: F.struct(*[p[k].alias(k) for k in ("phi", "cos", "tan")], *[v.alias(k) for k, v in zip(("root", "t", "c", "d"), _terms(p["x"], p["sin"], p["cos"], p["tan"]))]))
    return F.transform(terms, lambda p: F.struct(*[v.alias(k) for k, v in zip(("lon", "lat"), _beside_foot(*[p[k] for k in ("phi", "cos", "tan", "root", "t", "c", "d")], zone))]))


def lon_lat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * SPHERE, F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * SPHERE


def mercator_to_lon_lat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SPHERE), F.degrees(2 * F.atan(F.exp(y / SPHERE)) - F.pi() / 2)


def tile_fraction(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Tile coordinates with fractions."""
    n = F.pow(F.lit(2.0), zoom)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n


def tile_for(lon: Column, lat: Column, zoom: Column, size: int = 256) -> Column:
    """Struct of the tile (x, y) that holds a coordinate and the pixel (px, py) in it, clamped to the tile."""
    fx, fy = tile_fraction(lon, lat, zoom)

    def pixel(f):
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((f - F.floor(f)) * size).cast("int")))

    return F.struct(F.floor(fx).cast("long").alias("x"), F.floor(fy).cast("long").alias("y"), pixel(fx).alias("px"), pixel(fy).alias("py"))


def tile_range(west: Column, south: Column, east: Column, north: Column, zoom: Column) -> Column:
    """Struct of the first and last tile columns and rows over a box."""
    x0, y0 = tile_fraction(west, north, zoom)
    x1, y1 = tile_fraction(east, south, zoom)
    return F.struct(F.floor(x0).cast("long").alias("x0"), F.floor(x1).cast("long").alias("x1"), F.floor(y0).cast("long").alias("y0"), F.floor(y1).cast("long").alias("y1"))


def tile_bounds(x: Column, y: Column, zoom: Column) -> Column:
    """Struct of a tile's west, south, east and north in degrees."""
    n = F.pow(F.lit(2.0), zoom)

    def lat(row):
        return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * row / n))))

    return F.struct((x / n * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / n * 360 - 180).alias("east"), lat(y).alias("north"))


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return METRES_PER_PIXEL_0 * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def mercator_area_inflation(lat: Column) -> Column:
    return 1 / F.pow(F.cos(F.radians(lat)), 2)


def native_zoom(west: Column, east: Column, width: Column, deepest: int = 24) -> Column:
    """Deepest zoom at which a box isn't wider in pixels than its source, 0 if there is none."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(deepest)), lambda z: (east - west) / 360 * 256 * F.pow(F.lit(2.0), z) <= width)
    return F.coalesce(F.array_max(fits), F.lit(0))


def box_hectares(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area of a box by a local metric approximation at its middle latitude."""
    wide = (east - west) * METRES_PER_DEGREE_X * F.cos(F.radians((south + north) / 2))
    return wide * (north - south) * METRES_PER_DEGREE_Y / 10000


def scale_world(px_width: Column, px_height: Column, origin_x: Column, origin_y: Column, from_size: tuple[Column, Column], to_size: tuple[Column, Column]) -> Column:
    """A world file's values for a raster resized to other columns and rows, its outer edges where they were."""
    w, h = px_width * from_size[0] / to_size[0], px_height * from_size[1] / to_size[1]
    return F.struct(w.alias("px_width"), h.alias("px_height"), (origin_x - px_width / 2 + w / 2).alias("origin_x"), (origin_y - px_height / 2 + h / 2).alias("origin_y"))


def raster_corners(px_width: Column, px_height: Column, origin_x: Column, origin_y: Column, width: Column, height: Column, zone: Column, northern: Column) -> Column:
    """array<struct<lon, lat>>: top left, top right, bottom right and bottom left of a raster whose origin is its first pixel's centre; px_height is negative."""
    west, north = origin_x - px_width / 2, origin_y - px_height / 2
    east, south = west + width * px_width, north + height * px_height

    def at(e, n):
        lon, lat = utm_to_lon_lat(e, n, zone, northern)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return F.array(at(west, north), at(east, north), at(east, south), at(west, south))


def _projected(points: Column, zone: Column, northern: Column) -> Column:
    def place(p):
        east, north = lon_lat_to_utm(p["lon"], p["lat"], zone, northern)
        return F.struct(east.alias("x"), north.alias("y"))

    return F.transform(points, place)


def lon_lat_length(points: Column, zone: Column, northern: Column) -> Column:
    """Metres along array<struct<lon, lat>>, in the UTM zone; 0 with fewer than two points."""
    return path_length(_projected(points, zone, northern))


def lon_lat_area(points: Column, zone: Column, northern: Column) -> Column:
    """Square metres of a ring of array<struct<lon, lat>>, closed or not, in the UTM zone; 0 with fewer than three points."""
    return F.when(F.size(points) < 3, 0.0).otherwise(polygon_area(_projected(points, zone, northern)))


def measured(points: Column, area: bool, zone: Column, northern: Column) -> Column:
    """struct<length, area> of a drawn line or, with area, of the ring it closes to; null with fewer than two points."""
    line = F.when(F.lit(area) & (F.size(points) > 2), F.concat(points, F.slice(points, 1, 1))).otherwise(points)
    found = F.struct(lon_lat_length(line, zone, northern).alias("length"), (lon_lat_area(points, zone, northern) if area else F.lit(0.0)).alias("area"))
    return F.when(F.size(points) >= 2, found)
