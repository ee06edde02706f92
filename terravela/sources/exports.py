"""Text exports of points and lines, as DataFrames of lines: (ord, line), to be written in order.

Numbers keep a fixed number of decimals. points have (seq, name, easting, northing, elevation); name may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, empty for null."""
    return F.when(value.isNull(), "").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def _label() -> Column:
    return F.coalesce(F.col("name"), F.col("seq").cast("string"))


def csv_cell(text: Column) -> Column:
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _framed(body: DataFrame, before: list[str], after: list[str] = ()) -> DataFrame:
    """body(seq, part, line) between fixed lines."""
    spark = body.sparkSession
    rows = [(i - len(before), 0, line) for i, line in enumerate(before)] + [(2**62 + i, 0, line) for i, line in enumerate(after)]
    return body.select(F.col("seq").cast("long").alias("seq"), F.col("part").cast("int").alias("part"), "line").unionByName(spark.createDataFrame(rows, "seq long, part int, line string"))


def points_csv(points: DataFrame, epsg: int, digits: int = 3, label: str = "Spot levels") -> DataFrame:
    """Spot levels with the CRS in comments; an export without an EPSG code is refused."""
    if not epsg:
        raise ValueError("a CSV without an EPSG code can't be placed")
    line = F.concat_ws(",", csv_cell(_label()), fixed(F.col("easting"), digits), fixed(F.col("northing"), digits), fixed(F.col("elevation"), digits))
    head = [f"# {label}", f"# CRS: EPSG:{epsg}", "# Coordinates are easting and northing in metres, not longitude and latitude.", "point,easting,northing,elevation"]
    return _framed(points.select("seq", F.lit(0).alias("part"), line.alias("line")), head)


def profile_csv(profile: DataFrame, epsg: int, length: float, spacing: float, digits: int = 3) -> DataFrame:
    """profile(seq, chainage, easting, northing, elevation, slope_percent), chainage first."""
    if not epsg:
        raise ValueError("a CSV without an EPSG code can't be placed")
    line = F.concat_ws(",", *[fixed(F.col(c), digits) for c in ("chainage", "easting", "northing", "elevation")], fixed(F.col("slope_percent"), 4))
    head = ["# Cross section", f"# CRS: EPSG:{epsg}", f"# Length {length:.{digits}f} m, sampled every {spacing:g} m", "chainage,easting,northing,elevation,slope_percent"]
    return _framed(profile.select("seq", F.lit(0).alias("part"), line.alias("line")), head)


def points_txt(points: DataFrame, digits: int = 3, delimiter: str = " ") -> DataFrame:
    line = F.concat_ws(delimiter, _label(), fixed(F.col("easting"), digits), fixed(F.col("northing"), digits), fixed(F.col("elevation"), digits))
    return _framed(points.select("seq", F.lit(0).alias("part"), line.alias("line")), [])


def points_dxf(points: DataFrame, layer: str = "SPOT_LEVELS", labels: bool = True, text_height: float = 0.5) -> DataFrame:
    """A POINT, and a TEXT beside it, for each level; those without an elevation are left out."""
    e, n, z = F.col("easting"), F.col("northing"), F.col("elevation")
    pairs = [("0", "POINT"), ("8", layer), ("10", fixed(e, 4)), ("20", fixed(n, 4)), ("30", fixed(z, 4))]
    if labels:
        pairs += [("0", "TEXT"), ("8", f"{layer}_TEXT"), ("10", fixed(e + text_height * 0.4, 4)), ("20", fixed(n, 4)), ("30", fixed(z, 4)), ("40", f"{text_height:g}"), ("1", fixed(z, 2))]
    lines = F.array(*[x if isinstance(x, Column) else F.lit(x) for pair in pairs for x in pair])
    body = points.where("elevation IS NOT NULL").select("seq", F.posexplode(lines).alias("part", "line"))
    return _framed(body, ["0", "SECTION", "2", "ENTITIES"], ["0", "ENDSEC", "0", "EOF"])


def line_dxf(vertices: DataFrame, layer: str = "ALIGNMENT", closed: bool = False) -> DataFrame:
    """vertices(seq, easting, northing, elevation) as a POLYLINE; a null elevation is 0."""
    pairs = [("0", "VERTEX"), ("8", layer), ("10", fixed(F.col("easting"), 4)), ("20", fixed(F.col("northing"), 4)), ("30", fixed(F.coalesce("elevation", F.lit(0.0)), 4))]
    lines = F.array(*[x if isinstance(x, Column) else F.lit(x) for pair in pairs for x in pair])
    head = ["0", "SECTION", "2", "ENTITIES", "0", "POLYLINE", "8", layer, "66", "1", "70", "1" if closed else "0"]
    return _framed(vertices.select("seq", F.posexplode(lines).alias("part", "line")), head, ["0", "SEQEND", "0", "ENDSEC", "0", "EOF"])


def xml_text(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def points_landxml(points: DataFrame, epsg: int, digits: int = 4, name: str = "Spot levels", stamp: str = "2000-01-01T00:00:00") -> DataFrame:
    """Points as northing, easting, elevation; those without an elevation are left out."""
    if not epsg:
        raise ValueError("LandXML without an EPSG code can't be placed")
    date, _, time = stamp.partition("T")
    quoted = name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    line = F.concat(F.lit('   <CgPoint name="'), xml_text(_label()), F.lit('">'), fixed(F.col("northing"), digits), F.lit(" "), fixed(F.col("easting"), digits), F.lit(" "), fixed(F.col("elevation"), digits), F.lit("</CgPoint>"))
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>', f'<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2" date="{date}" time="{time}">', " <Units>",
        '  <Metric areaUnit="squareMeter" linearUnit="meter" volumeUnit="cubicMeter" temperatureUnit="celsius" pressureUnit="milliBars"/>', " </Units>",
        f' <CoordinateSystem epsgCode="{epsg}" horizontalDatum="WGS 84"/>', f' <CgPoints name="{quoted}">',
    ]
    return _framed(points.where("elevation IS NOT NULL").select("seq", F.lit(0).alias("part"), line.alias("line")), head, [" </CgPoints>", "</LandXML>"])


def prj(epsg: Column) -> Column:
    """ESRI's WKT of a WGS84 UTM zone; fails for another code."""
    from terravela.functions.geodesy import central_meridian, utm_is_north, utm_zone

    zone, north = utm_zone(epsg), utm_is_north(epsg)
    text = F.concat(
        F.lit('PROJCS["WGS_1984_UTM_Zone_'), zone.cast("string"), F.when(north, "N").otherwise("S"), F.lit('",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],'),
        F.lit('PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",'), F.when(north, "0.0").otherwise("10000000.0"), F.lit('],PARAMETER["Central_Meridian",'), central_meridian(zone).cast("string"),
        F.lit('.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'),
    )
    return F.when(zone.isNull(), F.raise_error("no WGS84 UTM zone").cast("string")).otherwise(text)


def ordered(lines: DataFrame) -> DataFrame:
    """The lines in order, as (line)."""
    return lines.orderBy("seq", "part").select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text parts whose names sort as their lines do."""
    ordered(lines).write.text(path)
