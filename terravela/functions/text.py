"""Names, titles and formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of well-known file stems.
KNOWN_TITLES = {
    "topographic-survey-report": "Topographic Survey Report",
    "topographic-survey": "Topographic Survey Report",
    "contour-map": "Contour Map",
    "point-cloud-summary": "LiDAR Point Cloud, survey summary",
    "volume-analysis": "Volume Analysis Report",
    "orthomosaic-sheet": "Orthomosaic Sheet",
    "ortho": "Orthomosaic preview",
    "dsm": "DSM preview",
    "dtm": "DTM preview",
    "contours": "Contours over orthomosaic",
    "grid": "Survey Elevation Grid",
}
#: Layer titles by the first pattern that a lower-case stem with spaces matches.
LAYER_TITLES = (
    (r"\b(dsm|dem|surface)\b", "Surface model (DSM)"),
    (r"\b(dtm|terrain|bare.?earth)\b", "Terrain model (DTM)"),
    (r"contour", "Contours"),
    (r"ortho|mosaic|rgb", "Orthomosaic"),
    (r"ndvi", "Vegetation index (NDVI)"),
    (r"hillshade|shade", "Hillshade"),
    (r"drainage", "Drainage"),
    (r"gcp|control", "Ground control"),
)
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def spaced(stem: Column) -> Column:
    """Underscores and hyphens as single spaces."""
    return F.trim(F.regexp_replace(stem, r"[_\-\s]+", " "))


def title_for(stem: Column) -> Column:
    """A known title, else the stem spaced with each word's first letter upper case and the rest as it was."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN_TITLES.items() for x in pair])
    words = F.transform(F.split(spaced(stem), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    return F.coalesce(F.try_element_at(known, F.lower(stem)), F.array_join(words, " "))


def layer_title(stem: Column) -> Column:
    n, out = F.regexp_replace(F.lower(stem), "[_-]+", " "), None
    for pattern, title in LAYER_TITLES:
        out = F.when(n.rlike(pattern), title) if out is None else out.when(n.rlike(pattern), title)
    return out.otherwise(spaced(stem))


def slugify(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(value)), "[^a-z0-9]+", "-"), "^-|-$", "")


def leading_number(value: Column) -> Column:
    """A number, or the first one in a text such as "338 m"; null without one (an empty text too)."""
    found = F.regexp_extract(value, r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(value.try_cast("double"), found.try_cast("double"))


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def format_distance(metres: Column) -> Column:
    return (
        F.when(metres < 1, F.concat(_fixed(metres * 100, 0), F.lit(" cm")))
        .when(metres < 100, F.concat(_fixed(metres, 2), F.lit(" m")))
        .when(metres < 1000, F.concat(_fixed(metres, 1), F.lit(" m")))
        .otherwise(F.concat(_fixed(metres / 1000, 3), F.lit(" km")))
    )


def format_area(square_metres: Column) -> Column:
    return (
        F.when(square_metres < 100, F.concat(_fixed(square_metres, 2), F.lit(" m²")))
        .when(square_metres < 10000, F.concat(_fixed(square_metres, 1), F.lit(" m²")))
        .when(square_metres < 1000000, F.concat(_fixed(square_metres / 10000, 3), F.lit(" ha")))
        .otherwise(F.concat(_fixed(square_metres / 1000000, 4), F.lit(" km²")))
    )


def format_elevation(metres: Column, tolerance: float = 0.04) -> Column:
    return F.concat(_fixed(metres, 2), F.lit(f" m ±{tolerance * 100:.0f} cm"))


def safe_filename(name: Column) -> Column:
    """Without control characters, quotes and backslashes; others beyond ASCII as _; 120 characters at most."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f\x7f"\\]', ""), r"[^\x20-\x7e]", "_"))
    return F.coalesce(F.nullif(F.substring(cleaned, 1, 120), F.lit("")), F.lit("file"))


def client_ip(forwarded: Column) -> Column:
    """The last hop that isn't empty of a comma-separated list, null if there is none."""
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda h: F.trim(h)), lambda h: h != "")
    return F.when(F.size(hops) > 0, F.element_at(hops, -1))


def wrap(text: Column, width: int) -> Column:
    """Greedy word wrap: an array of lines; a longer word has a line of its own."""

    def step(lines, word):
        last = F.element_at(lines, -1)
        joins = F.length(last) + 1 + F.length(word) <= width
        return F.when(F.size(lines) == 0, F.array(word)).when(joins, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"), step)


def parse_coordinates(text: Column) -> Column:
    """Points from "E,N E,N" or "E,N;E,N"; fails on a pair that isn't two numbers."""

    def pair(token):
        x, y = F.get(F.split(token, ","), F.lit(0)).try_cast("double"), F.get(F.split(token, ","), F.lit(1)).try_cast("double")
        return F.struct(F.coalesce(x, F.raise_error("not a coordinate pair").cast("double")).alias("x"), F.coalesce(y, F.raise_error("not a coordinate pair").cast("double")).alias("y"))

    return F.transform(F.filter(F.split(F.trim(text), r"[;\s]+"), lambda t: t != ""), pair)


def percent(share: Column) -> Column:
    return F.concat(_fixed(share * 100, 1), F.lit("%"))


def valid_slug(value: Column) -> Column:
    return F.coalesce(value.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(False))


def valid_email(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))


def valid_uuid(value: Column) -> Column:
    return F.coalesce(F.lower(value).rlike(UUID_PATTERN), F.lit(False))


def grouped_digits(n: Column) -> Column:
    """A whole number with its digits in the Indian groups: the last three, then twos."""
    return F.regexp_replace(n.cast("string"), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")


def iso_date(value: Column) -> Column:
    """A date as YYYY-MM-DD, null for null."""
    return F.date_format(value, "yyyy-MM-dd")


def iso_instant(value: Column) -> Column:
    """A timestamp in UTC as YYYY-MM-DDThh:mm:ss.mmmZ; the session's time zone must be UTC."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
