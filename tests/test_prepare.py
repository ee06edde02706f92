"""Publication in versions, and the preparation of a site's folder."""

import json
import struct

import pytest

from terravela.operators.grid import GridMeta
from terravela.plans import prepare
from terravela.sources.geotiff import write_geotiff
from terravela.sources.published import current_version, publish_version, read_published


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "site")
    with pytest.raises(ValueError, match="nothing"):
        read_published(spark, root, "a")
    one = publish_version({"a": spark.range(3), "b": spark.range(4)}, root)
    broken = spark.range(5).selectExpr("raise_error('lost') AS id")
    with pytest.raises(Exception, match="lost"):
        publish_version({"a": spark.range(9), "b": broken}, root)
    assert current_version(root) == one and read_published(spark, root, "a").count() == 3
    two = publish_version({"a": spark.range(7), "b": spark.range(1)}, root, base=one)
    assert current_version(root) == two and read_published(spark, root, "a").count() == 7 and read_published(spark, root, "a", one).count() == 3
    with pytest.raises(ValueError, match="another version"):
        publish_version({"a": spark.range(2)}, root, base=one)
    assert current_version(root) == two


def dbf(heights):
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(heights), 32 + 32 + 1, 11) + b"ELEV".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([10, 2]) + b"\0" * 14 + b"\r"
    return head + b"".join(b" " + f"{h:10.2f}".encode() for h in heights) + b"\x1a"


def test_a_folder_becomes_a_published_site(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    m = GridMeta(24, 18, 2.0, 300000.0, 2500036.0, epsg=32643)
    cells = spark.createDataFrame([(r, c, 100 + abs(c - 10) * 0.5 - r * 0.05) for r in range(18) for c in range(24)], "row int, col int, v double")
    write_geotiff(cells, m, str(folder / "Site DTM.tif"))
    (folder / "plan.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0))
    line = struct.pack("<i4dii", 3, 0, 0, 9, 9, 1, 3) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", 300000.0 + x, 2500000.0 + y) for x, y in ((0, 0), (10, 9), (20, 1)))
    (folder / "lines.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(line) // 2) + line)
    (folder / "lines.dbf").write_bytes(dbf([338.0]))
    layers = {r["key"]: r for r in prepare.prepare_site(spark, str(folder), out, "quarry", levels=1, threshold=20).collect()}
    assert {k: layers[k]["kind"] for k in ("site-dtm", "terrain-filled", "lines", "plan")} == {"site-dtm": "elevation", "terrain-filled": "product", "lines": "contours", "plan": "imagery"}
    assert layers["terrain-filled"]["n"] == 432 and layers["lines"]["n"] == 1 and layers["site-dtm"]["max_zoom"] - layers["site-dtm"]["min_zoom"] == 1 and layers["site-dtm"]["n"] > 0
    feature = json.loads(spark.read.text(layers["lines"]["place"]).first()["value"])
    assert feature["properties"]["elevation"] == 338.0 and len(feature["geometry"]["coordinates"]) == 3
    assert read_published(spark, out, "layers").count() == len(layers) and read_published(spark, out, "files").count() == 4
    first = current_version(out)
    monkeypatch.setattr(prepare.vector, "contours", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        prepare.prepare_site(spark, str(folder), out, "quarry", levels=0, threshold=20)
    assert current_version(out) == first
