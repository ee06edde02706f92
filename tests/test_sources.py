import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravela.operators.grid import GridMeta
from terravela.sources import exports, geotiff, survey_files
from terravela.sources.geotiff import lzw_decode, read_meta, tiff_header, write_geotiff


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    survey_files.register(spark)


def grid_values(df):
    return {(r["row"], r["col"]): r["v"] for r in df.collect()}


def test_a_grid_comes_back_from_its_geotiff(spark, tmp_path):
    m = GridMeta(7, 600, 2.5, 300000.0, 2500000.0, epsg=32643)
    cells = spark.range(7 * 600).selectExpr("cast(id div 7 as int) AS row", "cast(id % 7 as int) AS col", "if(id % 11 = 0, null, cast(id / 4.0 as double)) AS v").where("row < 300 OR row > 560")
    write_geotiff(cells, m, str(tmp_path / "a.tif"))
    assert read_meta(str(tmp_path / "a.tif")) == m
    got = grid_values(spark.read.format("geotiff").option("cells_per_part", 2000).load(str(tmp_path / "a.tif")))
    want = grid_values(cells)
    assert len(got) == 4200 and all(v == want.get(k) for k, v in got.items())


def lzw_encode(data):
    """Codes of a growing table, packed from the high bit, widening a code early."""
    out, bits, width, table = 0, 0, 9, {bytes([i]): i for i in range(256)}

    def put(code):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256)
    size, word = 258, b""
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = size
        size += 1
        if size + 1 > (1 << width) and width < 12:
            width += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word])
        size += 1
        if size + 1 > (1 << width) and width < 12:
            width += 1
    put(257)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaaaaaaaaaaa", bytes(range(256)) * 40, bytes(np.random.default_rng(1).integers(0, 4, 30_000, dtype=np.uint8)), bytes(np.random.default_rng(2).integers(0, 256, 9_000, dtype=np.uint8))])
def test_lzw(data):
    assert lzw_decode(lzw_encode(data), len(data)) == data


def test_other_tiffs_are_refused_by_name(tmp_path):
    head, _ = tiff_header(GridMeta(4, 4, epsg=32643), 1, 4)
    bad = bytearray(head + b"\0" * 64)
    at = 10 + 12 * 3 + 8  # the value of the fourth field, the compression
    bad[at : at + 2] = struct.pack("<H", 8)
    (tmp_path / "b.tif").write_bytes(bad)
    with pytest.raises(ValueError, match="its compression"):
        read_meta(str(tmp_path / "b.tif"))
    (tmp_path / "c.tif").write_bytes(b"II+\0" + b"\0" * 20)
    with pytest.raises(ValueError, match="classic"):
        read_meta(str(tmp_path / "c.tif"))


@pytest.mark.parametrize("top_down", [True, False])
def test_saga(spark, tmp_path, top_down):
    values = np.arange(12, dtype="<f4").reshape(3, 4)
    values[1, 2] = -99999
    (tmp_path / "g.sgrd").write_text(f"NAME\t= x\nDATAFORMAT\t= FLOAT\nBYTEORDER_BIG\t= FALSE\nPOSITION_XMIN\t= 100.5\nPOSITION_YMIN\t= 200.5\nCELLCOUNT_X\t= 4\nCELLCOUNT_Y\t= 3\nCELLSIZE\t= 1\nZ_FACTOR\t= 2\nNODATA_VALUE\t= -99999;-99999\nTOPTOBOTTOM\t= {str(top_down).upper()}\n")
    (tmp_path / "g.sdat").write_bytes((values if top_down else values[::-1]).tobytes())
    got = grid_values(spark.read.format("saga").load(str(tmp_path / "g.sgrd")))
    assert got == {(r, c): None if (r, c) == (1, 2) else 2.0 * values[r, c] for r in range(3) for c in range(4)}
    m, _ = survey_files.saga_header(str(tmp_path / "g.sgrd"))
    assert (m.origin_x, m.origin_y) == (100.0, 203.0)


def dbf_bytes(rows):
    fields = [(b"NAME", b"C", 8), (b"ELEV", b"N", 6)]
    head = struct.pack("<BBBBIHH", 3, 24, 1, 1, len(rows), 33 + 32 * 2, 15) + b"\0" * 20
    head += b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, t, w in fields) + b"\r"
    return head + b"".join(flag + n.encode().ljust(8) + e.encode().rjust(6) for flag, n, e in rows)


def test_dbf_and_shapefile_join_by_place(spark, tmp_path):
    (tmp_path / "s.dbf").write_bytes(dbf_bytes([(b" ", "a", "12.5"), (b"*", "b", ""), (b" ", "338 m", "7")]))
    got = [tuple(r) for r in spark.read.format("dbf").load(str(tmp_path / "s.dbf")).orderBy("rec").collect()]
    assert got == [(0, "a", "a", 12.5, "12.5"), (1, "b", "b", None, ""), (2, "338 m", "338 m", 7.0, "7")]

    def record(k, content):
        return struct.pack(">II", k, len(content) // 2) + content

    points = [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0), (9.0, 9.0), (8.0, 8.0)]
    line = struct.pack("<i4dii", 13, 0, 0, 9, 9, 2, 5) + struct.pack("<2i", 0, 3) + b"".join(struct.pack("<dd", *p) for p in points) + b"\0" * 56
    dot = struct.pack("<idd", 1, 5.0, 6.0)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + record(1, line) + record(2, dot) + record(3, struct.pack("<i", 0)))
    lines = [tuple(r) for r in spark.read.format("shp").load(str(tmp_path / "s.shp")).orderBy("rec", "part").collect()]
    assert [(r, p, None if q is None else [tuple(x) for x in q]) for r, p, q in lines] == [(0, 0, points[:3]), (0, 1, points[3:]), (1, None, None), (2, None, None)]
    dots = spark.read.format("shp").option("geometry", "point").load(str(tmp_path / "s.shp")).where("part IS NOT NULL").collect()
    assert [(r["rec"], tuple(r["points"][0])) for r in dots] == [(1, (5.0, 6.0))]


def test_las(spark, tmp_path):
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    head[58:66] = b"writer\0\0"
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<BHI", head, 104, 1, 28, 0)
    struct.pack_into("<6d", head, 179, 9, 1, 8, 2, 7, 3)
    struct.pack_into("<Q", head, 247, 1000)
    (tmp_path / "p.las").write_bytes(bytes(head) + b"".join(b"\0" * 15 + bytes([i % 5 | 96]) + b"\0" * 12 for i in range(1000)))
    row = spark.read.format("las").load(str(tmp_path / "p.las")).first()
    assert (row["version"], row["software"], row["count"], row["min_x"], row["max_z"]) == ("1.4", "writer", 1000, 1.0, 7.0)
    sampled = spark.read.format("las").option("mode", "points").option("sample", 250).load(str(tmp_path / "p.las")).collect()
    assert sorted(r["idx"] for r in sampled) == list(range(0, 1000, 4)) and all(r["cls"] == r["idx"] % 5 for r in sampled)
    shares = survey_files.class_histogram(spark.createDataFrame(sampled)).collect()
    assert sum(r["share"] for r in shares) == pytest.approx(1)


def test_sidecars_and_tables(spark, tmp_path):
    (tmp_path / "a.tfw").write_text("0.5\n0\n0\n-0.5\n100.25\n199.75\n")
    row = survey_files.world_file(spark, str(tmp_path / "a.tfw")).first()
    assert tuple(row) == (0.5, 100.0, 200.0)
    (tmp_path / "a.prj").write_text('PROJCS["WGS_1984_UTM_Zone_43N",GEOGCS[...]]')
    assert tuple(survey_files.projection(spark, str(tmp_path / "a.prj")).first()) == (43, True)
    (tmp_path / "g.csv").write_text('x,Y,"Elev, m"\n1,2,3.5\n1,3,\n4,5,"6"\n')
    assert sorted(map(tuple, survey_files.csv_grid(spark, str(tmp_path / "g.csv")).collect())) == [(1.0, 2.0, 3.5), (4.0, 5.0, 6.0)]
    rows, more = survey_files.csv_preview(spark, str(tmp_path / "g.csv"), 2)
    assert rows.count() == 2 and more
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":[{"geometry":{"type":"LineString","coordinates":[[72.1,19.0],[72.2,19.1]]},"properties":{"elevation":5}},{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"elevation":1}},{"geometry":{"type":"LineString","coordinates":[]},"properties":{}}]}')
    lines = survey_files.geojson_lines(spark, str(tmp_path / "c.geojson")).collect()
    assert [(r["elevation"], r["coordinates"]) for r in lines] == [(5.0, [[72.1, 19.0], [72.2, 19.1]])]


def test_exports(spark):
    points = spark.createDataFrame([(1, None, 500000.25, 2000000.5, 12.3456), (2, 'a "b", & <c>', 500001.0, 2000001.0, None)], "seq long, name string, easting double, northing double, elevation double")
    lines = lambda df: [r["line"] for r in exports.ordered(df).collect()]
    assert lines(exports.points_txt(points)) == ["1 500000.250 2000000.500 12.346", 'a "b", & <c> 500001.000 2000001.000 ']
    assert lines(exports.points_csv(points, 32643))[-2:] == ["1,500000.250,2000000.500,12.346", '"a ""b"", & <c>",500001.000,2000001.000,']
    dxf = lines(exports.points_dxf(points))
    assert dxf[:4] == ["0", "SECTION", "2", "ENTITIES"] and dxf.count("POINT") == 1 and dxf[-2:] == ["0", "EOF"] and "500000.4500" in dxf
    assert lines(exports.line_dxf(points, closed=True)).count("VERTEX") == 2
    xml = lines(exports.points_landxml(points.withColumn("elevation", F.lit(1.0)), 32643))
    assert '   <CgPoint name="a &quot;b&quot;, &amp; &lt;c&gt;">2000001.0000 500001.0000 1.0000</CgPoint>' in xml and xml[-1] == "</LandXML>"
    profile = points.selectExpr("seq", "0.0D AS chainage", "easting", "northing", "elevation", "null AS slope_percent")
    assert lines(exports.profile_csv(profile, 32643, 80.0, 2.5))[4] == "0.000,500000.250,2000000.500,12.346,"
    with pytest.raises(ValueError, match="EPSG"):
        exports.points_csv(points, 0)
    assert 'PARAMETER["Central_Meridian",75.0]' in spark.range(1).select(exports.prj(F.lit(32643)).alias("w")).first()["w"]
    with pytest.raises(Exception, match="UTM"):
        spark.range(1).select(exports.prj(F.lit(4326))).collect()
    assert geotiff.NODATA == -99999.0


def test_a_shapefile_with_an_index_is_read_in_parts(spark, tmp_path):
    rng, contents = np.random.default_rng(3), []
    for k in range(40):
        n = int(rng.integers(2, 30))
        xy = rng.normal(size=(n, 2))
        contents.append(struct.pack("<i", 0) if k % 9 == 4 else struct.pack("<i4dii", 3, 0, 0, 9, 9, 1, n) + struct.pack("<i", 0) + xy.astype("<f8").tobytes())
    at, body, index = 100, b"", b""
    for k, c in enumerate(contents):
        index += struct.pack(">ii", at // 2, len(c) // 2)
        body += struct.pack(">ii", k + 1, len(c) // 2) + c
        at += 8 + len(c)
    (tmp_path / "alone.shp").write_bytes(b"\0" * 100 + body)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + body)
    (tmp_path / "s.shx").write_bytes(b"\0" * 100 + index)
    read = lambda name: spark.read.format("shp").option("part_bytes", 2000).load(str(tmp_path / name))
    assert read("s.shp").rdd.getNumPartitions() > 2 and read("alone.shp").rdd.getNumPartitions() == 1
    rows = [sorted(map(tuple, read(n).collect())) for n in ("s.shp", "alone.shp")]
    assert rows[0] == rows[1] and len(rows[0]) == 40 and sum(r[2] is None for r in rows[0]) == 4


@pytest.mark.parametrize("sample", [1000, 10])
def test_las_points_near_and_far(spark, tmp_path, monkeypatch, sample):
    monkeypatch.setattr(survey_files, "NEAR_BYTES", 100)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 1, 28, 997)
    struct.pack_into("<6d", head, 179, 11, 1, 8, 3, 7, 3)
    (tmp_path / "p.las").write_bytes(bytes(head) + b"".join(b"\0" * 15 + bytes([i % 13 | 64]) + b"\0" * 12 for i in range(997)))
    got = spark.read.format("las").option("mode", "points").option("sample", sample).load(str(tmp_path / "p.las")).collect()
    assert sorted((r["idx"], r["cls"]) for r in got) == [(i, i % 13) for i in range(0, 997, max(1, 997 // sample))]
    row = survey_files.point_density(spark.read.format("las").load(str(tmp_path / "p.las"))).first()
    assert row["area"] == 50.0 and row["density"] == 997 / 50
    names = {r["cls"]: r["name"] for r in spark.createDataFrame(got).select("cls", survey_files.class_name(F.col("cls")).alias("name")).collect()}
    assert names[0] == "Created, never classified" and sample == 10 or names[2] == "Ground" and names[8] == "Reserved (8)"


def rgb_tiff(planar):
    """A 5 x 4 image of three 8-bit samples in strips of two rows, with a place."""
    pixels = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    strips = [pixels[i : i + 2, :, k].tobytes() for k in range(3) for i in (0, 2)] if planar else [pixels[i : i + 2].tobytes() for i in (0, 2)]
    fields = [(256, 3, (5,)), (257, 3, (4,)), (258, 3, (8, 8, 8)), (259, 3, (1,)), (262, 3, (2,)), (273, 4, [0] * len(strips)), (277, 3, (3,)), (278, 3, (2,)), (279, 4, [len(x) for x in strips]), (284, 3, (2 if planar else 1,)), (33550, 12, (1.0, 1.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 10.0, 20.0, 0.0))]
    sizes = {3: (2, "H"), 4: (4, "I"), 12: (8, "d")}
    at = 8 + 2 + 12 * len(fields) + 4
    begin = at + sum(sizes[k][0] * len(v) for _, k, v in fields if sizes[k][0] * len(v) > 4)
    entries, extra = b"", b""
    for tag, kind, values in fields:
        values = [begin + sum(map(len, strips[:k])) for k in range(len(strips))] if tag == 273 else values
        data = struct.pack("<" + sizes[kind][1] * len(values), *values)
        held = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(extra))
        extra += data if len(data) > 4 else b""
        entries += struct.pack("<HHI", tag, kind, len(values)) + held
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + entries + b"\0" * 4 + extra + b"".join(strips), pixels


@pytest.mark.parametrize("planar", [True, False])
def test_samples_are_read_one_by_one_and_told_from_elevations(spark, tmp_path, planar):
    data, pixels = rgb_tiff(planar)
    (tmp_path / "rgb.tif").write_bytes(data)
    for k in range(3):
        got = spark.read.format("geotiff").option("sample", k).load(str(tmp_path / "rgb.tif")).collect()
        assert {(r["row"], r["col"]): r["v"] for r in got} == {(r, c): float(pixels[r, c, k]) for r in range(4) for c in range(5)}
    with pytest.raises(Exception, match="has 3 samples"):
        spark.read.format("geotiff").option("sample", 3).load(str(tmp_path / "rgb.tif")).collect()
    write_geotiff(spark.createDataFrame([(0, 0, 5.0)], "row int, col int, v double"), GridMeta(3, 2, 1.0, epsg=32643), str(tmp_path / "dem.tif"))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 7, 9, 8, 6, 0, 0, 0))
    (tmp_path / "x.txt").write_bytes(b"no image")
    files = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("rgb.tif", "dem.tif", "i.png", "x.txt", "none.tif")] + [(None,)], "path string")
    kinds = {r["path"].rpartition("/")[2]: tuple(r)[1:] for r in geotiff.raster_class(files).collect()}
    assert kinds == {"rgb.tif": (5, 4, 3, 8, "imagery"), "dem.tif": (3, 2, 1, 32, "elevation"), "i.png": (7, 9, 4, 8, "imagery"), "x.txt": (None,) * 5, "none.tif": (None,) * 5}


def test_a_database_table_is_read_in_ranges(spark, tmp_path):
    from terravela.sources import tables

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).selectExpr("id AS site_id", "concat('site-', id) AS slug")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.format("jdbc").options(url=url, dbtable="sites", **driver).save()
    got = tables.jdbc_table(spark, url, "sites", "site_id", (0, 100), parts=4, **driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(r["slug"] for r in got.collect()) == sorted(f"site-{k}" for k in range(100))
    whole = tables.jdbc_table(spark, url, "(SELECT \"slug\" FROM sites WHERE \"site_id\" < 3) s", **driver)
    assert sorted(r[0] for r in whole.collect()) == ["site-0", "site-1", "site-2"]
