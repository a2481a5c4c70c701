import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from orbweave.operators import metadata, workloads
from orbweave.operators.proximity import near_join
from orbweave.sources import kml, sinks
from orbweave.sources.load import CannotParseFileExtension, UnsupportedFileType, file_bbox, load_geometries
from orbweave.sources.points import InvalidDelimiter, MissingLatLngField, read_query_points
from orbweave.streaming.near_stream import POINTS, near_stream, radius_stream


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def shp(records, kind, box=(0.0, 0.0, 9.0, 9.0)):
    body = b"".join(struct.pack(">ii", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + struct.pack("<ii4d", 1000, kind, *box) + bytes(32) + body


def dbf(fields, rows):
    head = 32 + 32 * len(fields) + 1
    out = struct.pack("<4xIHH20x", len(rows), head, 1 + sum(n for _, _, n in fields))
    for name, code, n in fields:
        out += name.encode().ljust(11, b"\0") + code.encode() + bytes(4) + bytes([n]) + bytes(15)
    return out + b"\r" + b"".join(b" " + b"".join(r) for r in rows)


def ring(points):
    return b"".join(struct.pack("<dd", *p) for p in points)


def poly(kind, rings):
    n = sum(map(len, rings))
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    return struct.pack("<i4dii", kind, 0, 0, 9, 9, len(rings), n) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(map(ring, rings)) + bytes(16)


GEOJSON = {
    "type": "FeatureCollection", "bbox": [0, 0, 5, 9, 9, 5],
    "features": [
        {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"s": "x", "n": 0.0, "o": {"t": 1}, "z": None, "b": True}},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, "properties": {"s": 5}},
        {"type": "Feature", "id": "c", "geometry": None, "properties": None},
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": []}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}, "properties": {}},
    ],
}
KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Doc</name><Style id="s"/><Folder><Placemark id="7"><name>N</name><color>red</color>
<Point><coordinates>1,2,0</coordinates></Point></Placemark></Folder><Placemark><name>no shape</name></Placemark>
<MultiGeometry><Point><coordinates>3,4</coordinates></Point><LineString><coordinates>0,0 1,1</coordinates></LineString></MultiGeometry>
<Placemark><MultiGeometry><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark><Location><longitude>10</longitude><latitude>20</latitude></Location>
<LinearRing><coordinates>0,0 1,0 1,1</coordinates></LinearRing></Document></kml>"""


def test_geojson(spark, tmp_path):
    path = put(tmp_path, "a.geojson", json.dumps(GEOJSON))
    found = load_geometries(spark, path)
    rows = found.parts.orderBy("find_index", "part_no").collect()
    assert [(r["find_index"], r["part_no"], r["kind"]) for r in rows] == [(0, 0, "Point"), (1, 0, "LineString"), (1, 1, "LineString"), (4, 0, "Polygon")]
    assert rows[0]["props"] == {"s": "x", "n": "0.0", "o": "", "z": "", "b": "true"} and rows[0]["rings"][0][0]["lat"] == 2
    assert sorted((r["index"], r["code"]) for r in found.rejects.collect()) == [(2, "MissingGeometry"), (3, "UnsupportedGeometry")]
    assert file_bbox(spark, path) == [0, 0, 5, 9, 9, 5] and metadata.count(spark, path) == 5
    assert {r["name"]: r["value"] for r in metadata.header(spark, path).collect()} == {"type": "FeatureCollection", "contains": "Point", "bbox": "0.0,0.0,9.0,9.0"}
    assert [tuple(r) for r in metadata.fields(spark, path).collect()] == [("id", "Mixed"), ("b", "Bool"), ("n", "Number"), ("o", "Object"), ("s", "Mixed"), ("z", "Null")]
    data = metadata.data(spark, path, length=2, index=True).collect()
    assert data[0].asDict() == {"index": 0, "id": "a", "b": "true", "n": "0.0", "o": '{"t":1}', "s": "x", "z": "null"} and data[1]["s"] == "5" and data[1]["id"] == ""
    assert [r["index"] for r in metadata.data(spark, path, start=1, length=2, index=True, rebase=True).collect()] == [0, 1]


def test_geojson_bare_geometry(spark, tmp_path):
    path = put(tmp_path, "b.json", '{"type":"Point","coordinates":[5,6]}')
    assert [(r["find_index"], r["kind"], r["props"]) for r in load_geometries(spark, path).parts.collect()] == [(0, "Point", None)]
    with pytest.raises(metadata.TypeDoesNotContainMetadata):
        metadata.fields(spark, path)


def test_kml_and_kmz(spark, tmp_path):
    path = put(tmp_path, "a.kml", KML)
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("doc.kml", KML)
    for where in (path, str(tmp_path / "b.kmz")):
        found = load_geometries(spark, where)
        assert sorted((r["find_index"], r["part_no"], r["kind"]) for r in found.parts.collect()) == [(0, 0, "Point"), (2, 0, "Point"), (2, 1, "LineString"), (4, 0, "Point"), (5, 0, "LineString")]
        assert sorted((r["index"], r["code"]) for r in found.rejects.collect()) == [(1, "MissingGeometry"), (3, "NestedKmlMulti")]
        assert metadata.count(spark, where) == 6
    first = load_geometries(spark, path).parts.where("find_index = 0").first()
    assert first["props"] == {"id": "7", "name": "N", "description": ""}
    place = load_geometries(spark, path).parts.where("find_index = 4").first()["rings"][0][0]
    assert (place["lng"], place["lat"]) == (10, 20)
    assert [tuple(r) for r in metadata.header(spark, path).collect()][:1] == [("name", "Doc")]
    assert [r["name"] for r in metadata.fields(spark, path).collect()] == ["name", "description", "color"]
    assert metadata.data(spark, path).first().asDict() == {"name": "N", "description": "", "color": "red"}
    assert list(kml.items(b"<kml/>")) == []


def test_shapefile(spark, tmp_path):
    outer, hole = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    records = [poly(5, [outer, hole]), struct.pack("<i", 0), struct.pack("<i4di", 8, 0, 0, 9, 9, 2) + ring([(1, 2), (3, 4)]), struct.pack("<idddd", 11, 5, 6, 7, 8), poly(3, [[(0, 0), (1, 1)], [(2, 2), (3, 3)]]), struct.pack("<i", 31)]
    path = put(tmp_path, "a.shp", shp(records, 5))
    fields = [("C1", "C", 4), ("N1", "N", 5), ("L1", "L", 1), ("D1", "D", 8), ("I1", "I", 4), ("T1", "T", 8)]
    row = [b"ab  ", b"  1.5", b"T", b"20240131", struct.pack("<i", 7), struct.pack("<ii", 2460341, 3_661_000)]
    put(tmp_path, "a.dbf", dbf(fields, [row, [b"    ", b"     ", b"?", b"        ", struct.pack("<i", 0), struct.pack("<ii", 2460341, 0)]] * 3))
    found = load_geometries(spark, path)
    got = sorted((r["find_index"], r["part_no"], r["kind"], len(r["rings"])) for r in found.parts.collect())
    assert got == [(0, 0, "Polygon", 2), (2, 0, "Point", 1), (2, 1, "Point", 1), (3, 0, "Point", 1), (4, 0, "LineString", 1), (4, 1, "LineString", 1)]
    assert sorted(r["index"] for r in found.rejects.collect()) == [1, 5]
    assert found.parts.where("find_index = 0").first()["props"] == {"C1": "ab", "N1": "1.5", "L1": "true", "D1": "2024-01-31", "I1": "7", "T1": "2024- 1-31  1: 1: 1"}
    assert metadata.data(spark, path, start=1, length=1).first()[:4] == ("", "NaN", "", "")
    assert [tuple(r) for r in metadata.fields(spark, path).collect()][:2] == [("C1", "Character"), ("N1", "Numeric")]
    assert metadata.count(spark, path) == 6 and file_bbox(spark, path) == [0, 0, 9, 9]
    assert {r["name"]: r["value"] for r in metadata.header(spark, path).collect()}["shape_type"] == "Polygon"


def test_csv_points(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'ID,LNG,lat,Lat,Note\n1,2,x,3,"a,b"\n2,2\n\n3, 4,1,1,c\n4,5,1,6,d,e\n5,7,0,8,f\n')
    found = load_geometries(spark, path)
    rows = found.parts.orderBy("find_index").collect()
    assert [(r["find_index"], r["rings"][0][0]["lat"], r["props"]["note"]) for r in rows] == [(0, 3.0, "a,b"), (4, 8.0, "f")]
    assert sorted(r["index"] for r in found.rejects.collect()) == [1, 2, 3]
    asked = read_query_points(spark, path).orderBy("input_index").collect()
    assert [(r["input_index"], r["id"], r["lng"]) for r in asked] == [(0, "1", 2.0), (1, None, None), (2, "3", None), (3, None, None), (4, "5", 7.0)]
    with pytest.raises(MissingLatLngField):
        read_query_points(spark, put(tmp_path, "b.csv", "a,b\n1,2\n"))
    with pytest.raises(InvalidDelimiter):
        read_query_points(spark, path, "::")


def test_dispatch(spark):
    for path, error in (("x/data", CannotParseFileExtension), ("x/a.SHP", UnsupportedFileType), ("a.txt", UnsupportedFileType)):
        with pytest.raises(error):
            load_geometries(spark, path)
    with pytest.raises(UnsupportedFileType):
        metadata.count(spark, "a.csv")


def test_sink_rounds_to_three_decimals(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "1.50", "2", 0.0005, 3)], "input_index long, id string, lng string, lat string, distance double, find_index long")
    sinks.write_matches(rows, str(tmp_path / "out"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"input_index,id,lng,lat,distance,find_index", "0,a,1.50,2,0.001,3"}


def test_workloads(spark, tmp_path):
    runs = [{"shape": "point", "count": 20, "meta": 1, "cmp": 5}, {"shape": "LineString", "count": 5, "meta": 0, "cmp": 5, "desc": "lines"}]
    path = put(tmp_path, "set.json", json.dumps(runs))
    kept = workloads.load_runs(path, str(tmp_path / "config"))
    with pytest.raises(FileExistsError):
        workloads.load_runs(path, str(tmp_path / "config"))
    assert [tuple(r) for r in workloads.list_runs(workloads.read_runs(spark, str(kept))).orderBy("index").collect()] == [("set", 0, "point", 20, 1, 5), ("set", 1, "LineString", 5, 0, 5)]
    done = workloads.execute(spark, workloads.check_runs(str(kept)), "set", str(tmp_path / "build"), 1)
    assert [(r["index"], r["data_count"], r["desc"]) for r in done] == [(0, 20, ""), (1, 5, "lines")]
    workloads.remove_runs("set", str(tmp_path / "config"), str(tmp_path / "build"))
    workloads.clean(str(tmp_path / "build"))
    assert not kept.exists() and not (tmp_path / "build").exists()
    with pytest.raises(ValueError):
        workloads.check_runs(put(tmp_path, "bad.json", '[{"shape":"cube","count":1,"meta":0,"cmp":1}]'))


def test_streams(spark, tmp_path):
    parts = workloads.random_parts(spark, 50, seed=3)
    raw = workloads.as_queries(workloads.random_points(spark, 10, 5)).select("input_index", "id", "lng_raw", "lat_raw")
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINTS).parquet(str(tmp_path / "in"))
    near_stream(stream, parts, str(tmp_path / "out"), k=2).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/matches")).count() == 20
    query = radius_stream(stream, parts, 3_000_000.0).writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("near").where(F.col("distance") > 3_000_000).count() == 0


def test_command_line(spark, tmp_path, capsys):
    from orbweave import cli

    index = put(tmp_path, "a.geojson", json.dumps(GEOJSON))
    asked = put(tmp_path, "q.csv", "name;lng;lat\nx;1;2\ny;bad;2\n")
    cli.main(["proximity", index, asked, "-s", "--point", "--fields", "s", "--delimiter", ";", "--id-col", "name", "--id-label", "who"], spark)
    said = capsys.readouterr()
    assert said.out.splitlines() == ["input_index;who;lng;lat;distance;find_index;s", "0;x;1;2;0.000;0;x"]
    assert "lng is no number" in said.err
    cli.main(["meta", "count", index], spark)
    cli.main(["meta", "fields", index, "--types", "--length", "1"], spark)
    cli.main(["meta", "data", index, "--length", "1", "--headers", "--index"], spark)
    assert capsys.readouterr().out.splitlines() == ["5", "id [String]", "b [Bool]", "n [Number]", "o [Object]", "s [String]", "z [Null]", "index,id,b,n,o,s,z", '0,a,true,0.0,"{""t"":1}",x,null']
    run = put(tmp_path, "r.json", '[{"shape":"point","count":3,"meta":0,"cmp":2}]')
    dirs = ["--config-dir", str(tmp_path / "c"), "--build-dir", str(tmp_path / "b")]
    for args in (["load", run], ["list"], ["execute", "r"], ["remove", "r"], ["clean"]):
        cli.main(["bench", *args, *dirs], spark)
    assert "r,0,point,3,0,2" in capsys.readouterr().out


def test_ordinals_go_on_over_files_and_dbf_goes_with_its_shp(spark, tmp_path):
    for k, lng in enumerate((0, 50)):
        (tmp_path / f"p{k}.csv").write_text(f"id,lng,lat\nq{k},{lng},{lng}\n")
        (tmp_path / f"g{k}.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [lng + d, lng]}, "properties": {}} for d in (1, 2)]}))
        (tmp_path / f"k{k}.kml").write_text(f"<kml><Placemark><name>m{k}</name><Point><coordinates>{lng},{lng}</coordinates></Point></Placemark></kml>" if k else "<kml><broken")
    points = read_query_points(spark, str(tmp_path / "p*.csv"))
    assert sorted(tuple(r) for r in points.select("input_index", "id").collect()) == [(0, "q0"), (1, "q1")]
    parts = load_geometries(spark, str(tmp_path / "g*.json")).parts
    found = near_join(points, parts, k=1).matches.collect()
    assert sorted((r["input_index"], r["find_index"]) for r in found) == [(0, 0), (1, 2)]
    kml = load_geometries(spark, str(tmp_path / "k*.kml"))
    assert [r["find_index"] for r in kml.parts.collect()] == [1] and [r["code"].split(":")[0] for r in kml.rejects.collect()] == ["CannotReadKml"]
