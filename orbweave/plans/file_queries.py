"""Registered queries that write the tables as geometry files, run sets or
matches and read them again, so that each format's reader is held against SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata
from ..operators.bounds import resolve_bbox
from ..operators.proximity import admit_points, near_join
from ..operators.workloads import build, list_runs, read_runs
from ..sources import shapefile
from ..sources.load import file_bbox, load_geometries
from ..sources.points import over_files, read_query_points
from ..sources.sinks import write_matches
from ..sources.tables import lat_of, lat_sql, lng_of, lng_sql, read
from ..sources.writers import shapefiles, write_documents, write_geojson, write_kml
from .queries import _Q, _S, _customers, _ranked, _suppliers

def key() -> Column:
    return F.col("s_suppkey")


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one; a temporary one if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="orbweave-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def _place(shift: int = 0) -> Column:
    k = key() + shift
    return F.concat_ws(",", lng_of(k), lat_of(k))


def _pair(shift: int = 0) -> Column:
    return F.concat(F.lit("["), _place(shift), F.lit("]"))


def _chain(*shifts: int) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *map(_pair, shifts)), F.lit("]"))


def _geometry() -> Column:
    """Each sixth supplier has no geometry, each sixth one of a kind that has no parts."""
    shape = lambda kind, at: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), at, F.lit("}"))
    kinds = [
        F.lit("null"), shape("Point", _pair()), shape("MultiPoint", _chain(0, 1)), shape("LineString", _chain(0, 1)),
        shape("Polygon", F.concat(F.lit("["), _chain(0, 1, 2, 0), F.lit("]"))), F.lit('{"type":"GeometryCollection","geometries":[]}'),
    ]
    return F.get(F.array(*kinds), (key() % 6).cast("int"))


def _properties() -> Column:
    """Text, number, truth, null, list and object; ``mixed`` is a number or text."""
    mixed = F.when(key() % 2 == 0, key().cast("string")).otherwise(F.concat(F.lit('"'), key(), F.lit('"')))
    head = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), (F.col("s_nationkey") > 12).alias("high")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"none":null,"list":[1],"object":{"a":1},"mixed":'), mixed, F.lit("}"))


def _features(spark: SparkSession, sf_dir: str, geometry: Column) -> DataFrame:
    ident = F.when(key() % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"id":"s'), key(), F.lit('",')))
    text = F.concat(F.lit('{"type":"Feature",'), ident, F.lit('"geometry":'), geometry, F.lit(',"properties":'), _properties(), F.lit("}"))
    return read(spark, sf_dir, "supplier").select(key().alias("at"), text.alias("text"))


def _points_geojson(spark: SparkSession, sf_dir: str, per_file: int = 10_000, bbox: list[float] | None = None) -> str:
    point = F.concat(F.lit('{"type":"Point","coordinates":'), _pair(), F.lit("}"))
    return write_geojson(_features(spark, sf_dir, point), f"{folder(spark)}/suppliers.geojson", per_file, bbox)


def _mixed_geojson(spark: SparkSession, sf_dir: str) -> str:
    return write_geojson(_features(spark, sf_dir, _geometry()), f"{folder(spark)}/mixed.json", 30)


def _parts(parts: DataFrame) -> DataFrame:
    """Parts with their number of places and the sums of their coordinates."""
    total = lambda name: F.round(F.aggregate(F.flatten("rings"), F.lit(0.0), lambda a, p: a + p[name]), 4).alias(name)
    return parts.select("find_index", F.col("part_no").cast("bigint").alias("part_no"), "kind", F.size(F.flatten("rings")).cast("bigint").alias("places"), total("lng"), total("lat"))


def geojson_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 30 features each; metadata of all types beside the matches."""
    parts = load_geometries(spark, _points_geojson(spark, sf_dir, 30)).parts
    names = ("id", "name", "nation", "high", "none", "list", "object", "mixed", "absent")
    found = near_join(_customers(spark, sf_dir), parts, fields=names, id_label="customer").matches
    return found.select("input_index", "distance", "find_index", *names)


def geojson_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(load_geometries(spark, _mixed_geojson(spark, sf_dir)).parts)


def geojson_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_geometries(spark, _mixed_geojson(spark, sf_dir)).rejects.select("stage", "index", "code")


def geojson_file_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box that the file states bounds both sides."""
    path = _points_geojson(spark, sf_dir, bbox=[120.0, -45.0, 0.0, -120.0, 45.0, 9.0])
    found = near_join(_customers(spark, sf_dir), load_geometries(spark, path).parts, bbox=resolve_bbox(file_bbox=file_bbox(spark, path))).matches
    return found.select("input_index", "distance", "find_index")


def meta_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.header(spark, _points_geojson(spark, sf_dir, bbox=[120.0, -45.0, 0.0, -120.0, 45.0, 9.0]))


def meta_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, items and not parts: of GeoJSON and of KML."""
    counts = [(kind, metadata.count(spark, path)) for kind, path in (("geojson", _mixed_geojson(spark, sf_dir)), ("kml", _kml(spark, sf_dir)))]
    return spark.createDataFrame(counts, "kind string, n bigint")


def meta_fields_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.fields(spark, _mixed_geojson(spark, sf_dir))


def meta_data_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 10 to 59 across files, counted anew from 0."""
    return metadata.data(spark, _mixed_geojson(spark, sf_dir), start=10, length=50, index=True, rebase=True)


def _kml(spark: SparkSession, sf_dir: str) -> str:
    """Placemarks of points, lines and collections; some without a geometry, some
    with a collection inside, which has no parts."""
    at = lambda *shifts: F.concat(F.lit("<coordinates>"), F.concat_ws(" ", *map(_place, shifts)), F.lit("</coordinates>"))
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    point, line = tag("Point", at(0)), tag("LineString", at(0, 1))
    many = tag("MultiGeometry", F.concat(point, line))
    placemark = lambda shape: F.concat(F.lit('<Placemark id="p'), key(), F.lit('">'), tag("name", F.concat(F.lit("R&amp;D "), F.col("s_name"))), tag("nation", F.col("s_nationkey").cast("string")), shape, F.lit("</Placemark>"))
    items = F.get(F.array(placemark(F.lit("")), placemark(point), placemark(line), placemark(many), many), (key() % 5).cast("int"))
    # every other item is in a folder of its own
    text = F.when(key() % 2 == 0, tag("Folder", items)).otherwise(items)
    return write_kml(read(spark, sf_dir, "supplier").select(key().alias("at"), text.alias("text")), f"{folder(spark)}/suppliers.kml", 30, "suppliers")


def kml_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(load_geometries(spark, _kml(spark, sf_dir)).parts)


def kml_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_geometries(spark, _kml(spark, sf_dir)).rejects.select("stage", "index", "code")


def kml_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the file only, with the name and the XML id of the match."""
    found = near_join(_customers(spark, sf_dir), load_geometries(spark, _kml(spark, sf_dir)).parts, mode="point", fields=("name", "id"), id_label="customer").matches
    return found.select("input_index", "distance", "find_index", F.col("part_no").cast("bigint").alias("part_no"), "name", "id")


def meta_header_kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.header(spark, _kml(spark, sf_dir))


def meta_fields_kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.fields(spark, _kml(spark, sf_dir))


def meta_data_kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.data(spark, _kml(spark, sf_dir), start=5, length=40, index=True)


#: Name, type code and width of the test records' fields.
DBF = [("NAME", "C", 30), ("NATION", "N", 6), ("HIGH", "L", 1), ("OPENED", "D", 8), ("GAP", "N", 4)]


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, polylines and null shapes of the suppliers, in files of 30."""
    at = lambda shift: F.struct(lng_of(key() + shift).alias("lng"), lat_of(key() + shift).alias("lat"))
    places = F.when(key() % 5 == 0, F.slice(F.array(at(0)), 1, 0)).when(key() % 3 == 0, F.array(at(0), at(1))).otherwise(F.array(at(0)))
    opened = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), key().cast("int")), "yyyyMMdd")
    texts = [F.col("s_name"), F.lpad(F.col("s_nationkey").cast("string"), 6, " "), F.when(F.col("s_nationkey") > 12, "T").otherwise("n"), opened, F.lit("")]
    rows = read(spark, sf_dir, "supplier").select(key().alias("at"), places.alias("places"), *(t.cast("binary").alias(n) for t, (n, _, _) in zip(texts, DBF)))
    files = shapefiles(rows, DBF, 30).cache()
    return over_files(shapefile.shape_records(files), "find_index", files.count()).drop("path")


def shp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(shapefile.shape_rows(_shapes(spark, sf_dir))[0])


def shp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapefile.shape_rows(_shapes(spark, sf_dir))[1].select("stage", "index", "code")


def shp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tuple(n for n, _, _ in DBF)
    found = near_join(_customers(spark, sf_dir), shapefile.shape_rows(_shapes(spark, sf_dir))[0], mode="point", fields=names).matches
    return found.select("input_index", "distance", "find_index", *names)


def meta_data_shp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.shape_data(_shapes(spark, sf_dir), [n for n, _, _ in DBF], start=10, length=50)


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh row lacks a field, each eleventh a number."""
    k = F.col("c_custkey")
    line = F.when(k % 7 == 0, F.concat_ws(";", k, F.lit("1.5"))).when(k % 11 == 0, F.concat_ws(";", k, F.lit("1.5d"), F.lit("2"))).otherwise(F.concat_ws(";", k, lng_of(k), lat_of(k)))
    rows = read(spark, sf_dir, "customer").groupBy(F.floor(k / 400).alias("file")).agg(F.array_sort(F.collect_list(F.struct(k.alias("at"), line.alias("line")))).alias("rows"))
    path = f"{folder(spark)}/points.csv"
    text = F.concat(F.lit("id;lng;lat\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    write_documents(rows.select("file", text.alias("value")), path, 2)
    return admit_points(read_query_points(spark, path, ";")).rejects.select("stage", "index", "code")


def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as written: text columns, the distance with three decimals."""
    path = f"{folder(spark)}/matches"
    write_matches(near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), mode="point", id_label="customer").matches, path, "customer", (), "|")
    return spark.read.csv(path, header=True, sep="|")


def _run_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run-set file made of the region table, read again."""
    run = F.struct(F.when(F.col("r_regionkey") % 2 == 0, "point").otherwise("lineString").alias("shape"), ((F.col("r_regionkey") + 1) * 10).cast("bigint").alias("count"), F.col("r_regionkey").cast("bigint").alias("meta"), F.lit(5).cast("bigint").alias("cmp"), F.col("r_name").alias("desc"))
    rows = read(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", run.alias("run")))).alias("runs"))  # five regions
    path = f"{folder(spark)}/runs"
    rows.select(F.to_json(F.transform("runs", lambda r: r["run"]))).write.text(path)
    return read_runs(spark, path)


def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_runs(_run_sets(spark, sf_dir)).drop("file")


def run_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, query points, kinds and metadata of each built run."""
    runs, where = [r.asDict(recursive=True) for r in _run_sets(spark, sf_dir).first()["runs"]], folder(spark)  # five runs
    build(spark, runs, "regions", where)
    out = None
    for k in range(len(runs)):
        parts = spark.read.parquet(f"{where}/regions/{k}/data").agg(F.count(F.lit(1)).alias("parts"), F.max("kind").alias("kind"), F.max(F.coalesce(F.size("props"), F.lit(0))).cast("bigint").alias("meta"))
        points = spark.read.parquet(f"{where}/regions/{k}/cmp").agg(F.count(F.lit(1)).alias("points"))
        row = parts.crossJoin(points).withColumn("index", F.lit(k).cast("bigint"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        geojson_nearest, geojson_parts, geojson_rejects, geojson_file_bbox, kml_nearest, kml_parts, kml_rejects, shp_nearest, shp_parts, shp_rejects, csv_rejects,
        meta_header, meta_header_kml, meta_count, meta_fields_types, meta_fields_kml, meta_data_geojson, meta_data_kml, meta_data_shp, match_lines, run_list, run_build,
    )
}

# --- oracles -----------------------------------------------------------------

_RANK = "(SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS o FROM supplier)"


def _xy(shift: int) -> str:
    return f"{lng_sql(f's_suppkey + {shift}')} AS x{shift}, {lat_sql(f's_suppkey + {shift}')} AS y{shift}"


_PLACES = f"(SELECT *, {_xy(0)}, {_xy(1)}, {_xy(2)} FROM {_RANK})"
_POINT = "'Point' AS kind, CAST(1 AS BIGINT) AS places, round(x0, 4) AS lng, round(y0, 4) AS lat"
_NEXT = "'Point' AS kind, CAST(1 AS BIGINT) AS places, round(x1, 4) AS lng, round(y1, 4) AS lat"
_LINE = "'LineString' AS kind, CAST(2 AS BIGINT) AS places, round(x0 + x1, 4) AS lng, round(y0 + y1, 4) AS lat"
_AREA = "'Polygon' AS kind, CAST(4 AS BIGINT) AS places, round(x0 + x1 + x2 + x0, 4) AS lng, round(y0 + y1 + y2 + y0, 4) AS lat"


def _part_sql(*kinds: tuple[str, int, str]) -> str:
    """Union of (columns, part_no, condition) over the suppliers."""
    return " UNION ALL ".join(f"SELECT o AS find_index, CAST({part} AS BIGINT) AS part_no, {columns} FROM {_PLACES} WHERE {where}" for columns, part, where in kinds)


def _near_sql(where: str, columns: str) -> str:
    """The nearest of the suppliers that meet ``where``, by ordinals."""
    return f"""SELECT r.i AS input_index, r.distance, o AS find_index, {columns}
        FROM ({_ranked(_Q, f"(SELECT * FROM {_S} s WHERE {where.replace('s_suppkey', 'f')})")}) r JOIN {_RANK} s ON s_suppkey = r.f WHERE r.rank = 1"""


_IN = "{0}.lng BETWEEN -120 AND 120 AND {0}.lat BETWEEN -45 AND 45"
_DATE = "strftime(DATE '2020-01-01' + CAST(s_suppkey AS INTEGER), '%Y-%m-%d')"
_MIXED_TYPES = "(VALUES ('name', 'String'), ('nation', 'Number'), ('high', 'Bool'), ('none', 'Null'), ('list', 'Array'), ('object', 'Object')) v(name, type)"
_DBF_COLUMNS = f"""s_name AS "NAME", CAST(s_nationkey AS VARCHAR) AS "NATION", CASE WHEN s_nationkey > 12 THEN 'true' ELSE 'false' END AS "HIGH", {_DATE} AS "OPENED", 'NaN' AS "GAP" """

ORACLE = {
    "geojson_nearest": _near_sql("true", """CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 's' || s_suppkey END AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation,
        CASE WHEN s_nationkey > 12 THEN 'true' ELSE 'false' END AS high, '' AS "none", '' AS "list", '' AS "object", CAST(s_suppkey AS VARCHAR) AS mixed, '' AS absent"""),
    "geojson_parts": _part_sql((_POINT, 0, "s_suppkey % 6 = 1"), (_POINT, 0, "s_suppkey % 6 = 2"), (_NEXT, 1, "s_suppkey % 6 = 2"), (_LINE, 0, "s_suppkey % 6 = 3"), (_AREA, 0, "s_suppkey % 6 = 4")),
    "geojson_rejects": f"SELECT 'build' AS stage, o AS index, CASE WHEN s_suppkey % 6 = 0 THEN 'MissingGeometry' ELSE 'UnsupportedGeometry' END AS code FROM {_RANK} s WHERE s_suppkey % 6 IN (0, 5)",
    "geojson_file_bbox": f"""SELECT r.i AS input_index, r.distance, o AS find_index FROM ({_ranked(f"(SELECT * FROM {_Q} q WHERE {_IN.format('q')})", f"(SELECT * FROM {_S} s WHERE {_IN.format('s')})")}) r JOIN {_RANK} s ON s_suppkey = r.f WHERE r.rank = 1""",
    "kml_nearest": _near_sql("s_suppkey % 5 IN (1, 4)", """CAST(0 AS BIGINT) AS part_no, CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE 'R&D ' || s_name END AS name,
        CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE 'p' || s_suppkey END AS id"""),
    "kml_parts": _part_sql((_POINT, 0, "s_suppkey % 5 IN (1, 4)"), (_LINE, 0, "s_suppkey % 5 = 2"), (_LINE, 1, "s_suppkey % 5 = 4")),
    "kml_rejects": f"SELECT 'build' AS stage, o AS index, CASE WHEN s_suppkey % 5 = 0 THEN 'MissingGeometry' ELSE 'NestedKmlMulti' END AS code FROM {_RANK} s WHERE s_suppkey % 5 IN (0, 3)",
    "shp_nearest": _near_sql("s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0", _DBF_COLUMNS),
    "shp_parts": _part_sql((_POINT, 0, "s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0"), (_LINE, 0, "s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0")),
    "shp_rejects": f"SELECT 'build' AS stage, o AS index, 'UnsupportedShape' AS code FROM {_RANK} s WHERE s_suppkey % 5 = 0",
    "csv_rejects": "SELECT 'query' AS stage, o AS index, 'CannotParseRecord' AS code FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS o FROM customer) c WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0",
    "meta_header": "SELECT * FROM (VALUES ('type', 'FeatureCollection'), ('contains', 'Point'), ('bbox', '-120.0,-45.0,120.0,45.0')) v(name, value)",
    "meta_header_kml": "SELECT 'name' AS name, 'suppliers' AS value",
    "meta_count": "SELECT k AS kind, (SELECT count(*) FROM supplier) AS n FROM (VALUES ('geojson'), ('kml')) v(k)",
    "meta_fields_types": f"""SELECT 'id' AS name, CASE WHEN bool_or(s_suppkey % 5 = 0 AND o > f) THEN 'Mixed' ELSE 'String' END AS type FROM {_RANK} s, (SELECT min(o) AS f FROM {_RANK} t WHERE s_suppkey % 5 <> 0) x
        UNION ALL SELECT * FROM {_MIXED_TYPES} UNION ALL SELECT 'mixed', CASE WHEN min(s_suppkey % 2) < max(s_suppkey % 2) THEN 'Mixed' WHEN max(s_suppkey % 2) = 0 THEN 'Number' ELSE 'String' END FROM supplier""",
    "meta_fields_kml": "SELECT * FROM (VALUES ('name', 'String'), ('description', 'String'), ('nation', 'String')) v(name, type)",
    "meta_data_geojson": f"""SELECT o - 10 AS index, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 's' || s_suppkey END AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation,
        CASE WHEN s_nationkey > 12 THEN 'true' ELSE 'false' END AS high, 'null' AS "none", '[1]' AS "list", '{{"a":1}}' AS "object", CAST(s_suppkey AS VARCHAR) AS mixed FROM {_RANK} s WHERE o >= 10 AND o < 60""",
    "meta_data_kml": f"""SELECT o AS index, CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE 'R&D ' || s_name END AS name, '' AS description, CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END AS nation
        FROM {_RANK} s WHERE o >= 5 AND o < 45""",
    "meta_data_shp": f"SELECT o AS index, {_DBF_COLUMNS} FROM {_RANK} s WHERE o >= 10 AND o < 60",
    "match_lines": f"SELECT CAST(i AS VARCHAR) AS input_index, CAST(i AS VARCHAR) AS customer, CAST(lng AS VARCHAR) AS lng, CAST(lat AS VARCHAR) AS lat, printf('%.3f', distance) AS distance, CAST(f AS VARCHAR) AS find_index FROM ({_ranked(_Q, _S)}) r WHERE rank = 1",
    "run_list": "SELECT CAST(r_regionkey AS BIGINT) AS index, CASE WHEN r_regionkey % 2 = 0 THEN 'point' ELSE 'lineString' END AS shape, CAST(10 * (r_regionkey + 1) AS BIGINT) AS count, CAST(r_regionkey AS BIGINT) AS meta, CAST(5 AS BIGINT) AS cmp FROM region",
    "run_build": "SELECT CAST(r_regionkey AS BIGINT) AS index, CAST(10 * (r_regionkey + 1) AS BIGINT) AS parts, CASE WHEN r_regionkey % 2 = 0 THEN 'Point' ELSE 'LineString' END AS kind, CAST(r_regionkey AS BIGINT) AS meta, CAST(5 AS BIGINT) AS points FROM region",
}
