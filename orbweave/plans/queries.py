"""Registered queries of the proximity and metadata operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..operators import metadata
from ..operators.bounds import BBox, parse_bbox, resolve_bbox
from ..operators.proximity import admit_parts, admit_points, describe_index, index_size, near_join, retrieve
from ..operators.workloads import hashed_points
from ..sources.load import load_geometries
from ..sources.points import parse_points, read_query_points
from ..sources.tables import box_parts, lat_sql, line_parts, lng_sql, point_parts, query_points, read

#: Rows of a CSV file that is written, if these need more than three files: one task reads a file.
ROWS_A_FILE = 50_000
BOX = "-120,-45,120,45"
_OUT = ["input_index", "distance", "find_index", "rank"]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_points(read(spark, sf_dir, "customer"), "c_custkey")


def _suppliers(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return point_parts(read(spark, sf_dir, "supplier"), "s_suppkey", **more)


def nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supplier of each customer, with the writer's columns."""
    found = near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), mode="point").matches
    return found.select("input_index", "id", F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat"), "distance", "find_index")


def knn3_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = point_parts(read(spark, sf_dir, "part"), "p_partkey")
    return near_join(_customers(spark, sf_dir), parts, k=3, mode="point").matches.select(_OUT)


def knn3_part_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = point_parts(read(spark, sf_dir, "part"), "p_partkey")
    return near_join(_customers(spark, sf_dir), parts, k=3, mode="point", strategy="grid").matches.select(_OUT)


def nearest_within_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), r=500_000.0, mode="point").matches.select(_OUT)


def knn_within_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), k=5, r=2_000_000.0, mode="point", strategy="grid").matches.select(_OUT)


def radius_join_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = query_points(read(spark, sf_dir, "orders"), "o_orderkey")
    parts = point_parts(read(spark, sf_dir, "customer"), "c_custkey")
    return near_join(points, parts, k=None, r=100_000.0, mode="point", strategy="grid").matches.select("input_index", "distance", "find_index")


def bbox_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), bbox=resolve_bbox(text=BOX), mode="point").matches.select(_OUT)


def bbox_swapped_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), bbox=parse_bbox("120,45,-120,-45,7"), mode="point").matches.select(_OUT)


def unmatched_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), r=300_000.0, bbox=parse_bbox(BOX), mode="point").rejects
    return found.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("index").alias("index_sum"))


def point_mode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _suppliers(spark, sf_dir).unionByName(line_parts(read(spark, sf_dir, "nation"), "n_nationkey"))
    return admit_parts(mixed, "point").rejects.select("stage", "index", "code")


def multipart_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts share each supplier's index; parts are the unit."""
    parts = _suppliers(spark, sf_dir).unionByName(_suppliers(spark, sf_dir, offset=5000, part_no=1))
    return near_join(_customers(spark, sf_dir), parts, k=3, mode="point").matches.select("input_index", "distance", "find_index", F.col("part_no").cast("bigint").alias("part_no"), "rank")


def multipart_knn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _suppliers(spark, sf_dir).unionByName(_suppliers(spark, sf_dir, offset=5000, part_no=1))
    return near_join(_customers(spark, sf_dir), parts, k=3, mode="point", dedupe_features=True, strategy="grid").matches.select(_OUT)


def nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join(_customers(spark, sf_dir), line_parts(read(spark, sf_dir, "nation"), "n_nationkey")).matches
    return found.select("input_index", F.round("distance", 0).alias("distance"), "find_index")


def nearest_line_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join(_customers(spark, sf_dir), line_parts(read(spark, sf_dir, "nation"), "n_nationkey"), strategy="grid").matches
    return found.select("input_index", F.round("distance", 0).alias("distance"), "find_index")


def nearest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join(_customers(spark, sf_dir), box_parts(read(spark, sf_dir, "region"), "r_regionkey")).matches
    return found.select("input_index", F.round("distance", 0).alias("distance"), "find_index")


def polygon_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join(_customers(spark, sf_dir), box_parts(read(spark, sf_dir, "region"), "r_regionkey"), k=None, r=0.0, strategy="grid").matches
    return found.where("distance = 0").select("input_index", "find_index")


def candidates_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve(box_parts(read(spark, sf_dir, "region"), "r_regionkey"), line_parts(read(spark, sf_dir, "nation"), "n_nationkey"))
    return found.select("probe_index", "find_index")


def meta_fields_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _suppliers(spark, sf_dir, props={"name": "s_name", "nation": "s_nationkey"})
    found = near_join(_customers(spark, sf_dir), parts, k=2, mode="point", fields=("name", "nation", "unknown")).matches
    return found.select("input_index", "find_index", "name", "nation", "unknown", "rank")


def id_label_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(_customers(spark, sf_dir), _suppliers(spark, sf_dir), mode="point", id_label="customer").matches.select("input_index", "customer", "find_index")


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _suppliers(spark, sf_dir).unionByName(line_parts(read(spark, sf_dir, "nation"), "n_nationkey"))
    return describe_index(parts).select("kind", "parts").unionByName(index_size(parts).select(F.lit("all").alias("kind"), F.col("size").alias("parts")))


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as text; each seventh row has a suffix, each eleventh a space."""
    k = F.col("c_custkey")
    bad = F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit("d"))).when(k % 11 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise((k % 180).cast("string"))
    raw = read(spark, sf_dir, "customer").select(k.alias("input_index"), k.cast("string").alias("id"), bad.alias("lng_raw"), F.lit("1.5").alias("lat_raw"))
    return admit_points(parse_points(raw)).rejects.select("index", "code")


def csv_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and parts written as several CSV files each and read again; their
    ordinals go on from file to file."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="orbweave-")
    base = f"{base.rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows = {"points": query_points(read(spark, sf_dir, "customer"), "c_custkey"), "parts": query_points(read(spark, sf_dir, "supplier"), "s_suppkey")}
    for name, points in rows.items():
        files = points.repartitionByRange(max(3, points.count() // ROWS_A_FILE), "input_index").sortWithinPartitions("input_index")
        files.select("id", F.col("lat_raw").alias("LAT"), F.col("lng_raw").alias("lng")).write.csv(f"{base}/{name}.csv", header=True)
    index, points = load_geometries(spark, f"{base}/parts.csv"), read_query_points(spark, f"{base}/points.csv")
    found = near_join(points, index.parts, fields=("id",), id_label="customer").matches
    return found.select("input_index", "customer", "distance", "find_index", "id")


def _events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("find_index"), F.col("event_type").alias("id"), F.col("props").alias("properties"))


def meta_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.extent_of(_suppliers(spark, sf_dir))


def meta_data_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.json_data(_events_props(spark, sf_dir), ["k"], start=10, length=50)
    return rows.select(F.col("index"), "id", "k")


def gen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_points(spark, 10_000)


QUERIES = {
    f.__name__: f
    for f in (
        nearest_supplier, knn3_part, knn3_part_grid, nearest_within_r, knn_within_r, radius_join_grid, bbox_both_sides, bbox_swapped_corners, unmatched_rejects,
        point_mode_rejects, multipart_knn, multipart_knn_features, nearest_line, nearest_line_grid, nearest_polygon, polygon_contains, candidates_bbox,
        meta_fields_projection, id_label_projection, index_summary, parse_rejects, csv_nearest, meta_extent, meta_data_slice, gen_points,
    )
}

# --- oracles -----------------------------------------------------------------

_Q = f"(SELECT c_custkey AS i, {lng_sql('c_custkey')} AS lng, {lat_sql('c_custkey')} AS lat FROM customer)"
_S = f"(SELECT s_suppkey AS f, 0 AS p, {lng_sql('s_suppkey')} AS lng, {lat_sql('s_suppkey')} AS lat FROM supplier)"
_S2 = f"(SELECT * FROM {_S} UNION ALL SELECT s_suppkey, 1, {lng_sql('s_suppkey + 5000')}, {lat_sql('s_suppkey + 5000')} FROM supplier)"
_P = f"(SELECT p_partkey AS f, 0 AS p, {lng_sql('p_partkey')} AS lng, {lat_sql('p_partkey')} AS lat FROM part)"
_HAV = haversine_sql("q.lng", "q.lat", "b.lng", "b.lat")
_IN = "{0}.lng BETWEEN -120 AND 120 AND {0}.lat BETWEEN -45 AND 45"


def _ranked(queries: str, parts: str, where: str = "true") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, f, p) AS rank FROM
        (SELECT q.i, q.lng, q.lat, b.f, b.p, {_HAV} AS d, round({_HAV}, 3) AS distance FROM {queries} q, {parts} b) x WHERE {where}"""


def _knn(queries: str, parts: str, k: int, where: str = "true") -> str:
    return f"SELECT i AS input_index, distance, f AS find_index, rank FROM ({_ranked(queries, parts, where)}) r WHERE rank <= {k}"


_QB, _SB = f"(SELECT * FROM {_Q} q WHERE {_IN.format('q')})", f"(SELECT * FROM {_S} s WHERE {_IN.format('s')})"

# Segment distance, in the terms of the expression: vectors of both ends and of the point.
_VEC = "cos(radians({0}lat)) * cos(radians({0}lng)) AS {1}x, cos(radians({0}lat)) * sin(radians({0}lng)) AS {1}y, sin(radians({0}lat)) AS {1}z"


def _segment_join(segments: str, inside: str = "") -> str:
    """(i, f, distance) from segments (f, alng, alat, blng, blat)."""
    ends = f"least({haversine_sql('lng', 'lat', 'alng', 'alat')}, {haversine_sql('lng', 'lat', 'blng', 'blat')})"
    return f"""
        WITH s AS ({segments}), q AS (SELECT * FROM {_Q}),
        v AS (SELECT i, f, lng, lat, alng, alat, blng, blat, {_VEC.format("", "p")}, {_VEC.format("a", "a")}, {_VEC.format("b", "e")} FROM q, s),
        n AS (SELECT *, ay * ez - az * ey AS nx, az * ex - ax * ez AS ny, ax * ey - ay * ex AS nz FROM v),
        w AS (SELECT i, f, lng, lat, alng, alat, blng, blat,
            (ny * az - nz * ay) * px + (nz * ax - nx * az) * py + (nx * ay - ny * ax) * pz >= 0 AND (ey * nz - ez * ny) * px + (ez * nx - ex * nz) * py + (ex * ny - ey * nx) * pz >= 0
                AND nx * nx + ny * ny + nz * nz > 0 AS within,
            6371008.8 * atan2(abs(nx * px + ny * py + nz * pz), sqrt(power(ny * pz - nz * py, 2) + power(nz * px - nx * pz, 2) + power(nx * py - ny * px, 2))) AS arc FROM n),
        d AS (SELECT i, f, round(min({inside} CASE WHEN within THEN arc ELSE {ends} END), 3) AS distance FROM w GROUP BY i, f),
        r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, f) AS k FROM d)
        SELECT i AS input_index, round(distance, 0) AS distance, f AS find_index FROM r WHERE k = 1"""


_LINES = f"SELECT CAST(n_nationkey AS BIGINT) AS f, {lng_sql('n_nationkey')} AS alng, {lat_sql('n_nationkey')} AS alat, {lng_sql('n_nationkey + 1')} AS blng, {lat_sql('n_nationkey + 1')} AS blat FROM nation"
_BOXES = "SELECT CAST(r_regionkey AS BIGINT) AS f, r_regionkey * 60.0 - 150 AS w, r_regionkey * 20.0 - 60 AS s FROM region"
_SIDES = f"""SELECT f, CAST(w + x1 AS DOUBLE) AS alng, CAST(s + y1 AS DOUBLE) AS alat, CAST(w + x2 AS DOUBLE) AS blng, CAST(s + y2 AS DOUBLE) AS blat
    FROM ({_BOXES}) z, (VALUES (0, 0, 40, 0), (40, 0, 40, 30), (40, 30, 0, 30), (0, 30, 0, 0)) AS t(x1, y1, x2, y2)"""
_WITHIN = "CASE WHEN lng >= f * 60.0 - 150 AND lng < f * 60.0 - 110 AND lat >= f * 20.0 - 60 AND lat < f * 20.0 - 30 THEN 0.0 ELSE 1e12 END, "

ORACLE = {
    "nearest_supplier": f"SELECT i AS input_index, CAST(i AS VARCHAR) AS id, lng, lat, distance, f AS find_index FROM ({_ranked(_Q, _S)}) r WHERE rank = 1",
    "knn3_part": _knn(_Q, _P, 3),
    "knn3_part_grid": _knn(_Q, _P, 3),
    "nearest_within_r": _knn(_Q, _S, 1, "d <= 500000"),
    "knn_within_r": _knn(_Q, _S, 5, "d <= 2000000"),
    "radius_join_grid": f"""SELECT i AS input_index, round(d, 3) AS distance, f AS find_index FROM
        (SELECT q.i, b.f, {_HAV} AS d FROM (SELECT o_orderkey AS i, {lng_sql("o_orderkey")} AS lng, {lat_sql("o_orderkey")} AS lat FROM orders) q
         JOIN (SELECT c_custkey AS f, {lng_sql("c_custkey")} AS lng, {lat_sql("c_custkey")} AS lat FROM customer) b ON abs(q.lat - b.lat) < 1) x WHERE d <= 100000""",
    "bbox_both_sides": _knn(_QB, _SB, 1),
    "bbox_swapped_corners": _knn(_QB, _SB, 1),
    "unmatched_rejects": f"""
        WITH m AS (SELECT DISTINCT i FROM ({_ranked(_QB, _SB, "d <= 300000")}) r)
        SELECT 'build' AS stage, 'InsertFailedOutOfBounds' AS code, count(*) AS n, CAST(sum(f) AS BIGINT) AS index_sum FROM {_S} s WHERE NOT ({_IN.format("s")}) HAVING count(*) > 0
        UNION ALL SELECT 'query', 'OutOfBounds', count(*), CAST(sum(i) AS BIGINT) FROM {_Q} q WHERE NOT ({_IN.format("q")}) HAVING count(*) > 0
        UNION ALL SELECT 'find', 'NoMatch', count(*), CAST(sum(i) AS BIGINT) FROM {_QB} q WHERE i NOT IN (SELECT i FROM m) HAVING count(*) > 0""",
    "point_mode_rejects": "SELECT 'build' AS stage, CAST(n_nationkey AS BIGINT) AS index, 'InsertFailedRequiresPoint' AS code FROM nation",
    "multipart_knn": f"SELECT i AS input_index, distance, f AS find_index, CAST(p AS BIGINT) AS part_no, rank FROM ({_ranked(_Q, _S2)}) r WHERE rank <= 3",
    "multipart_knn_features": f"""SELECT i AS input_index, distance, f AS find_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, f) AS rank FROM
        (SELECT i, f, min(distance) AS distance FROM ({_ranked(_Q, _S2).replace("*, row_number() OVER (PARTITION BY i ORDER BY distance, f, p) AS rank", "*")}) y GROUP BY i, f) z) r WHERE rank <= 3""",
    "nearest_line": _segment_join(_LINES),
    "nearest_line_grid": _segment_join(_LINES),
    "nearest_polygon": _segment_join(_SIDES, "least(" + _WITHIN).replace("END), 3) AS distance", "END)), 3) AS distance"),
    "polygon_contains": f"SELECT i AS input_index, f AS find_index FROM {_Q} q, ({_BOXES}) b WHERE lng >= w AND lng < w + 40 AND lat >= s AND lat < s + 30",
    "candidates_bbox": f"SELECT l.f AS probe_index, b.f AS find_index FROM ({_LINES}) l, ({_BOXES}) b WHERE least(alng, blng) <= w + 40 AND w <= greatest(alng, blng) AND least(alat, blat) <= s + 30 AND s <= greatest(alat, blat)",
    "meta_fields_projection": f"""SELECT i AS input_index, f AS find_index, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation, '' AS "unknown", rank
        FROM ({_ranked(_Q, _S)}) r JOIN supplier ON s_suppkey = f WHERE rank <= 2""",
    "id_label_projection": f"SELECT i AS input_index, CAST(i AS VARCHAR) AS customer, f AS find_index FROM ({_ranked(_Q, _S)}) r WHERE rank = 1",
    "index_summary": "SELECT 'Point' AS kind, count(*) AS parts FROM supplier UNION ALL SELECT 'LineString', count(*) FROM nation UNION ALL SELECT 'all', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation)",
    "parse_rejects": "SELECT CAST(c_custkey AS BIGINT) AS index, 'CannotParseRecord' AS code FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0",
    "csv_nearest": f"""SELECT (SELECT count(*) FROM customer c WHERE c.c_custkey < i) AS input_index, CAST(i AS VARCHAR) AS customer, distance,
        (SELECT count(*) FROM supplier s WHERE s.s_suppkey < f) AS find_index, CAST(f AS VARCHAR) AS id FROM ({_ranked(_Q, _S)}) r WHERE rank = 1""",
    "meta_extent": f"SELECT min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM {_S} s",
    "meta_data_slice": "SELECT event_id AS index, event_type AS id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 10)",
    "gen_points": "SELECT i AS id, (i * 48271 % 3600001) / 10000.0 - 180 AS lng, (i * 69621 % 1800001) / 10000.0 - 90 AS lat FROM range(0, 10000) t(i)",
}
