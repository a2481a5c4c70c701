import glob
import os
import tracemalloc

import duckdb
import pytest

from orbweave.plans import file_queries, queries
from orbweave.sources import shapefile
from orbweave.sources.points import csv_records
from orbweave.sources.writers import dbf_bytes, shp_bytes, write_documents


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Suppliers with gaps in their keys, over several files of each format."""
    folder, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT i * 7 + 1 AS s_suppkey, 'Supplier ' || i AS s_name, CAST(i % 25 AS INTEGER) AS s_nationkey, 1.0 AS s_acctbal FROM range(70) t(i)")
    con.execute("CREATE TABLE region AS SELECT CAST(i AS INTEGER) AS r_regionkey, 'R' || i AS r_name FROM range(3) t(i)")
    for name in ("supplier", "region"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["geojson_parts", "geojson_rejects", "kml_parts", "kml_rejects", "shp_parts", "shp_rejects", "meta_fields_types", "meta_data_geojson", "meta_data_kml", "meta_data_shp", "run_build"])
def test_files_against_sql(spark, tables, name):
    folder, con = tables
    got = file_queries.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in got.columns)} FROM ({file_queries.ORACLE[name]}) x").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_shapefile_bytes():
    content = shp_bytes([[(1.0, 2.0)], [], [(0.0, 0.0), (3.0, 4.0)]])
    head = shapefile.shp_header(content)
    assert (head["west"], head["south"], head["east"], head["north"]) == (0, 0, 3, 4) and head["file_length"] * 2 == len(content)
    records = list(shapefile.shp_records(content))
    assert [shapefile.shape_parts(r)[0]["kind"] for r in (records[0], records[2])] == ["Point", "LineString"]
    assert list(shapefile.dbf_records(dbf_bytes([("A", "C", 3), ("B", "N", 4)], [(b"x", b"12"), (b"long", b"")]))) == [{"A": "x", "B": "12"}, {"A": "lon", "B": "NaN"}]


def test_documents_sort_by_path(spark, tmp_path):
    path = write_documents(spark.range(1200).selectExpr("id * 2 AS file", "CAST(id AS STRING) AS value"), f"{tmp_path}/many.txt", 1)
    rows = spark.read.text(path).select("_metadata.file_path", "value").collect()
    assert [int(r["value"]) for r in sorted(rows)] == list(range(1200))


def test_csv_rejects_of_many_files(spark, tmp_path):
    """More files a task than three digits number."""
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT i * 400 + 1 AS c_custkey FROM range(2300) t(i)")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    want = con.execute(f"SELECT stage, index, code FROM ({file_queries.ORACLE['csv_rejects']}) x").fetchall()
    assert sorted(map(tuple, file_queries.QUERIES["csv_rejects"](spark, str(tmp_path)).collect())) == sorted(want)


def test_csv_records_are_read_in_pieces():
    content = b"id,lng,lat\n" + b"1,2.5,3.5\n" * 200_000
    tracemalloc.start()
    rows = csv_records(content, ",")
    assert next(rows) == (0, {"id": "1", "lng": "2.5", "lat": "3.5"})
    assert sum(1 for _ in rows) == 199_999
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * len(content)


def test_csv_files_follow_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_A_FILE", 100)
    con = duckdb.connect()
    for name, key, n in (("customer", "c_custkey", 1500), ("supplier", "s_suppkey", 40)):
        con.execute(f"CREATE TABLE {name} AS SELECT i * 3 + 1 AS {key} FROM range({n}) t(i)")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = queries.QUERIES["csv_nearest"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE['csv_nearest']}) x").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    base = got.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    newest = max(glob.glob(f"{base}/csv-*"), key=os.path.getmtime)
    assert len(glob.glob(f"{newest}/points.csv/*.csv")) == 15 and len(glob.glob(f"{newest}/parts.csv/*.csv")) == 3
