"""CSV points: query points and indexed points, with rejects.

Rows keep their place in the input as an ordinal, rejected rows too; of several
files, one goes on where the one before it by path ends.
Fields are cut by a reader that, unlike a permissive CSV scan, tells rows with a
wrong number of fields.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import number, point_rings
from ..operators.proximity import reject


class InvalidDelimiter(ValueError):
    pass


class MissingLatLngField(ValueError):
    pass



def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files by Spark's own reader, so any store works."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def over_files(rows: DataFrame, ordinal: str, files: int) -> DataFrame:
    """Ordinals that go on from file to file, in the order of the paths, for rows
    (path, ordinal, ...) whose ordinals begin anew in each of ``files`` files."""
    if files < 2:
        return rows
    sizes = rows.groupBy("path").agg((F.max(ordinal) + 1).alias("n"))  # as many rows as files
    before = sizes.select("path", F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "path").withColumn(ordinal, F.col(ordinal) + F.col("before")).select(*rows.columns)


def check_delimiter(delimiter: str) -> str:
    if len(delimiter.encode()) != 1:
        raise InvalidDelimiter(f"the delimiter must be one byte: {delimiter!r}")
    return delimiter


def csv_records(content: bytes, delimiter: str) -> Iterator[tuple[int, dict[str, str] | None]]:
    """(ordinal, fields by header) of each record; None if its width is wrong.

    Of headers that are equal but for case the last wins; blank lines are none.
    """
    rows = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline=""), delimiter=delimiter)
    header: list[str] | None = None
    at = 0
    for row in rows:
        if not row:
            continue
        if header is None:
            header = row
            continue
        yield at, dict(zip(header, row)) if len(row) == len(header) else None
        at += 1


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, index, fields): fields is a map with the header's own names."""
    check_delimiter(delimiter)

    def cut(frames):
        import pandas as pd

        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                rows = csv_records(bytes(content), delimiter)
                while part := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame({"path": [where] * len(part), "index": [i for i, _ in part], "fields": [f for _, f in part]})

    files = file_bytes(spark, path)
    return over_files(files.mapInPandas(cut, "path string, index bigint, fields map<string,string>"), "index", len(files.inputFiles()))


def csv_header(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    line = spark.read.text(path).where("trim(value) <> ''").first()
    return next(csv.reader([line[0]], delimiter=check_delimiter(delimiter))) if line else []


def _column(header: list[str], name: str) -> str | None:
    return next((h for h in reversed(header) if h.lower() == name), None)


def parse_points(raw: DataFrame) -> DataFrame:
    """Adds lng and lat to (input_index, id, lng_raw, lat_raw); null if it is no number."""
    return raw.withColumns({"lng": number(F.col("lng_raw")), "lat": number(F.col("lat_raw"))})


def read_query_points(spark: SparkSession, path: str, delimiter: str = ",", id_col: str = "id") -> DataFrame:
    """Query points of a CSV file; broken rows have null coordinates."""
    header = csv_header(spark, path, delimiter)
    lng, lat, ident = (_column(header, n) for n in ("lng", "lat", id_col.lower()))
    if lng is None or lat is None:
        raise MissingLatLngField("the header needs lng and lat")
    at = lambda name: F.try_element_at("fields", F.lit(name)) if name is not None else F.lit(None).cast("string")
    return parse_points(read_csv(spark, path, delimiter).select(F.col("index").alias("input_index"), at(ident).alias("id"), at(lng).alias("lng_raw"), at(lat).alias("lat_raw")))


def read_csv_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Point parts of a comma-separated file, with lower-cased metadata, and rejects."""
    points = read_csv(spark, path).withColumn("props", F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(F.lower(e["key"]), e["value"]))))
    header = csv_header(spark, path)
    lng, lat = (_column(header, n) for n in ("lng", "lat"))
    if lng is None or lat is None:
        raise MissingLatLngField("the header needs lng and lat")
    if len({h.lower() for h in header}) < len(header):  # the last of equal names wins
        last = {h.lower(): h for h in header}
        points = points.withColumn("props", F.when(F.col("fields").isNotNull(), F.map_from_arrays(F.array(*map(F.lit, last)), F.array(*(F.try_element_at("fields", F.lit(h)) for h in last.values())))))
    known = points.withColumns({"lng": number(F.try_element_at("fields", F.lit(lng))), "lat": number(F.try_element_at("fields", F.lit(lat)))})
    good = F.col("lng").isNotNull() & F.col("lat").isNotNull()
    parts = known.where(good).select(F.col("index").alias("find_index"), F.lit(0).alias("part_no"), F.lit("Point").alias("kind"), point_rings(F.col("lng"), F.col("lat")).alias("rings"), F.try_element_at("props", F.lit("id")).alias("id"), "props", F.lit("csv").alias("src"))
    return parts, reject(known.where(~good), "build", "index", "CannotParseRecord", F.when(F.col("fields").isNull(), "wrong number of fields").otherwise("lng or lat is no number"))
