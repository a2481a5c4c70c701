"""Geometry files written by Spark: GeoJSON and KML documents of bounded size,
and shapefile bytes.

Every document takes the rows of one range of their ordinals, so no task holds
more than ``per_file`` of them; the files' names follow the ordinals.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _documents(rows: DataFrame, per_file: int, text: Column) -> DataFrame:
    """(file, value): the texts (at, text) of each range, wrapped by ``text``."""
    ranges = rows.groupBy(F.floor(F.col("at") / per_file).alias("file"))
    return ranges.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts")).select("file", text.alias("value"))


#: Spark numbers the files of a task and folder with three digits, so names of more than 1,000 do not sort.
FILES_A_FOLDER = 500


def write_documents(documents: DataFrame, path: str, tasks: int = 4) -> str:
    """Each ``value`` of (file, value) as a file; paths sort as ``file`` does, which
    is a whole number from 0 below 10**9 * FILES_A_FOLDER."""
    # numbers of one width; a folder is written by one task, in order
    named = documents.withColumn("folder", F.floor(F.col("file") / FILES_A_FOLDER) + 1_000_000_000)
    dealt = named.repartitionByRange(tasks, "folder").sortWithinPartitions("folder", "file")
    dealt.select("folder", "value").write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    return path


def write_geojson(features: DataFrame, path: str, per_file: int = 10_000, bbox: list[float] | None = None) -> str:
    """Features (at, text) as collections of at most ``per_file``."""
    head = '{"type":"FeatureCollection",' + (f'"bbox":{list(bbox)},' if bbox else "") + '"features":['
    return write_documents(_documents(features, per_file, F.concat(F.lit(head), F.array_join("texts", ","), F.lit("]}"))), path)


def write_kml(items: DataFrame, path: str, per_file: int = 10_000, name: str = "") -> str:
    """Items (at, text), such as Placemarks, in a Document of each file."""
    head = f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{name}</name>'
    return write_documents(_documents(items, per_file, F.concat(F.lit(head), F.array_join("texts", "\n"), F.lit("</Document></kml>"))), path)


def shp_bytes(shapes: list[list[tuple[float, float]]]) -> bytes:
    """A .shp of points (one place), polylines (several) and null shapes (none)."""
    records = []
    for n, places in enumerate(shapes):
        line = b"".join(struct.pack("<dd", *p) for p in places)
        if len(places) > 1:
            xs, ys = zip(*places)
            body = struct.pack("<i4diii", 3, min(xs), min(ys), max(xs), max(ys), 1, len(places), 0) + line
        else:
            body = struct.pack("<i", 1 if places else 0) + line
        records.append(struct.pack(">ii", n + 1, len(body) // 2) + body)
    every = [p for places in shapes for p in places] or [(0.0, 0.0)]
    xs, ys = zip(*every)
    size = 100 + sum(map(len, records))
    return struct.pack(">i20xi", 9994, size // 2) + struct.pack("<ii4d", 1000, 3, min(xs), min(ys), max(xs), max(ys)) + bytes(32) + b"".join(records)


def dbf_bytes(fields: list[tuple[str, str, int]], rows: list[tuple[bytes, ...]]) -> bytes:
    """A .dbf of (name, type code, width) fields."""
    out = struct.pack("<4xIHH20x", len(rows), 33 + 32 * len(fields), 1 + sum(w for _, _, w in fields))
    for name, code, width in fields:
        out += name.encode("ascii").ljust(11, b"\0") + code.encode() + bytes(4) + bytes([width]) + bytes(15)
    return out + b"\r" + b"".join(b" " + b"".join(v.ljust(w)[:w] for v, (_, _, w) in zip(row, fields)) for row in rows)


def shapefiles(rows: DataFrame, fields: list[tuple[str, str, int]], per_file: int = 10_000) -> DataFrame:
    """(path, content, dbf) of rows (at, places, *fields as binary), as
    ``shapefile.shape_records`` takes them."""
    names = [n for n, _, _ in fields]

    def encode(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        shp = shp_bytes([[(p["lng"], p["lat"]) for p in places] for places in frame["places"]])
        dbf = dbf_bytes(fields, [tuple(bytes(v) for v in row) for row in zip(*(frame[n] for n in names))])
        return pd.DataFrame({"path": [f"{key[0]:012}.shp"], "content": [shp], "dbf": [dbf]})

    return rows.groupBy(F.floor(F.col("at") / per_file).alias("file")).applyInPandas(encode, "path string, content binary, dbf binary")
