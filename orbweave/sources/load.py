"""One entry for all geometry files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import geojson, kml, points, shapefile


class UnsupportedFileType(ValueError):
    pass


class CannotParseFileExtension(ValueError):
    pass


@dataclass
class Loaded:
    parts: DataFrame
    rejects: DataFrame


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in name.lstrip("."):
        raise CannotParseFileExtension(f"no file extension: {path}")
    return name.rsplit(".", 1)[1]


def load_geometries(spark: SparkSession, path: str) -> Loaded:
    """Parts and rejects of a .shp, .json/.geojson, .kml/.kmz or .csv file.

    Extensions count in this very case.
    """
    kind = extension(path)
    if kind == "shp":
        return Loaded(*shapefile.shape_rows(shapefile.read_shapes(spark, path)))
    if kind in ("json", "geojson"):
        return Loaded(*geojson.parts(geojson.features(spark, path)))
    if kind in ("kml", "kmz"):
        return Loaded(*kml.kml_parts(kml.read_items(spark, path)))
    if kind == "csv":
        return Loaded(*points.read_csv_parts(spark, path))
    raise UnsupportedFileType(f"cannot read .{kind} files")


def file_bbox(spark: SparkSession, path: str) -> list[float] | None:
    """The box that a shapefile or GeoJSON file states."""
    kind = extension(path)
    if kind == "shp":
        head = shapefile.shp_header(bytes(points.file_bytes(spark, path).first()["content"][:100]))
        return [head[k] for k in ("west", "south", "east", "north")]
    return geojson.file_bbox(spark, path) if kind in ("json", "geojson") else None
