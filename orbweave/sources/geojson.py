"""GeoJSON: features, parts, metadata text.

Files are read whole by Spark's text reader and taken apart with JSON functions;
only the features' array becomes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.proximity import reject
from .points import over_files

_POINT, _LINE, _AREA = "array<double>", "array<array<double>>", "array<array<array<double>>>"
_MULTI = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


class MissingBoundingBox(ValueError):
    pass


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, top, type): the whole text of each file and its top-level type."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("top"))
    return rows.withColumn("type", F.get_json_object("top", "$.type"))


def features(spark: SparkSession, path: str) -> DataFrame:
    """(find_index, id, geometry, properties) as JSON text, in file order.

    A bare geometry is feature 0 without metadata.
    """
    many = F.from_json(F.get_json_object("top", "$.features"), "array<string>")
    one = F.array(F.when(F.col("type") == "Feature", F.col("top")).otherwise(F.concat(F.lit('{"geometry":'), F.col("top"), F.lit("}"))))
    files = documents(spark, path)
    rows = files.select("path", F.posexplode(F.when(F.col("type") == "FeatureCollection", many).otherwise(one)).alias("find_index", "f"))
    rows = over_files(rows.withColumn("find_index", F.col("find_index").cast("bigint")), "find_index", len(files.inputFiles()))
    fields = F.from_json("f", "struct<id:string,geometry:string,properties:string>")
    return rows.select(F.col("find_index").cast("bigint").alias("find_index"), fields.alias("x"), "f").select("find_index", F.col("x.id").alias("id"), F.col("x.geometry").alias("geometry"), F.col("x.properties").alias("properties"), F.expr("schema_of_variant(variant_get(try_parse_json(f), '$.id', 'variant'))").alias("id_kind"))


def _pairs(line: Column) -> Column:
    return F.transform(line, lambda c: F.struct(F.get(c, F.lit(0)).alias("lng"), F.get(c, F.lit(1)).alias("lat")))


def parts(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each simple geometry; features without a usable one are rejects."""
    kind = F.get_json_object("geometry", "$.type")
    coordinates = F.get_json_object("geometry", "$.coordinates")
    read = lambda schema: F.from_json(coordinates, schema)
    area = lambda a: F.transform(a, _pairs)
    rings = (
        F.when(kind == "Point", F.array(F.array(_pairs(F.array(read(_POINT))))))
        .when(kind == "MultiPoint", F.transform(read(_LINE), lambda p: F.array(_pairs(F.array(p)))))
        .when(kind == "LineString", F.array(F.array(_pairs(read(_LINE)))))
        .when(kind == "MultiLineString", F.transform(read(_AREA), lambda r: F.array(_pairs(r))))
        .when(kind == "Polygon", F.array(area(read(_AREA))))
        .when(kind == "MultiPolygon", F.transform(read(f"array<{_AREA}>"), area))
    )
    rows = features.withColumns({"type": kind, "all": rings})
    missing, unknown = F.col("geometry").isNull(), F.col("all").isNull()
    rejects = reject(rows.where(missing), "build", "find_index", "MissingGeometry", "the feature has no geometry").unionByName(
        reject(rows.where(~missing & unknown), "build", "find_index", "UnsupportedGeometry", F.concat(F.lit("cannot index "), F.coalesce("type", F.lit("?"))))
    )
    simple = F.col("type")
    for many, one in _MULTI.items():
        simple = F.when(F.col("type") == many, one).otherwise(simple)
    out = rows.where(~missing & ~unknown).select("find_index", "id", "properties", simple.alias("kind"), F.posexplode("all").alias("part_no", "rings"))
    return out.select("find_index", "part_no", "kind", "rings", "id", flat_text(F.col("properties")).alias("props"), F.lit("json").alias("src")), rejects


def _texts(properties: Column) -> Column:
    return F.from_json(properties, "map<string,string>")


def flat_text(properties: Column) -> Column:
    """Metadata beside matches: null, arrays and objects are empty."""
    kinds = F.from_json(properties, "map<string,variant>")
    kind = lambda k: F.call_function("schema_of_variant", F.try_element_at(kinds, k))
    return F.transform_values(_texts(properties), lambda k, v: F.when(v.isNull() | kind(k).startswith("ARRAY") | kind(k).startswith("OBJECT"), "").otherwise(v))


def full_text(properties: Column) -> Column:
    """Metadata listings: everything but strings as JSON, so null is ``null``."""
    return F.transform_values(_texts(properties), lambda k, v: F.coalesce(v, F.lit("null")))


def type_names(properties: Column) -> Column:
    """Map of keys to Null, Bool, Number, String, Array or Object."""
    return F.transform_values(F.from_json(properties, "map<string,variant>"), lambda k, v: type_name(F.call_function("schema_of_variant", v)))


def type_name(schema: Column) -> Column:
    return (
        F.when(schema.isNull() | (schema == "VOID"), "Null").when(schema == "BOOLEAN", "Bool").when(schema == "STRING", "String")
        .when(schema.startswith("ARRAY"), "Array").when(schema.startswith("OBJECT"), "Object").otherwise("Number")
    )


def file_bbox(spark: SparkSession, path: str) -> list[float]:
    box = documents(spark, path).select(F.from_json(F.get_json_object("top", "$.bbox"), "array<double>")).first()[0]
    if box is None:
        raise MissingBoundingBox("the file has no bbox")
    return box
