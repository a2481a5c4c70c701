"""Header, count, fields and data of geometry files, for all formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bounds
from ..sources import geojson, kml, points, shapefile
from ..sources.load import UnsupportedFileType, extension
from .bounds import from_corners


class UnexpectedEndOfInput(ValueError):
    pass


class TypeDoesNotContainMetadata(ValueError):
    pass


def extent_of(parts: DataFrame) -> DataFrame:
    """The box around all parts."""
    box = bounds(F.col("rings"))
    return parts.agg(F.min(box["west"]).alias("west"), F.min(box["south"]).alias("south"), F.max(box["east"]).alias("east"), F.max(box["north"]).alias("north"))


def _kind(path: str) -> str:
    kind = extension(path)
    found = {"shp": "shp", "json": "json", "geojson": "json", "kml": "kml", "kmz": "kml"}.get(kind)
    if found is None:
        raise UnsupportedFileType(f"no metadata of .{kind} files")
    return found


def _stem(path: str) -> str:
    return path[: -len(".shp")]


def header(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, value) of what the file says about itself."""
    kind = _kind(path)
    if kind == "shp":
        rows = [(k, str(v)) for k, v in shapefile.shp_header(bytes(points.file_bytes(spark, path).first()["content"][:100])).items()]
    elif kind == "kml":
        rows = kml.header_rows(bytes(points.file_bytes(spark, path).first()["content"]))
    else:
        shape = F.when(F.col("type") == "FeatureCollection", F.get_json_object("top", "$.features[0].geometry.type")).when(F.col("type") == "Feature", F.get_json_object("top", "$.geometry.type")).otherwise(F.col("type"))
        row = geojson.documents(spark, path).select("type", F.coalesce(shape, F.lit("None")).alias("contains"), F.from_json(F.get_json_object("top", "$.bbox"), "array<double>").alias("bbox")).first()
        rows = [("type", row["type"]), ("contains", row["contains"])]
        if row["bbox"] is not None:
            box = from_corners(row["bbox"])
            rows.append(("bbox", f"{box.west},{box.south},{box.east},{box.north}"))
    return spark.createDataFrame(rows, "name string, value string")


def count(spark: SparkSession, path: str) -> int:
    """Top-level records: features or items, not parts."""
    kind = _kind(path)
    if kind == "shp":
        return shapefile.read_shapes(spark, path).count()
    return (kml.read_items(spark, path) if kind == "kml" else geojson.features(spark, path)).count()


def json_fields(rows: DataFrame) -> DataFrame:
    """(name, type) of the properties of (find_index, id, properties) rows.

    Keys with several types are Mixed.  The id's type is that of the first id,
    Mixed if a later row has none or another type; without ids it is left out.
    """
    types = rows.select(F.explode(geojson.type_names(F.col("properties"))).alias("name", "type"))
    keys = types.groupBy("name").agg(F.collect_set("type").alias("types")).select("name", F.when(F.size("types") > 1, "Mixed").otherwise(F.get("types", F.lit(0))).alias("type"))
    kind = geojson.type_name(F.col("id_kind")) if "id_kind" in rows.columns else F.lit("String")
    ids = rows.select("find_index", F.when(F.col("id").isNotNull(), kind).alias("t"))
    first = ids.where("t is not null").agg(F.min(F.struct("find_index", "t")).alias("f"))
    # one row against all: the first id's place and type
    later = ids.join(F.broadcast(first), F.col("find_index") >= F.col("f.find_index"))
    ident = later.select(F.col("f.t").alias("first"), "t").groupBy("first").agg(F.max(F.when(~F.col("t").eqNullSafe(F.col("first")), 1).otherwise(0)).alias("mixed"))
    named = ident.select(F.lit("id").alias("name"), F.when(F.col("mixed") == 1, "Mixed").otherwise(F.col("first")).alias("type"))
    return named.unionByName(keys.where("name <> 'id'"))


def slice_rows(rows: DataFrame, start: int = 0, length: int | None = None, rebase: bool = False) -> DataFrame:
    """Rows by their ordinal ``find_index``, which stays or is counted anew."""
    keep = F.col("find_index") >= start
    if length is not None:
        keep &= F.col("find_index") < start + length
    return rows.where(keep).withColumn("index", F.col("find_index") - start if rebase else F.col("find_index"))


def json_data(rows: DataFrame, names: list[str], start: int = 0, length: int | None = None, rebase: bool = False) -> DataFrame:
    """index, id and the named properties as text; what is missing is empty."""
    text = geojson.full_text(F.col("properties"))
    cut = slice_rows(rows, start, length, rebase).withColumn("text", text)
    return cut.select("index", F.coalesce("id", F.lit("")).alias("id"), *(F.coalesce(F.try_element_at("text", F.lit(n)), F.lit("")).alias(n) for n in names))


def shape_data(rows: DataFrame, names: list[str], start: int = 0, length: int | None = None, rebase: bool = False) -> DataFrame:
    """index and the named fields of (find_index, props) records as text."""
    cut = slice_rows(rows, start, length, rebase)
    return cut.select("index", *(F.coalesce(F.try_element_at("props", F.lit(n)), F.lit("")).alias(n) for n in names))


def fields(spark: SparkSession, path: str, start: int = 0, length: int | None = None) -> DataFrame:
    """(name, type) of the file's metadata, id first and then by name."""
    kind = _kind(path)
    if kind == "shp":
        content = points.file_bytes(spark, f"{_stem(path)}.dbf").first()
        if shapefile.read_shapes(spark, path).isEmpty() or content is None:
            raise UnexpectedEndOfInput("the file has no records")
        return spark.createDataFrame([(n, shapefile.DBASE.get(c, c)) for n, c, _ in shapefile.dbf_fields(bytes(content["content"]))], "name string, type string")
    if kind == "kml":
        names = slice_rows(kml.read_items(spark, path), start, length).select(F.explode(F.map_keys("children")).alias("name")).distinct().orderBy("name")
        return spark.createDataFrame([(n, "String") for n in ["name", "description", *(r[0] for r in names.collect())]], "name string, type string")
    if geojson.documents(spark, path).where("type not in ('Feature', 'FeatureCollection')").count():
        raise TypeDoesNotContainMetadata("a bare geometry has no metadata")
    found = json_fields(slice_rows(geojson.features(spark, path), start, length))
    return found.orderBy(F.col("name") != "id", "name")


def data(spark: SparkSession, path: str, start: int = 0, length: int | None = None, index: bool = False, rebase: bool = False) -> DataFrame:
    """The records' metadata as text columns, in file order."""
    kind = _kind(path)
    if kind == "shp":
        names = [n for n, _, _ in shapefile.dbf_fields(bytes(points.file_bytes(spark, f"{_stem(path)}.dbf").first()["content"]))]
        out = shape_data(shapefile.read_shapes(spark, path), names, start, length, rebase)
    elif kind == "kml":
        names = [r["name"] for r in fields(spark, path, start, length).collect()][2:]
        rows = slice_rows(kml.read_items(spark, path), start, length, rebase)
        text = lambda c: F.coalesce(c, F.lit(""))
        out = rows.select("index", text(F.col("name")).alias("name"), text(F.col("description")).alias("description"), *(text(F.try_element_at("children", F.lit(n))).alias(n) for n in names))
    else:
        names = [r["name"] for r in fields(spark, path, start, length).collect()]
        out = json_data(geojson.features(spark, path), [n for n in names if n != "id"], start, length, rebase)
        out = out if "id" in names else out.drop("id")
    out = out.orderBy("index")
    return out if index else out.drop("index")


def write_csv(rows: DataFrame, path: str, delimiter: str = ",", headers: bool = True) -> None:
    rows.write.mode("overwrite").csv(path, sep=points.check_delimiter(delimiter), header=headers)
