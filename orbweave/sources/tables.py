"""Points and geometries derived from the relational test tables.

The tables have no coordinates; both engines derive them from integer keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import as_point, point_rings


def lng_of(key: Column) -> Column:
    return F.pmod(key.cast("bigint") * 7919, F.lit(36001)).cast("double") / 100 - 180


def lat_of(key: Column) -> Column:
    return F.pmod(key.cast("bigint") * 104729, F.lit(18001)).cast("double") / 100 - 90


def lng_sql(key: str) -> str:
    return f"(cast((cast({key} as bigint) * 7919) % 36001 as double) / 100 - 180)"


def lat_sql(key: str) -> str:
    return f"(cast((cast({key} as bigint) * 104729) % 18001 as double) / 100 - 90)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query_points(rows: DataFrame, key: str) -> DataFrame:
    """Query points of a table: the key is ordinal and id."""
    k = F.col(key).cast("bigint")
    lng, lat = lng_of(k), lat_of(k)
    return rows.select(k.alias("input_index"), k.cast("string").alias("id"), lng.cast("string").alias("lng_raw"), lat.cast("string").alias("lat_raw"), lng.alias("lng"), lat.alias("lat"))


def point_parts(rows: DataFrame, key: str, props: dict[str, str] | None = None, offset: int = 0, part_no: int = 0) -> DataFrame:
    """One point part for each row; ``offset`` shifts the key of the place."""
    k = F.col(key).cast("bigint")
    pairs = [x for name, column in (props or {}).items() for x in (F.lit(name), F.col(column).cast("string"))]
    props_column = F.create_map(*pairs) if pairs else F.lit(None)
    return rows.select(
        k.alias("find_index"), F.lit(part_no).alias("part_no"), F.lit("Point").alias("kind"), point_rings(lng_of(k + offset), lat_of(k + offset)).alias("rings"),
        F.lit(None).cast("string").alias("id"), props_column.cast("map<string,string>").alias("props"), F.lit("shp").alias("src"),
    )


def line_parts(rows: DataFrame, key: str) -> DataFrame:
    """Lines from each key's place to the next key's, kept off the poles."""
    k = F.col(key).cast("bigint")
    a, b = as_point(lng_of(k), lat_of(k)), as_point(lng_of(k + 1), lat_of(k + 1))
    return rows.select(k.alias("find_index"), F.lit(0).alias("part_no"), F.lit("LineString").alias("kind"), F.array(F.array(a, b)).alias("rings"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("map<string,string>").alias("props"), F.lit("shp").alias("src"))


def box_parts(rows: DataFrame, key: str) -> DataFrame:
    """Boxes of 40 by 30 degrees, one for each key."""
    k = F.col(key).cast("double")
    west, south = k * 60 - 150, k * 20 - 60
    corner = lambda dx, dy: as_point(west + dx, south + dy)
    ring = F.array(corner(0, 0), corner(40, 0), corner(40, 30), corner(0, 30), corner(0, 0))
    return rows.select(F.col(key).cast("bigint").alias("find_index"), F.lit(0).alias("part_no"), F.lit("Polygon").alias("kind"), F.array(ring).alias("rings"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("map<string,string>").alias("props"), F.lit("shp").alias("src"))
