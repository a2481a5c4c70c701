"""Streams of query points against fixed parts.

Ranks need a window over the whole batch, which streaming plans refuse, so kNN
runs per micro-batch; a batch that is repeated overwrites its own folder.  A
radius join has no rank and runs as a stateless stream-static join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.geo import EARTH_RADIUS, part_m
from ..operators.proximity import BROADCAST_PARTS, near_join
from ..sources.points import parse_points

POINTS = "input_index bigint, id string, lng_raw string, lat_raw string"


def near_stream(stream: DataFrame, parts: DataFrame, output: str, **options) -> DataStreamWriter:
    """A writer of ``near_join`` results for each micro-batch of raw points,
    to ``output``/matches and ``output``/rejects by batch."""

    def put(batch: DataFrame, number: int) -> None:
        points = parse_points(batch.select("input_index", "id", "lng_raw", "lat_raw")).persist()
        found = near_join(points, parts, **options)
        found.matches.write.mode("overwrite").parquet(f"{output}/matches/batch={number}")
        found.rejects.write.mode("overwrite").parquet(f"{output}/rejects/batch={number}")
        points.unpersist()

    return stream.writeStream.foreachBatch(put)


def radius_stream(stream: DataFrame, parts: DataFrame, r: float, radius: float = EARTH_RADIUS) -> DataFrame:
    """Append-only matches within ``r`` metres; refuses more parts than are
    broadcast (those go through ``near_stream``)."""
    if parts.count() > BROADCAST_PARTS:
        raise ValueError(f"more than {BROADCAST_PARTS} parts")
    points = parse_points(stream).where("lng is not null and lat is not null")
    d = part_m(F.col("kind"), F.col("rings"), F.col("lng"), F.col("lat"), radius)
    side = parts.select("find_index", "part_no", "kind", "rings")
    return points.join(F.broadcast(side)).withColumn("d", d).where(F.col("d") <= r).select("input_index", "id", "find_index", "part_no", F.round("d", 3).alias("distance"))
