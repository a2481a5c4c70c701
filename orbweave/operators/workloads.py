"""Run sets: list, load, remove, clean, build and timed execution."""

from __future__ import annotations

import json
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import as_point, point_rings
from .proximity import near_join

RUN = "struct<shape:string,count:bigint,meta:bigint,cmp:bigint,desc:string>"
SHAPES = {"point": "Point", "Point": "Point", "POINT": "Point", "linestring": "LineString", "LineString": "LineString", "LINESTRING": "LineString", "lineString": "LineString"}


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, runs) of run-set files; the name is the file's without .json."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file"), F.from_json("value", f"array<{RUN}>").alias("runs"))
    return rows


def list_runs(sets: DataFrame) -> DataFrame:
    runs = sets.select("file", F.posexplode("runs").alias("index", "run"))
    return runs.select("file", F.col("index").cast("bigint").alias("index"), "run.shape", "run.count", "run.meta", "run.cmp")


def check_runs(path: str) -> list[dict]:
    """The runs of one file, checked."""
    runs = json.loads(Path(path).read_text())
    for run in runs:
        if run["shape"] not in SHAPES or any(not isinstance(run[k], int) or run[k] < 0 for k in ("count", "meta", "cmp")):
            raise ValueError(f"not a run: {run}")
    return runs


def load_runs(path: str, config_dir: str) -> Path:
    """Copy a run set to the configuration; it must not be there yet."""
    check_runs(path)
    to = Path(config_dir) / Path(path).name
    if to.exists():
        raise FileExistsError(str(to))
    to.parent.mkdir(parents=True, exist_ok=True)
    return Path(shutil.copy(path, to))


def remove_runs(name: str, config_dir: str, build_dir: str) -> None:
    (Path(config_dir) / f"{name}.json").unlink(missing_ok=True)
    shutil.rmtree(Path(build_dir) / name, ignore_errors=True)


def clean(build_dir: str) -> None:
    shutil.rmtree(build_dir, ignore_errors=True)


def random_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, lng, lat) uniform in degrees."""
    return spark.range(n).select("id", (F.rand(seed) * 360 - 180).alias("lng"), (F.rand(seed + 1) * 180 - 90).alias("lat"))


def hashed_points(spark: SparkSession, n: int) -> DataFrame:
    """(id, lng, lat) spread by integer arithmetic, equal in every engine."""
    i = F.col("id")
    return spark.range(n).select("id", (i * 48271 % 3600001 / 10000.0 - 180).alias("lng"), (i * 69621 % 1800001 / 10000.0 - 90).alias("lat"))


def random_parts(spark: SparkSession, n: int, shape: str = "point", meta: int = 0, seed: int = 0) -> DataFrame:
    """Parts of a run: points, or lines of up to a degree, with ``meta`` fields."""
    rows = random_points(spark, n, seed)
    lng, lat = F.col("lng"), F.col("lat")
    line = F.array(F.array(as_point(lng, lat), as_point(F.least(lng + F.rand(seed + 2), F.lit(180.0)), F.least(lat + F.rand(seed + 3), F.lit(90.0)))))
    kind = SHAPES[shape]
    props = F.map_from_arrays(F.array(*(F.lit(f"field{k}") for k in range(meta))), F.array(*(F.concat(F.lit(f"v{k}-"), F.col("id")) for k in range(meta)))) if meta else F.lit(None).cast("map<string,string>")
    return rows.select(F.col("id").alias("find_index"), F.lit(0).alias("part_no"), F.lit(kind).alias("kind"), (point_rings(lng, lat) if kind == "Point" else line).alias("rings"), F.lit(None).cast("string").alias("id"), props.alias("props"), F.lit("shp").alias("src"))


def as_queries(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("input_index"), F.col("id").cast("string").alias("id"), F.col("lng").cast("string").alias("lng_raw"), F.col("lat").cast("string").alias("lat_raw"), "lng", "lat")


def build(spark: SparkSession, runs: list[dict], name: str, build_dir: str, seed: int = 0) -> None:
    """Write the data and query points of all runs, over any older ones."""
    for k, run in enumerate(runs):
        random_parts(spark, run["count"], run["shape"], run["meta"], seed).write.mode("overwrite").parquet(f"{build_dir}/{name}/{k}/data")
        as_queries(random_points(spark, run["cmp"], seed + 10)).write.mode("overwrite").parquet(f"{build_dir}/{name}/{k}/cmp")


def execute(spark: SparkSession, runs: list[dict], name: str, build_dir: str, times: int = 1) -> list[dict]:
    """Time each run: read, join with the nearest part, drop the output."""
    out = []
    build(spark, runs, name, build_dir)
    for k, run in enumerate(runs):
        for i in range(times):
            began = time.perf_counter()
            parts, points = spark.read.parquet(f"{build_dir}/{name}/{k}/data"), spark.read.parquet(f"{build_dir}/{name}/{k}/cmp")
            near_join(points, parts, points_only=SHAPES[run["shape"]] == "Point").matches.write.format("noop").mode("overwrite").save()
            out.append({"name": name, "index": k, "iteration": i, "shape": run["shape"], "data_count": run["count"], "cmp_count": run["cmp"], "time": round(1000 * (time.perf_counter() - began)), "desc": run.get("desc") or ""})
        shutil.rmtree(f"{build_dir}/{name}/{k}", ignore_errors=True)
    return out
