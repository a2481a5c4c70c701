"""Command line: ``python -m orbweave.cli proximity|meta|bench ...``."""

from __future__ import annotations

import argparse
import csv
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .operators import metadata, workloads
from .operators.bounds import resolve_bbox
from .operators.proximity import describe_index, near_join
from .sources.geojson import MissingBoundingBox
from .sources.load import file_bbox, load_geometries
from .sources.points import check_delimiter, read_query_points
from .sources.sinks import match_lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orbweave")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("proximity", help="join points with the nearest parts of a geometry file")
    p.add_argument("path", help="geometry file: shp, json, geojson, kml, kmz or csv")
    p.add_argument("points", help="CSV file of query points")
    p.add_argument("--point", action="store_true", help="index points only")
    p.add_argument("-k", type=int, default=1)
    p.add_argument("-r", type=float, help="radius in metres")
    box = p.add_mutually_exclusive_group()
    box.add_argument("-s", "--sphere", action="store_true", help="bounds are the whole sphere")
    box.add_argument("-x", "--bbox", help="bounds as four comma-separated numbers")
    p.add_argument("--fields", default="", help="comma-separated metadata to add")
    p.add_argument("--id-col", default="id", help="column of the points' ids")
    p.add_argument("--id-label", default="id", help="name of the ids in the output")
    p.add_argument("--delimiter", default=",")
    p.add_argument("--ordered", action="store_true", help="keep the order of the points")
    p.add_argument("--print", dest="describe", action="store_true", help="describe the index on stderr")
    p.add_argument("--depth", type=int, default=10, help="grid level of the index description; never changes results")
    p.add_argument("--children", type=int, default=10, help="accepted for compatibility; the grid has no node capacity")
    p.add_argument("--verbose", action="store_true", help="timings on stderr")
    p.add_argument("-o", "--output", help="folder for CSV output, else stdout")
    m = commands.add_parser("meta", help="what a geometry file holds")
    m.add_argument("what", choices=["header", "count", "fields", "data"])
    m.add_argument("path")
    m.add_argument("--types", action="store_true")
    m.add_argument("--headers", action="store_true")
    m.add_argument("--index", action="store_true")
    m.add_argument("--rebase", action="store_true", help="count the index from the first row shown")
    m.add_argument("--start", type=int, default=0)
    m.add_argument("--length", type=int)
    m.add_argument("--delimiter", default=",")
    b = commands.add_parser("bench", help="generated workloads")
    b.add_argument("what", choices=["list", "load", "remove", "clean", "build", "execute"])
    b.add_argument("name", nargs="?", help="run set (load: its file)")
    b.add_argument("--config-dir", default="bench-config")
    b.add_argument("--build-dir", default="bench-build")
    b.add_argument("-n", type=int, default=1, help="iterations of each run")
    return top


def _print(rows: DataFrame, delimiter: str, headers: bool) -> None:
    out = csv.writer(sys.stdout, delimiter=check_delimiter(delimiter), lineterminator="\n")
    if headers:
        out.writerow(rows.columns)
    for row in rows.toLocalIterator():
        out.writerow(["" if x is None else x for x in row])


def _proximity(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.perf_counter()
    fields = tuple(f for f in a.fields.split(",") if f)
    stated = None
    if not a.sphere and a.bbox is None:
        try:
            stated = file_bbox(spark, a.path)
        except MissingBoundingBox:
            stated = None
    bbox = None if a.sphere else resolve_bbox(text=a.bbox, file_bbox=stated)
    index = load_geometries(spark, a.path)
    points = read_query_points(spark, a.points, a.delimiter, a.id_col)
    found = near_join(points, index.parts, k=a.k, r=a.r, bbox=bbox, mode="point" if a.point else "bounds", fields=fields, id_label=a.id_label, ordered=a.ordered)
    if a.describe:
        for row in describe_index(index.parts, max(0, min(a.depth, 13))).collect():
            print(*row, file=sys.stderr)
    lines = match_lines(found.matches, a.id_label, fields)
    if a.output:
        lines.write.mode("overwrite").csv(a.output, header=True, sep=check_delimiter(a.delimiter))
    else:
        _print(lines, a.delimiter, True)
    for row in index.rejects.unionByName(found.rejects).toLocalIterator():
        print(f"{row['stage']} {row['index']}: {row['message']}", file=sys.stderr)
    if a.verbose:
        print(f"{time.perf_counter() - began:.3f} s", file=sys.stderr)


def _meta(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.what == "header":
        for row in metadata.header(spark, a.path).collect():
            print(f"{row['name']}: {row['value']}")
    elif a.what == "count":
        print(metadata.count(spark, a.path))
    elif a.what == "fields":
        for row in metadata.fields(spark, a.path, a.start, a.length).collect():
            print(f"{row['name']} [{row['type']}]" if a.types else row["name"])
    else:
        _print(metadata.data(spark, a.path, a.start, a.length, a.index, a.rebase), a.delimiter, a.headers)


def _bench(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.what == "list":
        _print(workloads.list_runs(workloads.read_runs(spark, f"{a.config_dir}/*.json")).orderBy("file", "index"), ",", True)
    elif a.what == "load":
        print(workloads.load_runs(a.name, a.config_dir))
    elif a.what == "remove":
        workloads.remove_runs(a.name, a.config_dir, a.build_dir)
    elif a.what == "clean":
        workloads.clean(a.build_dir)
    else:
        runs = workloads.check_runs(f"{a.config_dir}/{a.name}.json")
        if a.what == "build":
            workloads.clean(a.build_dir)
            workloads.build(spark, runs, a.name, a.build_dir)
        else:
            for row in workloads.execute(spark, runs, a.name, a.build_dir, a.n):
                print(json.dumps(row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("orbweave").getOrCreate()
    {"proximity": _proximity, "meta": _meta, "bench": _bench}[a.command](spark, a)


if __name__ == "__main__":
    main()
