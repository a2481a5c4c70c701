"""KML and KMZ as a Python data source: items in document order.

Folders and documents are flattened depth first.  ``spark.read.format("kml")``
gives one row for each item; ``kml_parts`` turns items into geometry parts.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import RINGS
from ..operators.proximity import reject
from .points import file_bytes, over_files

_FOLDERS = {"kml", "Document", "Folder"}
_SHAPES = {"Point", "LineString", "LinearRing", "Polygon", "MultiGeometry", "Location"}
ITEM = f"find_index bigint, type string, name string, description string, attrs map<string,string>, children map<string,string>, parts array<struct<kind:string,rings:{RINGS},attrs:map<string,string>>>, error string"


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element | None) -> str | None:
    return None if element is None else "".join(element.itertext()).strip()


def _child(element: ElementTree.Element, *names: str) -> ElementTree.Element | None:
    return next((c for c in element if _local(c) in names), None)


def _positions(element: ElementTree.Element) -> list[dict]:
    out = []
    for triple in (_text(_child(element, "coordinates")) or "").split():
        lng, lat = (float(x) for x in triple.split(",")[:2])
        out.append({"lng": lng, "lat": lat})
    return out


def geometry_parts(element: ElementTree.Element, nested: bool = False) -> list[dict]:
    """Parts of a geometry element; a collection inside another is an error."""
    kind, attrs = _local(element), {k.rsplit("}", 1)[-1]: v for k, v in element.attrib.items()}
    if kind == "Point":
        return [{"kind": "Point", "rings": [_positions(element)[:1]], "attrs": attrs}]
    if kind in ("LineString", "LinearRing"):
        return [{"kind": "LineString", "rings": [_positions(element)], "attrs": attrs}]
    if kind == "Polygon":
        borders = [c for c in element if _local(c) in ("outerBoundaryIs", "innerBoundaryIs")]
        return [{"kind": "Polygon", "rings": [_positions(r) for b in borders for r in b if _local(r) == "LinearRing"], "attrs": attrs}]
    if kind == "Location":
        at = {"lng": float(_text(_child(element, "longitude")) or 0), "lat": float(_text(_child(element, "latitude")) or 0)}
        return [{"kind": "Point", "rings": [[at]], "attrs": attrs}]
    if kind == "MultiGeometry" and not nested:
        return [p for c in element if _local(c) in _SHAPES for p in geometry_parts(c, nested=True)]
    raise ValueError("NestedKmlMulti" if kind == "MultiGeometry" else "UnknownKml")


def items(content: bytes) -> Iterator[dict]:
    """Items of a KML document, or of the first one in a KMZ archive."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))

    def walk(element: ElementTree.Element) -> Iterator[ElementTree.Element]:
        for child in element:
            if _local(child) in _FOLDERS:
                yield from walk(child)
            elif _local(child) in _SHAPES or _local(child) == "Placemark":
                yield child

    root = ElementTree.fromstring(content)
    found = walk(root) if _local(root) in _FOLDERS else iter([root])
    for index, element in enumerate(found):
        kind, parts, error = _local(element), [], None
        shape = element if kind != "Placemark" else _child(element, *_SHAPES)
        try:
            if shape is None:
                error = "MissingGeometry"
            else:
                parts = geometry_parts(shape, nested=kind == "Placemark")
                if any(not r for p in parts for r in p["rings"]) or any(not p["rings"] for p in parts):
                    parts, error = [], "MissingGeometry"
        except ValueError as e:
            parts, error = [], str(e) if str(e) in ("NestedKmlMulti", "UnknownKml") else "CannotParseGeometry"
        simple = {_local(c): _text(c) or "" for c in element if not len(c) and _local(c) not in ("name", "description", "coordinates")} if kind == "Placemark" else {}
        yield {
            "find_index": index, "type": kind, "name": _text(_child(element, "name")), "description": _text(_child(element, "description")),
            "attrs": {k.rsplit("}", 1)[-1]: v for k, v in element.attrib.items()}, "children": simple, "parts": parts, "error": error,
        }


def header_rows(content: bytes) -> list[tuple[str, str]]:
    """Simple children of the first Document."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(next(n for n in z.namelist() if n.lower().endswith(".kml")))
    root = ElementTree.fromstring(content)
    first = next((e for e in root.iter() if _local(e) == "Document"), None)
    return [] if first is None else [(_local(c), _text(c) or "") for c in first if not len(c)]


def _file_items(content: bytes) -> Iterator[dict]:
    """A file that is no KML is one item with an error."""
    try:
        yield from items(content)
    except (ElementTree.ParseError, zipfile.BadZipFile, StopIteration) as e:
        yield {"find_index": 0, "type": "", "name": None, "description": None, "attrs": {}, "children": {}, "parts": [], "error": f"CannotReadKml: {e}"}


def read_items(spark: SparkSession, path: str) -> DataFrame:
    columns = ["find_index", "type", "name", "description", "attrs", "children", "parts", "error"]

    def run(frames):
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                rows = pd.DataFrame(list(_file_items(bytes(content))), columns=columns)
                yield rows.assign(path=where)[["path", *columns]]

    files = file_bytes(spark, path)
    return over_files(files.mapInPandas(run, f"path string, {ITEM}"), "find_index", len(files.inputFiles())).drop("path")


def kml_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts with name, description and XML attributes; items without are rejects."""
    rejects = reject(rows.where("error is not null"), "build", "find_index", "KmlGeometry", F.col("error")).withColumn("code", F.col("message"))
    good = rows.where("error is null").select("*", F.posexplode("parts").alias("part_no", "p"))
    own = F.when(F.col("type") == "MultiGeometry", F.col("p.attrs")).otherwise(F.col("attrs"))
    named = F.create_map(F.lit("name"), F.coalesce("name", F.lit("")), F.lit("description"), F.coalesce("description", F.lit("")))
    props = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin("name", "description")), named)
    return good.select("find_index", "part_no", F.col("p.kind").alias("kind"), F.col("p.rings").alias("rings"), F.lit(None).cast("string").alias("id"), props.alias("props"), F.lit("kml").alias("src")), rejects
