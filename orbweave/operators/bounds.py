"""Bounding boxes: parsing, precedence, predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class InvalidBoundingBox(ValueError):
    pass


@dataclass(frozen=True)
class BBox:
    west: float
    south: float
    east: float
    north: float

    def holds(self, lng: Column, lat: Column) -> Column:
        """Closed on all edges."""
        return lng.between(self.west, self.east) & lat.between(self.south, self.north)

    def contains(self, box: Column) -> Column:
        """Whether a ``bounds`` struct lies inside altogether."""
        return (box["west"] >= self.west) & (box["east"] <= self.east) & (box["south"] >= self.south) & (box["north"] <= self.north)


SPHERE = BBox(-180.0, -90.0, 180.0, 90.0)


def parse_bbox(text: str) -> BBox:
    """Four comma-separated numbers (more are ignored); corners are ordered."""
    try:
        a, b, c, d = (float(x) for x in text.split(",")[:4])
    except ValueError as e:
        raise InvalidBoundingBox(f"not a bounding box: {text!r}") from e
    return from_corners([a, b, c, d])


def from_corners(numbers: list[float]) -> BBox:
    """Of 4 numbers, or 6 with heights in places 3 and 6."""
    if len(numbers) == 6:
        numbers = [numbers[0], numbers[1], numbers[3], numbers[4]]
    if len(numbers) != 4:
        raise InvalidBoundingBox(f"4 or 6 numbers are needed, not {len(numbers)}")
    a, b, c, d = map(float, numbers)
    return BBox(min(a, c), min(b, d), max(a, c), max(b, d))


def resolve_bbox(sphere: bool = False, text: str | None = None, file_bbox: list[float] | None = None) -> BBox:
    """The sphere flag, then the given text, then the file's box, then the sphere."""
    if sphere and text is not None:
        raise InvalidBoundingBox("sphere and a bounding box exclude each other")
    if sphere:
        return SPHERE
    if text is not None:
        return parse_bbox(text)
    return from_corners(file_bbox) if file_bbox is not None else SPHERE


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])
