"""Nearest-neighbour, kNN and radius joins of points with geometry parts.

``near_join`` matches each query point with its k nearest parts (k none or 1:
the nearest), optionally within a radius and boxes, and returns the matches and
a table of rejects.  A point without any match is a reject, so matches are an
inner join.  Ranks go by the distance rounded to millimetres, then by
``find_index`` and ``part_no``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS, bounds, closed, crossing, haversine_m, pair_haversine_m, point_columns, segment_columns, segment_pair_m, segments
from ..plans import grid
from .bounds import BBox, boxes_meet

#: Below this many pairs, and this many parts, all pairs are tried.
ALL_PAIRS = 20_000_000
BROADCAST_PARTS = 20_000
#: So few segments or points are tried with any number of queries.
FEW_PARTS = 512
#: Queries of one task, which become many rows; of fewer than two tasks' worth, they stay as stored.
QUERIES_A_TASK = 20_000
#: Columns that the matches take from the query points.
CARRIED = ("id", "lng_raw", "lat_raw")
#: Pairs that one task tries.
PAIRS_A_TASK = 500_000
#: More than BROADCAST_PARTS; millimetres times this fit into 64 bits.
PART_NUMBERS = 1 << 20
REJECT = "stage string, index bigint, code string, message string"


@dataclass
class NearResult:
    matches: DataFrame
    rejects: DataFrame


def reject(rows: DataFrame, stage: str, index: str, code: str, message: Column | str) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(stage).alias("stage"), F.col(index).cast("bigint").alias("index"), F.lit(code).alias("code"), message.alias("message"))


def admit_parts(parts: DataFrame, mode: str = "bounds", bbox: BBox | None = None) -> NearResult:
    """The parts an index takes: in point mode only points; only inside ``bbox``."""
    if mode not in ("point", "bounds"):
        raise ValueError(f"mode is point or bounds, not {mode!r}")
    wrong = F.lit(mode == "point") & (F.col("kind") != "Point")
    outside = ~bbox.contains(bounds(F.col("rings"))) if bbox else F.lit(False)
    rejects = reject(parts.where(wrong), "build", "find_index", "InsertFailedRequiresPoint", "the index takes points only")
    if bbox:
        rejects = rejects.unionByName(reject(parts.where(~wrong & outside), "build", "find_index", "InsertFailedOutOfBounds", "the geometry is out of bounds"))
    return NearResult(parts.where(~wrong & ~outside), rejects)


def admit_points(points: DataFrame, bbox: BBox | None = None) -> NearResult:
    """Query points with coordinates, inside ``bbox``."""
    known = F.col("lng").isNotNull() & F.col("lat").isNotNull()
    inside = bbox.holds(F.col("lng"), F.col("lat")) if bbox else F.lit(True)
    rejects = reject(points.where(~known), "query", "input_index", "CannotParseRecord", F.when(F.col("lng").isNull(), "lng is no number").otherwise("lat is no number"))
    if bbox:
        rejects = rejects.unionByName(reject(points.where(known & ~inside), "query", "input_index", "OutOfBounds", "the input point is out of bounds"))
    return NearResult(points.where(known & inside), rejects)


def spread(points: DataFrame, pairs: int) -> DataFrame:
    """Query points in enough partitions for so many pairs, however they are stored;
    dealt by ``input_index``, so that aggregates and ranks of a query need no other shuffle."""
    return points.repartition(max(1, min(pairs // PAIRS_A_TASK, 100_000)), "input_index") if pairs >= 2 * PAIRS_A_TASK else points


def numbered(parts: DataFrame) -> DataFrame:
    """``part``: the place of a part by find_index and part_no (few parts)."""
    return parts.withColumn("part", F.row_number().over(W.orderBy("find_index", "part_no")).cast("bigint"))


def query_rows(points: DataFrame) -> DataFrame:
    """Query points with the vectors that pair distances need."""
    lng, lat = F.col("lng"), F.col("lat")
    return points.select("input_index", "lng", "lat", *(c.alias(k) for k, c in point_columns(lng, lat).items()))


def segment_rows(parts: DataFrame, *keys: str) -> DataFrame:
    """A row for each segment of the parts, with its vectors computed once."""
    rings = parts.select(*keys, "kind", F.explode("rings").alias("ring"))
    lines = rings.select(*keys, "kind", F.explode(segments(F.when(F.col("kind") == "Polygon", closed(F.col("ring"))).otherwise(F.col("ring")))).alias("s"))
    return lines.select(*keys, (F.col("kind") == "Polygon").alias("area"), *(c.alias(k) for k, c in segment_columns(F.col("s.a"), F.col("s.b")).items()))


def nearest_segments(met: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Distance ``d`` of each query and part from rows of a query and a segment;
    0 inside a polygon."""
    near = met.select("input_index", *keys, segment_pair_m(radius).alias("d"), F.when(F.col("area"), crossing(F.col("lng"), F.col("lat"))).otherwise(0).alias("crossed"))
    whole = near.groupBy("input_index", *keys).agg(F.min("d").alias("d"), F.sum("crossed").alias("crossed"))
    return whole.select("input_index", *keys, F.when(F.col("crossed") % 2 == 1, 0.0).otherwise(F.col("d")).alias("d"))


def all_pairs(points: DataFrame, parts: DataFrame, points_only: bool, radius: float) -> DataFrame:
    """Distances of every pair of a point and a part of ``numbered`` parts; their
    number is checked.

    Parts are taken apart into segments whose vectors are computed once, and the
    segments of a part come together again by a hash aggregate.
    """
    queries = query_rows(points)
    if points_only:
        first = F.get(F.get("rings", F.lit(0)), F.lit(0))
        side = parts.select("part", "find_index", "part_no", F.radians(first["lng"]).alias("a_rlng"), F.radians(first["lat"]).alias("a_rlat"), F.cos(F.radians(first["lat"])).alias("a_cos"))
        return queries.join(F.broadcast(side)).select("input_index", "part", "find_index", "part_no", pair_haversine_m("a", radius).alias("d"))
    met = queries.join(F.broadcast(segment_rows(parts, "part")))
    whole = nearest_segments(met, ["part"], radius)
    named = whole.join(F.broadcast(parts.select("part", "find_index", "part_no")), "part")
    return named.select("input_index", "part", "find_index", "part_no", "d")


def nearest_pairs(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Of all pairs with ``part`` numbers the nearest of each query, by one hash
    aggregate over whole numbers: millimetres first, then the part's place."""
    best = pairs.groupBy("input_index").agg(F.min(millimetres() * F.lit(PART_NUMBERS) + F.col("part")).alias("best"))
    cut = best.select("input_index", F.call_function("div", F.col("best"), F.lit(PART_NUMBERS)).alias("mm"), (F.col("best") % PART_NUMBERS).alias("part"))
    return cut.withColumn("d", F.col("mm") / 1000).join(F.broadcast(parts.select("part", "find_index", "part_no")), "part").select("input_index", "find_index", "part_no", "d")


def millimetres() -> Column:
    """Distances as ranks compare them."""
    return F.floor(F.col("d") * 1000 + 0.5)


def rounded() -> Column:
    """``round(d, 3)``, which goes by the decimal digits of d; those are looked at
    only near a tie, where floating point could round otherwise."""
    x = F.col("d") * 1000
    clear = (F.abs(x) < 1e11) & (F.abs(x - F.floor(x) - 0.5) > 0.001)
    return F.when(clear, F.floor(x + 0.5) / 1000).otherwise(F.round("d", 3))


def segment_count(parts: DataFrame) -> Column:
    """Segments of a part, one at least for each ring."""
    return F.aggregate("rings", F.lit(0).cast("bigint"), lambda n, ring: n + F.greatest(F.size(ring), F.lit(1)))


def grid_pairs(points: DataFrame, parts: DataFrame, k: int | None, r: float | None, points_only: bool, radius: float, segments: int, features: bool = False) -> DataFrame:
    """Distances of all pairs that can matter, by the grid; with ``features`` for the k nearest features."""
    queries = points.select("input_index", "lng", "lat")
    if k is None:
        reach = queries.withColumn("reach", F.lit(float(r)))
    else:
        # a millimetre more, as ranks go by rounded distances
        reach = grid.upper_bounds(queries, parts, k, radius, features).withColumn("reach", F.col("reach") + 0.001)
        if r is not None:
            reach = reach.withColumn("reach", F.least("reach", F.lit(float(r))))
    pairs = grid.candidates(reach, parts, points_only, radius)
    if points_only:
        met = pairs.select("input_index", "find_index", "part_no", haversine_m("lng", "lat", "vlng", "vlat", radius).alias("d"), "reach")
        return met.where(F.col("d") <= F.col("reach")).drop("reach")
    key = ["input_index", "lng", "lat", "find_index", "part_no"]
    pairs = pairs.select(key)
    if not parts.where("kind = 'Polygon'").isEmpty():
        pairs = pairs.unionByName(grid.polygon_candidates(queries, parts))
    # by query, so that what follows needs no other shuffle
    pairs = pairs.repartition("input_index").distinct()
    asked = pairs.select(*key, *(c.alias(n) for n, c in point_columns(F.col("lng"), F.col("lat")).items()))
    rows = segment_rows(parts, "find_index", "part_no")
    met = asked.join(F.broadcast(rows) if segments <= BROADCAST_PARTS else rows.hint("merge"), ["find_index", "part_no"])
    return nearest_segments(met, ["find_index", "part_no"], radius)


def distances(points: DataFrame, parts: DataFrame, k: int | None, r: float | None, points_only: bool | None, strategy: str, radius: float, features: bool = False) -> DataFrame:
    if k is None and r is None:
        raise ValueError("k or a radius is needed")
    if points_only is None:
        points_only = parts.where("kind <> 'Point'").isEmpty()
    segments = 0
    if strategy != "grid" or not points_only or k is None:
        n, segments = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(1) if points_only else segment_count(parts)), F.lit(0))).first()
    m = points.count()
    if strategy == "auto":
        strategy = "pairs" if n <= BROADCAST_PARTS and n * m <= ALL_PAIRS or segments <= FEW_PARTS else "grid"
    if strategy == "pairs":
        if n >= PART_NUMBERS:
            raise ValueError(f"{n} parts are too many for all pairs")
        parts = numbered(parts)
        out = all_pairs(spread(points, segments * m), parts, points_only, radius)
        if k == 1 and not features:
            out = nearest_pairs(out.where(F.col("d") <= r) if r is not None else out, parts)
            return out
    elif strategy == "grid" and k is None and points_only:
        # all pairs within a radius are kept, so they bring the columns of their queries along and are not joined again
        queries = points.select("input_index", "lng", "lat", *(c for c in CARRIED if c in points.columns))
        return grid.within(queries, parts, r, min(n, m), n <= m, radius)
    elif strategy == "grid":
        if m >= 2 * QUERIES_A_TASK:
            points = points.repartition(min(m // QUERIES_A_TASK, 10_000), "input_index")
        out = grid_pairs(points, parts, k, r, points_only, radius, segments, features)
    else:
        raise ValueError(f"strategy is auto, pairs or grid, not {strategy!r}")
    return out.where(F.col("d") <= r) if r is not None else out


def rank(pairs: DataFrame, k: int | None, dedupe_features: bool = False) -> DataFrame:
    """The k first of each query; of a feature with several parts optionally
    only the nearest part."""
    order = ["mm", "find_index", "part_no"]
    pairs = pairs.select("input_index", "find_index", "part_no", "d", millimetres().alias("mm"), *(c for c in CARRIED if c in pairs.columns))
    if dedupe_features:
        pairs = pairs.withColumn("f", F.row_number().over(W.partitionBy("input_index", "find_index").orderBy(*order))).where("f = 1").drop("f")
    if k is None:
        ranked = pairs.withColumn("rank", F.lit(None).cast("int"))
    else:
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("input_index").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.withColumn("distance", rounded()).drop("mm")


def near_join(
    points: DataFrame, parts: DataFrame, k: int | None = 1, r: float | None = None, bbox: BBox | None = None, mode: str = "bounds",
    fields: tuple[str, ...] = (), id_label: str = "id", strategy: str = "auto", dedupe_features: bool = False, points_only: bool | None = None,
    radius: float = EARTH_RADIUS, ordered: bool = False,
) -> NearResult:
    """Matches with the columns ``input_index, <id_label>, lng, lat, distance,
    find_index, *fields`` (and ``part_no``, ``rank``), and rejects.

    ``k`` 0 gives no matches; ``k`` none with a radius gives all parts within.
    The metadata of parts is joined after ranking.
    """
    build, probe = admit_parts(parts, mode, bbox), admit_points(points, bbox)
    if k == 0:
        pairs = probe.matches.select("input_index").join(build.matches.select("find_index", "part_no").where("false")).select("input_index", "find_index", "part_no", F.lit(0.0).alias("d"))
    else:
        pairs = distances(probe.matches, build.matches, k, r, points_only or (True if mode == "point" else None), strategy, radius, dedupe_features)
    top = rank(pairs, k, dedupe_features)
    # merged, as sizes of exploded and computed rows are underestimated and large tables would be broadcast
    found = top if CARRIED[0] in top.columns else top.join(probe.matches.select("input_index", *CARRIED).hint("merge"), "input_index")
    if fields:
        found = found.join(parts.select("find_index", "part_no", "props", F.col("id").alias("feature_id"), "src").hint("merge"), ["find_index", "part_no"])
    matches = found.select(
        "input_index", F.coalesce("id", F.lit("")).alias(id_label), F.col("lng_raw").alias("lng"), F.col("lat_raw").alias("lat"), "distance", "find_index",
        *(field_value(f).alias(f) for f in fields), "part_no", F.col("rank").cast("bigint").alias("rank"),
    )
    missed = probe.matches.join(top.select("input_index").distinct().hint("merge"), "input_index", "left_anti")
    rejects = build.rejects.unionByName(probe.rejects).unionByName(reject(missed, "find", "input_index", "NoMatch", "nothing was found within the limits"))
    return NearResult(matches.orderBy("input_index", "rank") if ordered else matches, rejects)


def field_value(name: str) -> Column:
    """A metadata field as text, empty if unknown; CSV fields whatever their
    case, and ``id`` of GeoJSON is the feature's id."""
    value = F.when(F.col("src") == "csv", F.get(F.filter(F.map_values(F.map_filter("props", lambda k, _: F.lower(k) == name.lower())), lambda _: F.lit(True)), F.lit(0))).otherwise(F.try_element_at("props", F.lit(name)))
    if name == "id":
        value = F.when(F.col("src") == "json", F.col("feature_id")).otherwise(value)
    return F.coalesce(value, F.lit(""))


def index_size(parts: DataFrame) -> DataFrame:
    return parts.agg(F.count(F.lit(1)).alias("size"))


def describe_index(parts: DataFrame, level: int = 4) -> DataFrame:
    """Parts and features by kind, and the fullest cell of a grid level."""
    vertex = F.get(F.get("rings", F.lit(0)), F.lit(0))
    cell = grid._cell(grid.unit_vector(vertex["lng"], vertex["lat"]), level)
    cells = parts.groupBy("kind", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("kind").agg(F.sum("n").alias("parts"), F.count(F.lit(1)).alias("cells"), F.max("n").alias("fullest"))


def retrieve(parts: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs of a probe part and the parts whose bounding boxes meet its own.

    Boxes are dealt to cells of ten degrees; pairs meet by an equi-join.
    """
    at = lambda x: F.floor(x / 10).cast("int")
    spread = lambda df, p: df.select(F.col("find_index").alias(f"{p}_index"), F.col("part_no").alias(f"{p}_part"), bounds(F.col("rings")).alias(f"{p}_box")).withColumn("i", F.explode(F.sequence(at(F.col(f"{p}_box.west")), at(F.col(f"{p}_box.east"))))).withColumn("j", F.explode(F.sequence(at(F.col(f"{p}_box.south")), at(F.col(f"{p}_box.north")))))
    met = spread(probes, "probe").join(spread(parts, "find"), ["i", "j"]).where(boxes_meet(F.col("probe_box"), F.col("find_box")))
    return met.select("probe_index", "probe_part", "find_index", F.col("find_part").alias("part_no")).distinct()
