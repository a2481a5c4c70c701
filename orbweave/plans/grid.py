"""Candidate pairs for distance joins on a 3-D grid of unit vectors.

A cell of level l has edges of 2 / 2**l.  Cells of the sphere in space know no
pole and no antimeridian.  A query looks at those of the 27 cells around its own
that its search radius and the sphere touch, at the finest level whose edge
covers the radius, so pairs meet by an equi-join on cells and none is missed.
If points of one radius meet points, parts may as well look for queries; then the
smaller side looks, and the rows of the larger are shuffled once each.

For nearest neighbours without a radius each query first takes any k parts from
cells of its own that hold k; the least of their k-th distances bounds the k-th
neighbour's, and becomes the search radius.  No loop, no all-pairs.

Spark takes rows that come out of an explode for as few as went in, and would
broadcast them; so sides that grow with the input are joined by merging, and only
the cells of coarse levels, whose number is fixed, and a list of hot cells are
broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS, closed, haversine_m, pair_haversine_m, point_columns, segments, unit_vector

LEVELS = 13
#: The level that has one cell for everything.
ALL = -1
#: Levels up to this have a few thousand cells on the sphere, whatever the input.
COARSE = 4
#: Cells that more queries ask for are dealt to several tasks.
HOT = 100_000
#: Rows of one task that looks for cells, each of which becomes several.
ASKS_A_TASK = 50_000
#: Pairs that meet in one task of ``within``, which has so many tasks at most.
PAIRS_A_TASK, MOST_TASKS = 5_000_000, 2_000
#: Cells with more pairs than this, and than this share of all, are dealt to several tasks.
HOT_PAIRS, HOT_SHARE = 50_000_000, 1 / 200
#: Positions of cells, which run from -2**12 - 1 to 2**12 + 1, as 14 bits.
_SHIFT, _SPAN = 5_000, 1 << 14
#: Steps of a rounded position on each axis, and half a chord by which it is off at most.
_STEPS = 1 << 21
_PLACE_ERROR = 5e-7


def _size(level: Column) -> Column:
    return F.lit(2.0) / F.pow(F.lit(2.0), level)


def _at(x: Column, level: Column) -> Column:
    """Position of a cell on one axis; level ALL has one cell."""
    return F.when(level == ALL, 0).otherwise(F.floor(x / _size(level))).cast("bigint")


def _packed(i: Column, j: Column, k: Column, level: Column) -> Column:
    """A cell as one number."""
    out = level.cast("bigint") + 1
    for at in (i, j, k):
        out = out * _SPAN + (at + _SHIFT)
    return out


def _place(xyz: list[Column]) -> Column:
    """A position on the sphere as one number of 63 bits, so that hash aggregates take it."""
    out = F.lit(0).cast("bigint")
    for x in xyz:
        out = out * _STEPS + F.least(F.floor((x + 1) / 2 * _STEPS), F.lit(_STEPS - 1))
    return out


def _placed(place: Column) -> Column:
    """The middle of the positions with that number."""
    at = lambda bits: (F.shiftright(place, bits).bitwiseAND(F.lit(_STEPS - 1)) + 0.5) * 2 / _STEPS - 1
    return F.struct(*(at(bits).alias(n) for bits, n in zip((42, 21, 0), "xyz")))


def _cell(xyz: list[Column], level: Column | int) -> Column:
    """The number of the cell of a position."""
    level = F.lit(level) if isinstance(level, int) else level
    return _packed(*(_at(x, level) for x in xyz), level)


def upper_bounds(queries: DataFrame, parts: DataFrame, k: int, radius: float = EARTH_RADIUS, features: bool = False) -> DataFrame:
    """(input_index, lng, lat, reach): within ``reach`` metres there are k parts,
    or with ``features`` parts of k features.

    Queries of an index with fewer than k of them get half the circumference.
    Only one vertex of each part is used; a part is at most as far as its vertex.
    """
    vertex = F.get(F.get("rings", F.lit(0)), F.lit(0))
    slot = F.pmod(F.xxhash64("find_index", *([] if features else ["part_no"])), F.lit(4 * k))
    # One part for each of 4 k hash slots: few rows a cell, pre-aggregated, however full it is.
    # A feature's parts share a slot when features count, so the slots' parts are of different features.
    heads = parts.select(slot.cast("int").alias("slot"), *(c.alias(n) for c, n in zip(unit_vector(vertex["lng"], vertex["lat"]), "xyz")))
    heads = heads.select("slot", *"xyz", _place([F.col(n) for n in "xyz"]).alias("p"))

    def bounds_at(numbers: list[int], small: bool) -> DataFrame:
        levels = F.explode(F.lit(numbers)).alias("level")
        dealt = heads.select("*", levels).select(_cell([F.col(n) for n in "xyz"], F.col("level")).alias("cell"), "slot", "p")
        few = dealt.groupBy("cell", "slot").agg(F.min("p").alias("p")).groupBy("cell").agg(F.collect_list("p").alias("few")).where(F.size("few") >= k)
        some = few.select("cell", F.transform("few", _placed).alias("few"))
        tried = queries.select("input_index", "lng", "lat", levels).select("input_index", "lng", "lat", _cell(unit_vector(F.col("lng"), F.col("lat")), F.col("level")).alias("cell"))
        met = tried.join(F.broadcast(some) if small else some.hint("merge"), "cell", "left" if small else "inner")
        met = met.select("input_index", "lng", "lat", "few", *(c.alias(f"q{n}") for c, n in zip(unit_vector(F.col("lng"), F.col("lat")), "xyz")))
        square = lambda p: sum((p[n] - F.col(f"q{n}")) * (p[n] - F.col(f"q{n}")) for n in "xyz")
        chords = F.transform("few", square)
        least = F.array_min(chords) if k == 1 else F.get(F.sort_array(chords), F.lit(k - 1))
        return met.select("input_index", "lng", "lat", F.coalesce(least, F.lit(4.0)).alias("square"))

    found = bounds_at([ALL, COARSE // 2, COARSE], True).unionByName(bounds_at([*range(COARSE + 1, LEVELS + 1)], False))
    half = F.sqrt("square") / 2 + _PLACE_ERROR
    reach = F.when(half < 0.99, F.lit(2 * radius) * F.asin(half)).otherwise(3.1416 * radius)
    return found.groupBy("input_index", "lng", "lat").agg(F.min("square").alias("square")).select("input_index", "lng", "lat", reach.alias("reach"))


def sample_rows(parts: DataFrame, levels: Column) -> DataFrame:
    """(find_index, part_no, level, x, y, z): points along all segments, at each
    of the ``levels`` at most one edge apart."""
    key = ["find_index", "part_no"]
    rings = parts.select(*key, "kind", F.explode("rings").alias("ring"))
    lines = rings.select(*key, F.explode(segments(F.when(F.col("kind") == "Polygon", closed(F.col("ring"))).otherwise(F.col("ring")))).alias("s"))
    ends = [c.alias(f"{end}{n}") for end in "ab" for c, n in zip(unit_vector(F.col(f"s.{end}.lng"), F.col(f"s.{end}.lat")), "xyz")]
    theta = haversine_m(F.col("s.a.lng"), F.col("s.a.lat"), F.col("s.b.lng"), F.col("s.b.lat"), 1.0).alias("theta")
    step = F.lit(2.0) / F.pow(F.lit(2.0), F.greatest(F.col("level"), F.lit(0)))
    dealt = lines.select(*key, theta, *ends).select("*", levels).withColumn("n", F.greatest(F.ceil(F.col("theta") / step).cast("int"), F.lit(1)))
    along = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).withColumn("t", F.col("i") / F.col("n"))
    share = lambda t: F.when(F.col("theta") > 1e-12, F.sin(t * F.col("theta")) / F.sin("theta")).otherwise(t)
    parted = along.select(*key, "level", *(f"{end}{n}" for end in "ab" for n in "xyz"), share(1 - F.col("t")).alias("fa"), share(F.col("t")).alias("fb"))
    return parted.select(*key, "level", *((F.col("fa") * F.col(f"a{n}") + F.col("fb") * F.col(f"b{n}")).alias(n) for n in "xyz"))


def search_level(reach: float, radius: float) -> int:
    """The level at which points look for points within ``reach`` metres."""
    theta = min(max(reach, 0.0) / radius, 3.1416)
    need = 2 * (1 + 1e-9) * math.sin(theta / 2) + 1e-12
    return ALL if need > 2 or theta >= 3.14159 else max(ALL, min(LEVELS, math.floor(math.log2(2 / need))))


def asked_cells(queries: DataFrame, points_only: bool, radius: float, level: int | None = None) -> DataFrame:
    """(*queries, level, cell): the cells in which each query looks for parts, of
    the level that goes with its ``reach`` unless one is given."""
    slack = 1.0 if points_only else 2.0  # the samples of longer parts are up to one edge apart
    theta = F.least(F.col("reach") / radius, F.lit(3.1416))
    need = F.lit(2 * slack * (1 + 1e-9)) * F.sin(theta / 2) + 1e-12
    finest = F.greatest(F.lit(ALL), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(2.0) / need)).cast("int")))
    finest = F.when((need > 2.0) | (theta >= 3.14159), ALL).otherwise(finest) if level is None else F.lit(level)
    rows = queries.select(*queries.columns, need.alias("need"), finest.alias("level"), *(c.alias(n) for c, n in zip(unit_vector(F.col("lng"), F.col("lat")), "xyz")))
    size, spot = F.col("size"), [F.col(f"at_{n}") for n in "xyz"]
    rows = rows.withColumn("size", _size(F.col("level"))).withColumns({f"at_{n}": _at(F.col(n), F.col("level")) for n in "xyz"})
    # what a cell may be away: the search radius, for samples half an edge more
    far = F.col("need") / slack + (0.0 if points_only else size / 2) + 1e-9
    apart = F.lit(0.0)
    for n, at in zip("xyz", spot):  # axis by axis, so that cells out of reach are left out early
        gap = F.when(F.col(f"d_{n}") < 0, F.col(n) - at * size).when(F.col(f"d_{n}") > 0, (at + 1) * size - F.col(n)).otherwise(0.0)
        apart = apart + gap * gap
        steps = F.when(F.col("level") == ALL, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (-1, 0, 1))))
        rows = rows.select("*", F.explode(steps).alias(f"d_{n}")).where((F.col("level") == ALL) | (apart <= far * far))
    cell = [at + F.col(f"d_{n}") for n, at in zip("xyz", spot)]
    # cells that the sphere does not touch are empty
    middle = F.sqrt(sum(((at + 0.5) * size) * ((at + 0.5) * size) for at in cell))
    touched = F.abs(middle - 1) <= size * 0.8661 + 1e-9
    return rows.where((F.col("level") == ALL) | touched).select(*queries.columns, "level", _packed(*cell, F.col("level")).alias("cell"))


def candidates(queries: DataFrame, parts: DataFrame, points_only: bool, radius: float = EARTH_RADIUS) -> DataFrame:
    """Rows of ``queries`` (input_index, lng, lat, reach, ...) with find_index and
    part_no of all parts within each query's ``reach`` metres, and some more.
    Pairs of points come once, with their places vlng and vlat; others may come
    from several cells."""
    asks = asked_cells(queries, points_only, radius)
    sizes = asks.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("level")
    # at most LEVELS + 2 rows, and one hot cell for each HOT asks
    used = sizes.agg(F.collect_list(F.when(F.col("n") > HOT, F.struct("cell", F.ceil(F.col("n") / HOT).cast("int").alias("shares")))).alias("hot")).collect()
    hot = [tuple(h) for r in used for h in r["hot"]]
    levels = F.explode(F.lit(sorted(r["level"] for r in used)).cast("array<int>")).alias("level")
    if points_only:
        vertex = F.get(F.get("rings", F.lit(0)), F.lit(0))
        heads = parts.select("find_index", "part_no", vertex["lng"].alias("vlng"), vertex["lat"].alias("vlat"), levels)
        rows = heads.select("find_index", "part_no", "vlng", "vlat", _cell(unit_vector(F.col("vlng"), F.col("vlat")), F.col("level")).alias("cell"))
    else:
        rows = sample_rows(parts, levels).select("find_index", "part_no", _cell([F.col("x"), F.col("y"), F.col("z")], F.col("level")).alias("cell")).distinct()
    asks, on = asks.drop("level"), ["cell"]
    if hot:  # queries of a hot cell are dealt to shares, each of which gets all of the cell's parts
        dealt, on = F.broadcast(queries.sparkSession.createDataFrame(hot, "cell bigint, shares int")), ["cell", "share"]
        shares = F.coalesce("shares", F.lit(1))
        asks = asks.join(dealt, "cell", "left").withColumn("share", F.pmod(F.xxhash64("input_index"), shares).cast("int")).drop("shares")
        rows = rows.join(dealt, "cell", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    return asks.join(rows.hint("merge"), on).drop(*on)


def shares(n: int, m: int, most: float) -> tuple[int, int]:
    """Into how many shares n and m rows of a cell are dealt, so that about ``most``
    of their pairs meet in a task; each row goes to all shares of the other side, so
    both are dealt by their sizes."""
    need = n * m / most
    i = max(1, min(round(math.sqrt(need * n / m)), math.ceil(need)))
    return i, math.ceil(need / i)


def within(queries: DataFrame, parts: DataFrame, reach: float, asking: int, parts_ask: bool, radius: float = EARTH_RADIUS) -> DataFrame:
    """Rows of ``queries`` (input_index, lng, lat, ...) with find_index, part_no and
    the distance d of all point parts within ``reach`` metres, each pair once.

    The parts look for cells of queries, or the queries for cells of parts; those
    that look are ``asking`` rows, and only they are repeated.  Cells are counted
    first, as pairs grow as the product of both sides.  Vectors are computed after
    the shuffle, and tell most pairs apart without a distance.
    """
    level = search_level(reach, radius)
    vertex = F.get(F.get("rings", F.lit(0)), F.lit(0))
    heads, key = parts.select("find_index", "part_no", vertex["lng"].alias("lng"), vertex["lat"].alias("lat")), ["find_index", "part_no"]
    (askers, by), (listed, dealt_by) = ((heads, key), (queries, ["input_index"])) if parts_ask else ((queries, ["input_index"]), (heads, key))
    if asking >= 2 * ASKS_A_TASK:
        askers = askers.repartition(min(asking // ASKS_A_TASK, 10_000), *by)
    asks = asked_cells(askers.withColumn("reach", F.lit(float(reach))), True, radius, level).drop("reach", "level")
    rows, on = listed.select("*", _cell(unit_vector(F.col("lng"), F.col("lat")), level).alias("cell")), ["cell"]
    count = lambda frame, n: frame.groupBy("cell").agg(F.count(F.lit(1)).alias(n))
    sizes = count(rows, "n").join(count(asks, "m").hint("merge"), "cell").withColumn("pairs", F.col("n") * F.col("m"))
    # one cell for each HOT_PAIRS pairs at most
    total, hot = sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.collect_list(F.when(F.col("pairs") > HOT_PAIRS, F.struct("cell", "n", "m")))).first()
    most = max(HOT_PAIRS, total * HOT_SHARE)
    if hot := [(h["cell"], *shares(h["n"], h["m"], most)) for h in hot if h["n"] * h["m"] > most]:
        dealt, on = F.broadcast(queries.sparkSession.createDataFrame(hot, "cell bigint, i int, j int")), ["cell", "share", "block"]
        part = lambda by, of: F.pmod(F.xxhash64(*by), F.coalesce(of, F.lit(1))).cast("int")
        all_of = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))
        rows = rows.join(dealt, "cell", "left").withColumn("share", part(dealt_by, "i")).withColumn("block", all_of("j")).drop("i", "j")
        asks = asks.join(dealt, "cell", "left").withColumn("block", part(by, "j")).withColumn("share", all_of("i")).drop("i", "j")
    tasks = max(1, min(total // PAIRS_A_TASK, MOST_TASKS))
    asks, rows = asks.repartition(tasks, *on), rows.repartition(tasks, *on)
    asked, found = (rows, asks) if parts_ask else (asks, rows)
    place = dict(zip(("a_rlng", "a_rlat", "a_cos", "ax", "ay", "az"), point_columns(F.col("lng"), F.col("lat")).values()))
    found = found.select(*on, *key, *(c.alias(n) for n, c in place.items()))
    asked = asked.select("*", *(c.alias(n) for n, c in point_columns(F.col("lng"), F.col("lat")).items()))
    met = asked.join(found.hint("merge"), on) if parts_ask else found.hint("merge").join(asked, on)  # the smaller side of a cell is held
    square = sum((F.col(f"p{n}") - F.col(f"a{n}")) * (F.col(f"p{n}") - F.col(f"a{n}")) for n in "xyz")
    chord, d = (2 * math.sin(min(max(reach, 0.0) / radius, math.pi) / 2)) ** 2, pair_haversine_m("a", radius)
    # distances decide only about pairs at the border
    met = met.where((square <= chord * (1 + 1e-9) + 1e-12) & ((square <= chord * (1 - 1e-9) - 1e-12) | (d <= float(reach))))
    return met.select(*queries.columns, *key, d.alias("d"))


def polygon_candidates(queries: DataFrame, parts: DataFrame, degrees: float = 10.0) -> DataFrame:
    """Rows of ``queries`` with the polygons whose bounding boxes hold them."""
    from ..functions.geo import bounds

    at = lambda x: F.floor(x / degrees).cast("int")
    boxes = parts.where("kind = 'Polygon'").select("find_index", "part_no", bounds(F.col("rings")).alias("box"))
    cells = boxes.select("find_index", "part_no", "box", F.explode(F.sequence(at(F.col("box.west")), at(F.col("box.east")))).alias("i")).select("*", F.explode(F.sequence(at(F.col("box.south")), at(F.col("box.north")))).alias("j"))
    points = queries.select("*", at(F.col("lng")).alias("i"), at(F.col("lat")).alias("j"))
    hit = F.col("lng").between(F.col("box.west"), F.col("box.east")) & F.col("lat").between(F.col("box.south"), F.col("box.north"))
    return points.join(cells.hint("merge"), ["i", "j"]).where(hit).select(*queries.columns, "find_index", "part_no")
