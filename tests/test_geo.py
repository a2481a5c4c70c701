import math
import random
import re

import pytest
from pyspark.sql import functions as F

from orbweave.functions.geo import EARTH_RADIUS, haversine_m, inside, number, part_m, point_rings
from orbweave.operators import bounds as B
from orbweave.operators import proximity
from orbweave.operators.proximity import NearResult, admit_parts, describe_index, near_join, retrieve
from orbweave.plans import grid
from orbweave.sources.points import parse_points
from orbweave.sources.tables import point_parts, query_points

PART = "find_index bigint, part_no int, kind string, rings array<array<struct<lng:double,lat:double>>>, id string, props map<string,string>, src string"
DEGREE = math.pi * EARTH_RADIUS / 180


def parts(spark, rows):
    return spark.createDataFrame([(i, 0, kind, rings, None, props, "shp") for i, (kind, rings, props) in enumerate(rows)], PART)


def points(spark, rows):
    raw = [(i, f"p{i}", str(x), str(y)) for i, (x, y) in enumerate(rows)]
    return parse_points(spark.createDataFrame(raw, "input_index bigint, id string, lng_raw string, lat_raw string"))


def cloud(n, seed, spread=None):
    r = random.Random(seed)
    if spread:
        return [(20 + r.gauss(0, spread), 50 + r.gauss(0, spread)) for _ in range(n)]
    return [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(n)]


@pytest.mark.parametrize("a, b, degrees", [((0, 0), (1, 0), 1), ((179.9, 0), (-179.9, 0), 0.2), ((10, 90), (170, 90), 0), ((0, 0), (180, 0), 180), ((5, 5), (5, 5), 0)])
def test_haversine_known_answers(spark, a, b, degrees):
    d = spark.range(1).select(haversine_m(*map(F.lit, map(float, (*a, *b))))).first()[0]
    assert d == pytest.approx(degrees * DEGREE, abs=0.01)


def test_segment_and_polygon_distance(spark):
    line = ("LineString", [[(0.0, 0.0), (10.0, 0.0)]], None)
    dot = ("LineString", [[(3.0, 3.0), (3.0, 3.0)]], None)
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]  # left open
    hole = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    frame = parts(spark, [line, dot, ("Polygon", [ring, hole], None)])
    at = lambda x, y: [r[0] for r in frame.orderBy("find_index").select(part_m(F.col("kind"), F.col("rings"), F.lit(float(x)), F.lit(float(y)))).collect()]
    on_line, off_dot, in_area = at(5, 1)
    assert on_line == pytest.approx(DEGREE, rel=1e-6) and in_area == 0
    assert off_dot == pytest.approx(at(5, 1)[1])
    assert at(-1, 0)[0] == pytest.approx(DEGREE, rel=1e-6)
    assert at(5, 5)[2] == pytest.approx(DEGREE, rel=1e-2)  # in the hole
    assert not spark.range(1).select(inside(F.lit(5.0), F.lit(5.0), point_rings(F.lit(0.0), F.lit(0.0)))).first()[0]


@pytest.mark.parametrize("spread", [None, 3.0])
@pytest.mark.parametrize("k, r", [(1, None), (5, None), (3, 800_000.0), (None, 500_000.0)])
def test_grid_equals_all_pairs(spark, k, r, spread):
    data = parts(spark, [("Point", [[p]], None) for p in cloud(300, 1, spread)])
    asked = points(spark, cloud(80, 2))
    found = [sorted(map(tuple, near_join(asked, data, k=k, r=r, strategy=s, mode="point").matches.select("input_index", "distance", "find_index").collect())) for s in ("pairs", "grid")]
    assert found[0] == found[1] and (k is None or r is not None or len(found[0]) == 80 * k)


def test_grid_equals_all_pairs_for_lines_and_areas(spark):
    r = random.Random(4)
    shapes = []
    for x, y in cloud(40, 3):
        x, y = min(x, 150.0), min(max(y, -60.0), 60.0)
        shapes.append(("LineString", [[(x, y), (x + r.uniform(0, 20), y + r.uniform(0, 20))]], None))
        shapes.append(("Polygon", [[(x, y), (x + 8.0, y), (x + 8.0, y + 8.0), (x, y + 8.0), (x, y)]], None))
    data, asked = parts(spark, shapes), points(spark, cloud(60, 5))
    for k, reach in ((2, None), (None, 400_000.0)):
        found = [sorted(map(tuple, near_join(asked, data, k=k, r=reach, strategy=s).matches.select("input_index", "distance", "find_index").collect())) for s in ("pairs", "grid")]
        assert found[0] == found[1]


@pytest.mark.parametrize("r", [None, 900_000.0])
def test_grid_equals_all_pairs_for_features_of_many_parts(spark, r):
    # feature 0 has 12 parts beside the query; the others are far apart
    rows = [(0, n, "Point", [[(0.0001 * n, 0.0)]], None, None, "shp") for n in range(12)]
    rows += [(i, n, "Point", [[(x + 0.001 * n, y)]], None, None, "shp") for i, (x, y) in enumerate([(0.01, 0.0), (5.0, 0.0), *cloud(30, 8)], 1) for n in range(3)]
    data, asked = spark.createDataFrame(rows, PART), points(spark, [(0, 0), (1, 1), *cloud(20, 9)])
    found = [sorted(map(tuple, near_join(asked, data, k=3, r=r, strategy=s, mode="point", dedupe_features=True).matches.select("input_index", "distance", "find_index", "rank").collect())) for s in ("pairs", "grid")]
    assert found[0] == found[1] and [x[2] for x in found[1][:3]] == [0, 1, 2]


def test_k_nests_and_k_edges(spark):
    data, asked = parts(spark, [("Point", [[p]], None) for p in cloud(10, 1)]), points(spark, cloud(5, 2))
    rows = lambda k, **o: {tuple(x) for x in near_join(asked, data, k=k, **o).matches.select("input_index", "find_index").collect()}
    assert rows(2) < rows(3) and rows(0) == set() and len(rows(50)) == 50 and rows(50, strategy="grid") == rows(50)


def test_ties_go_by_index_and_rejects(spark):
    data = parts(spark, [("Point", [[(1.0, 0.0)]], {"a": "x"}), ("Point", [[(1.0, 0.0)]], None)])
    asked = points(spark, [(0, 0), ("x", 0), (0, "39d"), (0, " 39"), (100, 50)])
    found = near_join(asked, data, k=1, r=200_000.0, fields=("a", "b"))
    assert [tuple(r) for r in found.matches.select("find_index", "a", "b", "id").collect()] == [(0, "x", "", "p0")]
    assert sorted((r["index"], r["code"]) for r in found.rejects.collect()) == [(1, "CannotParseRecord"), (2, "CannotParseRecord"), (3, "CannotParseRecord"), (4, "NoMatch")]


def test_empty_index(spark):
    found = near_join(points(spark, [(0, 0)]), parts(spark, []), k=2)
    assert found.matches.count() == 0 and [r["code"] for r in found.rejects.collect()] == ["NoMatch"]
    assert near_join(points(spark, [(0, 0)]), parts(spark, []), k=2, strategy="grid").matches.count() == 0


def test_point_mode_and_bounds(spark):
    data = parts(spark, [("Point", [[(1.0, 1.0)]], None), ("LineString", [[(0.0, 0.0), (9.0, 9.0)]], None), ("Point", [[(50.0, 1.0)]], None)])
    kept: NearResult = admit_parts(data, "point", B.parse_bbox("0,0,10,10"))
    assert [r["find_index"] for r in kept.matches.collect()] == [0]
    assert sorted(r["code"] for r in kept.rejects.collect()) == ["InsertFailedOutOfBounds", "InsertFailedRequiresPoint"]


def test_bbox_rules():
    assert B.parse_bbox("10,20,-10,-20,99") == B.BBox(-10, -20, 10, 20)
    assert B.from_corners([0, 1, 9, 2, 3, 9]) == B.BBox(0, 1, 2, 3)
    assert B.resolve_bbox(True) == B.SPHERE == B.resolve_bbox() and B.resolve_bbox(text="0,0,1,1", file_bbox=[5, 5, 6, 6]) == B.BBox(0, 0, 1, 1)
    for bad in ("1,2,3", "a,b,c,d"):
        with pytest.raises(B.InvalidBoundingBox):
            B.parse_bbox(bad)
    with pytest.raises(B.InvalidBoundingBox):
        B.resolve_bbox(True, "0,0,1,1")


def test_distances_round_as_decimals(spark):
    r = random.Random(5)
    ties = [n / 2000 for n in range(2001)] + [1.0005, 2.5015, 1234567.0005, 20015115.0705, 20015086.7965]
    near = [math.nextafter(x, way) for x in ties for way in (-1.0, 1e9)]
    rows = ties + near + [r.uniform(0, 2.1e7) for _ in range(5000)] + [r.uniform(0, 2) for _ in range(5000)] + [0.0, 1e-9, 1e12, 1e300, math.inf, None]
    frame = spark.createDataFrame([(x,) for x in rows], "d double")
    assert frame.count() == frame.where(F.round("d", 3).eqNullSafe(proximity.rounded())).count()


def test_numbers(spark):
    rows = [("1.5", 1.5), ("-.5e1", -5.0), ("1d", None), (" 1", None), ("", None), ("inf", None), ("1.", 1.0), (None, None), ("1\n", None)]
    frame = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in frame.select(number(F.col("t"))).collect()] == [v for _, v in rows]


def test_describe_and_retrieve(spark):
    data = parts(spark, [("Point", [[(1.0, 1.0)]], None), ("Polygon", [[(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 0.0)]], None), ("Point", [[(99.0, 1.0)]], None)])
    assert {r["kind"]: r["parts"] for r in describe_index(data).collect()} == {"Point": 2, "Polygon": 1}
    assert {(r["probe_index"], r["find_index"]) for r in retrieve(data, data.where("find_index = 1")).collect()} == {(1, 0), (1, 1)}


def joins(frame):
    """(kind, first key) of the joins of a plan."""
    return set(re.findall(r"(BroadcastHash|SortMerge|BroadcastNestedLoop)Join (?:\[(\w+)#)?", frame._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def stored(spark, tmp_path):
    """Query points and parts of stored tables, whose sizes Spark estimates."""
    spark.range(900).write.parquet(f"{tmp_path}/points")
    spark.range(700).write.parquet(f"{tmp_path}/parts")
    return query_points(spark.read.parquet(f"{tmp_path}/points"), "id"), point_parts(spark.read.parquet(f"{tmp_path}/parts"), "id", {"key": "id"})


def test_grid_broadcasts_no_table(stored):
    found = near_join(*stored, k=2, mode="point", strategy="grid", fields=("key",))
    assert {key for kind, key in joins(found.matches) | joins(found.rejects) if kind != "SortMerge"} == {"cell"}  # those of coarse levels


def test_radius_pairs_are_not_joined_again(stored):
    found = near_join(*stored, k=None, r=900_000.0, mode="point", strategy="grid").matches
    assert joins(found) == {("SortMerge", "cell")}
    assert {tuple(r) for r in found.select("input_index", "id", "lng", "find_index").collect()} == {tuple(r) for r in near_join(*stored, k=None, r=900_000.0, mode="point", strategy="pairs").matches.select("input_index", "id", "lng", "find_index").collect()}


@pytest.mark.parametrize("n_points, n_parts, repeated", [(900, 60, "find_index"), (60, 700, "input_index")])
def test_radius_join_repeats_the_smaller_side(spark, monkeypatch, n_points, n_parts, repeated):
    """Rows of the larger side are shuffled once each, however many cells are in reach."""
    monkeypatch.setattr(grid, "PAIRS_A_TASK", 100, raising=False)
    asked, data = query_points(spark.range(n_points), "id"), point_parts(spark.range(n_parts), "id")
    found, every = (near_join(asked, data, k=None, r=900_000.0, mode="point", strategy=s).matches.select("input_index", "distance", "find_index") for s in ("grid", "pairs"))
    sides = found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(cell#")[1:]
    assert len(sides) == 2
    assert ["input_index" if "input_index#" in side else "find_index" for side in sides if "explode([-1,0,1])" in side] == [repeated]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) != []


@pytest.mark.parametrize("n_points, n_parts", [(150, 40), (40, 150)])
@pytest.mark.parametrize("r", [-1.0, 0.0, 300_000.0, 2_000_000.0, 12_000_000.0, 21_000_000.0])
def test_cells_of_a_radius_join_are_dealt(spark, monkeypatch, n_points, n_parts, r):
    for name, value in (("HOT_PAIRS", 10), ("HOT_SHARE", 0.02), ("PAIRS_A_TASK", 100), ("MOST_TASKS", 6), ("ASKS_A_TASK", 15)):
        monkeypatch.setattr(grid, name, value)
    places = cloud(40, 2, 3.0) + [(0.0, 90.0), (77.0, 90.0), (5.0, -90.0), (180.0, 0.0), (-180.0, 0.0), (0.0, 0.0)]
    asked, data = points(spark, places + cloud(n_points - 46, 1)) if n_points > 46 else points(spark, places[6:]), parts(spark, [("Point", [[p]], None) for p in (places + cloud(n_parts, 3))[:n_parts]])
    found = [sorted(map(tuple, near_join(asked, data, k=None, r=r, mode="point", strategy=s).matches.select("input_index", "id", "distance", "find_index").collect())) for s in ("pairs", "grid")]
    assert found[0] == found[1] and bool(found[0]) == (r >= 0)


@pytest.mark.parametrize("n, m", [(10**6, 10**6), (135_000, 54_000), (54_000_000, 10), (10, 54_000_000), (1, 1)])
def test_dealt_rows_are_repeated_rarely(n, m):
    """Two hundred shares of a cell repeat its rows thirty times at most."""
    i, j = grid.shares(n, m, n * m / 200)
    assert 200 <= i * j <= 220 and n * j + m * i <= 15 * (n + m)


@pytest.mark.parametrize("k, r", [(2, None), (None, 2_000_000.0)])
def test_hot_cells_are_dealt(spark, monkeypatch, k, r):
    monkeypatch.setattr(grid, "HOT", 10)
    data, asked = parts(spark, [("Point", [[p]], None) for p in cloud(40, 1)]), points(spark, cloud(150, 2, 3.0))
    found = [sorted(map(tuple, near_join(asked, data, k=k, r=r, strategy=s, mode="point").matches.select("input_index", "distance", "find_index").collect())) for s in ("pairs", "grid")]
    assert found[0] == found[1] and found[0]


def test_few_lines_need_no_grid(spark, monkeypatch):
    """However many queries there are; dealt by query, their pairs are shuffled once."""
    monkeypatch.setattr(proximity, "ALL_PAIRS", 1)
    monkeypatch.setattr(proximity, "PAIRS_A_TASK", 100)
    data, asked = parts(spark, [("LineString", [[p, (p[0] / 2, p[1] / 2)]], None) for p in cloud(5, 3)]), points(spark, cloud(60, 4))
    pairs = proximity.distances(asked, proximity.admit_parts(data).matches, 1, None, None, "auto", EARTH_RADIUS)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and not re.search(r"hashpartitioning\(input_index#\d+L?, part#", plan)
    found = [sorted(map(tuple, near_join(asked, data, strategy=s).matches.select("input_index", "distance", "find_index").collect())) for s in ("auto", "grid")]
    assert found[0] == found[1] and len(found[0]) == 60
