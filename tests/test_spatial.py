import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from conftest import plan_of, rows

from areapanel.functions import geometry as geo
from areapanel.operators import spatial
from areapanel.plans import clean
from areapanel.session import staged

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
HOLE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"

VALID = {
    "square": SQUARE,
    "hole": HOLE,
    "hole, same direction": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))",
    "hole touching the shell": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 2, 1 1, 1 3, 0 2))",
    "two parts": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((2 2, 3 2, 3 3, 2 3, 2 2)))",
    "parts touching": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 1, 3 1, 3 3, 1 3, 1 1)))",
    "island": "MULTIPOLYGON(((0 0,10 0,10 10,0 10,0 0),(2 2,8 2,8 8,2 8,2 2)),((4 4,6 4,6 6,4 6,4 4)))",
    "repeated point": "POLYGON ((0 0, 4 0, 4 0, 4 4, 0 4, 0 0))",
    "odd spacing": " polygon\t(( -1e0  0 , 4.0 0,4 .5E1,\n0 4, -1 0 )) ",
}
FAULTY = {
    "bow tie": ("POLYGON ((0 0, 3 2, 3 0, 0 2.5, 0 0))", "edges cross"),
    "hole outside": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (5 5, 6 5, 6 6, 5 6, 5 5))", "rings badly nested"),
    "hole crossing": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))", "edges cross"),
    "hole in hole": (
        "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 6 1, 6 6, 1 6, 1 1), (2 2, 3 2, 3 3, 2 3, 2 2))",
        "rings badly nested",
    ),
    "part in part": (
        "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((2 2, 3 2, 3 3, 2 3, 2 2)))",
        "rings badly nested",
    ),
    "shared edge": ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 0, 2 0, 2 1, 1 1, 1 0)))", "edges cross"),
    "crossing at corners": (
        "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((4 2, 6 2, 6 6, 2 6, 2 4, 3 3, 4 2)))",
        "rings badly nested",
    ),
    "hole equal to shell": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 4 0, 4 4, 0 4, 0 0))", "edges cross"),
    "spike": ("POLYGON ((0 0, 4 0, 4 4, 6 4, 4 4, 0 4, 0 0))", "edges cross"),
    "self touch": ("POLYGON ((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))", "edges cross"),
    "open": ("POLYGON ((0 0, 4 0, 4 4, 0 4))", "ring not closed"),
    "three points": ("POLYGON ((0 0, 4 0, 0 0))", "ring too short"),
    "flat": ("POLYGON ((0 0, 2 0, 4 0, 0 0))", "ring without area"),
    "text": ("POLYGON ((0 0, 4 x, 4 4, 0 4, 0 0))", "malformed text"),
    "infinite": ("POLYGON ((0 0, 1e999 0, 4 4, 0 4, 0 0))", "malformed text"),
    "parentheses": ("POLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)))", "malformed text"),
    "cut off": ("POLYGON ((0 0, 4 0, 4 4", "malformed text"),
    "point": ("POINT(1 1)", "not a polygon"),
    "empty": ("POLYGON EMPTY", "malformed text"),
    "height": ("POLYGON Z ((0 0 1, 4 0 1, 4 4 1, 0 4 1, 0 0 1))", "malformed text"),
}


def raw_areas(spark, pairs):
    return spark.createDataFrame(list(pairs), "ZIP string, the_geom string")


def test_validity(spark):
    pairs = [*VALID.items(), *[(k, text) for k, (text, _) in FAULTY.items()], (None, SQUARE), ("null", None)]
    raw = raw_areas(spark, pairs)
    assert rows(clean.clean_boundaries(raw), "ZIP_Code") == sorted(((k,) for k in VALID), key=repr)
    assert dict(rows(clean.rejected_boundaries(raw))) == {k: reason for k, (_, reason) in FAULTY.items()}


def test_strict_fails(spark):
    raw = raw_areas(spark, [("a", FAULTY["bow tie"][0])])
    with pytest.raises(Exception, match="area a: edges cross"):
        clean.clean_boundaries(raw, strict=True).collect()


def test_many_edges_on_one_polygon(spark):
    angle = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    ring = [(float(x), float(y)) for x, y in zip(np.cos(angle) * 2, np.sin(angle))]
    broken = ring.copy()
    broken[100], broken[101] = broken[101], broken[100]

    def text(points):
        return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*points, points[0]]) + "))"

    raw = raw_areas(spark, [("good", text(ring)), ("broken", text(broken))])
    assert rows(clean.rejected_boundaries(raw)) == [("broken", "edges cross")]


def test_geometry_column(spark):
    raw = spark.createDataFrame([("a", "12.5", SQUARE)], "ZIP string, SHAPE_AREA string, the_geom string")
    assert clean.find_geometry_column(raw) == "the_geom"
    assert clean.find_geometry_column(raw.select("ZIP", "SHAPE_AREA")) == "SHAPE_AREA"
    assert clean.find_geometry_column(raw.select("ZIP")) == "the_geom"


def place(spark, areas, points, **options):
    prepared = clean.clean_boundaries(raw_areas(spark, areas))
    data = spark.createDataFrame([(str(p), float(p[0]), float(p[1])) for p in points], "p string, x double, y double")
    return rows(spatial.assign_area(data, prepared, **options), "p", "ZIP_Code")


def test_point_positions(spark):
    areas = [
        ("hole", HOLE),
        ("right", "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))"),
        ("parts", "MULTIPOLYGON (((20 0, 21 0, 21 1, 20 1, 20 0)), ((22 2, 23 2, 23 3, 22 3, 22 2)))"),
    ]
    expected = {
        (3, 3): ["hole"],
        (1.5, 1.5): [],
        (1, 1.5): ["hole"],
        (4, 2): ["hole", "right"],
        (4, 4): ["hole", "right"],
        (0, 0): ["hole"],
        (0.5, 1): ["hole"],  # its ray passes a corner of the hole
        (-1, 4): [],  # its ray runs along the top edges
        (22.5, 2.5): ["parts"],
        (21.5, 1.5): [],
        (9, 9): [],
    }
    want = sorted((str(p), a) for p, found in expected.items() for a in found)
    for options in ({}, {"grid": 3}, {"grid": 0.1}, {"max_cells": 4}, {"broadcast_bytes": 0, "hot_rows": 1}):
        assert place(spark, areas, expected, **options) == want, options


def test_repeated_and_overlapping_areas_stay_apart(spark):
    areas = [("a", SQUARE), ("a", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))")]
    assert place(spark, areas, [(3, 3), (1, 1), (5, 5)]) == sorted(
        [("(1, 1)", "a"), ("(3, 3)", "a"), ("(3, 3)", "a"), ("(5, 5)", "a")]
    )


def test_points_that_are_nowhere(spark):
    prepared = clean.clean_boundaries(raw_areas(spark, [("a", SQUARE)]))
    points = spark.createDataFrame(
        [(1, None, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, 1.0, 1.0)], "k int, x double, y double"
    )
    assert rows(spatial.assign_area(points, prepared), "k") == [(4,)]
    no_areas = spatial.assign_area(points, prepared.where("false"))
    assert no_areas.columns == ["k", "x", "y", "ZIP_Code"] and no_areas.count() == 0


def test_far_coordinates_need_wide_indexes(spark):
    shifted = [("far", "POLYGON ((100000000 0, 100000004 0, 100000004 4, 100000000 4, 100000000 0))"), ("near", SQUARE)]
    points = [(100000001, 1), (100000004, 2), (100000005, 2), (1, 1), (-90000000, 1)]
    for options in ({}, {"broadcast_bytes": 0, "hot_rows": 1}):
        assert place(spark, shifted, points, **options) == [
            ("(1, 1)", "near"), ("(100000001, 1)", "far"), ("(100000004, 2)", "far"),
        ]


def star(rng, cx, cy, r, n):
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False) + rng.uniform(-0.3, 0.3, n) / n
    radius = r * (0.8 + 0.15 * np.sin(3 * angle) + 0.04 * np.sin(7 * angle))
    ring = np.round(np.stack([cx + radius * np.cos(angle), cy + radius * np.sin(angle)], 1) * 4096) / 4096
    return np.vstack([ring, ring[:1]])


def brute_force(polygons, x, y):
    found = []
    for name, rings in polygons:
        odd, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
                side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
                box = (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
                on |= (side == 0) & box
                odd ^= ((y1 > y) != (y2 > y)) & ((side > 0) == (y2 > y1))
        found += [(int(i), name) for i in np.nonzero(on | odd)[0]]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def random_case(spark):
    rng = np.random.default_rng(7)
    polygons = []
    for k in range(25):
        cx, cy = rng.uniform(-87.95, -87.55), rng.uniform(41.55, 42.05)
        r, n = rng.uniform(0.03, 0.12), int(rng.integers(8, 200))
        rings = [star(rng, cx, cy, r, n)] + ([star(rng, cx, cy, r * 0.3, 8)] if k % 2 else [])
        polygons.append((f"z{k % 20}", rings))
    corners = np.vstack([ring for _, rings in polygons for ring in rings])
    x = np.concatenate([np.round(rng.uniform(-88, -87.5, 15000) * 4096) / 4096, corners[:, 0].clip(-88, -87.5)])
    y = np.concatenate([np.round(rng.uniform(41.5, 42.1, 15000) * 4096) / 4096, corners[:, 1].clip(41.5, 42.1)])

    def text(rings):
        return "POLYGON (" + ", ".join("(" + ", ".join(f"{a} {b}" for a, b in r) + ")" for r in rings) + ")"

    areas = staged(clean.clean_boundaries(raw_areas(spark, [(k, text(r)) for k, r in polygons])), "areas")
    assert areas.count() == 25
    points = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "x": x, "y": y}))
    return points, areas, brute_force(polygons, x, y)


BOUNDS = ((-88.0, -87.5), (41.5, 42.1))


@pytest.mark.parametrize(
    "options",
    [
        {"bounds": BOUNDS},
        {"grid": 17.3},
        {"max_cells": 30, "bounds": BOUNDS},
        {"broadcast_bytes": 0, "bounds": BOUNDS, "hot_rows": 5},
        {"broadcast_bytes": 0, "max_cells": 50, "grid": 400},
        {"broadcast_bytes": 0, "max_cells": 50, "bitmap_bytes": 0},
    ],
)
def test_against_brute_force(random_case, options):
    points, areas, expected = random_case
    assert rows(spatial.assign_area(points, areas, **options), "k", "ZIP_Code") == expected


def test_counts_agree_between_broadcast_and_shuffle(spark, random_case):
    points, areas, expected = random_case
    events = points.selectExpr(
        "x", "y", "date'2020-01-01' as Month_Date", "2020 as Year",
        "if(k % 3 = 0, 'Violent', 'Property') as Crime_Category",
    )
    copies = events.unionByName(events).unionByName(events.where("x < -87.8"))
    near = rows(spatial.count_by_area(copies, areas, bounds=BOUNDS))
    far = rows(spatial.count_by_area(copies, areas, bounds=BOUNDS, broadcast_bytes=0, hot_rows=10))
    assert near == far
    for more in ({"grid": 400, "max_cells": 50}, {"bitmap_bytes": 0}, {"grid": 900}):
        assert near == rows(spatial.count_by_area(copies, areas, broadcast_bytes=0, **more)), more
    base = rows(spatial.count_by_area(events, areas, bounds=BOUNDS))
    assert sum(r[3] + r[4] for r in base) == len(expected)


def test_points_outside_go_and_whole_cells_are_counted_before_the_shuffle(spark):
    areas = clean.clean_boundaries(raw_areas(spark, [("a", SQUARE)]))
    cells, measure = spatial.measured_cells(areas, grid=4)
    cells = spatial._indexed(cells, measure)
    bits = spatial.cell_bits(cells, measure, 1 << 20)
    assert spatial.cell_bits(cells, measure, 100) is None
    points = spark.range(20_000).selectExpr(
        "(id % 200) / 10 - 10 as x", "floor(id / 200) / 5 - 10 as y", "date'2020-01-01' as Month_Date", "2020 as Year",
        "'Violent' as Crime_Category",
    )
    placed = spatial._with_cell(points, measure.levels, 4, measure.index)
    left = staged(spatial._covered(placed, bits), "left")
    known = {tuple(r) for r in cells.select("cx", "cy").collect()}
    inside = sum(tuple(r) in known for r in placed.select("cx", "cy").collect())
    assert inside <= left.count() < inside + 600 < 20_000
    border = {tuple(r) for r in cells.where("size(edges) > 0").select("cx", "cy").collect()}
    counted = spatial._tiers(left, points.columns)
    got = counted.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    plain = [r for r in got if (r["cx"], r["cy"]) in known - border]
    assert plain and all(r["rows"] <= r["n"] for r in plain) and any(r["rows"] == 1 < r["n"] for r in plain)
    assert sum(r["n"] for r in got) == left.count()


def test_hot_cell_is_salted(spark):
    areas = clean.clean_boundaries(raw_areas(spark, [("a", SQUARE), ("b", SQUARE)]))
    points = spark.range(3000).selectExpr("id", "if(id < 1000, 1.5, 3 * rand(1)) as x", "1.5 as y")
    hot = rows(spatial.hot_cells(spatial._with_cell(points, [0], 200), 100))
    assert len(hot) == 1 and hot[0][3] >= 10
    joined = spatial.assign_area(points, areas, broadcast_bytes=0, hot_rows=100)
    assert "SortMergeJoin" in plan_of(joined) and "salt" in plan_of(joined)
    assert joined.count() == 6000 and joined.distinct().count() == 6000


def test_plan_has_no_nested_loop_and_no_python(random_case):
    points, areas, _ = random_case
    for options in ({}, {"broadcast_bytes": 0}):
        plan = plan_of(spatial.assign_area(points, areas, **options))
        for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "InPandas"):
            assert bad not in plan


def test_equal_points_go_to_several_salts(spark):
    points = staged(spark.range(1000).select(F.lit(-87.7).alias("x"), F.lit(41.8).alias("y")), "points")
    placed = spatial._with_cell(points.withColumn("position", F.monotonically_increasing_id()), [0], 200)
    hot = spatial.hot_cells(placed, 100)
    cells = placed.select(*spatial.CELL).distinct()
    placed, repeated = spatial._salted(placed, cells, hot)
    per_salt = {r["salt"]: r["count"] for r in placed.groupBy("salt").count().collect()}
    assert len(per_salt) == 10 and max(per_salt.values()) <= 200
    assert {r["salt"] for r in repeated.collect()} == set(range(10))


def test_any_number_of_cells_may_be_hot(spark):
    points = spark.range(6000 * 3).select((F.col("id") % 6000 / 200 + 0.001).alias("x"), F.lit(0.001).alias("y"))
    hot = spatial.hot_cells(spatial._with_cell(points, [0], 200), 2)
    assert hot.count() == 6000 and {r["salts"] for r in hot.collect()} == {2}


def test_cells_are_prepared_once(spark, monkeypatch):
    calls, original = [], spatial.area_cells
    monkeypatch.setattr(spatial, "area_cells", lambda *a, **k: calls.append(1) or original(*a, **k))
    areas = clean.clean_boundaries(spark.createDataFrame([("1", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")], "ZIP string, the_geom string"))
    points = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0)], "x double, y double")
    joined = spatial.assign_area(points, areas)
    assert "Window" not in plan_of(joined) and rows(joined) == [(0.5, 0.5, "1")] and len(calls) == 1


def test_sides_are_exact(spark):
    """Signs against rational arithmetic, for points on and a step beside slanted edges between decimal ends."""
    import random
    from fractions import Fraction

    rng, cases = random.Random(4), []
    for _ in range(400):
        x1, y1, dx, dy = rng.randrange(9**5) / 1000, rng.randrange(9**5) / 1000, rng.randrange(1, 90) / 7, rng.randrange(1, 90) / 10
        t = rng.randrange(0, 11) / 10
        x, y = x1 + t * dx, y1 + t * dy
        x = rng.choice([x, math.nextafter(x, 1e9), math.nextafter(x, -1e9)])
        cases.append((x1, y1, x1 + dx, y1 + dy, x, y))
    cases += [(0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (1e-3, 1e15, 1e15, 2e15, 0.5, 1e15), (0.5, 0.5, 12.0, 12.0, 24.0, 24.0)]
    df = spark.createDataFrame(cases, "x1 double, y1 double, x2 double, y2 double, x double, y double")
    edge = F.struct("x1", "y1", "x2", "y2")
    got = [r[0] for r in df.select(F.signum(geo.bound_once(edge, lambda e: geo.side(e, F.col("x"), F.col("y"))))).collect()]
    plain = 0
    for sign, case in zip(got, cases):
        x1, y1, x2, y2, x, y = map(Fraction, case)
        true = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        assert sign == (true > 0) - (true < 0)
        x1, y1, x2, y2, x, y = case
        rough = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        plain += (rough > 0) - (rough < 0) != sign
    assert plain > 0  # doubles alone get some of them wrong


def test_cells_of_many_large_areas_follow_their_edges(spark):
    """Forty areas of 160,000 fine cells each: few cells are written, and every point finds its areas."""
    text = "POLYGON (({0} 0, {1} 0, {1} 2, {0} 2, {0} 0))"
    areas = [(str(k), text.format(k * 0.5, k * 0.5 + 2)) for k in range(40)]
    _, measure = spatial.measured_cells(clean.clean_boundaries(raw_areas(spark, areas)))
    assert measure.cells < 40 * 64 * 4 * 2
    points = [(x / 8, y) for x in range(-1, 180, 7) for y in (0, 0.75, 2)]
    want = sorted((str(p), str(k)) for p in points for k in range(40) if k * 0.5 <= p[0] <= k * 0.5 + 2)
    for options in ({}, {"broadcast_bytes": 0}):
        assert place(spark, areas, points, **options) == want
