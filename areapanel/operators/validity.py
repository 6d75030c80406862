"""Polygon validity: ring structure per row, edge crossings and ring nesting per grid cell.

Structure is decided with array expressions on the row. Crossings and nesting are equi-joins of a
polygon's edges on a grid fitted to that polygon (about one edge per cell), so a polygon that
holds most of all edges is spread over many cells. A semi join keeps offending edges only;
candidate pairs are never written out. Whether holes cut the interior in two is decided on the
points where rings of one part touch, which are few.

Equal rows (same area, same text) are checked once and returned as often as they came.
"""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from areapanel.functions import geometry as geo
from areapanel.operators.cycles import cyclic
from areapanel.session import staged

MAX_SIDE = 2048  # grid rows of one polygon


def read_polygons(raw: DataFrame, area: str, wkt: str) -> DataFrame:
    """Parsed distinct rows and the first structural fault, if any.

    Columns: ZIP_Code, area_key, copies (how often the row came), reason, and for rows without a
    fault ``rings`` (part, ring, edges) and the box. Rows without an area id or a geometry text are
    dropped.
    """
    text = F.col("wkt")
    # One deal of the texts both finds equal rows and spreads the parsing; explicit partitions are
    # not merged again, so a few large texts still reach many tasks.
    spark = raw.sparkSession
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    named = raw.dropna(subset=[area, wkt]).select(
        F.col(f"`{area}`").cast("string").alias("ZIP_Code"), F.col(f"`{wkt}`").alias("wkt")
    )
    counted = named.repartition(pieces, "ZIP_Code", "wkt").groupBy("ZIP_Code", "wkt").agg(F.count(F.lit(1)).alias("copies"))
    parsed = counted.select(
        "ZIP_Code",
        "copies",
        F.md5(F.concat_ws("\x01", "ZIP_Code", text)).alias("area_key"),
        geo.looks_like_polygon(text).alias("named_polygon"),
        F.when(geo.is_polygon_text(text), geo.polygon_parts(text)).alias("read_parts"),
    )

    def any_ring(parts, test):
        return F.exists(parts, lambda part: F.exists(part, test))

    unreadable = any_ring("read_parts", lambda ring: F.exists(ring, lambda p: p.isNull()))
    cleaned = F.transform("read_parts", lambda part: F.transform(part, geo.without_repeats))
    readable = parsed.withColumn("parts", F.when(~unreadable, cleaned))
    fault = (
        F.when(~F.col("named_polygon"), "not a polygon")
        .when(F.col("parts").isNull(), "malformed text")
        .when(any_ring("parts", lambda r: F.element_at(r, 1) != F.element_at(r, -1)), "ring not closed")
        .when(any_ring("parts", lambda r: F.size(r) < 4), "ring too short")
        .when(any_ring("parts", lambda r: geo.ring_area_twice(r) == 0), "ring without area")
    )
    rings = F.flatten(
        F.transform(
            "parts",
            lambda part, p: F.transform(
                part,
                lambda ring, r: F.struct(
                    p.alias("part"), r.alias("ring"), geo.ring_edges(ring).alias("edges")
                ),
            ),
        )
    )
    return (
        readable.withColumn("reason", fault)
        .select("ZIP_Code", "area_key", "copies", "reason", F.when(F.col("reason").isNull(), rings).alias("rings"))
        .withColumn("box", geo.edge_box(all_edges()))
        .select("ZIP_Code", "area_key", "copies", "reason", "rings", "box.*")
    )


def all_edges():
    """The edges of all rings of a row; rows are never regrouped by area id."""
    return F.flatten(F.transform("rings", lambda r: r.edges))


def _rings(polygons: DataFrame) -> DataFrame:
    """One row per ring with its polygon's own grid: lower corner and cells per unit."""
    n_edges = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r.edges))
    sized = polygons.withColumn("n_edges", n_edges)
    side = F.least(F.lit(MAX_SIDE), F.ceil(F.sqrt("n_edges"))).cast("double")
    grid = F.struct(
        F.col("xmin"),
        F.col("ymin"),
        (side / (F.col("xmax") - F.col("xmin"))).alias("ux"),
        (side / (F.col("ymax") - F.col("ymin"))).alias("uy"),
    )
    return (
        sized.select("area_key", grid.alias("g"), "rings")
        .select("area_key", "g", F.explode("rings").alias("r"))
        .select("area_key", "g", "r.*", F.size("r.edges").alias("n"), geo.edge_box(F.col("r.edges")).alias("around"))
    )


def _row(y):
    return F.floor((y - F.col("g.ymin")) * F.col("g.uy"))


def _edge_rows(polygons: DataFrame) -> DataFrame:
    """One row per edge and grid row it passes."""
    return (
        _rings(polygons)
        .select("area_key", "g", "part", "ring", "n", "around", F.posexplode("edges").alias("i", "e"))
        .withColumn("cy", F.explode(F.sequence(_row(F.col("e.y1")), _row(F.col("e.y2")))))
    )


def _edge_cells(polygons: DataFrame) -> DataFrame:
    """One row per edge and grid cell it passes: per grid row only the columns it reaches there."""
    g, cy = F.col("g"), F.col("cy")
    left, right = geo.x_range(
        F.col("e"), g.ymin + (cy - geo.SLACK) / g.uy, g.ymin + (cy + 1 + geo.SLACK) / g.uy
    )
    columns = F.sequence(
        F.floor((left - g.xmin) * g.ux - geo.SLACK), F.floor((right - g.xmin) * g.ux + geo.SLACK)
    )
    return _edge_rows(polygons).withColumn("cx", F.explode(columns))


def _on(s, edge, x, y):
    """Whether a point with side ``s`` lies on the edge."""
    return (s == 0) & geo.between_x(edge, x) & y.between(edge.y1, edge.y2)


def _clash(a, b):
    """Edges that may not meet the way they do: a proper crossing, a common stretch, or a touch
    of two edges of one ring that are not neighbours."""
    sides = geo.record(
        b1=geo.side(a, b.x1, b.y1), b2=geo.side(a, b.x2, b.y2), a1=geo.side(b, a.x1, a.y1), a2=geo.side(b, a.x2, a.y2)
    )
    return geo.bound_once(sides, lambda s: _meet_badly(a, b, s.a1, s.a2, s.b1, s.b2))


def _meet_badly(a, b, a1, a2, b1, b2):
    """The same, given the sides of all four ends."""
    crossing = (F.signum(b1) * F.signum(b2) < 0) & (F.signum(a1) * F.signum(a2) < 0)
    stretch = F.when(
        a.y1 == a.y2, F.greatest(a.x1, b.x1) < F.least(a.x2, b.x2)
    ).otherwise(F.greatest(a.y1, b.y1) < F.least(a.y2, b.y2))
    along = (b1 == 0) & (b2 == 0) & stretch
    touch = (
        _on(b1, a, b.x1, b.y1) | _on(b2, a, b.x2, b.y2) | _on(a1, b, a.x1, a.y1) | _on(a2, b, a.x2, a.y2)
    )
    apart = F.abs(F.col("a.i") - F.col("b.i"))
    neighbours = (apart == 1) | (apart == F.col("a.n") - 1)
    same_ring = (F.col("a.part") == F.col("b.part")) & (F.col("a.ring") == F.col("b.ring"))
    return crossing | along | (same_ring & ~neighbours & touch)


def cut_areas(polygons: DataFrame) -> DataFrame:
    """Keys of polygons with a part whose holes cut its interior in two.

    Rings that do not cross meet in single points. Link every ring that passes a point to the first
    ring that does: the interior is in one piece exactly when the rings of a part and these links have no
    cycle. Links are rows throughout, so a part may hold any number of touching holes.
    """
    cells = _edge_cells(polygons.where(F.size("rings") > 1)).select("area_key", "cy", "cx", "part", "ring", "e")
    left, right = cells.alias("a"), cells.alias("b")
    place = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("area_key", "part", "cy", "cx")]
    a, b = F.col("a.e"), F.col("b.e")

    def end(edge, x, y):
        return F.when(_on(geo.side(edge, x, y), edge, x, y), F.struct(x.alias("x"), y.alias("y")))

    ends = F.array(end(a, b.x1, b.y1), end(a, b.x2, b.y2), end(b, a.x1, a.y1), end(b, a.x2, a.y2))
    met = left.join(right.hint("merge"), [*place, F.col("a.ring") < F.col("b.ring"), F.exists(ends, lambda p: p.isNotNull())])
    whole = lambda p: F.struct((p.x + 0.0).alias("x"), (p.y + 0.0).alias("y"))  # noqa: E731  (no negative zero)
    touches = (
        met.select("a.area_key", "a.part", F.explode(F.array("a.ring", "b.ring")).alias("ring"), F.filter(ends, lambda p: p.isNotNull()).alias("ends"))
        .select("area_key", "part", "ring", F.explode(F.transform("ends", whole)).alias("p"))
        .distinct()
    )
    touches = staged(touches, "touches")
    point = ["area_key", "part", "p"]
    first = touches.groupBy(*point).agg(F.min("ring").alias("first"))
    links = touches.join(first, point).where("ring <> first").select("area_key", "part", F.col("first").alias("a"), F.col("ring").alias("b"))
    return cyclic(links, ["area_key", "part"]).select("area_key").distinct()


def crossing_areas(polygons: DataFrame) -> DataFrame:
    """Keys of polygons whose edges cross, overlap, or touch inside one ring."""
    cells = _edge_cells(polygons).select("area_key", "cy", "cx", "part", "ring", "i", "n", "e")
    a, b = cells.alias("a"), cells.alias("b")
    place = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("area_key", "cy", "cx")]
    earlier = F.struct("a.part", "a.ring", "a.i") < F.struct("b.part", "b.ring", "b.i")
    found = a.join(b.hint("merge"), [*place, earlier, _clash(F.col("a.e"), F.col("b.e"))], "left_semi")
    return found.select("area_key").distinct()


def misplaced_areas(polygons: DataFrame) -> DataFrame:
    """Keys of polygons with a hole outside its shell, a hole in a hole, or a part in a part.

    Both ends and the middle of every edge are placed against the other rings of the polygon;
    places on a boundary decide nothing.
    """
    several = polygons.where(F.size("rings") > 1)
    rings = _rings(several)
    places = F.transform(
        "edges",
        lambda e: F.array(
            F.struct(e.x1.alias("x"), e.y1.alias("y")),
            F.struct(((e.x1 + e.x2) / 2).alias("x"), ((e.y1 + e.y2) / 2).alias("y")),
            F.struct(e.x2.alias("x"), e.y2.alias("y")),
        ),
    )
    total = 3 * F.col("n")
    probes = (
        rings.select(
            "area_key",
            "g",
            "part",
            "ring",
            total.alias("total"),
            F.posexplode(F.flatten(places)).alias("place", "p"),
        )
        .select("area_key", _row(F.col("p.y")).alias("cy"), "part", "ring", "total", "place", "p.x", "p.y")
        .alias("p")
    )
    edges = (
        _edge_rows(several)
        .select("area_key", "cy", F.col("part").alias("o_part"), F.col("ring").alias("o_ring"), "around", "e")
        .alias("e")
    )
    e, x, y = F.col("e.e"), F.col("p.x"), F.col("p.y")
    place = (F.col("p.area_key") == F.col("e.area_key")) & (F.col("p.cy") == F.col("e.cy"))
    other = (F.col("part") != F.col("o_part")) | (F.col("ring") != F.col("o_ring"))
    reach = y.between(e.y1, e.y2) & (F.greatest(e.x1, e.x2) >= x)
    # A place beyond a ring's box is outside that ring whatever its edges: islands never meet.
    box = F.col("e.around")
    reach &= x.between(box.xmin, box.xmax) & y.between(box.ymin, box.ymax)
    met = probes.join(edges.hint("merge"), place & other & reach, "left")
    s = geo.side(e, x, y)
    placed = met.groupBy("p.area_key", "p.cy", "part", "ring", "total", "place", "o_part", "o_ring").agg(
        F.bool_or((s == 0) & geo.between_x(e, x)).alias("on_edge"),
        (F.count_if((s > 0) & (y < e.y2)) % 2 == 1).alias("odd"),
    )
    within = F.count_if(F.col("on_edge") | F.col("odd"))
    pairs = placed.groupBy("area_key", "part", "ring", "total", "o_part", "o_ring").agg(
        F.count_if(~F.col("on_edge") & F.col("odd")).alias("inside"), within.alias("within")
    )
    shell, hole = F.col("o_ring") == 0, F.col("o_ring") > 0
    sides = pairs.groupBy("area_key", "part", "ring", "total", "o_part").agg(
        F.max(F.when(shell, F.col("within"))).alias("within_shell"),
        F.max(F.when(shell, F.col("inside"))).alias("inside_shell"),
        F.coalesce(F.max(F.when(hole, F.col("within"))), F.lit(0)).alias("within_hole"),
        F.coalesce(F.max(F.when(hole, F.col("inside"))), F.lit(0)).alias("inside_hole"),
    )
    own = F.col("o_part") == F.col("part")
    good_hole = own & (F.col("within_shell") == F.col("total")) & (F.col("inside_hole") == 0)
    bad_part = (
        (F.col("ring") == 0)
        & ~own
        & (F.col("inside_shell") > 0)
        & (F.col("within_hole") < F.col("total"))
    )
    verdict = sides.groupBy("area_key", "part", "ring").agg(
        F.coalesce(F.bool_or(good_hole), F.lit(False)).alias("good_hole"),
        F.coalesce(F.bool_or(bad_part), F.lit(False)).alias("bad_part"),
    )
    bad = F.col("bad_part") | ((F.col("ring") > 0) & ~F.col("good_hole"))
    return verdict.where(bad).select("area_key").distinct()


def assess_polygons(raw: DataFrame, area: str, wkt: str) -> DataFrame:
    """Every polygon row with its fault; a null reason means valid.

    The parsed rows are written once to the shared folder, because the checks read them several
    times. Checks see every distinct row once; the verdict goes back to all of its copies.
    """
    seen = Observation()
    parsed = read_polygons(raw, area, wkt).observe(
        seen, F.count_if(F.size("rings") > 1).alias("with_several_rings")
    )
    polygons = staged(parsed, "polygons")
    sound = polygons.where(F.col("reason").isNull())
    faults = crossing_areas(sound).withColumn("fault", F.lit("edges cross"))
    if seen.get["with_several_rings"]:
        misplaced = misplaced_areas(sound).withColumn("fault", F.lit("rings badly nested"))
        cut = cut_areas(sound).withColumn("fault", F.lit("interior cut in two"))
        faults = faults.unionByName(misplaced).unionByName(cut)
        rank = F.when(F.col("fault") == "edges cross", 0).when(F.col("fault") == "rings badly nested", 1).otherwise(2)
        faults = faults.groupBy("area_key").agg(F.min_by("fault", rank).alias("fault"))
    judged = polygons.join(faults, "area_key", "left").withColumn("reason", F.coalesce("reason", "fault"))
    every = judged.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return every.drop("copies", "copy")
