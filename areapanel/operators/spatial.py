"""Point-in-area join as a grid-cell equi-join with an exact test on the cell's edges.

Every area is cut into grid cells. A cell that no edge passes through lies wholly inside or
wholly outside: inside cells are kept without edges, outside cells are dropped. The other cells
keep the edges that a ray to the right meets before it enters a cell without edges. A point has
exactly one cell per grid, so a (point, area) pair appears once, and an area row is never merged
with another row of the same id.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from areapanel import settings
from areapanel.functions import geometry as geo
from areapanel.operators.panel import aggregate_categories
from areapanel.session import staged

CELL = ["level", "cx", "cy"]
EDGE_BYTES = 56
ROW_BYTES = 128


def _grid(level: Column, grid: float) -> Column:
    """Cells per unit; each level is four times coarser."""
    return F.lit(float(grid)) / F.pow(F.lit(4.0), level)


def area_cells(
    areas: DataFrame,
    *,
    grid: float = settings.GRID,
    max_cells: int = settings.MAX_CELLS,
    bounds=None,
    all_cells: int = settings.ALL_CELLS,
    edge_cells: int = settings.EDGE_CELLS,
) -> DataFrame:
    """(ZIP_Code, level, cx, cy, odd, edges): the cells an area covers or touches.

    ``bounds`` ((xmin, xmax), (ymin, ymax)) is the caller's promise that no point lies beyond;
    cells outside are left out.
    An area of more than ``max_cells`` cells takes a coarser grid. Where all areas together have more than
    ``all_cells`` cells, one of more than ``edge_cells`` cells an edge does, so that the cells
    grow with the areas' edges and not with their size.
    """
    box = {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    if bounds:
        (bx0, bx1), (by0, by1) = bounds
        areas = areas.where(
            (F.col("xmin") <= bx1)
            & (F.col("xmax") >= bx0)
            & (F.col("ymin") <= by1)
            & (F.col("ymax") >= by0)
        )
        box = {
            "xmin": F.greatest("xmin", F.lit(float(bx0))),
            "ymin": F.greatest("ymin", F.lit(float(by0))),
            "xmax": F.least("xmax", F.lit(float(bx1))),
            "ymax": F.least("ymax", F.lit(float(by1))),
        }
    cells = ((box["xmax"] - box["xmin"]) * grid + 1) * ((box["ymax"] - box["ymin"]) * grid + 1)
    # Rows are told apart by their place in a written table, which a lost executor does not change.
    numbered = staged(areas.select("ZIP_Code", "edges", "xmin", "ymin", "xmax", "ymax"), "area_rows")
    # A coarser grid has a sixteenth of the cells.
    most = F.lit(max_cells)
    total = numbered.agg(F.sum(F.least(cells, most))).first()[0] or 0
    if total > all_cells:
        most = F.least(most, F.greatest(F.size("edges"), F.lit(1)) * edge_cells)
    levelled = numbered.select(
        F.monotonically_increasing_id().alias("row"),
        "ZIP_Code",
        "edges",
        *[column.alias(name) for name, column in box.items()],
        F.ceil(F.greatest(F.log(16.0, cells / most), F.lit(0.0))).cast("int").alias("level"),
    ).withColumn("g", _grid(F.col("level"), grid))

    g = F.col("g")

    def index(value):
        return geo.cell(value, g)

    # Edges first, then grid rows: a large area is spread over (area row, grid row) groups.
    e, middle = F.col("e"), (F.col("cy") + 0.5) / g
    top, bottom = F.least(index(e.y2), index(F.col("ymax"))), F.greatest(index(e.y1), index(F.col("ymin")))
    low, high = (F.col("cy") - geo.SLACK) / g, (F.col("cy") + 1 + geo.SLACK) / g
    left, right = geo.x_range(e, low, high)
    spans = (
        levelled.select("*", F.explode("edges").alias("e"))
        .drop("edges")
        .select("*", F.explode(F.when(bottom <= top, F.sequence(bottom, top))).alias("cy"))
        .select(
            "row",
            "ZIP_Code",
            "level",
            "cy",
            index(F.col("xmin")).alias("first"),
            index(F.col("xmax")).alias("last"),
            F.floor(left * g - geo.SLACK).alias("left"),
            F.floor(right * g + geo.SLACK).alias("right"),
            ((e.y1 <= middle) & (middle < e.y2)).cast("int").alias("crosses"),
            "e",
        )
    )
    # Stretches of neighbouring columns that edges enter. Between two of them no edge passes: a ray that
    # starts in one can end behind it, and the cells up to the next all have the state found there.
    band = Window.partitionBy("row", "cy").orderBy("left", "right")
    reached = F.max("right").over(band.rowsBetween(Window.unboundedPreceding, -1))
    begins = (reached.isNull() | (F.col("left") > reached + 1)).cast("int")
    runs = (
        spans.withColumn("begins", begins)
        .withColumn("run", F.sum("begins").over(band.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("row", "ZIP_Code", "level", "cy", "first", "last", "run")
        .agg(
            F.min("left").alias("a"),
            F.max("right").alias("b"),
            F.sum("crosses").alias("crossing"),
            F.collect_list(F.struct("right", "e")).alias("near"),
        )
    )
    later = Window.partitionBy("row", "cy").orderBy("run")
    beyond = F.sum("crossing").over(later.rowsBetween(1, Window.unboundedFollowing))
    placed = (
        runs.withColumn("odd", F.pmod(F.coalesce(beyond, F.lit(0)), F.lit(2)).cast("int"))
        .withColumn("next", F.lead("a").over(later))
        .withColumn("from", F.greatest("a", "first"))
        .withColumn("to", F.least(F.when(F.col("odd") == 1, F.col("next") - 1).otherwise(F.col("b")), "last"))
        .select("*", F.explode(F.when(F.col("from") <= F.col("to"), F.sequence("from", "to"))).alias("cx"))
    )
    reachable = F.filter("near", lambda s: s.right >= F.col("cx"))
    return placed.select(
        "ZIP_Code",
        "level",
        "cx",
        "cy",
        "odd",
        F.when(F.col("cx") <= F.col("b"), F.transform(reachable, lambda s: s.e))
        .otherwise(F.array().cast(f"array<{geo.EDGE_TYPE}>"))
        .alias("edges"),
    )


@dataclass(frozen=True)
class Measure:
    """Size of prepared cells in bytes, the grid levels in use, the type a cell index needs, and the number of cells."""

    size: int
    levels: tuple
    index: str
    cells: int


def measured_cells(areas: DataFrame, **options) -> tuple[DataFrame, Measure]:
    """The areas' cells, prepared and written once, and their measure, observed while writing."""
    seen = Observation()
    indexes = [F.abs("cx"), F.abs("cy")]
    cells = area_cells(areas, **options).observe(
        seen,
        F.sum(F.lit(ROW_BYTES) + F.length("ZIP_Code") + F.size("edges") * EDGE_BYTES).alias("bytes"),
        F.bit_or(F.expr("shiftleft(1L, level)")).alias("levels"),
        F.max(F.greatest(*indexes)).alias("largest"),
        F.count(F.lit(1)).alias("cells"),
    )
    cells = staged(cells, "cells")
    row = seen.get
    levels = tuple(i for i in range(63) if (row["levels"] or 0) >> i & 1)
    return cells, Measure(row["bytes"] or 0, levels, "int" if (row["largest"] or 0) < 2**31 else "bigint", row["cells"])


def _with_cell(points: DataFrame, levels, grid: float, index="bigint") -> DataFrame:
    """Add the point's cell for every grid level in use (one in the usual case).

    Two int indexes make one long join key. A point beyond the range of an index type that holds
    all cells of the areas has no cell there and drops out.
    """
    each = [F.lit(level).cast("int") for level in levels]
    level = each[0] if len(each) == 1 else F.explode(F.array(*each))
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    levelled = points.where(finite).withColumn("level", level)
    size = _grid(F.col("level"), grid)
    return levelled.withColumn("cx", geo.cell(F.col("x"), size).try_cast(index)).withColumn(
        "cy", geo.cell(F.col("y"), size).try_cast(index)
    )


def cell_bits(cells: DataFrame, measure: Measure, most_bytes: int) -> tuple[DataFrame, int] | None:
    """(cell_bucket, covered, border) and the number of bits: bitmaps over a hash of the cell, 16 bits a cell, of the cells that some area
    covers or touches and of those that an edge passes. None where both take more than ``most_bytes``.

    Two cells may share a bit, so a set bit says perhaps and a clear one says no.
    """
    slots = 2 ** max(15, (16 * measure.cells).bit_length())
    if slots // 4 > most_bytes:
        return None
    bit = F.bitmap_bit_position(_slot(slots))
    bits = cells.groupBy(F.bitmap_bucket_number(_slot(slots)).alias("cell_bucket")).agg(
        F.bitmap_construct_agg(bit).alias("covered"),
        F.bitmap_construct_agg(F.when(F.size("edges") > 0, bit)).alias("border"),
    )
    return staged(bits, "cell_bits"), slots


def _slot(slots) -> Column:
    return F.pmod(F.xxhash64(*CELL), F.lit(slots).cast("bigint")) + 1


def _has(bitmap, at) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def _covered(placed: DataFrame, bits) -> DataFrame:
    """Points whose cell may belong to an area; ``at_border`` says whether an edge may pass their cell."""
    if bits is None:
        return placed.withColumn("at_border", F.lit(True))
    table, slots = bits
    at = F.bitmap_bit_position(_slot(slots))
    placed = placed.withColumn("cell_bucket", F.bitmap_bucket_number(_slot(slots)))
    found = placed.join(F.broadcast(table), "cell_bucket").where(_has("covered", at))
    return found.withColumn("at_border", _has("border", at)).drop("cell_bucket", "covered", "border")


def hot_cells(placed: DataFrame, hot_rows: int) -> DataFrame:
    """(cell, salts) of every cell with more than ``hot_rows`` points: one salt per ``hot_rows`` points."""
    load = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    return staged(load.select(*CELL, F.ceil(F.col("n") / F.lit(hot_rows)).cast("bigint").alias("salts")), "hot_cells")


def _salted(placed: DataFrame, cells: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread the points of hot cells over salts and repeat those cells once per salt.

    The salt follows a point's ``position`` in the written table, so equal points are spread as well
    and a repeated task deals them out the same way.
    """
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    placed = placed.join(hot, CELL, "left").withColumn("salt", F.pmod("position", salts)).drop("salts")
    cells = (
        cells.join(hot, CELL, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
        .drop("salts")
    )
    return placed, cells


def assign_area(
    points: DataFrame,
    areas: DataFrame,
    *,
    bounds=None,
    grid: float = settings.GRID,
    max_cells: int = settings.MAX_CELLS,
    broadcast_bytes: int = settings.BROADCAST_BYTES,
    hot_rows: int = settings.HOT_ROWS,
    bitmap_bytes: int = settings.BROADCAST_BYTES,
    cells: tuple[DataFrame, Measure] | None = None,
) -> DataFrame:
    """Inner join of points (x, y) with the areas they lie in or on, adding ZIP_Code.

    A point on a shared edge belongs to both areas, overlapping areas repeat the point, points
    outside every area vanish. The cells are broadcast only when their measured size allows it;
    beyond that points whose cell no area covers are dropped at the scan by a bitmap, the others are written
    once to the shared folder, hot cells are found there, and both sides are shuffled by cell with the hot
    cells salted. ``cells`` are ``measured_cells`` of the areas with the same grid and bounds, for several joins.
    """
    cells, measure = cells or measured_cells(areas, grid=grid, max_cells=max_cells, bounds=bounds)
    if not measure.levels:
        return points.withColumn("ZIP_Code", F.lit("")).where(F.lit(False))
    return _join_cells(points, cells, measure, grid, broadcast_bytes, hot_rows, bitmap_bytes)


def _join_cells(points, cells, measure, grid, broadcast_bytes, hot_rows, bitmap_bytes):
    placed = _with_cell(points, measure.levels, grid, measure.index)
    cells = _indexed(cells, measure)
    if measure.size <= broadcast_bytes:
        return _inside(placed.join(F.broadcast(cells), CELL), points.columns)
    placed = _covered(placed, cell_bits(cells, measure, bitmap_bytes)).drop("at_border")
    return _inside(_shuffled(placed, cells, hot_rows), points.columns)


def _indexed(cells, measure):
    return cells.withColumns({c: F.col(c).cast(measure.index) for c in ("cx", "cy")})


def _shuffled(placed, cells, hot_rows):
    placed = staged(placed, "points").withColumn("position", F.monotonically_increasing_id())
    placed, cells = _salted(placed, cells, hot_cells(placed, hot_rows))
    return placed.join(cells.hint("merge"), [*CELL, "salt"])


def _inside(joined, columns):
    return joined.where(geo.covers_point(F.col("edges"), F.col("odd"), F.col("x"), F.col("y"))).select(
        *[F.col(f"`{c}`") for c in columns], "ZIP_Code"
    )


def _tiers(placed: DataFrame, columns) -> DataFrame:
    """Points counted together before they are shuffled: of a cell without edges all points of a month and category,
    of other cells only equal points. One point of the cell stands for all, as no edge tells them apart."""
    rest = [c for c in columns if c not in ("x", "y")]
    exact = [F.when(F.col("at_border"), F.col(c)).alias(f"exact_{c}") for c in ("x", "y")]
    return placed.groupBy(*CELL, *rest, *exact).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.count(F.lit(1)).alias("n")
    ).drop("exact_x", "exact_y")


def count_by_area(
    points: DataFrame,
    areas: DataFrame,
    categories=settings.CATEGORIES,
    *,
    bounds=None,
    grid: float = settings.GRID,
    max_cells: int = settings.MAX_CELLS,
    broadcast_bytes: int = settings.BROADCAST_BYTES,
    hot_rows: int = settings.HOT_ROWS,
    bitmap_bytes: int = settings.BROADCAST_BYTES,
) -> DataFrame:
    """Points per (area, month, year) and category: the join and the count in one step.

    With broadcast cells the points are never shuffled, only partial counts are. When the cells
    are too large, points of cells that no edge passes are first counted by cell, month and category; of border
    cells equal points are counted together. Points of cells outside all areas are dropped at the scan.
    """
    cells, measure = measured_cells(areas, grid=grid, max_cells=max_cells, bounds=bounds)
    slim = points.select("x", "y", "Month_Date", "Year", "Crime_Category")
    if not measure.levels:
        joined = slim.withColumn("ZIP_Code", F.lit("")).where(F.lit(False))
        return aggregate_categories(joined, categories)
    if measure.size <= broadcast_bytes:
        joined = _join_cells(slim, cells, measure, grid, broadcast_bytes, hot_rows, bitmap_bytes)
        return aggregate_categories(joined, categories)
    cells = _indexed(cells, measure)
    placed = _covered(_with_cell(slim, measure.levels, grid, measure.index), cell_bits(cells, measure, bitmap_bytes))
    counted = _tiers(placed, slim.columns)
    joined = _inside(_shuffled(counted, cells, hot_rows), [*slim.columns, "n"])
    return aggregate_categories(joined, categories)
