"""Polygon expressions: WKT text to edges, grid cells, point tests. No UDF, no shuffle.

An edge is a struct (x1, y1, x2, y2) whose lower end comes first. Two areas that share an edge
then compute the same number for a point near it, whatever way their rings run.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any plain or scientific number; possessive, so a long text is read once.
NUMBER = r"[+-]?(?:\d++\.?\d*+|\.\d++)(?:E[+-]?\d++)?"
PAIR = f"^{NUMBER} {NUMBER}$"
SLACK = 1e-3  # share of a grid cell that covers the rounding of ``x_range``
#: Relative error that covers two differences, two products and their difference in doubles.
ROUNDING = 4.0 * 2.0**-53
#: Cuts a double into two halves of 26 bits.
SPLIT = 2.0**27 + 1
EDGE_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"


def is_polygon_text(wkt: Column) -> Column:
    text = F.upper(F.trim(wkt))
    return text.rlike(r"^POLYGON\s*\(\s*\(") & text.rlike(r"\)\s*\)$") | (
        text.rlike(r"^MULTIPOLYGON\s*\(\s*\(\s*\(") & text.rlike(r"\)\s*\)\s*\)$")
    )


def looks_like_polygon(text: Column) -> Column:
    return F.upper(F.trim(text)).rlike(r"^(MULTI)?POLYGON\b")


def _point(pair: Column) -> Column:
    """One coordinate pair; null unless it is exactly two numbers that are finite doubles."""
    x = F.substring_index(pair, " ", 1).try_cast("double")
    y = F.substring_index(pair, " ", -1).try_cast("double")
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.when(pair.rlike(PAIR) & finite, F.struct(x.alias("x"), y.alias("y")))


def polygon_parts(wkt: Column) -> Column:
    """array<part: array<ring: array<point>>>; a point that cannot be read is null."""
    text = F.regexp_replace(F.upper(F.trim(wkt)), r"\s+", " ")
    single = F.regexp_replace(text, r"^POLYGON ?\( ?\( ?| ?\) ?\)$", "")
    several = F.regexp_replace(text, r"^MULTIPOLYGON ?\( ?\( ?\( ?| ?\) ?\) ?\)$", "")
    parts = F.when(
        F.upper(F.trim(wkt)).startswith("MULTI"), F.split(several, r" ?\) ?\) ?, ?\( ?\( ?")
    ).otherwise(F.array(single))
    return F.transform(
        parts,
        lambda part: F.transform(
            F.split(part, r" ?\) ?, ?\( ?"),
            lambda ring: F.transform(F.split(ring, " ?, ?"), _point),
        ),
    )


def without_repeats(ring: Column) -> Column:
    """Ring points without immediate repetitions."""
    return F.filter(
        ring,
        lambda p, i: (i == 0) | (p != F.element_at(ring, F.greatest(i, F.lit(1)))),
    )


def ring_edges(ring: Column) -> Column:
    """Edges of one ring, in ring order, each with its lower end first."""
    pairs = F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def edge(p):
        up = (p.a.y < p.b.y) | ((p.a.y == p.b.y) & (p.a.x <= p.b.x))
        return F.struct(
            F.when(up, p.a.x).otherwise(p.b.x).alias("x1"),
            F.when(up, p.a.y).otherwise(p.b.y).alias("y1"),
            F.when(up, p.b.x).otherwise(p.a.x).alias("x2"),
            F.when(up, p.b.y).otherwise(p.a.y).alias("y2"),
        )

    return F.transform(pairs, edge)


def ring_area_twice(ring: Column) -> Column:
    """Shoelace sum, measured from the first point so that large offsets cost no digits."""
    origin = F.element_at(ring, 1)
    rest = F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: (a.x - origin.x) * (b.y - origin.y) - (b.x - origin.x) * (a.y - origin.y),
    )
    return F.abs(F.aggregate(rest, F.lit(0.0), lambda acc, v: acc + v))


def record(**fields) -> Column:
    """A struct by field names; unlike aliases they also hold inside the condition of a join."""
    return F.named_struct(*[c for name, value in fields.items() for c in (F.lit(name), value)])


def bound_once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _product(p: Column) -> Column:
    """The product of a pair's ``a`` and ``b`` as two doubles whose sum is exact (Veltkamp's split, Dekker's product)."""

    def high(v):
        return SPLIT * v - (SPLIT * v - v)

    ah, bh = high(p.a), high(p.b)
    al, bl = p.a - ah, p.b - bh
    whole = p.a * p.b
    return F.array(al * bl - (((whole - ah * bh) - al * bh) - ah * bl), whole)


def _grown(total: Column, value: Column) -> Column:
    """An exact sum of doubles (smallest first, no two overlap) with one more double added."""

    def carry(state, part):
        x = state.q + part
        lost = (state.q - (x - (x - state.q))) + (part - (x - state.q))
        return record(q=x, h=F.array_append(state.h, lost))

    begin = record(q=value, h=F.array().cast("array<double>"))
    return F.aggregate(total, begin, carry, lambda state: F.array_append(state.h, state.q))


def exact_side(edge: Column, x: Column, y: Column) -> Column:
    """A double with the sign that ``side`` has without any rounding: its products are summed exactly."""
    factors = [(edge.x2, y), (-edge.x2, edge.y1), (-edge.x1, y), (-x, edge.y2), (x, edge.y1), (edge.x1, edge.y2)]
    pairs = F.array(*[record(a=a, b=b) for a, b in factors])
    terms = F.flatten(F.transform(pairs, _product))
    total = F.aggregate(terms, F.array().cast("array<double>"), _grown)
    # The last part that is not zero is larger than all before it together.
    return F.aggregate(total, F.lit(0.0), lambda sign, part: F.when(part != 0, part).otherwise(sign))


def side(edge: Column, x: Column, y: Column) -> Column:
    """Positive when the point is left of the upward edge, zero when on its line; the sign is exact.

    Plain doubles decide wherever their error cannot reach the result; where they do not, ends of the edge are on
    it, and only what is left is summed exactly. Products beyond the range of doubles are not covered.
    """
    left, right = (edge.x2 - edge.x1) * (y - edge.y1), (x - edge.x1) * (edge.y2 - edge.y1)
    at_end = ((x == edge.x1) & (y == edge.y1)) | ((x == edge.x2) & (y == edge.y2))
    return (
        F.when(F.abs(left - right) > ROUNDING * (F.abs(left) + F.abs(right)), left - right)
        .when(at_end, F.lit(0.0))
        .otherwise(exact_side(edge, x, y))
    )


def between_x(edge: Column, x: Column) -> Column:
    return x.between(F.least(edge.x1, edge.x2), F.greatest(edge.x1, edge.x2))


def covers_point(edges: Column, odd: Column, x: Column, y: Column) -> Column:
    """True inside or on the boundary: even-odd count of edges right of the point.

    ``odd`` is the parity already known from edges that were left out of ``edges``.
    The fold keeps -1 once the point lies on an edge.
    """

    def step(acc, e):
        def placed(s):
            return F.when((s == 0) & between_x(e, x), F.lit(-1)).when((s > 0) & (y < e.y2), 1 - acc).otherwise(acc)

        return F.when((acc == -1) | (y < e.y1) | (y > e.y2), acc).otherwise(bound_once(side(e, x, y), placed))

    return F.when(F.size(edges) == 0, odd != 0).otherwise(F.aggregate(edges, odd, step) != 0)


def cell(value: Column, grid: Column) -> Column:
    """Grid index. Always this expression: another rounding would lose points on cell borders."""
    return F.floor(value * grid)


def x_range(edge: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Smallest and largest x of the stretch of an edge between two heights."""
    slope = (edge.x2 - edge.x1) / F.nullif(edge.y2 - edge.y1, F.lit(0.0))

    def at(y):
        return edge.x1 + (F.least(F.greatest(y, edge.y1), edge.y2) - edge.y1) * slope

    start, end = F.coalesce(at(low), edge.x1), F.coalesce(at(high), edge.x2)
    return F.least(start, end), F.greatest(start, end)


def edge_box(edges: Column) -> Column:
    return F.struct(
        F.array_min(F.transform(edges, lambda e: F.least(e.x1, e.x2))).alias("xmin"),
        F.array_min(F.transform(edges, lambda e: e.y1)).alias("ymin"),
        F.array_max(F.transform(edges, lambda e: F.greatest(e.x1, e.x2))).alias("xmax"),
        F.array_max(F.transform(edges, lambda e: e.y2)).alias("ymax"),
    )
