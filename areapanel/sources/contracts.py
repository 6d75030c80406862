"""What a source must offer, and recognising a source by its header."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SourceRule:
    """A header scores one point per expected name present, and one for a name that contains any
    of ``parts`` (in any letter case); it is recognised from ``threshold`` on."""

    kind: str
    names: tuple
    threshold: int
    parts: tuple = ()


# Expected header names and thresholds of the three sources.
EVENT_COLUMNS = ("ID", "Date", "Primary Type", "Latitude", "Longitude")
VALUE_COLUMNS = ("RegionName", "RegionType", "State", "City")
AREA_COLUMNS = ("ZIP",)
GEOMETRY_PARTS = ("geom", "shape")
POPULATION_FILE = "historical_zip_population_10yrs.csv"
RULES = (
    SourceRule("crime", EVENT_COLUMNS, 5),
    SourceRule("zillow", VALUE_COLUMNS, 4),
    SourceRule("boundary", ("zip",), 2, GEOMETRY_PARTS),
)


def geometry_columns(columns, parts=GEOMETRY_PARTS) -> list[str]:
    """The names that contain any of ``parts``, in any letter case."""
    return [c for c in columns if any(part in c.lower() for part in parts)]


def require_columns(df: DataFrame, names, label="source") -> DataFrame:
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ValueError(f"{label} has no column {', '.join(lacking)}")
    return df


def require_any_matching(df: DataFrame, parts, label="source") -> DataFrame:
    if not geometry_columns(df.columns, parts):
        raise ValueError(f"{label}: no column name contains {' or '.join(parts)}")
    return df


def value_report(df: DataFrame, column: str, value: str) -> DataFrame:
    """One row: rows read, rows whose trimmed, lower-cased ``column`` is ``value``, and whether
    there is one. The whole table counts: row order means nothing here."""
    hit = F.coalesce(F.lower(F.trim(F.col(f"`{column}`"))) == value, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(hit).alias("matching_rows"),
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("accepted"),
    )


def require_value(df: DataFrame, column: str, value: str, label="source") -> DataFrame:
    hit = F.lower(F.trim(F.col(f"`{column}`"))) == value
    if df.where(hit).select(F.lit(1)).isEmpty():
        raise ValueError(f"{label}: no row has {column} = {value}")
    return df


def require_rows(df: DataFrame, label="source") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{label}: the table is missing or empty")
    return df


def check_events(df: DataFrame) -> DataFrame:
    return require_columns(df, EVENT_COLUMNS, "events")


def check_areas(df: DataFrame) -> DataFrame:
    return require_any_matching(require_columns(df, AREA_COLUMNS, "areas"), GEOMETRY_PARTS, "areas")


def check_values(df: DataFrame) -> DataFrame:
    return require_value(require_columns(df, VALUE_COLUMNS, "values"), "RegionType", "zip", "values")


def source_scores(headers: DataFrame, rules=RULES) -> DataFrame:
    """(file, kind, score) for every file and rule, from (file, column) rows in one grouping."""

    def score(rule):
        points = [F.max((F.col("column") == name).cast("int")) for name in rule.names]
        if rule.parts:
            name = F.lower("column")
            any_part = F.lit(False)
            for part in rule.parts:
                any_part = any_part | name.contains(part)
            points.append(F.max(any_part.cast("int")))
        return F.coalesce(sum(points[1:], points[0]), F.lit(0)).alias(rule.kind)

    scored = headers.groupBy("file").agg(*[score(r) for r in rules])
    return scored.unpivot(["file"], [r.kind for r in rules], "kind", "score")


def classify_sources(headers: DataFrame, rules=RULES, ignore=(POPULATION_FILE,)) -> DataFrame:
    """(kind, file, score): the best file per kind if it reaches the threshold; the first name
    wins a tie."""
    name = F.element_at(F.split("file", "/"), -1)
    best = (
        source_scores(headers.where(~name.isin(*ignore)), rules)
        .groupBy("kind")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "file")).alias("best"))
        .select("kind", "best.file", (-F.col("best.minus")).alias("score"))
    )
    enough = F.lit(False)
    for rule in rules:
        enough = enough | ((F.col("kind") == rule.kind) & (F.col("score") >= rule.threshold))
    return best.where(enough)
