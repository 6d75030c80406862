"""From raw sources to typed tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel import settings
from areapanel.functions import geometry as geo
from areapanel.functions import values as v
from areapanel.operators import reshape, validity
from areapanel.operators.dedupe import dedupe_by_key
from areapanel.sources import contracts


def clean_points(
    raw: DataFrame,
    *,
    years=settings.YEARS,
    latitudes=settings.LATITUDES,
    longitudes=settings.LONGITUDES,
    listed=settings.VIOLENT_TYPES,
    categories=settings.CATEGORIES,
) -> DataFrame:
    """Events to (ID, Month_Date, Year, Crime_Category, x, y).

    One row per ID is kept before any window is applied. Incomplete rows never survive, so they
    are dropped first and do not cross the shuffle; among complete rows of an ID the first by
    (Date, Primary Type, Latitude, Longitude) stays. Dates are parsed before the grouping: behind
    it the year filter would make Spark parse each date twice.
    """
    order = ["Date", "Primary Type", "Latitude", "Longitude"]
    complete = raw.select(
        "ID",
        "Date",
        "Primary Type",
        v.number(F.col("Latitude")).alias("Latitude"),
        v.number(F.col("Longitude")).alias("Longitude"),
        v.month_start(v.event_time(F.col("Date"))).alias("Month_Date"),
    ).dropna(subset=order)
    located = dedupe_by_key(complete, ["ID"], order).where(
        F.col("Latitude").between(*latitudes) & F.col("Longitude").between(*longitudes)
    )
    return (
        located.withColumn("Year", F.year("Month_Date"))
        .where(v.in_years(F.col("Year"), years))
        .select(
            "ID",
            "Month_Date",
            "Year",
            v.two_way_category(F.col("Primary Type"), listed, categories).alias("Crime_Category"),
            F.col("Longitude").alias("x"),
            F.col("Latitude").alias("y"),
        )
    )


def find_geometry_column(raw: DataFrame) -> str:
    """The geometry column by name; if several names qualify, the first that holds polygons."""
    named = contracts.geometry_columns(raw.columns)
    if len(named) < 2:
        return named[0] if named else settings.GEOMETRY_COLUMN
    hits = raw.agg(
        *[F.bool_or(geo.looks_like_polygon(F.col(f"`{c}`"))).alias(f"h{i}") for i, c in enumerate(named)]
    ).first()
    return next((c for i, c in enumerate(named) if hits[i]), named[0])


def clean_boundaries(raw: DataFrame, *, area="ZIP", strict=False) -> DataFrame:
    """Valid areas as (ZIP_Code, edges, xmin, ymin, xmax, ymax).

    With ``strict`` the first invalid geometry fails the job instead of being left out.
    """
    checked = validity.assess_polygons(raw, area, find_geometry_column(raw))
    if strict:
        message = F.concat(F.lit("area "), F.col("ZIP_Code"), F.lit(": "), F.col("reason"))
        fine = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    else:
        fine = F.col("reason").isNull()
    return checked.where(fine).select(
        "ZIP_Code", validity.all_edges().alias("edges"), "xmin", "ymin", "xmax", "ymax"
    )


def rejected_boundaries(raw: DataFrame, *, area="ZIP") -> DataFrame:
    """(ZIP_Code, reason) of the areas that ``clean_boundaries`` leaves out."""
    checked = validity.assess_polygons(raw, area, find_geometry_column(raw))
    return checked.where(F.col("reason").isNotNull()).select("ZIP_Code", "reason")


def clean_wide_series(
    raw: DataFrame, *, years=settings.YEARS, region=settings.REGION, region_type=None
) -> DataFrame:
    """Wide monthly values to (ZIP_Code, Month_Date, ZHVI_Value), positive values only.

    Month columns outside the window are not read at all.
    """
    months = reshape.month_columns(raw.columns, years)
    rows = raw
    for column, value in region.items():
        rows = rows.where(F.col(column) == value)
    if region_type:
        rows = rows.where(F.lower(F.trim("RegionType")) == region_type.lower())
    area = v.area_text(F.col("RegionName")).alias("ZIP_Code")
    long = reshape.melt_months(
        rows.select(area, *[f"`{m}`" for m in months]), ["ZIP_Code"], months, "Month_Date", "text"
    )
    return long.select("ZIP_Code", "Month_Date", v.number(F.col("text")).alias("ZHVI_Value")).where(
        "ZHVI_Value > 0"
    )
