"""Row counts, window profiles and guards that fail before a result is published."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from areapanel import settings
from areapanel.functions import values as v


def observe_counts(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while another action runs; read ``observation.get['rows']`` afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def observe_years(df: DataFrame, name: str, year="Year") -> tuple[DataFrame, Observation]:
    """Row count, null years and year range while another action runs."""
    seen = Observation(name)
    observed = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(year).isNull()).alias("null_years"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )
    return observed, seen


def year_profile(df: DataFrame, year="Year") -> DataFrame:
    """One row: first year, last year, number of distinct years, rows."""
    return df.agg(
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
        F.count_distinct(F.col(year)).alias("distinct_years"),
        F.count(F.lit(1)).alias("rows"),
    )


def guard_not_empty(profile, years=settings.YEARS) -> None:
    """``profile`` is any mapping or Row with ``rows``."""
    if not profile["rows"]:
        raise ValueError(
            f"the result is empty after restricting to {years[0]}-{years[1]}; "
            "check that events and values cover the same areas in that window"
        )


def guard_years(profile, years=settings.YEARS) -> None:
    low, high = profile["min_year"], profile["max_year"]
    if low is None or high is None or low < years[0] or high > years[1]:
        raise ValueError(f"the result leaves the year window {years[0]}-{years[1]}: {low}..{high}")


def key_overlap(analytical: DataFrame, population: DataFrame, years=settings.YEARS) -> DataFrame:
    """One row: distinct (area, year) pairs of each side in the window, pairs in both, and the
    year range of the whole analytical side.

    One grouping of the tagged keys of both tables gives all five numbers; no join is needed.
    """

    def tagged(df, left):
        return df.select(
            df["ZIP_Code"].alias("area"),
            F.col("Year").alias("year"),
            F.lit(left).alias("is_left"),
        )

    keys = (
        tagged(analytical, True)
        .unionByName(tagged(population, False))
        .groupBy("area", "year")
        .agg(
            F.bool_or("is_left").alias("in_left"),
            F.bool_or(~F.col("is_left")).alias("in_right"),
        )
    )
    inside = v.in_years(F.col("year"), years)
    both = F.col("in_left") & F.col("in_right") & F.col("area").isNotNull()
    return keys.agg(
        F.count_if(inside & F.col("in_left")).alias("analytical_pairs"),
        F.count_if(inside & F.col("in_right")).alias("population_pairs"),
        F.count_if(inside & both).alias("overlapping_pairs"),
        F.min(F.when(F.col("in_left"), F.col("year"))).alias("analytical_min_year"),
        F.max(F.when(F.col("in_left"), F.col("year"))).alias("analytical_max_year"),
    )


def guard_overlap(overlap, years=settings.YEARS) -> None:
    if not overlap["overlapping_pairs"]:
        raise RuntimeError(
            f"no (area, year) pair of {years[0]}-{years[1]} is in both the analytical table and the "
            f"population table; analytical years are {overlap['analytical_min_year']}.."
            f"{overlap['analytical_max_year']}"
        )
