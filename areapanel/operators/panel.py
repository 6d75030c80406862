"""Counting, merging and rating on the (area, month) panel."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel import settings
from areapanel.functions import values as v

KEY = ["ZIP_Code", "Month_Date"]


def aggregate_categories(joined: DataFrame, categories=settings.CATEGORIES) -> DataFrame:
    """Counts per (area, month, year) and category; rows may carry a multiplicity ``n``."""
    one = F.col("n") if "n" in joined.columns else F.lit(1)

    def counted(category):
        return F.sum(F.when(F.col("Crime_Category") == category, one).otherwise(0)).cast("bigint")

    return joined.groupBy("ZIP_Code", "Month_Date", "Year").agg(
        counted(categories[0]).alias("Violent_Crime_Count"),
        counted(categories[1]).alias("Property_Crime_Count"),
    )


def merge_master(counts: DataFrame, values: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Counts with values of the same area and month; with a population table also densities.

    Duplicate keys on either side multiply rows; ``duplicate_keys`` reports them.
    """
    master = counts.join(values, KEY, "inner")
    return master if population is None else add_density(master, population)


def add_density(master: DataFrame, population: DataFrame, per=1000, digits=4) -> DataFrame:
    """Left join of the yearly population and rounded counts per ``per`` people."""
    people = F.col("Population")
    return master.join(population, ["ZIP_Code", "Year"], "left").withColumns(
        {
            "Violent_Crime_Density_per_1k": v.density(F.col("Violent_Crime_Count"), people, per, digits),
            "Property_Crime_Density_per_1k": v.density(F.col("Property_Crime_Count"), people, per, digits),
        }
    )


def build_final(analytical: DataFrame, population: DataFrame, years=settings.YEARS) -> DataFrame:
    """The yearly population on every month of its year; months without one are dropped."""
    measures = ["Property_Crime_Count", "Violent_Crime_Count", "ZHVI_Value"]
    window = v.in_years(F.col("Year"), years)
    left = analytical.where(window).dropna(subset=measures)
    right = population.where(window).dropna(subset=["Population"])
    return left.join(right, ["ZIP_Code", "Year"], "inner").select(
        F.col("ZIP_Code").alias("ZIP_CODE"), "Month_Date", "Year", *measures, "Population"
    )


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def without_months(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop the (area, year, month) cells listed in a table."""
    listed = excluded.select(
        F.col("ZIP_CODE"), F.col("Year").alias("ex_year"), F.col("Month").alias("ex_month")
    )
    here = (F.year("Month_Date") == F.col("ex_year")) & (F.month("Month_Date") == F.col("ex_month"))
    return df.join(listed, (df["ZIP_CODE"] == listed["ZIP_CODE"]) & here, "left_anti")
