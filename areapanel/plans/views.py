"""The reporting views on the final table, each a function from DataFrame to DataFrame.

Input columns: ZIP_CODE, Month_Date, Year, Property_Crime_Count, Violent_Crime_Count,
ZHVI_Value, Population.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapanel import settings
from areapanel.functions import values as v
from areapanel.operators import reshape
from areapanel.operators.lags import average_growth, relative_change_by_row
from areapanel.sources.tables import register_views


def property_crime_distribution(final: DataFrame) -> DataFrame:
    return final.groupBy(F.col("ZIP_CODE").alias("zip_code")).agg(
        F.avg("Property_Crime_Count").alias("avg_property_crime_count")
    )


def violent_crime_distribution(final: DataFrame) -> DataFrame:
    return final.groupBy(F.col("ZIP_CODE").alias("zip_code")).agg(
        F.avg("Violent_Crime_Count").alias("avg_violent_crime_count")
    )


def investment_efficiency_property(final: DataFrame) -> DataFrame:
    return final.groupBy(F.col("ZIP_CODE").alias("zip_code")).agg(
        F.sum("Property_Crime_Count").alias("total_property_crime_count"),
        F.sum("ZHVI_Value").alias("total_zhvi_value"),
    )


def crime_seasonality(final: DataFrame, peak=settings.PEAK_MONTHS) -> DataFrame:
    return (
        final.groupBy(F.month("Month_Date").alias("month_num"))
        .agg(
            F.avg("Property_Crime_Count").alias("avg_property_crime_count"),
            F.avg("ZHVI_Value").alias("avg_zhvi_value"),
        )
        .withColumn("peak_season", v.peak_flag(F.col("month_num"), peak))
    )


def lag_effect_property_crime(final: DataFrame, dates=settings.LAG_RANGE) -> DataFrame:
    """Totals per calendar month over all years, and the change from one calendar month to the
    next. January has no earlier month."""
    totals = (
        final.where(F.col("Month_Date").between(F.lit(dates[0]), F.lit(dates[1])))
        .groupBy(F.month("Month_Date").alias("month_num"))
        .agg(
            F.sum("Property_Crime_Count").alias("total_property_crime_count"),
            F.sum("ZHVI_Value").alias("total_zhvi_value"),
        )
    )
    return relative_change_by_row(totals, "total_zhvi_value", ["month_num"])


def excluded_cells(area, month_date, cells=settings.EXCLUDED_MONTHS):
    """True for the listed (area, year, month) cells; null where the area or date decides nothing."""
    hit = F.lit(False)
    for name, year, month in cells:
        hit = hit | ((area == name) & (F.month(month_date) == month) & (F.year(month_date) == year))
    return hit


def crime_rate_base(final: DataFrame, excluded=settings.EXCLUDED_MONTHS) -> DataFrame:
    return (
        final.where(~excluded_cells(F.col("ZIP_CODE"), F.col("Month_Date"), excluded))
        .groupBy(
            F.col("ZIP_CODE").alias("zip_code"),
            F.year("Month_Date").alias("year_num"),
            F.month("Month_Date").alias("month_num"),
        )
        .agg(
            F.sum("Property_Crime_Count").alias("total_property_crime_count"),
            F.sum("Population").alias("total_population"),
            F.sum("ZHVI_Value").alias("total_zhvi_value"),
        )
        .withColumn(
            "property_crime_rate_per_1000",
            v.ratio_per(F.col("total_property_crime_count"), F.col("total_population")),
        )
    )


def crime_rate_appreciation(final: DataFrame, excluded=settings.EXCLUDED_MONTHS) -> DataFrame:
    return relative_change_by_row(
        crime_rate_base(final, excluded), "total_zhvi_value", ["year_num", "month_num"], ["zip_code"]
    )


def slope_compare(final: DataFrame, hypothesis=settings.HYPOTHESIS) -> DataFrame:
    """Average rate per crime type against average value growth, two rows per area."""
    people = F.col("Population")
    rated = final.withColumns(
        {
            "violent_rate": v.rate(F.col("Violent_Crime_Count"), people),
            "property_rate": v.rate(F.col("Property_Crime_Count"), people),
        }
    )
    areas = average_growth(rated, carried=["violent_rate", "property_rate", "Population"]).select(
        "ZIP_CODE",
        F.col("avg_violent_rate").alias("violent"),
        F.col("avg_property_rate").alias("property"),
        F.col("growth").alias("housing_growth_pct"),
        F.col("avg_Population").alias("avg_population"),
        F.lit(hypothesis).alias("hypothesis"),
    )
    return reshape.measures_to_rows(
        areas,
        ["ZIP_CODE", "housing_growth_pct", "avg_population", "hypothesis"],
        {"violent": "Violent Crime", "property": "Property Crime"},
        "crime_type",
        "crime_rate",
    ).select(
        "ZIP_CODE", "crime_type", "crime_rate", "housing_growth_pct", "avg_population", "hypothesis"
    )


def slope_table(final: DataFrame, hypothesis=settings.HYPOTHESIS) -> DataFrame:
    """The same comparison with upper-case names, as a table to store."""
    out = slope_compare(final, hypothesis)
    return out.select(*[F.col(c).alias(c.upper()) for c in out.columns])


VIEWS = {
    "vw_property_crime_distribution": property_crime_distribution,
    "vw_violent_crime_distribution": violent_crime_distribution,
    "vw_investment_efficiency_property": investment_efficiency_property,
    "vw_crime_seasonality": crime_seasonality,
    "vw_lag_effect_property_crime": lag_effect_property_crime,
    "vw_crime_rate_housing_appreciation_base": crime_rate_base,
    "vw_crime_rate_housing_appreciation": crime_rate_appreciation,
    "vw_crime_slope_compare_tableau": slope_compare,
}


def create_views(final: DataFrame) -> list[str]:
    """Create or replace all eight views on ``final`` for this session; returns their names."""
    register_views({name: build(final) for name, build in VIEWS.items()})
    return list(VIEWS)


def stored_definitions(final: str, slopes: str) -> dict[str, str]:
    """The eight views as SQL over the stored final table and the stored slope table."""
    first, last = settings.LAG_RANGE
    low, high = settings.PEAK_MONTHS
    cells = " OR ".join(
        f"(ZIP_CODE = '{area}' AND year(Month_Date) = {year} AND month(Month_Date) = {month})"
        for area, year, month in settings.EXCLUDED_MONTHS
    )
    change = "(total_zhvi_value - lag(total_zhvi_value) OVER w) / nullif(abs(lag(total_zhvi_value) OVER w), 0)"
    totals = "sum(Property_Crime_Count) AS total_property_crime_count"
    base = f"""
        SELECT *, total_property_crime_count / nullif(total_population / 1000.0D, 0) AS property_crime_rate_per_1000
        FROM (SELECT ZIP_CODE AS zip_code, year(Month_Date) AS year_num, month(Month_Date) AS month_num, {totals},
                sum(Population) AS total_population, sum(ZHVI_Value) AS total_zhvi_value
              FROM {final} WHERE NOT ({cells}) GROUP BY 1, 2, 3)"""
    return {
        "vw_property_crime_distribution": f"""
            SELECT ZIP_CODE AS zip_code, avg(Property_Crime_Count) AS avg_property_crime_count FROM {final} GROUP BY 1""",
        "vw_violent_crime_distribution": f"""
            SELECT ZIP_CODE AS zip_code, avg(Violent_Crime_Count) AS avg_violent_crime_count FROM {final} GROUP BY 1""",
        "vw_investment_efficiency_property": f"""
            SELECT ZIP_CODE AS zip_code, {totals}, sum(ZHVI_Value) AS total_zhvi_value FROM {final} GROUP BY 1""",
        "vw_crime_seasonality": f"""
            SELECT month(Month_Date) AS month_num, avg(Property_Crime_Count) AS avg_property_crime_count,
              avg(ZHVI_Value) AS avg_zhvi_value, coalesce(month(Month_Date) BETWEEN {low} AND {high}, false) AS peak_season
            FROM {final} GROUP BY 1, 4""",
        "vw_lag_effect_property_crime": f"""
            SELECT *, {change} AS monthly_appreciation_rate
            FROM (SELECT month(Month_Date) AS month_num, {totals}, sum(ZHVI_Value) AS total_zhvi_value FROM {final}
                  WHERE Month_Date BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY 1)
            WINDOW w AS (ORDER BY month_num NULLS LAST)""",
        "vw_crime_rate_housing_appreciation_base": base,
        "vw_crime_rate_housing_appreciation": f"""
            SELECT *, {change} AS monthly_appreciation_rate FROM ({base})
            WINDOW w AS (PARTITION BY zip_code ORDER BY year_num NULLS LAST, month_num NULLS LAST)""",
        "vw_crime_slope_compare_tableau": f"""
            SELECT ZIP_CODE, CRIME_TYPE AS crime_type, CRIME_RATE AS crime_rate, HOUSING_GROWTH_PCT AS housing_growth_pct,
              AVG_POPULATION AS avg_population, HYPOTHESIS AS hypothesis FROM {slopes}""",
    }


def store_views(spark: SparkSession, final: str, slopes: str, schema: str | None = None) -> list[str]:
    """Create or replace the eight views in the catalog, on two stored tables; returns their names.

    Session views of these names are dropped, because they would hide the stored ones.
    """
    for name, query in stored_definitions(final, slopes).items():
        spark.catalog.dropTempView(name)
        spark.sql(f"CREATE OR REPLACE VIEW {schema + '.' if schema else ''}{name} AS {query}")
    return list(VIEWS)
