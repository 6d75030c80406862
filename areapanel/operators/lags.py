"""Change against the previous row.

The lag goes by row, not by calendar month: a gap is spanned. Nulls sort last.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapanel.functions import values as v
from areapanel.session import staged

#: Distinct values of one area and month that a task takes; beyond it the month is cut into slices.
GROUP_ROWS = 100_000
SLICES = 1024


def _previous(column: str, order_by, partition_by=()):
    order = [F.col(c).asc_nulls_last() for c in order_by]
    return F.lag(column).over(Window.partitionBy(*partition_by).orderBy(*order))


def relative_change_by_row(df: DataFrame, value: str, order_by, partition_by=(), name="monthly_appreciation_rate"):
    """Add the change against the previous row as a fraction.

    For aggregated input: without ``partition_by`` the rows are calendar months (at most 13 groups),
    with it they are the months of one area, so a window group is bounded by the calendar.
    """
    return df.withColumn(
        name, v.relative_change(F.col(value), _previous(value, order_by, partition_by))
    )


def _sliced(level: DataFrame, keys, value: str, group_rows: int) -> DataFrame:
    """Adds ``slice``: 0 for most months, ranges of about equal size for months of very many values.

    The ranges follow the values' own quantiles, so values that lie close together are cut as well.
    Slices never fall as the value rises; nulls, which sort last, are a slice of their own. The large months are
    written first: without any nothing is joined, and few are broadcast.
    """
    number = F.col(value)
    large = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group_rows).drop("rows")
    large = staged(large, "large_months")
    if large.isEmpty():
        return level.withColumn("slice", F.when(number.isNull(), SLICES).otherwise(0))
    shares = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    cuts = level.join(large, keys).groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, shares, F.lit(8 * SLICES))).alias("cuts")
    )
    cuts = staged(cuts, "cuts")
    below = F.size(F.filter("cuts", lambda c: c <= number))
    place = F.when(number.isNull(), SLICES).when(F.col("cuts").isNull(), 0).otherwise(below)
    return level.join(cuts, keys, "left").withColumn("slice", place).drop("cuts")


def average_growth(
    df: DataFrame, area="ZIP_CODE", month="Month_Date", value="ZHVI_Value", carried=(), *, group_rows=GROUP_ROWS
):
    """Per area: average percent change of ``value`` from row to row in month order, and the
    plain averages of the ``carried`` columns.

    Rows of one month are taken in value order. No task needs all rows of an area or month: equal
    rows are first counted together, changes are found inside slices of a month (the whole month, or
    quantile ranges where it holds more than ``group_rows`` distinct values), and only one row per
    slice goes through the window over the area. A change
    between equal values is 0 (null when the value is 0), so ``n`` equal rows add ``n - 1`` such
    changes.
    """
    number = F.col(value)
    level = df.groupBy(area, month, value).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in carried],
        *[F.count(c).alias(f"cnt_{c}") for c in carried],
    )
    level = _sliced(level, [area, month], value, group_rows)
    step = v.percent_change(number, _previous(value, [value], [area, month, "slice"]))
    flat = F.when(number != 0, F.col("n") - 1).otherwise(0)
    slices = (
        level.withColumn("step", step)
        .withColumn("flat", flat)
        .groupBy(area, month, "slice")
        .agg(
            F.min(value).alias("first_value"),
            F.max(value).alias("last_value"),
            F.sum("step").alias("step_sum"),
            (F.count("step") + F.sum("flat")).alias("step_count"),
            *[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in carried for k in ("sum", "cnt")],
        )
    )
    before = _previous("last_value", [month, "slice"], [area])
    across = v.percent_change(F.col("first_value"), before)
    total = F.coalesce(F.sum("step_sum"), F.lit(0.0)) + F.coalesce(F.sum("across"), F.lit(0.0))
    count = F.sum("step_count") + F.count("across")
    return (
        slices.withColumn("across", across)
        .groupBy(area)
        .agg(
            (total / F.nullif(count, F.lit(0))).alias("growth"),
            *[
                (F.sum(f"sum_{c}") / F.nullif(F.sum(f"cnt_{c}"), F.lit(0))).alias(f"avg_{c}")
                for c in carried
            ],
        )
    )
