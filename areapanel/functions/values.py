"""Scalar column expressions: parsing, calendar, ratios and changes.

The session runs with ANSI errors on, so text is read with the ``try_`` forms and every
division that may meet a zero goes through ``nullif``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_FORMAT_12H = "MM/dd/yyyy hh:mm:ss a"
EVENT_FORMAT_24H = "MM/dd/yyyy HH:mm:ss"


def number(text: Column) -> Column:
    """Text to double; unreadable text and NaN become null."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def event_time(text: Column) -> Column:
    """Strict 12-hour form, else strict 24-hour form, else null.

    Only the 12-hour form can end in M, so one parse per row is enough.
    """
    return F.when(
        F.lower(text).endswith("m"), F.try_to_timestamp(text, F.lit(EVENT_FORMAT_12H))
    ).otherwise(F.try_to_timestamp(text, F.lit(EVENT_FORMAT_24H)))


def month_start(time: Column) -> Column:
    return F.trunc(time, "month")


def in_years(year: Column, years) -> Column:
    return year.between(*years)


def two_way_category(kind: Column, listed, categories) -> Column:
    """First category for listed values, the second for every other value."""
    return F.when(kind.isin(*listed), categories[0]).otherwise(categories[1])


def peak_flag(month: Column, peak) -> Column:
    return F.when(month.between(*peak), True).otherwise(False)


def density(count: Column, population: Column, per=1000, digits=4) -> Column:
    """Rounded count per ``per`` people; null when the population is missing or not positive."""
    return F.when(population > 0, F.round(count / population * per, digits))


def rate(count: Column, population: Column, per=1000) -> Column:
    """Count per ``per`` people of one row, null for an empty population."""
    return count / F.nullif(population, F.lit(0)) * per


def ratio_per(total: Column, population: Column, per=1000.0) -> Column:
    """Ratio of two totals, the lower one counted in units of ``per``."""
    return total / F.nullif(population / F.lit(per), F.lit(0))


def relative_change(now: Column, before: Column) -> Column:
    """Change as a fraction of the size of the earlier value."""
    return (now - before) / F.nullif(F.abs(before), F.lit(0))


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent of the earlier value, sign kept."""
    return (now - before) / F.nullif(before, F.lit(0)) * 100


def area_text(area: Column) -> Column:
    """Area ids are text everywhere, so leading zeros stay."""
    return area.cast("string")


def strip_text(text: Column, literal: str) -> Column:
    return F.replace(text, F.lit(literal), F.lit(""))


def null_tokens(text: Column, tokens) -> Column:
    """Trimmed text with the null spellings turned to null."""
    cut = F.trim(text)
    return F.when(~cut.isin(*tokens), cut)
