"""Wide to long, and long-format unions."""

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def month_of_label(label: str) -> dt.date | None:
    """The month a column name stands for (``yyyy-MM-dd`` or ``MM/dd/yyyy``), else None."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", label):
        form = "%Y-%m-%d"
    elif re.fullmatch(r"\d{2}/\d{2}/\d{4}", label):
        form = "%m/%d/%Y"
    else:
        return None
    try:
        return dt.datetime.strptime(label, form).date().replace(day=1)
    except ValueError:
        return None


def month_columns(columns, years=None) -> dict[str, dt.date]:
    """Column names that stand for a month, with that month; with ``years`` only inside the window.

    Raises when the table has no month column at all.
    """
    found = {c: month_of_label(c) for c in columns}
    found = {c: m for c, m in found.items() if m}
    if not found:
        raise ValueError("no month columns found; check the header of the value source")
    return {c: m for c, m in found.items() if years is None or years[0] <= m.year <= years[1]}


def melt_months(df: DataFrame, ids, months: dict, name: str, value: str) -> DataFrame:
    """One row per (row, month column); nulls are kept.

    The month comes from the column name once, as a date literal, so no row parses a date.
    """
    if not months:
        none = F.lit(None)
        return df.select(*ids, none.cast("date").alias(name), none.cast("string").alias(value)).where("false")
    pairs = [p for label, month in months.items() for p in (F.lit(month), F.col(f"`{label}`"))]
    return df.select(*ids, F.stack(F.lit(len(months)), *pairs).alias(name, value))


def measures_to_rows(df: DataFrame, ids, labels: dict, name: str, value: str) -> DataFrame:
    """Measure columns to (label, value) rows in one pass; ``labels`` maps column to label."""
    renamed = df.select(*ids, *[F.col(c).alias(label) for c, label in labels.items()])
    return renamed.unpivot(list(ids), list(labels.values()), name, value)


def append_all(frames) -> DataFrame:
    """Rows of all frames, columns matched by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
