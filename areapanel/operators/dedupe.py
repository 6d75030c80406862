"""One row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_by_key(df: DataFrame, keys, order_by) -> DataFrame:
    """Keep the smallest row of every key in the order of ``order_by``, then of the other columns.

    A minimum is combined before the shuffle, so a key that holds a large share of all rows
    (null ids, for example) reaches its task as one row per input partition. Null keys form one
    group. The choice depends on values only, not on the order in which tasks finish.
    """
    first = list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in first]
    kept = F.min(F.struct(*[F.col(f"`{c}`") for c in first + rest])).alias("kept")
    return (
        df.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(kept)
        .select(*[F.col(f"`{c}`") if c in keys else F.col(f"kept.`{c}`") for c in df.columns])
    )
