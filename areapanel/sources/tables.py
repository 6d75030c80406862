"""Tables, views and catalog listings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, name: str, partition_by=()) -> None:
    """Create or replace a managed Parquet table."""
    df.write.mode("overwrite").format("parquet").partitionBy(*partition_by).saveAsTable(name)


def register_views(frames: dict[str, DataFrame]) -> None:
    """Create or replace one temporary view per frame."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def peek(df: DataFrame, rows=20) -> DataFrame:
    return df.limit(rows)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """(column, type) rows of a table."""
    return spark.sql(f"DESCRIBE TABLE {name}").select(
        F.col("col_name").alias("column"), F.col("data_type").alias("type")
    )


def list_files(df: DataFrame) -> DataFrame:
    """Files a scan reads."""
    return df.select(F.col("_metadata.file_path").alias("file")).distinct()
