"""Publishing in versions, with one step that makes a version the current one.

A table is a view over ``<name>_versions``, which holds every version in partitions of its own, and shows the
version that the view ``pointer`` names. A run appends its rows under a new version, which nobody sees, and then replaces the
pointer: one catalog operation, which all tables and the views on them follow at once. Folders are
written whole beside their place and moved there after the pointer; ``settle`` ends or undoes what a
killed run has left, by what the pointer says, and the next run begins with it.
"""

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"
NEW, OLD = ".new-", ".old-"


def new_version() -> str:
    """A name that sorts by time and no other run has."""
    return f"v{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S%f}{uuid.uuid4().hex[:8]}"


def current(spark: SparkSession, pointer: str) -> str | None:
    """The published version, None before the first."""
    return spark.sql(f"SELECT {VERSION} FROM {pointer}").first()[0] if spark.catalog.tableExists(pointer) else None


def store_version(df: DataFrame, name: str, version: str, partition_by=()) -> None:
    """Append the rows of one version; no view shows them yet."""
    rows = df.withColumn(VERSION, F.lit(version))
    rows.write.mode("append").format("parquet").partitionBy(VERSION, *partition_by).saveAsTable(f"{name}_versions")


def define(spark: SparkSession, pointer: str, tables: dict[str, list[str]]) -> None:
    """Create or replace the views that show the current version: names with their columns.

    Before the first version the pointer names none, so all of them are empty.
    """
    if not spark.catalog.tableExists(pointer):
        swap(spark, pointer, None)
    for name, columns in tables.items():
        listed = ", ".join(f"`{c}`" for c in columns)
        spark.sql(
            f"CREATE OR REPLACE VIEW {name} AS SELECT {listed} FROM {name}_versions "
            f"WHERE {VERSION} = (SELECT {VERSION} FROM {pointer})"
        )


def swap(spark: SparkSession, pointer: str, version: str | None) -> None:
    """Make ``version`` the current one."""
    value = f"'{version}'" if version else "CAST(NULL AS STRING)"
    spark.sql(f"CREATE OR REPLACE VIEW {pointer} AS SELECT {value} AS {VERSION}")


def drop_versions(spark: SparkSession, names, keep) -> None:
    """Remove all versions of the tables but those in ``keep``."""
    for name in names:
        for row in spark.sql(f"SHOW PARTITIONS {name}_versions").collect():
            parts = dict(p.split("=", 1) for p in row[0].split("/"))
            if parts[VERSION] not in keep:
                spec = ", ".join(f"`{k}` = '{v}'" for k, v in parts.items())
                spark.sql(f"ALTER TABLE {name}_versions DROP IF EXISTS PARTITION ({spec})")


def beside(folder: str, version: str) -> str:
    """Where a version of a folder is written until it is moved to its place."""
    return f"{folder}{NEW}{version}"


def settle(spark: SparkSession, out: str, version: str | None) -> None:
    """Bring the folders below ``out`` to the published version: folders written for it take their places, others
    that are not in place go, and a folder that was moved aside returns if nothing has taken its place."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(out)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    names = lambda mark: sorted(n for n in (f.getPath().getName() for f in files.listStatus(root)) if mark in n)
    for name in names(NEW):
        place, _, written = name.partition(NEW)
        if written != version:
            files.delete(path(root, name), True)
            continue
        if files.exists(path(root, place)):
            move(files, path(root, place), path(root, f"{place}{OLD}{written}"))
        move(files, path(root, name), path(root, place))
    for name in names(OLD):
        place = name.partition(OLD)[0]
        if files.exists(path(root, place)):
            files.delete(path(root, name), True)
        else:
            move(files, path(root, name), path(root, place))


def move(files, source, target) -> None:
    if not files.rename(source, target):
        raise OSError(f"cannot move {source} to {target}")
