"""Yearly population responses: JSON arrays of rows, the first row holding the names."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapanel import settings
from areapanel.functions import values as v
from areapanel.sources.json_rows import read_array_rows


#: A number of four digits from 1900 to 2099 that stands alone.
YEAR_IN_NAME = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def _year(year_pattern, years_by_name) -> Column:
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\+", "%2B"))
    folder = F.regexp_extract("_metadata.file_path", r"(?i)year=(\d{4})/", 1).try_cast("int")
    found = F.array_distinct(F.regexp_extract_all(name, F.lit(year_pattern), F.lit(1)))
    unclear = F.raise_error(F.concat(F.lit("no single year in the file name "), name)).cast("int")
    year = F.coalesce(folder, F.when(F.size(found) == 1, found[0].try_cast("int")).otherwise(unclear))
    if years_by_name:
        given = F.create_map(*[F.lit(x) for pair in years_by_name.items() for x in pair])
        year = F.coalesce(F.element_at(given, name), year)
    return year


def read_responses(spark: SparkSession, path, whole_files=True, year_pattern=YEAR_IN_NAME, years_by_name=None) -> DataFrame:
    """(year, body): landed responses, one per file, or one per line without ``whole_files``.

    The year comes from ``years_by_name`` (file name to year, for the names it holds), else from a
    ``year=2014`` folder, else from the file name: the first group of ``year_pattern``, which must match
    exactly one value. A name with none or several raises.
    """
    year = _year(year_pattern, years_by_name)
    responses = spark.read.option("recursiveFileLookup", True).text(path, wholetext=whole_files)
    return responses.select(year.alias("year"), F.col("value").alias("body"))


def read_response_rows(spark: SparkSession, path, year_pattern=YEAR_IN_NAME, years_by_name=None) -> DataFrame:
    """The rows of landed responses, one document a file, read by many tasks a document: see ``read_array_rows``;
    ``year`` is found as in ``read_responses``."""
    return read_array_rows(spark, path, year=_year(year_pattern, years_by_name))


def _opened(responses: DataFrame, column: str) -> DataFrame:
    """Parsed rows and the positions of the two names needed; null when they are not there."""
    rows = F.from_json("body", "array<array<string>>")

    def position(name) -> Column:
        return F.nullif(F.array_position(F.col("rows")[0], name), F.lit(0)).cast("int")

    return (
        responses.select("year", rows.alias("rows"))
        .withColumn("rows", F.when(F.size("rows") > 0, F.col("rows")))
        .select("year", "rows", position("NAME").alias("at_name"), position(column).alias("at_count"))
    )


def _usable() -> Column:
    return F.col("at_name").isNotNull() & F.col("at_count").isNotNull()


def load_population(
    responses: DataFrame, years=settings.YEARS, column=settings.POPULATION_COLUMN
) -> DataFrame:
    """(ZIP_Code, Year, Population) from (year, body); bad documents and counts are dropped.

    The area id is taken from the name, not from the id column of the response.
    """
    # Unusable documents explode to nothing: a filter here would be pushed down and parse again.
    row = F.explode(F.when(_usable(), F.slice("rows", F.lit(2), F.size("rows"))))
    cells = _opened(responses.where(v.in_years(F.col("year"), years)), column).select(
        "year", "at_name", "at_count", row.alias("row")
    )
    return _counted(cells)


def _counted(cells: DataFrame) -> DataFrame:
    """The loaded columns from (year, at_name, at_count, row)."""
    count = F.try_element_at("row", F.col("at_count"))
    # Java reads a trailing d or f as part of a number; the source format has none.
    people = F.when(~count.rlike(r"[dDfF]\s*$"), v.number(count))
    return cells.select(
        v.strip_text(
            F.try_element_at("row", F.col("at_name")), settings.POPULATION_NAME_PREFIX
        ).alias("ZIP_Code"),
        F.col("year").alias("Year"),
        people.alias("Population"),
    ).where("Population > 0")


def _documents(rows: DataFrame, column: str) -> DataFrame:
    """(file, year, first, at_name, at_count, usable): every document's first row and where the names stand in it."""
    place = ["block", "chunk", "part"]
    found = rows.groupBy("file", "year").agg(
        F.min(F.struct(*place, "cells")).alias("first"), F.bool_or("broken").alias("broken")
    )
    found = found.withColumns({
        "at_name": F.array_position("first.cells", F.lit("NAME")).cast("int"),
        "at_count": F.array_position("first.cells", F.lit(column)).cast("int"),
    })
    return found.withColumn("usable", F.coalesce(~F.col("broken") & (F.least("at_name", "at_count") > 0), F.lit(False)))


def load_population_rows(rows: DataFrame, years=settings.YEARS, column=settings.POPULATION_COLUMN) -> DataFrame:
    """``load_population`` for the rows of ``read_response_rows``."""
    rows = rows.where(v.in_years(F.col("year"), years))
    documents = _documents(rows, column).where("usable").select("file", "first", "at_name", "at_count")
    place = F.struct("block", "chunk", "part")
    later = rows.join(documents, "file").where(place > F.struct("first.block", "first.chunk", "first.part"))
    cells = later.select("year", "at_name", "at_count", F.col("cells").alias("row"))
    return _counted(cells.where("row IS NOT NULL"))


def response_row_report(rows: DataFrame, column=settings.POPULATION_COLUMN) -> DataFrame:
    """``response_report`` for the rows of ``read_response_rows``; documents without a character do not count."""
    return _documents(rows, column).groupBy("year").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("usable").alias("usable_documents")
    )


def response_report(responses: DataFrame, column=settings.POPULATION_COLUMN) -> DataFrame:
    """(year, documents, usable_documents): what a load will skip."""
    return (
        _opened(responses, column)
        .groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(_usable()).alias("usable_documents"),
        )
    )
