"""CSV files: plain string scans, loads by column name, file skipping, type probing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel import settings
from areapanel.functions import values as v
from areapanel.session import staged
from areapanel.sources.csv_records import opens_quote, quoted_records

CORRUPT = "_corrupt_record"
PROBED_TYPES = ("bigint", "double", "date", "timestamp", "boolean")


def strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv_strings(spark: SparkSession, path, columns=None) -> DataFrame:
    """Header CSV, every column a string; without ``columns`` the names come from the header.

    Spark binds columns by position. Files whose header differs raise instead of mixing columns;
    ``read_csv_by_name`` loads those.
    """
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", False)
    )
    return (reader.schema(strings(columns)) if columns else reader).csv(path)


def _records(spark: SparkSession, path, glob, multi_line=False) -> DataFrame:
    """(file, line, record, torn): every record of every file; ``line`` orders the records of one file and
    ``torn`` marks records with a quote that is not closed.

    With ``multi_line`` line breaks inside quotes are part of their record, else every line is a record.
    Files are named as the scan names them; no name passes through the driver.
    """
    if multi_line:
        return quoted_records(spark, path, glob)
    scan = spark.read.option("pathGlobFilter", glob).text(path)
    return scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("line"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("record"),
        opens_quote(F.col("value")).alias("torn"),
    )


def _no_mark(record):
    """A line without the byte order mark a file may begin with."""
    return F.regexp_replace(record, r"^\x{FEFF}", "")


def _is_data(multi_line):
    """Lines that are no header, blank line or torn line.

    Records with line breaks are written once, so a header is found by its number. Plain lines are scanned
    anew, perhaps in other splits, so there every line that equals its file's header counts as one.
    """
    header = F.col("line") == F.col("first_line") if multi_line else _no_mark(F.col("record")) == F.col("header")
    return ~header & (F.trim("record") != "")


def _first_lines(records: DataFrame) -> DataFrame:
    """One row a file. Least structs alone would make Spark sort all lines by file; beside a collected list, which
    is empty, every task keeps one line a file in a hash table."""
    none = F.collect_list(F.when(F.col("line").isNull(), F.col("line")))
    first = records.groupBy("file").agg(F.min(F.struct("line", "record", "torn")).alias("first"), none.alias("none"))
    return first.where(F.size("none") == 0).select(
        "file",
        F.col("first.line").alias("first_line"),
        _no_mark(F.col("first.record")).alias("header"),
        F.col("first.torn").alias("torn_header"),
    )


def file_headers(spark: SparkSession, path, glob="*.csv", multi_line=False) -> DataFrame:
    """(file, header): the first line of every file, found in one distributed scan."""
    return _first_lines(_records(spark, path, glob, multi_line)).select("file", "header")


def _fields(text):
    """The fields of one CSV line: quotes may hold commas, and two quotes are one."""
    return F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1)),
        lambda x: F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"')),
    )


def header_columns(headers: DataFrame) -> DataFrame:
    """(file, column) rows of header lines; a comma inside quotes does not end a name."""
    return headers.select("file", F.explode(_fields(F.col("header"))).alias("column")).withColumn("column", F.trim("column"))


def normalise_nulls(df: DataFrame, columns=None, tokens=settings.NULL_TOKENS) -> DataFrame:
    """Trim text columns and turn every null spelling into null."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: v.null_tokens(F.col(f"`{c}`"), tokens) for c in columns})


def read_csv_by_name(
    spark: SparkSession,
    path,
    schema: T.StructType | None = None,
    *,
    glob="*.csv",
    skip_bad_files=True,
    tokens=settings.NULL_TOKENS,
    multi_line=False,
) -> DataFrame:
    """Load CSV files whose headers may differ in order and letter case.

    Names are matched without regard to case, missing columns are null. The text is read twice: once
    for the first lines, once for all records, which then meet their file's header; without ``multi_line``
    every line that equals its file's header is one. Only the distinct headers come to the driver. With a ``schema`` values are cast to it and other columns
    ignored. A file with a row of the wrong width or a value that cannot be cast is left out as a
    whole when ``skip_bad_files`` is set, else it raises.

    Fields with line breaks need ``multi_line``; such files are read by many tasks as well. A quote that
    stays open (to the end of the file, or without ``multi_line`` to the end of its line) makes its file a
    bad one, because no part of it can be trusted. Quotes inside unquoted fields are plain characters.
    """
    records = _records(spark, path, glob, multi_line)
    first = staged(_first_lines(records), "headers")
    headers = sorted(r[0] for r in first.where("NOT torn_header").select("header").distinct().collect())
    if not headers and first.isEmpty():
        raise FileNotFoundError(f"no file matches {glob} below {path}")
    names = _header_names(spark, headers)
    wanted = schema or strings(list(dict.fromkeys(n for h in headers for n in names[h])))
    read = F.lit(None).cast(_row_type(wanted))
    for header in headers:
        read = F.when(F.col("header") == header, _read_record(F.col("record"), names[header], wanted, tokens)).otherwise(read)
    if not multi_line:
        records = _records(spark, path, glob, multi_line)
    records = records.join(first, "file")
    # The only line of a file with a torn header stays, so that the file counts as a bad one.
    records = records.where(_is_data(multi_line) | F.col("torn") | F.col("torn_header"))
    torn = F.col("torn") | F.col("torn_header")
    read = F.when(~torn, read)
    rows = records.select("file", read.alias("r")).select("file", "r.*")
    rows = staged(rows.withColumn(BROKEN, F.coalesce(BROKEN, F.lit(True))), "rows")
    columns = [F.col(f"`{f.name}`") for f in wanted.fields]
    if not skip_bad_files:
        fail = F.raise_error(F.concat(F.lit("bad row in "), F.col("file"))).cast("boolean")
        return rows.where(F.when(F.col(BROKEN), fail).otherwise(True)).select(*columns)
    # Written first, so that Spark knows how few they are and leaves the rows where they lie.
    bad = staged(rows.where(BROKEN).select("file").distinct(), "bad_files")
    return rows.join(bad, "file", "left_anti").select(*columns)


def _header_names(spark, headers) -> dict:
    """Lower-case names of every distinct header line."""
    table = spark.createDataFrame([(h,) for h in headers], "header string")
    found = table.select("header", _fields(F.col("header")).alias("names")).collect()
    return {r["header"]: [n.strip().lower() for n in r["names"]] for r in found}


BROKEN = "_broken"


def _row_type(wanted):
    return T.StructType([*wanted.fields, T.StructField(BROKEN, T.BooleanType())])


def _read_record(record, names, wanted, tokens):
    """One record under one header as the wanted columns and whether it is broken."""
    plain = [f"c{i}" for i in range(len(names))]  # names may repeat or hold any character
    kinds = ", ".join([*[f"{c} string" for c in plain], f"{CORRUPT} string"])
    options = {
        "sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": "-1",
    }

    def row(parsed):
        broken, casts = parsed[CORRUPT].isNotNull(), []
        for field in wanted.fields:
            if field.name.lower() not in names:
                casts.append(F.lit(None).cast(field.dataType).alias(field.name))
                continue
            text = parsed[plain[names.index(field.name.lower())]]
            text = v.null_tokens(text, tokens)
            cast = text.try_cast(field.dataType)
            broken = broken | (text.isNotNull() & cast.isNull())
            casts.append(cast.alias(field.name))
        return F.struct(*casts, broken.alias(BROKEN))

    return F.get(F.transform(F.array(F.from_csv(record, F.lit(kinds), options)), row), F.lit(0)).cast(_row_type(wanted))


def bad_files(spark: SparkSession, path, columns, *, glob="*.csv", multi_line=False) -> DataFrame:
    """Files with at least one row whose width differs from ``columns`` or that holds an open quote, and their bad rows."""
    records = _records(spark, path, glob, multi_line)
    records = records.join(_first_lines(records).select("file", "first_line", "header"), "file")
    wanted = strings(columns)
    read = _read_record(F.col("record"), [c.lower() for c in columns], wanted, ())
    rows = records.where(_is_data(multi_line) | F.col("torn"))
    rows = rows.select("file", "torn", read.alias("r")).where(f"torn OR r.{BROKEN}")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("bad_rows"))


def _readable_as(text, keep_leading_zeros):
    """Bit set of the probed types that read one value (bit i stands for PROBED_TYPES[i])."""
    cut = F.trim(text)
    whole = r"^[+-]?\d+$"
    decimal = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    padded = cut.rlike(r"^[+-]?0\d") if keep_leading_zeros else F.lit(False)
    time = F.when(cut.try_cast("timestamp").isNotNull(), 8).otherwise(0)
    return (
        F.when(cut.rlike(decimal), F.when(padded, 0).when(
            cut.rlike(whole) & cut.try_cast("bigint").isNotNull(), 1 + 2
        ).otherwise(2))
        .when(F.lower(cut).isin("nan", "inf", "infinity"), 2)
        .when(cut.rlike(r"^\d{4}-\d{2}-\d{2}"), F.when(
            (F.length(cut) == 10) & cut.try_cast("date").isNotNull(), 4 + 8
        ).otherwise(time))
        .when(F.lower(cut).isin("true", "false", "t", "f", "yes", "no", "y", "n"), 16)
        .otherwise(0)
    )


def probe_types(df: DataFrame, keep_leading_zeros=True) -> DataFrame:
    """(column, type): the first of the probed types that reads every non-null value.

    One aggregation over the table; null values decide nothing, a column without values is text.
    A column with values such as ``00601`` stays text.
    """
    masks = [
        F.bit_and(F.when(F.col(f"`{c}`").isNotNull(), _readable_as(F.col(f"`{c}`"), keep_leading_zeros)))
        for c in df.columns
    ]
    row = df.agg(*[mask.alias(f"m{i}") for i, mask in enumerate(masks)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mask")) for i, c in enumerate(df.columns)]
    kind = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(PROBED_TYPES))):
        kind = F.when(F.col("mask").bitwiseAND(1 << i) != 0, name).otherwise(kind)
    return row.select(F.inline(F.array(*pairs))).select(
        "column", F.coalesce(kind, F.lit("string")).alias("type")
    )


def with_probed_types(df: DataFrame) -> DataFrame:
    """Cast text columns to their probed types; names become lower case."""
    kinds = {r["column"]: r["type"] for r in probe_types(df).collect()}
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c.lower()) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode="overwrite") -> None:
    """Header CSV directory, one part per task."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
