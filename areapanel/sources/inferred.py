"""Tables whose columns are inferred from text: one aggregation, then a typed table that is loaded by name.

What is known about a column's values is one small record: how many there are, which kinds read all of
them, and the most digits before and after the point. Records form a lattice; ``merged`` combines those of
several loads into what one pass over all their rows finds. Types, from narrow to wide: ``bigint``,
``decimal``, ``double``; ``date``, ``timestamp``; ``boolean``; ``string`` reads everything.

Defined results: nulls decide nothing, and a column without values is text; an empty table gives one
record a column; names are lower case, and two that differ in case alone are refused.
"""

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of values, as bits.
WHOLE, PLAIN, FLOATING, DATE, TIME, TRUTH = (1 << i for i in range(6))

#: Most digits of a bigint that are certain to fit, and of a decimal.
LONG_DIGITS, DECIMAL_DIGITS = 18, 38

#: Forms of dates, each with the pattern that its values match; no value matches two.
DATE_FORMS = {"yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$"}
TIME_FORM = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
PLAIN_FORM = r"^[+-]?(\d+\.?\d*|\.\d+)$"
FLOATING_FORM = r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"
TRUTHS, LIES = ("true", "t", "yes", "y"), ("false", "f", "no", "n")


def _date(cut: Column) -> Column:
    """The date of a text in one of the forms, else null."""
    read = F.lit(None).cast("date")
    for form, pattern in DATE_FORMS.items():
        read = F.when(cut.rlike(pattern), F.try_to_timestamp(cut, F.lit(form)).cast("date")).otherwise(read)
    return read


def _time(cut: Column) -> Column:
    return F.when(cut.rlike(TIME_FORM), cut.try_cast("timestamp")).otherwise(_date(cut).cast("timestamp"))


def _truth(cut: Column) -> Column:
    return F.when(F.lower(cut).isin(*TRUTHS), True).when(F.lower(cut).isin(*LIES), False)


def _digits(cut: Column) -> tuple[Column, Column]:
    """Digits of a plain number before (without leading zeros) and after the point."""
    before = F.ltrim(F.regexp_extract(cut, r"^[+-]?(\d*)", 1), F.lit("0"))
    return F.length(before), F.length(F.regexp_extract(cut, r"\.(\d*)$", 1))


def _known(cut: Column, plain: Column, keep_leading_zeros: bool) -> Column:
    """What one trimmed value says: kinds that read it, digits before and after the point; ``plain`` says whether it
    has the form of a plain number."""
    begins_low = F.substring(cut, 1, 1).isin("0", "+", "-")
    padded = begins_low & cut.rlike(r"^[+-]?0\d[\d.eE+-]*$") if keep_leading_zeros else F.lit(False)
    floating = cut.rlike(FLOATING_FORM) | F.lower(cut).isin("nan", "inf", "-inf", "infinity", "-infinity")
    point = F.instr(cut, ".")
    kinds = (
        F.when(padded, 0)
        .when(plain & (point == 0), WHOLE | PLAIN | FLOATING)
        .when(plain, PLAIN | FLOATING)
        .when(floating, FLOATING)
        .when(_date(cut).isNotNull(), DATE | TIME)
        .when(_time(cut).isNotNull(), TIME)
        .when(_truth(cut).isNotNull(), TRUTH)
        .otherwise(0)
    )
    # A plain number begins with one sign at most, so signs and zeros can go together.
    before = F.when(plain, F.length(F.substring_index(F.ltrim(cut, F.lit("+-0")), ".", 1)))
    after = F.when(plain, F.when(point > 0, F.length(cut) - point).otherwise(0))
    return F.when(cut.isNotNull(), F.struct(kinds.alias("kinds"), before.alias("before"), after.alias("after")))


def _joined(known):
    """The aggregates that join records or single values."""
    return [
        F.bit_and(known("kinds")).alias("kinds"),
        F.coalesce(F.max(known("before")), F.lit(0)).alias("before"),
        F.coalesce(F.max(known("after")), F.lit(0)).alias("after"),
    ]


def infer(df: DataFrame, keep_leading_zeros: bool = True) -> DataFrame:
    """(place, column, n, kinds, before, after): a record per text column of ``df``, by one scan.

    With ``keep_leading_zeros`` a column with values such as ``00601`` is text.
    """
    names = _names(df.columns)
    # One row a value: the expressions of all columns side by side make code that the JVM does not compile.
    pairs = [F.struct(F.lit(i).alias("place"), F.trim(F.col(_quoted(c))).alias("cut")) for i, c in enumerate(df.columns)]
    cuts = df.select(F.inline(F.array(*pairs))).where("cut IS NOT NULL")
    forms = cuts.withColumn("plain", F.col("cut").rlike(PLAIN_FORM))
    values = forms.select("place", _known(F.col("cut"), F.col("plain"), keep_leading_zeros).alias("v"))
    each = values.groupBy("place").agg(F.count("v").alias("n"), *_joined(lambda part: F.col(f"v.{part}")))

    def of(i, part):
        found = F.max(F.when(F.col("place") == i, F.col(part)))
        return (found if part == "kinds" else F.coalesce(found, F.lit(0))).alias(f"v{i}_{part}")

    found = each.agg(*[of(i, part) for i in range(len(names)) for part in ("n", "kinds", "before", "after")])
    records = [
        F.struct(
            F.lit(i).alias("place"), F.lit(name).alias("column"),
            *[F.col(f"v{i}_{part}").alias(part) for part in ("n", "kinds", "before", "after")],
        )
        for i, name in enumerate(names)
    ]
    return found.select(F.inline(F.array(*records)))


def merged(records: DataFrame) -> DataFrame:
    """One record per column from those of several loads; columns that a load lacks are null there."""
    return records.groupBy("column").agg(F.min("place").alias("place"), F.sum("n").alias("n"), *_joined(F.col)).select(
        "place", "column", "n", "kinds", "before", "after"
    )


def types(records: DataFrame) -> DataFrame:
    """(place, column, type): the narrowest type that reads all values of each record.

    Numbers of more digits than a decimal holds are text when whole and ``double`` otherwise.
    """
    has = lambda bit: F.col("kinds").bitwiseAND(bit) != 0
    digits = F.col("before") + F.col("after")
    precise = F.format_string("decimal(%d,%d)", F.greatest(digits, F.lit(1)), "after")
    kind = (
        F.when(F.col("n") == 0, "string")
        .when(has(WHOLE) & (F.col("before") <= LONG_DIGITS), "bigint")
        .when(has(PLAIN) & (digits <= DECIMAL_DIGITS), precise)
        .when(has(FLOATING) & ~has(WHOLE), "double")
        .when(has(DATE), "date")
        .when(has(TIME), "timestamp")
        .when(has(TRUTH), "boolean")
        .otherwise("string")
    )
    return records.select("place", "column", kind.alias("type"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _names(columns) -> list[str]:
    """Lower-case names; those that differ in case alone are refused."""
    names = [c.lower() for c in columns]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"columns that differ in case alone: {', '.join(twice)}")
    return names


def create_table(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    """An empty Parquet table with the given names and types."""
    listed = ", ".join(f"{_quoted(c)} {kind}" for c, kind in columns.items())
    spark.sql(f"CREATE TABLE {name} ({listed}) USING parquet")


def _read(text: Column, kind: str) -> Column:
    """The value of a text, null where the type cannot hold it."""
    cut = F.trim(text)
    if kind == "string":
        return text
    if kind == "date":
        value = _date(cut)
    elif kind == "timestamp":
        value = _time(cut)
    elif kind == "boolean":
        value = _truth(cut)
    else:
        value = cut.try_cast(kind)
        if kind.startswith("decimal"):  # a value that would be rounded does not fit
            value = F.when(_digits(cut)[1] <= int(kind[:-1].split(",")[1]), value)
    return value


def _checked(value: Column, text: Column, kind: str, column: str) -> Column:
    wrong = F.concat(F.lit(f"no {kind} in column {column}: "), text)
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(wrong).cast(kind))


def load_by_name(df: DataFrame, name: str) -> None:
    """Append text rows to a table: names are matched without regard to case, columns that ``df`` lacks
    are null and others of ``df`` are left out. A value that its column's type cannot hold stops the load."""
    spark = df.sparkSession
    given = dict(zip(_names(df.columns), df.columns))
    values, columns = [], []
    for i, field in enumerate(spark.table(name).schema.fields):
        kind, own = field.dataType.simpleString(), given.get(field.name.lower())
        if own is None:
            columns.append(F.lit(None).cast(kind).alias(field.name))
            continue
        text, value = F.col(_quoted(own)), F.col(f"v{i}")
        values += [text.alias(f"t{i}"), _read(text, kind).alias(f"v{i}")]
        columns.append((value if kind == "string" else _checked(value, F.col(f"t{i}"), kind, field.name)).alias(field.name))
    # Values are read in a step of their own, once each, and checked in the next.
    df.select(*values).select(*columns).write.insertInto(name)


def table_from_text(df: DataFrame, name: str, keep_leading_zeros: bool = True) -> None:
    """Create a table with the inferred columns of ``df`` and load its rows."""
    found = types(infer(df, keep_leading_zeros)).orderBy("place").collect()  # a row for each column
    create_table(df.sparkSession, name, {r["column"]: r["type"] for r in found})
    load_by_name(df, name)
