"""Rows of JSON documents that are arrays of arrays, cut out by many tasks a document.

The text is read in pieces that end at a closing bracket. Whether that bracket counts, and how deep it lies,
depends on all pieces before: quotes and depth are summed within chunks of pieces for both states a chunk may
begin in, then over the chunks of a document, then again within the chunks. A row ends where the depth
returns to one.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areapanel.session import staged

#: Pieces that are summed together.
CHUNK = 4096
#: Characters of the longest row.
LONGEST = 1 << 26

#: Names of files whose size says nothing about their text.
COMPRESSED = r"(?i)\.(gz|gzip|bz2|zst|lz4|snappy|deflate)$"

_PLACE = ["file", "block", "chunk"]


def _brackets(text):
    """Opening brackets of a text without escapes that begins outside quotes."""
    return F.regexp_count(F.regexp_replace(text, r'"[^"]*+("|\z)', ""), F.lit(r"\["))


def read_array_rows(spark: SparkSession, path, chunk=CHUNK, longest=LONGEST, **columns) -> DataFrame:
    """(file, block, chunk, part, cells, broken, *columns): the inner arrays of every document as text cells.

    A row's place is (block, chunk, part). A document is broken as a whole where any of its rows is: where it is no
    array of arrays, has no row, ends early, holds more after its end, or has a row of more than ``longest`` characters.
    Every document that holds anything has at least one row; the one for its end has no cells. ``columns`` are
    computed in the scan, from its metadata. Documents are split as Spark splits text; a compressed one is read by one
    task, and passes if nothing but its last bracket is missing. Pieces are numbered once and written; one row a chunk, and the rows that reach over a
    chunk's end, go through a window over the document.
    """
    scan = spark.read.option("recursiveFileLookup", True).option("lineSep", "]").text(path)
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("id"),
        "value",
        F.regexp_count(plain, F.lit('"')).alias("quotes"),
        _brackets(plain).alias("up0"),
        _brackets(F.regexp_replace(plain, r'^[^"]*+("|\z)', "")).alias("up1"),
        *[c.alias(name) for name, c in columns.items()],
    )
    pieces = staged(pieces.withColumn("chunk", F.floor(F.col("id") / chunk)), "pieces")
    order = Window.partitionBy(*_PLACE).orderBy("id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    parts = _parts(pieces, _begins(pieces), order, earlier, list(columns))
    parts = staged(parts, "parts")
    crosses = (F.col("part") == 0) | ~F.col("ended")
    whole = parts.where(~crosses & ~F.col("torn")).withColumn("size", F.length("text"))
    rows = whole.unionByName(_joined(parts.where(crosses & ~F.col("torn")), longest, list(columns)))
    # Only the first row of a document begins with a second bracket; what is left behind the last one closes it.
    first = (F.col("part") == 0) & (F.col("number") == 0)
    body = F.when(first, F.regexp_extract("text", r"(?s)^\s*\[\s*(\[.*)$", 1)).otherwise(
        F.regexp_extract("text", r"(?s)^\s*,\s*(\[.*)$", 1)
    )
    cells = F.when(F.col("ended"), F.from_json(F.nullif(body, F.lit("")), "array<string>"))
    end = F.when(F.col("unclosed"), r"^\s*\]\s*\]$").otherwise(r"^\s*\]$")
    good = F.when(F.col("ended"), cells.isNotNull()).otherwise(F.regexp_like("text", end))
    found = rows.select(*_PLACE, "part", cells.alias("cells"), (~good | (F.col("size") > longest)).alias("broken"), *columns)
    torn = parts.where("torn").groupBy("file", *columns).agg(
        F.min("block").alias("block"), F.min("chunk").alias("chunk"), F.lit(0).cast("bigint").alias("part")
    )
    none = F.lit(None).cast("array<string>")
    return found.unionByName(torn.withColumns({"cells": none, "broken": F.lit(True)}))


def _change(state):
    """Depth gained by a piece that begins in the given quote state (0 or 1), its closing bracket included."""
    closes = F.when((state + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    return F.when(state == 0, F.col("up0")).otherwise(F.col("up1")) - closes


def _begins(pieces) -> DataFrame:
    """(file, block, chunk, quoted, depth, torn, unclosed): state before every chunk; whether the document cannot be
    whole, and whether its last piece has no closing bracket."""
    states = [_change((F.col("before") + s) % 2) for s in (0, 1)]
    chunks = pieces.groupBy(*_PLACE).agg(
        F.sum("quotes").alias("quotes"),
        F.sum(states[0]).alias("d0"),
        F.sum(states[1]).alias("d1"),
        F.sum(F.octet_length("value")).alias("bytes"),
        F.count(F.lit(1)).alias("n"),
        F.max("file_size").alias("file_size"),
    )
    order = Window.partitionBy("file").orderBy("block", "chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    found = chunks.withColumn("quoted", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    found = found.withColumn("gain", F.when(F.col("quoted") == 0, F.col("d0")).otherwise(F.col("d1")))
    found = found.withColumn("depth", F.coalesce(F.sum("gain").over(earlier), F.lit(0)))
    # Bytes that are in no piece are closing brackets, and three of a byte order mark that the scan skips.
    brackets = (F.max("file_size") - F.sum("bytes") - F.sum("n")).alias("over")
    ends = found.groupBy("file").agg(F.sum("quotes").alias("quotes"), F.sum("gain").alias("deep"), brackets)
    packed = F.col("file").rlike(COMPRESSED)
    unclosed = F.when(packed, F.col("deep") == -1).otherwise(F.col("over").isin(-1, 2))
    known = packed | F.col("over").isin(-1, 0, 2, 3)
    torn = (F.col("quotes") % 2 == 1) | (F.col("deep") + unclosed.cast("int") != 0) | ~known
    return found.select(*_PLACE, "quoted", "depth").join(ends.select("file", torn.alias("torn"), unclosed.alias("unclosed")), "file")


def _parts(pieces, begins, order, earlier, columns) -> DataFrame:
    """Rows, and the parts of rows at a chunk's begin and end, with their number ``part`` in the chunk."""
    state = (F.col("before") + F.col("quoted")) % 2
    pieces = pieces.join(begins, _PLACE).withColumn("change", _change(state))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closes = (state + F.col("quotes")) % 2 == 0
    pieces = pieces.withColumn("ends", (closes & (F.col("depth") + F.sum("change").over(so_far) == 1)).cast("int"))
    pieces = pieces.withColumn("part", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    texts = F.transform(F.sort_array(F.collect_list(F.when(~F.col("torn"), F.struct("id", "value")))), lambda x: x["value"])
    return pieces.groupBy(*_PLACE, "part", "torn", "unclosed", *columns).agg(
        F.concat(F.array_join(texts, "]"), F.lit("]")).alias("text"), (F.max("ends") == 1).alias("ended")
    ).withColumn("number", F.lit(1).cast("bigint"))


def _joined(parts, longest, columns) -> DataFrame:
    """Rows put together from parts; ``number`` counts them in a document. Too long ones keep their size alone."""
    order = Window.partitionBy("file").orderBy("block", "chunk", "part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("number", F.coalesce(F.sum(F.col("ended").cast("bigint")).over(earlier), F.lit(0)))
    key = ["file", "number"]
    parts = parts.withColumn("so_far", F.sum(F.length("text")).over(
        Window.partitionBy(*key).orderBy("block", "chunk", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ))
    kept = F.when(F.col("so_far") <= longest, F.struct("block", "chunk", "part", "text"))
    texts = F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["text"])
    first = F.min(F.struct("block", "chunk", "part")).alias("first")
    rows = parts.groupBy(*key, "torn", "unclosed", *columns).agg(
        F.array_join(texts, "").alias("text"), F.bool_or("ended").alias("ended"), F.max("so_far").alias("size"), first
    )
    return rows.select("*", "first.*").drop("first")
