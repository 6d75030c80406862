"""Records of CSV files whose quoted fields may hold line breaks, put together by many tasks a file.

Whether a line begins inside quotes depends on all lines before it. A line is therefore described by its
effect: the state after it for either state before it. Effects compose, so chunks of lines are folded apart
from each other, a running composition over the chunks of a file says how each of them begins, and the same
over the lines of a chunk says how each line begins. A quote inside an unquoted field is a plain character.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areapanel.session import staged

#: Lines that are folded together.
CHUNK = 4096
#: Characters of the longest record; two lone quotes far apart must not make one value of a whole file.
LONGEST = 1 << 26

_BLANK = r"[\x00-\x20]*+"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:{_BLANK}{_QUOTED}"[^,]*+|(?!{_BLANK}")[^,]*+)'
_OPEN_AT_END = rf"(?:{_FIELD},)*+{_BLANK}{_QUOTED}\z"
_STAYS_OPEN = rf'^[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,{_OPEN_AT_END})'

CLOSES, TURNS, SAME, OPENS = 0, 1, 2, 3


def opens_quote(text: Column) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    return F.contains(text, F.lit('"')) & text.rlike(r"^\x{FEFF}?" + _OPEN_AT_END)


def line_effect(text: Column) -> Column:
    """Bit 0 is the state after the line if it begins outside quotes, bit 1 if it begins inside (1: inside)."""
    inside = F.when(text.rlike(_STAYS_OPEN), 2).otherwise(0)
    return F.when(~F.contains(text, F.lit('"')), SAME).otherwise(opens_quote(text).cast("int") + inside)


def quoted_records(spark: SparkSession, path, glob, chunk=CHUNK, longest=LONGEST) -> DataFrame:
    """(file, line, record, torn): every record of every file, line breaks in quotes kept as they are.

    ``line`` orders the records of a file. The last carriage returns of a record are cut. ``torn`` marks what
    cannot be trusted: all lines, one by one, of a file that ends inside quotes, and (without its text) a
    record of more than ``longest`` characters. Files are split as Spark splits text, compressed ones are one
    task. Lines are numbered once and written, so all later steps see the same numbers; the text is shuffled
    once, in groups of ``chunk`` lines, under a number for its file instead of the path. One row a chunk goes
    through the window over a file.
    """
    scan = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    numbered = scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    lines = staged(numbered.withColumn("effect", line_effect(F.col("value"))), "lines")
    files = lines.select(F.col("file").alias("path")).distinct().withColumn("file", F.monotonically_increasing_id())
    files = staged(files, "files")
    lines = lines.withColumnRenamed("file", "path").join(files, "path").drop("path")
    lines = lines.withColumn("chunk", F.floor(F.col("id") / chunk))
    begins = staged(_begins(_chunks(lines)), "begins")
    pieces = staged(_pieces(lines, begins), "pieces")
    line = F.struct("at_block", "at_id").alias("line")
    whole = pieces.where("whole").select("file", line, "record", "torn")
    records = whole.unionByName(_joined(pieces.where("NOT whole"), longest).select("file", line, "record", "torn"))
    return records.join(files, "file").select(F.col("path").alias("file"), "line", "record", "torn")


def _effects():
    """What a line sets the state to, null where it does not, and how often it turns it."""
    effect = F.col("effect")
    return F.when(effect == CLOSES, 0).when(effect == OPENS, 1), F.when(effect == TURNS, 1).otherwise(0)


def _chunks(lines) -> DataFrame:
    """(file, block, chunk, s0, o0, s1, o1): for both states before a chunk the state after it and the line
    that last went from outside to inside. Texts stay where they are, and no lines are collected."""
    order, found = Window.partitionBy("file", "block", "chunk").orderBy("id"), []
    lines = lines.select("file", "block", "chunk", "id", "effect")
    for s in (0, 1):
        lines = _composed(lines, *_effects(), F.lit(s), order).withColumnRenamed("after", f"after{s}")
        before, after = F.coalesce(F.lag(f"after{s}").over(order), F.lit(s)), F.col(f"after{s}")
        lines = lines.withColumn(f"opens{s}", F.when((before == 0) & (after == 1), F.col("id")))
        found += [F.max_by(after, "id").alias(f"s{s}"), F.max(f"opens{s}").alias(f"o{s}")]
    return lines.groupBy("file", "block", "chunk").agg(*found)


def _composed(df, fixed, turns, before, order) -> DataFrame:
    """Column ``after``: the state after every row, where a row sets the state to ``fixed`` or, where that is
    null, turns it ``turns`` (0 or 1) times; ``before`` is the state before the first row."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_turned", F.sum(turns).over(so_far))
    df = df.withColumn("_set", F.last((fixed + F.col("_turned")) % 2, ignorenulls=True).over(so_far))
    return df.withColumn("after", (F.coalesce("_set", before) + F.col("_turned")) % 2).drop("_turned", "_set")


def _begins(chunks) -> DataFrame:
    """(file, block, chunk, entry, from_block, from_id, torn): the state before every chunk, the line that opened the
    record it begins in, and whether the file ends inside quotes."""
    order = Window.partitionBy("file").orderBy("block", "chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("s0") == F.col("s1"), F.col("s0"))
    turns = F.when(F.col("s0") > F.col("s1"), 1).otherwise(0)
    found = _composed(chunks, fixed, turns, F.lit(0), order)
    found = found.withColumn("entry", F.coalesce(F.lag("after").over(order), F.lit(0)))
    found = found.withColumn("opener", F.when(F.col("entry") == 0, F.col("o0")).otherwise(F.col("o1")))
    opened = F.when(F.col("opener").isNotNull(), F.struct("block", "opener"))
    ends = found.groupBy("file").agg((F.max_by("after", F.struct("block", "chunk")) == 1).alias("torn"))
    begins = found.withColumn("opened", F.last(opened, ignorenulls=True).over(earlier)).select(
        "file", "block", "chunk", "entry", F.col("opened.block").alias("from_block"), F.col("opened.opener").alias("from_id")
    )
    return begins.join(ends, "file")


def _pieces(lines, begins) -> DataFrame:
    """(file, block, chunk, at_block, at_id, record, whole, torn): the records, or parts of records, of every chunk;
    ``at_`` names the line that a record begins with."""
    order = Window.partitionBy("file", "block", "chunk").orderBy("id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = _composed(lines.join(begins, ["file", "block", "chunk"]), *_effects(), F.col("entry"), order)
    before = F.coalesce(F.lag("after").over(order), "entry")
    state = state.withColumn("starts", F.col("torn") | (before == 0))
    state = state.withColumn("start", F.last(F.when(F.col("starts"), F.col("id")), ignorenulls=True).over(so_far))
    here = F.col("start").isNotNull()
    state = state.withColumn("at_block", F.when(here, F.col("block")).otherwise(F.col("from_block")))
    state = state.withColumn("at_id", F.when(here, F.col("start")).otherwise(F.col("from_id")))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"])
    # Groups within a chunk: the rows already lie together, so nothing moves again.
    pieces = state.groupBy("file", "block", "chunk", "at_block", "at_id", "torn").agg(
        F.array_join(texts, "\n").alias("record"),
        (F.bool_or("starts") & (F.col("torn") | (F.max_by("after", "id") == 0))).alias("whole"),
    )
    return pieces.withColumn("record", F.when(F.col("whole"), F.rtrim("record", F.lit("\r"))).otherwise(F.col("record")))


def _joined(parts, longest) -> DataFrame:
    """Records that reach over chunks, from their parts; measured before any is put together."""
    key = ["file", "at_block", "at_id"]
    sizes = parts.groupBy(*key).agg((F.sum(F.length("record") + 1) - 1).alias("size"))
    pairs = F.sort_array(F.collect_list(F.struct("block", "chunk", "record")))
    text = F.array_join(F.transform(pairs, lambda x: x["record"]), "\n")
    fit = parts.join(sizes.where(F.col("size") <= longest).drop("size"), key)
    short = fit.groupBy(*key).agg(F.rtrim(text, F.lit("\r")).alias("record")).withColumn("torn", F.lit(False))
    return short.unionByName(
        sizes.where(F.col("size") > longest).select(*key, F.lit("").alias("record"), F.lit(True).alias("torn"))
    )
