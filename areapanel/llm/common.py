"""Small helpers shared by the operators."""

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged


def crc_rest(column, modulus):
    """Remainder of the CRC-32 of an id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def importable(df: DataFrame) -> DataFrame:
    """``df``, with workers that can import this library, also where it runs from a source folder."""
    places = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = [p for p in places.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        places["PYTHONPATH"] = ":".join([*known, root])
    return df


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with workers that can import this library."""
    return importable(df).mapInArrow(function, schema)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Bits of a bitmap of ids, at most.
MOST_SLOTS = 1 << 28


def split_by_ids(df: DataFrame, ids: DataFrame, column="doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose id may be among ``ids``, and those whose id certainly is not.

    A bitmap over a hash of the id, 16 bits an id and ``MOST_SLOTS`` at most, is all that passes the driver, so
    only the first rows, few of them by chance, need a join.
    """
    n = ids.count()
    slots = min(1 << max(15, (16 * n).bit_length()), MOST_SLOTS)
    slot = F.pmod(F.xxhash64(column), F.lit(slots).cast("bigint")) + 1
    bucket, at = F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot)
    bits = staged(ids.groupBy(bucket).agg(F.bitmap_construct_agg(at).alias("_bits")), "id_bits")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    perhaps = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = df.select("*", bucket).join(F.broadcast(bits), "_bucket", "left")
    return marked.where(perhaps).select(*df.columns), marked.where(~perhaps).select(*df.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Alternating stars: every round is joins and minima over rows, written to the shared folder, so
    no component is ever gathered in one task. The number of rounds grows with the logarithm of a
    component's size. Rows with a null end are ignored; an empty table gives an empty table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = staged(small, "edges")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def usual_label(labels: DataFrame, column: str) -> DataFrame:
    """One label per id: (doc_id, y, held_out); null labels are left out, of several the largest counts."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    return known.withColumn("held_out", crc_rest("doc_id", 4) == 2)


def class_sample(labels: DataFrame, sizes: dict, seed: int) -> DataFrame:
    """(doc_id, y) of the training rows whose hashed ids are smallest, at most ``sizes[y]`` per class."""
    parts = []
    for y, n in sizes.items():
        own = labels.where((F.col("y") == y) & ~F.col("held_out"))
        parts.append(own.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n).select("doc_id", "y"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def label_share(labels: DataFrame) -> float:
    """The share of label 1 among the training rows, 0 without any."""
    row = labels.where(~F.col("held_out")).agg(F.avg((F.col("y") == 1).cast("double"))).first()
    return float(row[0] or 0.0)


def rows_where(docs: DataFrame, test) -> DataFrame:
    """The rows of ``docs`` for which ``test`` holds, a function of the Arrow column of texts."""
    import pyarrow as pa

    place = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.asarray(test(batch.column(place)), bool)))

    return mapped(docs, keep, docs.schema)


def common_words(words: DataFrame, limit: int) -> int:
    """The least count from which on there are at most ``limit`` words."""
    octave = F.floor(F.log2("n") * 8)
    rows = words.groupBy(octave.alias("o")).agg(F.count("*").alias("k"), F.min("n").alias("low")).orderBy(F.desc("o")).collect()
    total, least = 0, rows[0]["low"] * 2 if rows else 1
    for _, k, low in rows:  # a few hundred rows: eight per doubling of the count
        total += k
        if total > limit:
            break
        least = low
    return least
