"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt out by ranges of doc_id, tokenised where they arrive and written in ascending
order. A file is a Parquet folder in the shared store; a row is one segment: a run of whole
documents whose ids, end ids included, are cut into blocks of ``BLOCK`` ids. Of every block the
minimum is subtracted; the differences are packed at the width that holds ``PERCENTILE`` of them, and
the rest go to a list of exceptions. ``block_starts`` indexes the blocks inside ``payload``.

Equal keys are told apart by the text's hash and then by the row's position in the scan, so a key
that holds many rows is dealt out as well.

Defined results: a null text is empty and gives its end id alone; repeated rows are kept, one entry
each; null ids come first; an empty table gives an empty file; further columns are ignored.
"""

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import new_stage

from . import tokens
from .common import mapped

END_ID = 2
BLOCK = 512
PERCENTILE = 0.95
SEGMENT_IDS = 1 << 18

SEGMENT = (
    "part int, first_id long, doc_ids array<{id}>, lengths array<long>, block_starts array<long>, minima array<long>,"
    " widths array<int>, exception_blocks array<int>, exception_places array<int>, exception_values array<long>,"
    " payload binary"
)


def encode_blocks(ids, block: int = BLOCK, percentile: float = PERCENTILE) -> dict:
    """The blocks of an array of unsigned ids; the last block is filled up with its minimum."""
    ids = np.asarray(ids, np.uint32)
    many = -(-len(ids) // block)
    rows = np.full(many * block, ids[(many - 1) * block :].min() if many else 0, np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(many, block)
    minima = rows.min(axis=1) if many else np.zeros(0, np.uint32)
    rows = rows - minima[:, None]
    pick = min(block - 1, int(percentile * block))
    at = np.partition(rows, pick, axis=1)[:, pick] if many else np.zeros(0, np.uint32)
    widths = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    over = (rows.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    where, place = np.nonzero(over)
    values = rows[where, place]
    rows[where, place] = 0
    size = (widths * block + 7) // 8
    starts = np.concatenate([[0], np.cumsum(size)])
    payload = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths).tolist():
        if not width:
            continue
        own = np.flatnonzero(widths == width)
        kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
        loose = np.unpackbits(rows[own].astype(kind).view(np.uint8).reshape(-1, bits // 8), axis=1)
        packed = np.packbits(loose[:, bits - width :].reshape(len(own), -1), axis=1)
        payload[starts[own][:, None] + np.arange(packed.shape[1])] = packed
    return {
        "block_starts": starts[:-1],
        "minima": minima.astype(np.int64),
        "widths": widths.astype(np.int32),
        "exception_blocks": where.astype(np.int32),
        "exception_places": place.astype(np.int32),
        "exception_values": values.astype(np.int64),
        "payload": payload.tobytes(),
    }


def decode_blocks(coded: dict, count: int, block: int = BLOCK):
    """The first ``count`` ids of the blocks."""
    widths, starts = np.asarray(coded["widths"], np.int64), np.asarray(coded["block_starts"], np.int64)
    payload = np.frombuffer(coded["payload"], np.uint8)
    rows = np.zeros((len(widths), block), np.uint32)
    for width in np.unique(widths).tolist():
        if not width:
            continue
        own = np.flatnonzero(widths == width)
        kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
        packed = payload[starts[own][:, None] + np.arange((width * block + 7) // 8)]
        loose = np.unpackbits(packed, axis=1)[:, : width * block].reshape(-1, width)
        wide = np.zeros((len(loose), bits), np.uint8)
        wide[:, bits - width :] = loose
        rows[own] = np.packbits(wide, axis=1).view(kind).reshape(len(own), block)
    rows[np.asarray(coded["exception_blocks"], np.int64), np.asarray(coded["exception_places"], np.int64)] = coded[
        "exception_values"
    ]
    return (rows + np.asarray(coded["minima"], np.uint32)[:, None]).reshape(-1)[:count]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Tokenise ``docs`` (doc_id, text) with the vocabulary file and write the file to ``path``.

    ``first_id`` is the number of ids before a segment inside its part; parts ascend by doc_id.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(tokens.definition_of(vocabulary))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "h", "row"]
    dealt = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def segments(batches):
        from pyspark import TaskContext

        coder, part, before = tokens.encoder(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, offsets in tokens.encoded_slices(coder, batch.column(1)):
                lengths = np.diff(offsets) + 1
                whole = np.insert(ids, offsets[1:], end_id)
                ends = np.cumsum(lengths)
                a = 0
                while a < len(lengths):
                    done = int(ends[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, done + SEGMENT_IDS, "right")))
                    coded = encode_blocks(whole[done : ends[b - 1]])
                    row = {
                        "part": part,
                        "first_id": before + done,
                        "doc_ids": batch.column(0).slice(first + a, b - a).to_pylist(),
                        "lengths": lengths[a:b],
                    } | coded
                    yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=schema)
                    a = b
                before += len(whole)

    long = pa.list_(pa.int64())
    schema = pa.schema(
        {
            "part": pa.int32(),
            "first_id": pa.int64(),
            "doc_ids": pa.list_(_arrow(docs.schema["doc_id"].dataType)),
            "lengths": long,
            "block_starts": long,
            "minima": long,
            "widths": pa.list_(pa.int32()),
            "exception_blocks": pa.list_(pa.int32()),
            "exception_places": pa.list_(pa.int32()),
            "exception_values": long,
            "payload": pa.binary(),
        }
    )
    mapped(dealt, segments, SEGMENT.format(id=id_type)).write.parquet(path)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read(spark, path: str) -> DataFrame:
    """The documents of a file: doc_id, start (ids of all documents before), ids (little-endian uint32)."""
    import pyarrow as pa

    from pyspark.sql import Window

    file = spark.read.parquet(path)
    totals = file.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = totals.groupBy("part").agg(F.sum("n").alias("n"))  # one row per part of the file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = file.schema["doc_ids"].dataType.elementType

    def documents(batches):
        names = ["block_starts", "widths", "minima", "exception_blocks", "exception_places", "exception_values", "payload"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in [*names, "lengths", "doc_ids", "first_id", "base"]}
                coded = {k: row[k].as_py() if k == "payload" else row[k].values.to_numpy() for k in names}
                lengths = row["lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                ids = decode_blocks(coded, int(ends[-1])).astype("<u4")
                begin = ends - lengths
                for a in range(0, len(lengths), 1024):
                    b = min(len(lengths), a + 1024)
                    values = [ids[x:y].tobytes() for x, y in zip(begin[a:b].tolist(), ends[a:b].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            row["doc_ids"].values.slice(a, b - a),
                            pa.array(begin[a:b] + row["first_id"].as_py() + row["base"].as_py()),
                            pa.array(lengths[a:b]),
                            pa.array([zlib.crc32(v) for v in values], pa.int64()),
                            pa.array(values, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    joined = file.join(F.broadcast(base), "part")  # one row per part
    schema = f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long, ids binary"
    return mapped(joined, documents, schema)


def new_file(spark) -> str:
    """A path below the shared folder."""
    return new_stage(spark, "token_file")
