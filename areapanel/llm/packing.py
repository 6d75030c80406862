"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once and cut only where they are longer than a sequence. Which piece goes
where depends on lengths alone, so the plan is made from the number of pieces of every length: at
most ``capacity`` counts, however many documents there are. The plan is exactly what best fit
decreasing does document by document: longest first, each into the tightest open sequence that
still has room, found in a segment tree over the remaining capacities. Equal lengths are placed in
runs, and sequences in one state are kept as ranges of numbers.

The seat of a piece is its rank among the pieces of its length: its rank inside the task that
tokenised it, plus the pieces of that length in earlier tasks. No length, however common, is
gathered in one task.

Defined results: a null text is empty and consists of the end id; repeated rows are packed once per
row; an empty table gives no rows; null ids stay null; further columns of the input are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged

from . import tokens
from .common import mapped

CAPACITY = 2048
END_ID = 0
#: Largest plan that is sent to the tasks as arrays; a longer one is joined.
BROADCAST_STEPS = 1 << 20


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds ranges of open sequences."""

    def __init__(self, capacity):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges = [[] for _ in range(capacity + 1)]

    def _mark(self, capacity):
        node = self.size + capacity
        self.any[node] = bool(self.ranges[capacity])
        node >>= 1
        while node:
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]
            node >>= 1

    def push(self, capacity, first, count):
        if count:
            self.ranges[capacity].append((first, count))
            self._mark(capacity)

    def pop(self, capacity, most):
        """Up to ``most`` sequences of one range."""
        first, count = self.ranges[capacity].pop()
        if count > most:
            self.ranges[capacity].append((first + most, count - most))
            count = most
        self._mark(capacity)
        return first, count

    def tightest(self, length):
        """The smallest remaining capacity of at least ``length`` that is open, or None."""
        node = self.size + length
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan(counts: dict, capacity: int = CAPACITY) -> list:
    """Best fit decreasing for ``counts`` pieces per length.

    Returns steps (length, first rank, sequences, pieces in each, first sequence, offset): ranks run
    through a sequence before the next one begins.
    """
    tree, steps, opened = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, many, room = opened, max(1, left // each), capacity
                opened += many
            else:
                each = room // length
                first, many = tree.pop(room, max(1, left // each))
            each = min(each, left)
            steps.append((length, rank, many, each, first, capacity - room))
            tree.push(room - each * length, first, many)
            rank += many * each
            left -= many * each
    return steps


def pieces(docs: DataFrame, definition: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), task, seat."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(definition)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext

        coder, task = tokens.encoder(shared.value), TaskContext.get().partitionId()
        seats = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, ids, offsets in tokens.encoded_slices(coder, batch.column(1)):
                n = len(offsets) - 1
                sizes = np.diff(offsets) + 1
                many = -(-sizes // capacity)
                owner = np.repeat(np.arange(n), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                fresh = np.flatnonzero(np.diff(ranked, prepend=-1))
                seat = np.empty(len(length), np.int64)
                seat[order] = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order))))
                seat += seats[length]
                seats += np.bincount(length, minlength=capacity + 1)
                step = max(1, (64 << 20) // (4 * capacity))
                for a in range(0, len(owner), step):
                    b = min(len(owner), a + step)
                    part = whole[bounds[a] : bounds[b]].tobytes()
                    data = pa.Array.from_buffers(
                        pa.binary(),
                        b - a,
                        [None, pa.py_buffer((4 * (bounds[a : b + 1] - bounds[a])).astype(np.int32).tobytes()), pa.py_buffer(part)],
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(first + owner[a:b])),
                            pa.array(piece[a:b].astype(np.int32)),
                            pa.array(start[a:b]),
                            pa.array(length[a:b]),
                            data,
                            pa.array(np.full(b - a, task)),
                            pa.array(seat[a:b]),
                        ],
                        names=["doc_id", "piece", "start", "length", "ids", "task", "seat"],
                    )

    return mapped(
        docs.select("doc_id", "text"),
        cut, f"doc_id {id_type}, piece int, start long, length long, ids binary, task long, seat long"
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, carry: dict | None = None) -> DataFrame:
    """Every piece and its place: doc_id, piece, start, length, ``carry``, sequence_id, offset.

    ``path`` names the vocabulary file, read on the driver. ``carry`` maps names to columns over
    ``ids`` (little-endian unsigned 32-bit), computed where the pieces are read, so that only what is
    asked for moves with a piece; by default the ids themselves.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    spark = docs.sparkSession
    cut = staged(pieces(docs, tokens.definition_of(path), capacity, end_id), "pieces")
    by_task = staged(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece_counts")
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # <= capacity rows
    steps = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    carried = {"ids": F.col("ids")} if carry is None else carry
    ranked = (
        cut.select("doc_id", "piece", "start", "length", "task", "seat", *[c.alias(k) for k, c in carried.items()])
        .join(base, ["length", "task"])
        .select("doc_id", "piece", "start", "length", *carried, (F.col("base") + F.col("seat")).alias("rank"))
    )
    if len(steps) > BROADCAST_STEPS:
        table = spark.createDataFrame(steps.tolist(), "l long, first long, many long, each long, seq long, at long")
        hit = (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first"))
        hit &= F.col("rank") < F.col("first") + F.col("many") * F.col("each")
        inside = F.col("rank") - F.col("first")
        return ranked.join(table, hit).select(
            *ranked.columns[:-1],
            (F.col("seq") + F.floor(inside / F.col("each"))).alias("sequence_id"),
            (F.col("at") + inside % F.col("each") * F.col("length")).alias("offset"),
        )
    # Steps are ordered by length downwards, then rank: one sorted key finds a piece's step.
    width = 1 << max(counts.values(), default=1).bit_length()
    keys = (capacity - steps[:, 0]) * width + steps[:, 1]
    shared = spark.sparkContext.broadcast((keys, steps))

    def place(batches):
        keys, steps = shared.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            step = steps[np.searchsorted(keys, (capacity - length) * width + rank, "right") - 1]
            inside = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(step[:, 4] + inside // step[:, 3]),
                    pa.array(step[:, 5] + inside % step[:, 3] * length),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return mapped(ranked, place, f"{kinds}, sequence_id long, offset long")
