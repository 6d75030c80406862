"""Code length of texts under context-tree weighting, learned from a corpus.

A byte is eight binary decisions, each taken in the tree of the bytes before it, up to ``depth`` (2 to
6). Every node holds a Krichevsky-Trofimov estimate of its own decisions; its weighted probability is
half the estimate plus half the product of its children's, so all depths are mixed. Texts are scored by
the trained tree as it stands: on the way down, the mixture at each node is split by the posterior weight
of stopping there, and log10 probabilities of whole bytes follow.

The tree is counted over all training texts as byte runs of length ``depth`` + 1; shorter contexts are
their sums. Runs of the other texts are counted 0 times, which leaves the tree as it is, and so get their
probability as well. Nodes below the last two context bytes are worked out in the partition that holds
them; only the two upper levels (65 thousand numbers) meet in the driver. The finished tree is one number per
distinct run of the corpus. ``ROWS`` of them are sent to the tasks at once; a larger tree is applied slice by
slice, in as many passes, with the same result, and one slice at a time is in the driver. What a pass
adds is keyed by a digest of the text, so passes need not meet the rows in the same tasks.

Words are counted too, for the base score. Words are told apart by 64-bit hashes. The
commonest, at most ``COMMON`` words, are sent to the tasks, all others are joined.

Defined results: a null text is empty; an empty text is scored as the end of a text alone; with no
training text every byte has probability 1/256 and the base score is 0; repeated rows are learned and
scored row by row; null ids count as the empty id text; an empty table gives no rows; A to Z are
lowered first.
"""

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged

from . import textscan
from .common import common_words, crc_rest, mapped

BEFORE, END = 0xFE, 0xFF  # no UTF-8 text holds these bytes
ROWS = 3 << 20
DEPTH = 3
COMMON = 1 << 19
_HALF = math.log(2)
_X = np.arange(256)
#: For every byte the eight nodes of its decisions, and the decisions.
NODES = np.stack([(1 << k) | (_X >> (8 - k)) for k in range(8)])
BITS = np.stack([(_X >> (7 - k)) & 1 for k in range(8)])


def _log_gamma(x):
    """Natural logarithm of the gamma function for x >= 0.5 (Stirling's series after a shift by 8)."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def estimate(zeros, ones):
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 2 * _log_gamma(0.5) - _log_gamma(zeros + ones + 1)


def weighted(own, children):
    """Natural logarithm of half the own probability plus half the children's product."""
    return np.logaddexp(own, children) - _HALF


def decisions(contexts, values, counts):
    """Nodes (context * 256 + node) with their zeros and ones, from counts of bytes in contexts, and the
    place of every decision's node, eight times the bytes."""
    nodes = (contexts[None, :].astype(np.int64) << 8) + NODES[:, values]
    found, where = np.unique(nodes.ravel(), return_inverse=True)
    bits = BITS[:, values].ravel()
    many = np.tile(counts, 8).astype(np.float64)
    zeros, ones = (np.bincount(where, v, len(found)) for v in (many * (1 - bits), many * bits))
    return found, zeros, ones, where


def levels(contexts, values, counts, depth):
    """Nodes of the depths from ``depth`` up to two, the deepest first: (nodes, n0, n1, own, inner, where).

    ``own`` and ``inner`` are the logarithms of the estimate and of the weighted probability, ``where`` the
    place of every node of the level before, at the deepest that of every decision.
    """
    nodes, n0, n1, where = decisions(contexts, values, counts)
    own = estimate(n0, n1)
    found = [(nodes, n0, n1, own, own, where)]
    for d in range(depth - 1, 1, -1):
        nodes, n0, n1, _, inner, _ = found[-1]
        parents, where = np.unique(nodes & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        n0, n1, below = (np.bincount(where, v, len(parents)) for v in (n0, n1, inner))
        own = estimate(n0, n1)
        found.append((parents, n0, n1, own, weighted(own, below), where))
    return found


def _dense(rows, nodes, values, count, fill):
    table = np.full((count, 256), fill)
    table[rows, nodes] = values
    return table


class Top:
    """The root and the nodes below it: chance of a one and weight of stopping, per node."""

    def __init__(self, nodes, zeros, ones, below):
        context, node = nodes >> 8, nodes & 0xFF
        own = estimate(zeros, ones)
        inner = weighted(own, below)
        self.chance1 = _dense(context, node, (ones + 0.5) / (zeros + ones + 1), 256, 0.5)
        self.stop1 = _dense(context, node, np.exp(own - _HALF - inner), 256, 0.5)
        n0, n1, s = (np.bincount(node, v, 256) for v in (zeros, ones, inner))
        own = estimate(n0, n1)
        self.chance0, self.stop0 = (n1 + 0.5) / (n0 + n1 + 1), np.exp(own - _HALF - weighted(own, s))

    def mixed(self, nodes, deeper):
        """Chance of a one at ``nodes`` (any depth from one), given that of everything below depth one."""
        last, node = nodes >> 8 & 0xFF, nodes & 0xFF
        one = self.stop1[last, node] * self.chance1[last, node] + (1 - self.stop1[last, node]) * deeper
        return self.stop0[node] * self.chance0[node] + (1 - self.stop0[node]) * one


def down(contexts, values, counts, depth, top):
    """log10 probability of every value in its context."""
    found = levels(contexts, values, counts, depth)
    nodes, n0, n1, _, _, decided = found[0]
    place, chance = np.arange(len(nodes)), (n1 + 0.5) / (n0 + n1 + 1)
    for _, n0, n1, own, inner, where in found[1:]:
        place = where[place]
        here, stop = (n1 + 0.5) / (n0 + n1 + 1), np.exp(own - _HALF - inner)
        chance = stop[place] * here[place] + (1 - stop[place]) * chance
    chance = top.mixed(nodes, chance)
    one, zero = np.log10(chance)[decided], np.log10(1 - chance)[decided]
    return np.where(BITS[:, values].ravel() == 1, one, zero).reshape(8, -1).sum(axis=0)


def runs(data, offsets, depth):
    """Run (the context of ``depth`` bytes, then the byte, lowest) and owner of every position, ends included."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owners = np.repeat(np.arange(n), sizes)
    out = np.full(len(data) + (depth + 1) * n, BEFORE, np.uint64)
    out[np.arange(len(data)) + (depth + 1) * owners + depth] = data
    ends = offsets[1:] + (depth + 1) * np.arange(1, n + 1) - 1
    out[ends] = END
    real = np.ones(len(out), bool)
    begins = offsets[:-1] + (depth + 1) * np.arange(n)
    for k in range(depth):
        real[begins + k] = False
    keys = out.copy()
    for k in range(1, depth + 1):
        keys[k:] |= out[:-k] << np.uint64(8 * k)
    return keys[real], np.repeat(np.arange(n), sizes + 1)


class _Counter:
    """Adds up counts of 64-bit keys in little memory."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys, times=1):
        keys, counts = np.unique(keys, return_counts=True)
        counts = counts * times
        self.parts.append((keys.astype(np.uint64), counts))
        self.held += len(keys)
        if self.held > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self):
        keys = np.concatenate([self.keys, *[k for k, _ in self.parts]])
        counts = np.concatenate([self.counts, *[c for _, c in self.parts]])
        self.keys, where = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(where, counts, len(self.keys)).astype(np.int64)
        self.parts, self.held = [], 0


WORD, RUN, TEXT = 0, 1, 2


def gather(texts: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): how often each word and each run of ``depth`` + 1 bytes occurs in the texts that are
    learned, and their number; runs of other texts are listed with 0. ``texts`` has text and learned."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def count(batches):
        words, grams, texts = _Counter(), _Counter(), 0
        for batch in batches:
            learned = batch.filter(batch.column(1))
            texts += learned.num_rows
            for _, data, offsets in textscan.slices(learned.column(0)):
                data = textscan.LOWER[data]
                starts, ends, _ = textscan.spans(data, offsets)
                words.add(textscan.word_hashes(data, starts, ends))
                grams.add(runs(data, offsets, depth)[0])
            for _, data, offsets in textscan.slices(batch.filter(pc.invert(batch.column(1))).column(0)):
                grams.add(runs(textscan.LOWER[data], offsets, depth)[0], 0)
        words.merge()
        grams.merge()
        for kind, keys, counts in (
            (WORD, words.keys, words.counts), (RUN, grams.keys, grams.counts), (TEXT, np.zeros(1, np.uint64), np.array([texts]))
        ):
            for a in range(0, len(keys), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys[part]), kind, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(counts[part])],
                    names=["kind", "key", "n"],
                )

    counted = mapped(texts, count, "kind int, key long, n long")
    return staged(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "corpus_counts")


def _columns(batches):
    import pyarrow as pa

    whole = pa.Table.from_batches(list(batches))
    return [c.to_numpy() for c in whole.columns] if whole.num_rows else None


def tree(grams: DataFrame, depth: int) -> DataFrame:
    """The trained tree: (key, value), the log10 probability of every run's last byte."""
    import pyarrow as pa

    grams = grams.select("key", "n", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("below"))

    def grouped():
        return grams.repartition("below").select("key", "n")

    def rise(batches):
        if (columns := _columns(batches)) is not None:
            key, n = columns
            nodes, n0, n1, _, inner, _ = levels(key >> 8, key & 0xFF, n, depth)[-1]
            found, where = np.unique(nodes & 0xFFFF, return_inverse=True)
            sums = [np.bincount(where, v, len(found)) for v in (n0, n1, inner)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["node", "n0", "n1", "inner"])

    risen = mapped(grouped(), rise, "node long, n0 double, n1 double, inner double")
    rows = risen.groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("inner")).orderBy("node").collect()  # <= 65,536 rows
    top = Top(*(np.array([r[i] for r in rows], np.int64 if i == 0 else np.float64) for i in range(4)))
    shared = grams.sparkSession.sparkContext.broadcast(top)

    def fall(batches):
        if (columns := _columns(batches)) is not None:
            key, n = columns
            value = down(key >> 8, key & 0xFF, n, depth, shared.value).astype(np.float32)
            for a in range(0, len(key), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(value[part])], names=["key", "value"])

    return staged(mapped(grouped(), fall, "key long, value float"), "tree")


class Scorer:
    """Looks up the runs of one slice of the tree; runs of other slices count 0 in this pass."""

    def __init__(self, keys, values, depth):
        self.given, self.ready = (keys, values, depth), None

    def __getstate__(self):
        return {"given": self.given, "ready": None}

    def prepare(self):
        """A hash table with open addressing, at most half full; no run is ``FREE``."""
        keys, values, _ = self.given
        size = 1 << max(1, (2 * len(keys)).bit_length())
        self.ready = held, found = np.full(size, FREE), np.zeros(size, np.float32)
        place, left = _places(keys, size), np.arange(len(keys))
        while len(left):
            fits = left[held[place[left]] == FREE]
            held[place[fits]] = keys[fits]
            left = left[held[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & (size - 1)
        # Keys are distinct, so every place found now is the key's own.
        found[place] = values

    def scores(self, data, offsets):
        if self.ready is None:
            self.prepare()
        held, found = self.ready
        keys, owners = runs(data, offsets, self.given[2])
        place = _places(keys, len(held))
        here = held[place]
        total = np.where(here == keys, found[place], np.float32(0))
        left = np.flatnonzero((here != keys) & (here != FREE))
        while len(left):
            place[left] = (place[left] + 1) & (len(held) - 1)
            here = held[place[left]]
            met = here == keys[left]
            total[left[met]] = found[place[left[met]]]
            left = left[~met & (here != FREE)]
        return np.bincount(owners, total, len(offsets) - 1)


FREE = np.uint64((1 << 64) - 1)


def _places(keys, size):
    return (textscan.mix(keys) & np.uint64(size - 1)).astype(np.int64)


def slices_of(tree_rows: DataFrame, limit: int = ROWS) -> int:
    """In how many slices of about ``limit`` runs the tree is applied."""
    return max(1, -(-tree_rows.count() // limit))


def scorers(tree_rows: DataFrame, depth: int, slices: int):
    """One scorer per slice, made when it is asked for."""
    for k in range(slices):
        own = tree_rows.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k).toArrow()
        yield Scorer(own.column("key").to_numpy().view(np.uint64), own.column("value").to_numpy(), depth)


def _digests(data, offsets):
    raw, ends = data.tobytes(), offsets.tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]


def score(
    docs: DataFrame, modulus: int = 7, held: int = 2, rows_at_once: int = ROWS, common: int = COMMON, depth: int = DEPTH
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    The corpus is the texts whose crc32(doc_id) mod ``modulus`` is not ``held``. A byte is predicted from up
    to ``depth`` bytes before it.
    """
    import pyarrow as pa

    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")

    spark = docs.sparkSession
    counts = gather(docs.select("text", (crc_rest("doc_id", modulus) != held).alias("learned")), depth)
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    texts = counts.where(F.col("kind") == TEXT).agg(F.sum("n")).first()[0] or 0
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (total or 0) + texts, distinct + (texts > 0)
    least = common_words(words, common)
    known = words.where(F.col("n") >= least).toArrow()  # at most ``common`` rows
    keys = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, gain = keys[order], np.log10(known.column("n").to_numpy()[order] + 1.0)
    unit, end_gain = math.log10(total + distinct + 1), math.log10(texts + 1.0)
    lexicon = spark.sparkContext.broadcast((keys, gain))

    trained = tree(counts.where(F.col("kind") == RUN).select("key", "n"), depth)
    slices_ = slices_of(trained, rows_at_once)
    several, passes = slices_ > 1, scorers(trained, depth, slices_)
    shared = spark.sparkContext.broadcast(next(passes))

    def first(batches):
        from pyspark import TaskContext

        keys, gain = lexicon.value
        scorer, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, data, offsets in textscan.slices(batch.column(1)):
                n = len(offsets) - 1
                data = textscan.LOWER[data]
                starts, ends, owners = textscan.spans(data, offsets)
                hashes = textscan.word_hashes(data, starts, ends)
                place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                found = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                rare = np.bincount(owners[~found], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(at, n),
                        pa.array(np.bincount(owners, minlength=n) + 1),
                        pa.array(np.bincount(owners[found], minlength=n) + (1 if texts else 0)),
                        pa.array(np.bincount(owners[found], gain[place[found]], n) + end_gain),
                        pa.array(scorer.scores(data, offsets)),
                        pa.array(_digests(data, offsets) if several else [None] * n, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(rare)]).astype(np.int32)),
                            pa.array(hashes[~found].view(np.int64)),
                        ),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "gain", "score", "digest", "rare"],
                )
                row += n

    source = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"row long, doc_id {kind}, n_tokens long, n_known long, gain double, score double, digest binary, rare array<long>"
    scored = staged(mapped(source, first, fields), "scored")
    shared.destroy()
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    rare = rare.join(words.where(F.col("n") < least), "key")
    rare = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_gain"))
    parts = scored.drop("rare").join(rare, "row", "left")
    extras = []
    for scorer in passes:
        later = spark.sparkContext.broadcast(scorer)
        extras.append(staged(_pass(source, later), "pass"))
        later.destroy()
    if extras:
        extra = reduce(DataFrame.union, extras).groupBy("digest").agg(F.sum("extra").alias("extra"), F.count("*").alias("n"))
        whole = F.col("n").isNotNull() & (F.col("n") == len(extras))
        more = F.when(whole, F.col("extra")).otherwise(F.raise_error(F.lit("a text was not met in every pass")))
        parts = parts.join(extra, "digest", "left").withColumn("score", F.col("score") + more)
    known_words = F.col("n_known") + F.coalesce("more", F.lit(0))
    gained = F.col("gain") + F.coalesce("more_gain", F.lit(0.0))
    return parts.select(
        "doc_id",
        (crc_rest("doc_id", modulus) == held).alias("held_out"),
        "n_tokens",
        known_words.alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (gained - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        "score",
    )


def _pass(source: DataFrame, shared) -> DataFrame:
    """(digest, extra): what a later slice of the tree adds to every text, named by its own digest, so that it does
    not matter in which task or order a pass meets the rows."""
    import pyarrow as pa

    def more(batches):
        for batch in batches:
            for _, data, offsets in textscan.slices(batch.column(1)):
                data = textscan.LOWER[data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(data, offsets), pa.binary()), pa.array(shared.value.scores(data, offsets))], names=["digest", "extra"]
                )

    return mapped(source, more, "digest binary, extra double").groupBy("digest").agg(F.max("extra").alias("extra"))
