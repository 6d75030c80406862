"""Toxicity by a factorization machine over hashed terms.

A term is a run of letters and digits, A to Z in lower case, or its first four or five bytes; every
distinct term of a text sets one of ``BUCKETS`` hashed features. The score is the logistic function of a bias, linear weights and all
pairwise interactions, each the dot product of two learned vectors: an insult beside the mention of
a group weighs more than both alone.

The machine is fitted on a bounded sample of labelled rows: per class the ``SAMPLE`` rows whose hashed ids
are smallest. Only their distinct features reach the driver. Every feature in ``LEAST`` texts or more has
a weight and factors, by the same rule at every size; no feature is tested alone beforehand. The fit is joint
and penalised in units of what chance alone would give a feature's gradient, so most weights end at zero: first
the weights, then weights and factors, which begin along the leading directions of the pairs that weights
leave unexplained, then what is not zero again with a lighter penalty. Class shares of the sample are corrected by the true
shares. Every text is scored whole, in the tasks that read it.

Defined results: a null text is empty; an empty text scores the bias; a null label is ignored; ids
with several labels count with the largest, and of the texts of a labelled id one is learned; null ids
have no label; without labels of both classes every score is the share of toxic labels, or 0 without labels; repeated rows are scored row by row; further columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged

from . import textscan
from .common import class_sample, crc_rest, label_share, mapped, rows_where, usual_label

BUCKETS = 1 << 18
FACTORS = 8
BEGINNINGS = (4, 5)
SAMPLE = {1: 4000, 0: 8000}
LEAST = 4
PENALTY, PAIR_PENALTY, LIGHTER, RIDGE = 2.8, 5.0, 0.1, 0.02
STEPS, DIRECTIONS, PAIR_STEPS, LAST_STEPS = 120, 15, 30, 60
THRESHOLD = 0.3
#: Entries that the fit adds up at a time.
STRIDE = 1 << 16

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def features(data, offsets):
    """Distinct hashed terms of a slice of texts and their owners, ordered by owner."""
    data = textscan.LOWER[data]
    starts, ends, owners = textscan.spans(data, offsets, _BREAK)
    found, whose = [textscan.word_hashes(data, starts, ends)], [owners]
    for size in BEGINNINGS:
        longer = ends - starts > size
        found.append(textscan.mix(textscan.word_hashes(data, starts[longer], starts[longer] + size) + np.uint64(size)))
        whose.append(owners[longer])
    values = (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)
    whose = np.concatenate(whose)
    both = np.unique(whose * BUCKETS + values)
    return both % BUCKETS, both // BUCKETS


class Machine:
    """``bias`` + linear weights + factors, on features that the sample holds often enough."""

    def __init__(self, bias=0.0):
        self.bias = float(bias)
        self.linear = np.zeros(BUCKETS, np.float32)
        self.factors = np.zeros((BUCKETS, FACTORS), np.float32)
        self.used = np.zeros(BUCKETS, bool)

    def margins(self, values, owners, n):
        live = np.flatnonzero(self.used[values])
        values, owners = values[live], owners[live]
        total = np.zeros(n) + np.bincount(owners, self.linear[values], n)
        for k in range(FACTORS):
            v = self.factors[values, k].astype(np.float64)
            total += (np.bincount(owners, v, n) ** 2 - np.bincount(owners, v * v, n)) / 2
        return self.bias + total

    def scores(self, values, owners, n):
        return 1 / (1 + np.exp(-np.clip(self.margins(values, owners, n), -40, 40)))


def _chance(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class _Sums:
    """Sums of weights over the entries of every segment, some thousand entries at a time; segments may be empty."""

    def __init__(self, index, sizes):
        self.index, self.size = index, len(sizes)
        self.filled = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)[self.filled]
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self.ends = ends
        self.cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(index), STRIDE)), len(self.filled)))

    def __call__(self, weights):
        out, weights = np.zeros(self.size), weights.astype(np.float32)
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            begin = self.starts[a]
            found = weights.take(self.index[begin : self.ends[b - 1]].astype(np.intp), mode="clip")
            out[self.filled[a:b]] = np.add.reduceat(found, self.starts[a:b] - begin)
        return out


class _Fit:
    """Weights and factors of the kept features, moved by full proximal gradient steps."""

    def __init__(self, values, sizes, labels, count, rng):
        """``values`` are the texts' features one after another, ``sizes`` how many each text has."""
        self.labels, self.count, self.n = labels, count, len(labels)
        self.arrange(values, sizes)
        share = labels.mean()
        self.spread, self.bias = share * (1 - share), np.log(share / (1 - share))
        held = np.bincount(values, minlength=count)
        self.noise = np.sqrt(held * self.spread * (1 - held / (self.n + 1)))
        self.linear, self.factors = np.zeros(count), np.zeros((count, min(FACTORS, count)))
        self.free, self.paired, self.rng = np.ones(count, bool), np.ones(count, bool), rng
        self.restart()

    def arrange(self, values, sizes):
        """The same entries by text and by feature; ``sums`` adds per text, ``back`` per feature."""
        self.sums = _Sums(values, sizes)
        owners = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[np.argsort(values, kind="stable")]
        self.back = _Sums(owners, np.bincount(values, minlength=self.count))
        self.sizes = sizes

    def restart(self):
        self.moved, self.turned = np.full(self.count, 1e-2), np.full(self.count, 1e-2)

    def each(self, call, columns):
        return np.stack([call(column) for column in columns.T], axis=1)

    def weigh(self, errors, penalty, ridge=0.0, unmoved=True):
        limit, g = penalty * self.noise, self.back(errors) + ridge * self.linear
        # Only what exceeds the penalty slows later steps, so a weight still at zero keeps its first pace.
        over = np.where(self.linear != 0, g + np.sign(self.linear) * limit, np.sign(g) * np.maximum(np.abs(g) - limit, 0))
        self.moved += np.where(self.free, (over if unmoved else g) ** 2, 0)
        pace = 0.3 / np.sqrt(self.moved)
        after = self.linear - pace * g
        self.linear = np.where(self.free, np.sign(after) * np.maximum(np.abs(after) - pace * limit, 0), 0)

    def turn(self, errors, sums, penalty):
        own = self.back(errors)[:, None] * self.factors
        g = self.each(lambda s: self.back(errors * s), sums) - own
        limit = penalty * np.sqrt(self.spread * self.back((sums**2).sum(axis=1)))
        self.turned += (g**2).sum(axis=1)
        pace = 0.1 / np.sqrt(self.turned)
        after = np.where(self.paired[:, None], self.factors - pace[:, None] * g, 0)
        size = np.sqrt((after**2).sum(axis=1))
        self.factors = after * np.maximum(0, 1 - pace * limit / np.maximum(size, 1e-12))[:, None]

    def errors(self):
        sums = self.each(self.sums, self.factors)
        pairs = ((sums**2).sum(axis=1) - self.sums((self.factors**2).sum(axis=1))) / 2
        return _chance(self.bias + self.sums(self.linear) + pairs) - self.labels, sums

    def lead(self):
        """Factors along the leading directions of the pairs of features, by power iteration."""
        missing = self.labels - _chance(self.bias + self.sums(self.linear))
        missing /= np.maximum(self.sizes, 1)
        alone = self.back(missing)
        found = np.linalg.qr(self.rng.normal(size=self.factors.shape))[0]
        for _ in range(DIRECTIONS):
            turned = self.each(lambda q: self.back(missing * self.sums(q)) - alone * q, found)
            found = np.linalg.qr(turned + 0.5 * found)[0]
        self.factors = 0.5 * found

    def run(self):
        for _ in range(STEPS):
            errors = _chance(self.bias + self.sums(self.linear)) - self.labels
            self.weigh(errors, PENALTY)
            self.bias -= 0.1 * errors.mean() / self.spread
        self.lead()
        for _ in range(PAIR_STEPS):
            errors, sums = self.errors()
            self.weigh(errors, PENALTY)
            self.turn(errors, sums, PAIR_PENALTY)
            self.bias -= 0.1 * errors.mean() / self.spread
        self.free, self.paired = self.linear != 0, self.factors.any(axis=1)
        live = (self.free | self.paired)[self.sums.index]
        kept = np.add.reduceat(live, self.sums.starts, dtype=np.int64) if len(live) else 0
        sizes = np.zeros(self.n, np.int64)
        sizes[self.sums.filled] = kept
        self.arrange(self.sums.index[live], sizes)
        self.restart()
        for _ in range(LAST_STEPS):
            errors, sums = self.errors()
            self.weigh(errors, PENALTY * LIGHTER, RIDGE, unmoved=False)
            self.turn(errors, sums, PAIR_PENALTY * LIGHTER)
            self.bias -= 0.1 * errors.mean() / self.spread


def fit(rows, labels, share, seed=7):
    """A machine from feature arrays and 0/1 labels; ``share`` is the true share of label 1."""
    values = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    kept = np.flatnonzero(np.bincount(values, minlength=BUCKETS) >= LEAST)
    place = _places(kept)
    placed = [place[r][place[r] >= 0] for r in rows]
    flat = np.concatenate(placed) if len(rows) else np.zeros(0, np.int32)
    return fit_kept(kept, flat, np.array([len(r) for r in placed], np.int64), labels, share, seed)


def _places(kept):
    """The place of every feature among the kept ones, -1 for the others."""
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    return place


def fit_kept(kept, values, sizes, labels, share, seed=7):
    """A machine from places among the ``kept`` features, text after text, with the number of each text."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        machine = Machine(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return machine
    own = _Fit(values, sizes, labels, len(kept), np.random.default_rng(seed))
    if len(kept):
        own.run()
    machine = Machine(own.bias + np.log(share / (1 - share)) - np.log(labels.mean() / (1 - labels.mean())))
    machine.linear[kept] = own.linear
    machine.factors[kept, : own.factors.shape[1]] = own.factors
    machine.used = (machine.linear != 0) | machine.factors.any(axis=1)
    return machine


def sample_terms(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """y, terms (little-endian int32): one row for every picked id, of several texts the one whose terms sort first."""
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            for first, data, offsets in textscan.slices(batch.column(2)):
                values, owners = features(data, offsets)
                sizes = np.bincount(owners, minlength=len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(first, len(sizes)) for k in (0, 1)] + [_binary(values, sizes)], names=["doc_id", "y", "terms"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
    found = mapped(read, rows, f"doc_id {kind}, y int, terms binary")
    return staged(found.groupBy("doc_id", "y").agg(F.min("terms").alias("terms")).select("y", "terms"), "sample")


def _binary(values, sizes):
    """Runs of whole numbers as binary values, four bytes each."""
    import pyarrow as pa

    offsets = (4 * np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<i4").tobytes())]
    )


def _numbers(column):
    """The numbers of a column made by ``_binary``, one after another, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "<i4")
    return data[offsets[0] // 4 : offsets[-1] // 4], np.diff(offsets) // 4


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Machine:
    """A machine fitted on the sampled labelled texts of ``docs``; held-out ids are never used.

    Texts that hold each term are counted in the tasks, and terms in fewer than ``LEAST`` texts stay there.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    known = usual_label(labels, column)
    sample = sample_terms(docs, class_sample(known, SAMPLE, seed=9))  # at most the sizes in SAMPLE

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0))[0], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    counted = mapped(sample.select("terms"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = np.sort(counted.where(F.col("n") >= LEAST).select("term").toArrow().column(0).to_numpy())  # at most BUCKETS
    shared = spark.sparkContext.broadcast(_places(kept))

    def place(batches):
        for batch in batches:
            values, sizes = _numbers(batch.column(1))
            placed = shared.value[values]
            live = placed >= 0
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[live], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(placed[live], left)], names=["y", "terms"])

    got = mapped(sample, place, "y int, terms binary").toArrow().combine_chunks()
    shared.destroy()
    y = got.column("y").to_numpy()
    terms = got.column("terms")
    parts = [_numbers(chunk) for chunk in terms.chunks] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    values, sizes = (np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*parts))
    return fit_kept(kept, values, sizes.astype(np.int64), y, label_share(known))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def rows(batches):
        own = shared.value
        for batch in batches:
            for first, data, offsets in textscan.slices(batch.column(1)):
                n = len(offsets) - 1
                found = own.scores(*features(data, offsets), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(found),
                        pa.array((found >= threshold).astype(np.int32)),
                    ],
                    names=["doc_id", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = mapped(docs.select("doc_id", "text"), rows, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the machine does not call toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def clean(column):
        own = shared.value
        found = [own.scores(*features(data, offsets), len(offsets) - 1) for _, data, offsets in textscan.slices(column)]
        return np.concatenate(found) < threshold

    return rows_where(docs, clean)
