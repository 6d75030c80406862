"""Text quality by compression with dictionaries of good and of bad texts.

Two zstandard dictionaries are trained on labelled texts. A text is compressed with either; the
sizes are divided by the text's own size, and their difference says which dictionary knows the text
better. How well the text shrinks with the better one matters too (a text that repeats itself
shrinks under both), as does its size. A logistic calibration, fitted on labelled texts that the
dictionaries have not seen, turns these figures into a score from 0 to 1.

Both samples are bounded: per class and purpose the rows whose hashed ids are smallest, ``SAMPLE``
at most, none longer than ``LONGEST`` bytes. Every text is scored whole, in the tasks that read it.

Defined results: a null text is empty; an empty text gets the calibrated score of its figures, which
are zero; a null label is ignored; ids with several labels count with the largest; without labels of
both classes every score is the share of label 1, or 0 without labels; repeated rows are scored row
by row; further columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import class_sample, crc_rest, label_share, mapped, rows_where, usual_label

SAMPLE = 2000
LONGEST = 1 << 16
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
THRESHOLD = 0.7


class Judge:
    """Figures of texts under both dictionaries, and the calibrated score."""

    def __init__(self, good: bytes, bad: bytes, weights=None, share=0.0):
        self.good, self.bad, self.weights, self.share = good, bad, weights, share
        self.pair = None

    def __getstate__(self):
        return {**self.__dict__, "pair": None}

    def figures(self, texts):
        """One row per text (bytes): difference, better ratio, log size, and their products."""
        import zstandard

        if self.pair is None:
            self.pair = [
                zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False)
                for d in (self.good, self.bad)
            ]
        good, bad = self.pair
        sizes = np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], np.float64).reshape(-1, 3)
        own = np.maximum(sizes[:, 2], 1)
        known = (sizes[:, :2] - EMPTY_BYTES).clip(min=0) / own[:, None]
        gap, low, size = known[:, 1] - known[:, 0], known.min(axis=1), np.log1p(sizes[:, 2]) / 10
        relative = gap / np.maximum(known.max(axis=1), 1e-3)
        base = np.stack([gap, relative, low, size], axis=1)
        squares = [base[:, i] * base[:, j] for i in range(4) for j in range(i, 4)]
        return np.column_stack([base, *squares])

    def scores(self, texts):
        if self.weights is None:
            return np.full(len(texts), self.share)
        mean, spread, weights = self.weights
        rows = np.column_stack([np.ones(len(texts)), np.clip((self.figures(texts) - mean) / spread, -8, 8)])
        return 1 / (1 + np.exp(-np.clip(rows @ weights, -40, 40)))


#: Bytes of a frame that holds nothing.
EMPTY_BYTES = 9


def train_dictionary(texts) -> bytes:
    import zstandard

    texts = [t for t in texts if t]
    total = sum(map(len, texts))
    try:
        return zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, total // 8)), texts).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: the texts themselves are the dictionary
        return b"".join(texts)[:DICTIONARY_BYTES] or b"\n" * 8


def calibrate(figures, labels, share):
    """Mean, spread and weights of a logistic regression (Newton steps, a small ridge).

    Classes are weighted to their true shares.
    """
    mean, spread = figures.mean(axis=0), np.maximum(figures.std(axis=0), 1e-6)
    rows = np.column_stack([np.ones(len(figures)), np.clip((figures - mean) / spread, -8, 8)])
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    beta, ridge = np.zeros(rows.shape[1]), np.full(rows.shape[1], 1e-2 * len(rows) / 100)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (weight * (p - labels)) + ridge * beta
        bend = (rows * (weight * p * (1 - p) + 1e-9)[:, None]).T @ rows + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, beta


def fit(dictionary_rows, calibration_rows, share) -> Judge:
    """A judge from (label, text bytes) rows."""
    by = {y: [t for label, t in dictionary_rows if label == y] for y in (0, 1)}
    labels = np.array([y for y, _ in calibration_rows], np.float64)
    if not by[0] or not by[1] or not len(labels) or labels.min() == labels.max():
        return Judge(b"", b"", None, share)
    judge = Judge(train_dictionary(by[1]), train_dictionary(by[0]), None, share)
    judge.weights = calibrate(judge.figures([t for _, t in calibration_rows]), labels, share)
    return judge


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Judge:
    """A judge fitted on the sampled labelled texts of ``docs``; held-out ids are never used."""
    known = usual_label(labels, column)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    short = docs.where(F.octet_length("text") <= LONGEST).select("doc_id", "text")
    found = []
    for part in (0, 1):
        picked = F.broadcast(class_sample(known.where(half == part), {0: SAMPLE, 1: SAMPLE}, seed=part))
        rows = short.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        rows = rows.select("y", F.col("text").cast("binary").alias("text")).collect()  # a text for each picked id
        found.append([(r["y"], bytes(r["text"])) for r in rows])
    return fit(*found, label_share(known))


def _texts(column):
    """Texts as bytes; null is empty."""
    for _, data, offsets in textscan.slices(column):
        raw, offsets = data.tobytes(), offsets.tolist()
        yield [raw[a:b] for a, b in zip(offsets, offsets[1:])]


def score(docs: DataFrame, judge: Judge, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([shared.value.scores(t) for t in _texts(batch.column(1))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = mapped(docs.select("doc_id", "text"), rows, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (crc_rest("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, judge: Judge, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the judge calls good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def good(column):
        return np.concatenate([shared.value.scores(t) for t in _texts(column)]) >= threshold

    return rows_where(docs, good)
