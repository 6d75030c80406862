"""Quality rules with a hashed n-gram log-likelihood ratio.

Words and word pairs fall into ``BUCKETS`` hashed buckets. Two multinomials over the buckets, add-one
smoothed, are counted: one over trusted texts, one over the whole corpus. A document's score is the
mean over its n-grams of log(trusted / corpus), and it is kept if the score reaches a fixed threshold
and the counting rules do not fail it. Nothing is drawn at random: every document is judged alike.

Both counts cover every text: all of the corpus, and all whose id is labelled good. What a task has
counted leaves it as at most ``BUCKETS`` rows.

Defined results: a null text has no words; null ids have no label; a text of any length is counted whole; a text without words fails the rules and its score is 0;
without trusted texts all scores are 0; repeated rows count and are judged row by row; an empty table
gives no rows; further columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import mapped, usual_label

BUCKETS = 1 << 16
#: So many trusted ids (8 bytes each) are sent to the tasks that read the texts; more are joined.
BROADCAST_IDS = 1 << 20
THRESHOLD = -0.15
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _per_text(flags, offsets):
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(values, owners):
    """How often each value occurs within its owner."""
    order = np.lexsort((values, owners))
    v, o = values[order], owners[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    group = np.cumsum(fresh) - 1
    times = np.empty(len(v), np.int64)
    times[order] = np.bincount(group)[group] if len(v) else 0
    return times


def base_counts(data, offsets):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words of a slice of texts."""
    n = len(offsets) - 1
    starts, ends, owners = textscan.spans(data, offsets)
    inside = ~textscan.SPACE[data]
    chars = _per_text(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_text(_SYMBOLS[data], offsets)
    words = np.bincount(owners, minlength=n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], breaks + 1])
    line_ends = np.concatenate([breaks, offsets[1:]])
    line_starts.sort(kind="stable")
    line_ends.sort(kind="stable")
    filled = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    has = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[has], line_ends[has]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    lines, of = textscan.distinct_per_owner(textscan.word_hashes(data, line_starts, line_ends), line_owner)
    dup_lines = np.bincount(line_owner, minlength=n) - np.bincount(of, minlength=n)

    hashes = textscan.word_hashes(data, starts, ends)
    repeated = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        whole = owners[:-2] == owners[2:]
        triple, own = textscan.shingles(hashes, owners, n, 3)
        triple, own = triple[: whole.sum()], own[: whole.sum()]  # runs of fewer words come last
        at = np.flatnonzero(whole)[_repeats(triple, own) > 1]
        for k in range(3):
            repeated[at + k] = True
    repeat_words = np.bincount(owners[repeated], minlength=n)
    return words, chars, symbols, dup_lines, repeat_words


def buckets(data, offsets):
    """Hashed words and word pairs (A to Z in lower case) of a slice, with their owners."""
    data = textscan.LOWER[data]
    starts, ends, owners = textscan.spans(data, offsets)
    hashes = textscan.word_hashes(data, starts, ends)
    pairs = owners[:-1] == owners[1:]
    both = textscan.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[pairs]
    values = np.concatenate([hashes, both]) % np.uint64(BUCKETS)
    return values.astype(np.int64), np.concatenate([owners, owners[:-1][pairs]])


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(trusted / corpus) of every bucket; ``trusted`` holds each id (doc_id) of a trusted text once."""
    import pyarrow as pa

    trusted = trusted.select("doc_id", F.lit(True).alias("good"))
    known = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    marked = docs.select("doc_id", "text").join(known, "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")

    def count(batches):
        corpus, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in textscan.slices(batch.column(1)):
                values, owners = buckets(data, offsets)
                corpus += np.bincount(values, minlength=BUCKETS)
                target += np.bincount(values[good[first + owners]], minlength=BUCKETS)
        hit = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit), pa.array(corpus[hit]), pa.array(target[hit])], names=["bucket", "corpus", "target"]
        )

    counts = mapped(marked, count, "bucket long, corpus long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("corpus"), F.sum("target")).collect()  # <= BUCKETS rows
    corpus, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, c, t in rows:
        corpus[bucket] += c
        target[bucket] += t
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(corpus / corpus.sum())


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score for every row of ``docs``."""
    import pyarrow as pa

    trusted = usual_label(labels, "quality").where("y = 1")
    shared = docs.sparkSession.sparkContext.broadcast(ratios(docs, trusted))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def rows(batches):
        ratio = shared.value
        for batch in batches:
            for first, data, offsets in textscan.slices(batch.column(1)):
                n = len(offsets) - 1
                counts = base_counts(data, offsets)
                values, owners = buckets(data, offsets)
                total = np.bincount(owners, ratio[values], n)
                score = total / np.maximum(np.bincount(owners, minlength=n), 1)
                failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n)]
                    + [pa.array(np.asarray(c, np.int64)) for c in counts]
                    + [pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                    names=["doc_id", *names, "base_failed", "kept", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{n} long" for n in names)
    return mapped(docs.select("doc_id", "text"), rows, f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, score double")
