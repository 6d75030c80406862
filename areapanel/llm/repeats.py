"""Removal of long repeated strings with a sampled suffix array.

Every byte covered by a string of ``size`` bytes that starts anywhere else too is removed, in the same
text or another one. Texts are taken as UTF-8 bytes.

Not every suffix is sorted. A window of ``size`` bytes is led by a token: of its runs of ``GRAM`` bytes the
one with the least hash, the leftmost of equals. The choice depends on the window's bytes alone, so
equal windows are led by equal tokens at equal places, and it is enough to sort the suffixes that
begin with a token, about one in 180 bytes. The windows that one token of a text leads are
consecutive; the bytes they cover are its context. Equal contexts count once, and contexts whose token
occurs in no other context are left out before any bytes move.

The suffixes are range-partitioned by their leading token with splitters that Spark samples, so
windows that are equal never lie in different buckets. A bucket is sorted by multikey quicksort, eight bytes
a step, to the right of the tokens and, reversed, to the left. Neighbours that share r bytes to
the right and l to the left repeat every window that begins at most l before the token and ends at most r
behind it; runs of equal prefixes on either side give, for each beginning, all contexts whose windows are
equal. A token in more than ``GROUP`` different contexts would be too much for a bucket: its windows are
told apart by digests instead, first a band of beginnings at once by what all its windows share, then
those of the bands that are left one by one, as counts that Spark adds up.

Defined results: a null text is empty; texts shorter than ``size`` keep all; texts that occur twice lose
all they have; rows are judged one by one, so repeated rows are copies of each other, also with
equal or null ids; an empty table gives no rows; further columns are ignored; a text of any length is
searched whole, at most ``PIECE`` beginnings at a time.
"""

import hashlib
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged

from . import textscan
from .common import mapped

SIZE = 400
GRAM = 32
#: Bytes of texts that a task looks at together; work arrays take some hundred bytes for each. Of a longer text
#: ``PIECE`` beginnings at a time; never less than ``SLICE``, so that only texts met alone are parted, always alike.
SLICE = 1 << 18
PIECE = 1 << 19
#: Rows of bands or windows that a task makes before it hands them on.
ROWS = 1 << 14
#: Contexts of one token that are sorted in one task; windows of more are counted by digest.
GROUP = 1 << 14
#: Contexts that are sorted together; a token's own are never parted.
TOGETHER = 1 << 12
BAND = 32
#: So many keys (16 bytes each) are sent to the tasks that read their texts; more are joined.
BROADCAST_KEYS = 1 << 20
_FACTORS = textscan.mix(np.arange(1, GRAM // 8 + 1, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(data):
    """Hashes of the ``GRAM`` bytes from every place."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    n = len(data) - GRAM + 1
    value = eight[:n] * _FACTORS[0]
    for k in range(1, GRAM // 8):
        value += eight[8 * k : 8 * k + n] * _FACTORS[k]
    return textscan.mix(value)


def sliding_least(values, width):
    """The least of every ``width`` values in a row."""
    n = len(values)
    blocks = -(-n // width)
    filled = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    filled[:n] = values
    filled = filled.reshape(blocks, width)
    before = np.minimum.accumulate(filled, axis=1).ravel()
    after = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data, offsets, size=SIZE):
    """Tokens that lead windows: (text, hash, place, first and last beginning of the windows), in order."""
    found = []
    # The same for every part, so that equal windows compare equal bits of their hashes.
    bits = np.uint64((PIECE + size).bit_length())
    for begin in range(0, max(1, len(data)), PIECE):
        part = data[begin : begin + PIECE + size - 1]
        if len(part) < size:
            break
        hashes = gram_hashes(part)
        packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        places = (sliding_least(packed, size - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.arange(len(places)) + begin
        owners = np.searchsorted(offsets, starts, "right") - 1
        whole = np.flatnonzero(starts + size <= offsets[owners + 1])
        starts, owners, places = starts[whole], owners[whole], places[whole]
        fresh = np.flatnonzero(np.diff(places, prepend=-1) | np.diff(owners, prepend=-1))
        last = np.append(fresh[1:], len(places)) - 1
        if len(fresh):
            found.append((owners[fresh], hashes[places[fresh]], places[fresh] + begin, starts[fresh], starts[last]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5


def contexts(data, offsets, size=SIZE):
    """(text, token, place, first, last, digest) of a slice of texts; the digest is that of the context."""
    raw = data.tobytes()
    owners, tokens, places, first, last = anchors(data, offsets, size)
    digests = [hashlib.blake2b(raw[a : b + size], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist())]
    return owners, tokens.astype(np.uint64).view(np.int64), places, first, last, digests


class _Seen:
    """Texts of equal keys that a task has met; forgotten now and then, which costs repeated work only."""

    def __init__(self, most=1 << 18):
        self.keys, self.most = set(), most

    def fresh(self, keys):
        found = []
        for key in keys:
            found.append(key not in self.keys)
            if len(self.keys) >= self.most:
                self.keys.clear()
            self.keys.add(key)
        return np.array(found, bool)


def _batches(batches, others=0):
    """(column of keys, further columns, first row, bytes, offsets) of texts whose key is new to the task."""
    import pyarrow as pa

    seen = _Seen()
    for batch in batches:
        fresh = seen.fresh(batch.column(0).to_pylist())
        if not fresh.all():
            batch = batch.filter(pa.array(fresh))
        for first, data, offsets in textscan.slices(batch.column(1), SLICE):
            n = len(offsets) - 1
            rows = [batch.column(k).slice(first, n).to_pylist() for k in (0, *range(2, 2 + others))]
            yield rows[0], rows[1:], data, offsets


def context_rows(texts: DataFrame, size: int) -> DataFrame:
    """key, token, digest, n (how often the text has the context) for texts (key, text)."""
    import pyarrow as pa

    def rows(batches):
        for keys, _, data, offsets in _batches(batches):
            owners, tokens, _, _, _, digests = contexts(data, offsets, size)
            counts = {}
            for owner, token, digest in zip(owners.tolist(), tokens.tolist(), digests):
                at = (owner, token, digest)
                counts[at] = counts.get(at, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[o] for o, _, _ in counts], pa.binary()),
                    pa.array([t for _, t, _ in counts], pa.int64()),
                    pa.array([d for _, _, d in counts], pa.binary()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["key", "token", "digest", "n"],
            )

    found = mapped(texts, rows, "key binary, token long, digest binary, n long")
    return found.groupBy("key", "token", "digest").agg(F.max("n").alias("n"))


def context_bytes(texts: DataFrame, size: int) -> DataFrame:
    """token, digest, hot, before (bytes ahead of the token), bytes of the wanted contexts of texts (key, text,
    wanted), where wanted holds (digest, hot)."""
    import pyarrow as pa

    def rows(batches):
        for _, (wanted,), data, offsets in _batches(batches, others=1):
            wanted = [{w["digest"]: w["hot"] for w in row} for row in wanted]
            raw, out = data.tobytes(), []
            for owner, token, place, first, last, digest in zip(*[c.tolist() if isinstance(c, np.ndarray) else c for c in contexts(data, offsets, size)]):
                hot = wanted[owner].pop(digest, None)  # once a text
                if hot is not None:
                    out.append((token, digest, hot, place - first, raw[first : last + size]))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["token", "digest", "hot", "before", "bytes"])

    return mapped(texts, rows, "token long, digest binary, hot boolean, before int, bytes binary")


def multikey_order(groups, rows):
    """The order of fixed-width byte rows inside their groups, and the bytes that neighbours share.

    Three-way: rows are parted by eight bytes at a time, and only those equal so far go on to the next eight.
    Neighbours of different groups share -1 bytes.
    """
    n, width = rows.shape
    keys = np.ascontiguousarray(rows).view(">u8").reshape(n, -1)
    order, part = np.argsort(groups, kind="stable"), np.zeros(n, np.int64)
    part[1:] = np.cumsum(np.diff(groups[order]) != 0)
    open_ = np.flatnonzero(_shared_parts(part))
    for column in range(keys.shape[1]):
        if not len(open_):
            break
        own = keys[order[open_], column].astype(np.uint64)
        by = np.lexsort((own, part[open_]))
        order[open_], own = order[open_[by]], own[by]
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (np.diff(part[open_]) != 0) | (np.diff(own) != 0)
        # A part is named by its first place, so names stay distinct and in order.
        part[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        open_ = open_[_shared_parts(part[open_])]
    shared = np.full(n, -1, np.int64)
    for a in range(1, n, 4096):
        b = min(n, a + 4096)
        differs = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        shared[a:b] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    shared[1:][np.diff(groups[order]) != 0] = -1
    return order, shared


def _shared_parts(part):
    """Which of ordered part names occur more than once."""
    same = np.diff(part) == 0
    return np.append(same, False) | np.append(False, same)


def repeated_beginnings(tokens, before, raw, size=SIZE):
    """Mask (context, beginning): the window that begins so many bytes ahead of its token repeats.

    ``tokens`` are the contexts' groups, ``before`` the bytes ahead of the token and ``raw`` the bytes; all
    are different contexts.
    """
    n, reach = len(raw), size - GRAM
    right, left = np.zeros((n, -(-size // 8) * 8), np.uint8), np.zeros((n, -(-reach // 8) * 8), np.uint8)
    lowest = np.empty(n, np.int64)
    for i, (b, r) in enumerate(zip(before.tolist(), raw)):
        own = np.frombuffer(r, np.uint8)
        right[i, : len(r) - b] = own[b:]
        left[i, :b] = own[:b][::-1]
        lowest[i] = size - (len(r) - b)  # the last window begins that many bytes ahead of the token
    by_right, share_right = multikey_order(tokens, right)
    by_left, share_left = multikey_order(tokens, left)
    found = np.zeros((n, reach + 1), bool)
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach + 1):
        own = np.flatnonzero((lowest <= o) & (o <= before))
        if len(own) < 2:
            continue
        run_right[by_right] = np.cumsum(share_right < size - o)
        run_left[by_left] = np.cumsum(share_left < max(o, 0))
        key = run_right[own] * (n + 1) + run_left[own]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        found[own[order[np.append(same, False) | np.append(False, same)]], o] = True
    return found


def _runs(mask):
    """Rows with a true entry, and for these the lists of first and last places of runs of true entries."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    held, counts = np.unique(rows, return_counts=True)
    return held, counts, begin, end - 1


def sorted_buckets(found: DataFrame, size: int) -> DataFrame:
    """digest, low, high: ranges of repeated beginnings of contexts, from buckets of suffixes."""
    import pyarrow as pa

    def search(tokens, digests, before, raw):
        unique = dict.fromkeys(zip(tokens, digests))  # the same context from several texts
        if len(unique) < len(tokens):
            pick, seen = [], set()
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    pick.append(i)
            tokens, digests, before, raw = ([c[i] for i in pick] for c in (tokens, digests, before, raw))
        _, groups = np.unique(np.array(tokens, np.int64), return_inverse=True)
        held, counts, low, high = _runs(repeated_beginnings(groups, np.array(before, np.int64), raw, size))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([digests[i] for i in held.tolist()], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(low.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(high.astype(np.int32))),
            ],
            names=["digest", "low", "high"],
        )

    def rows(batches):
        held = [[], [], [], []]
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(held[0]) >= TOGETHER and row[0] != held[0][-1]:
                    yield search(*held)
                    held = [[], [], [], []]
                for column, value in zip(held, row):
                    column.append(value)
        if held[0]:
            yield search(*held)

    dealt = found.select("token", "digest", "before", "bytes").repartitionByRange("token").sortWithinPartitions("token")
    return mapped(dealt, rows, "digest binary, low array<int>, high array<int>")


def record_batches(rows, kinds, names):
    """Arrow batches of at most ``ROWS`` of the tuples ``rows``."""
    import pyarrow as pa

    rows = iter(rows)
    while out := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)


def counted_windows(found: DataFrame, size: int) -> DataFrame:
    """The same as ``sorted_buckets`` for tokens in very many contexts, by counts of digests.

    A band of beginnings is judged at once where the bytes of all its windows together occur in two contexts;
    where only what its windows have in common does, they are judged one by one.
    """
    import pyarrow as pa

    def digest(raw):
        return hashlib.blake2b(raw, digest_size=16).digest()

    def bands(batches):
        for batch in batches:
            for token, own, before, raw in zip(*[c.to_pylist() for c in batch.columns]):
                lowest = size - (len(raw) - before)
                for band in range(lowest // BAND, before // BAND + 1):
                    low, high = max(lowest, band * BAND), min(before, band * BAND + BAND - 1)
                    a, b = before - high, before - low  # beginnings of the band's windows
                    # All windows of the band share these bytes, also where a context leads only some of them.
                    core = digest(raw[before - band * BAND : before - band * BAND - BAND + 1 + size])
                    yield token, own, band, low, high, core, digest(raw[a : b + size])

    def band_rows(batches):
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return record_batches(bands(batches), kinds, ["token", "digest", "band", "low", "high", "core", "whole"])

    narrow = found.select("token", "digest", "before", "bytes")
    schema = "token long, digest binary, band int, low int, high int, core binary, whole binary"
    banded = staged(mapped(narrow, band_rows, schema).distinct(), "bands")
    several = lambda c: F.min(c) < F.max(c)
    classes = banded.groupBy("token", "band", "core", "low", "high", "whole").agg(F.min("digest").alias("digest"), several("digest").alias("twice"))
    classes = staged(classes, "band_classes")
    settled = banded.join(classes.where("twice").select("token", "low", "high", "whole"), ["token", "low", "high", "whole"])
    settled = settled.select("digest", "low", "high")
    # One context of each class stands for it; classes without a like are settled either way.
    shared = classes.groupBy("token", "band", "core").agg(F.count("*").alias("many")).where("many > 1")
    open_ = classes.join(shared, ["token", "band", "core"], "left_semi")
    wanted = open_.groupBy("digest").agg(F.collect_set("band").alias("open"))

    def windows(batches):
        for batch in batches:
            for own, before, raw, bands_ in zip(*[c.to_pylist() for c in batch.columns]):
                lowest = size - (len(raw) - before)
                for band in bands_:
                    for o in range(max(lowest, band * BAND), min(before, band * BAND + BAND - 1) + 1):
                        yield own, o, digest(raw[before - o : before - o + size])

    def window_rows(batches):
        return record_batches(windows(batches), [pa.binary(), pa.int32(), pa.binary()], ["digest", "at", "window"])

    single = narrow.join(wanted, "digest").select("digest", "before", "bytes", "open")
    single = staged(mapped(single, window_rows, "digest binary, at int, window binary").distinct(), "windows")
    twice = single.groupBy("window").agg(several("digest").alias("twice")).where("twice").select("window")
    ones = single.join(twice, "window").select("digest", F.col("at").alias("low"), F.col("at").alias("high"))
    return settled.union(ones).distinct().groupBy("digest").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))


def kept_parts(data, offsets, marks, size=SIZE):
    """For every text what is left of it, the bytes removed and the runs removed, given per text a map from
    context digests to ranges of repeated beginnings."""
    cover = np.zeros(len(data) + 1, np.int64)
    for owner, _, place, first, last, digest in zip(*[c.tolist() if isinstance(c, np.ndarray) else c for c in contexts(data, offsets, size)]):
        for low, high in marks[owner].get(digest, ()):
            a, b = max(first, place - high), min(last, place - low)
            if a <= b:
                cover[a] += 1
                cover[b + size] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[inner] = gone[inner]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = gone[a:b]
        yield data[a:b][~own].tobytes(), int(own.sum()), int(begins[a:b].sum())


def _with_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts of the listed keys, with what the list holds of them."""
    return texts.join(_sized(keys.select("key")), "key", "left_semi").join(keys, "key")


def _sized(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def removed(docs: DataFrame, size: int = SIZE, finish=None, fields: str = "kept binary"):
    """doc_id, n_bytes, n_removed, n_spans and what ``finish`` makes of the bytes that are kept, one value of type
    ``fields``, for every row of ``docs``; by default the bytes themselves.
    """
    import pyarrow as pa

    finish = finish or (lambda raw: raw)
    name, kind = fields.split(" ", 1)
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    long = read.where(F.octet_length("text") >= size).select("key", "text")
    copies = staged(long.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "copies")

    rows = staged(context_rows(long, size), "contexts")
    known = rows.groupBy("token", "digest").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    known = staged(known, "distinct_contexts")
    groups = known.groupBy("token").agg(F.count("*").alias("g")).where("g > 1")
    wanted = known.join(groups, "token").groupBy("key").agg(
        F.collect_list(F.struct("digest", (F.col("g") > GROUP).alias("hot"))).alias("wanted")
    )
    wanted = staged(wanted, "wanted")
    found = staged(context_bytes(_with_keys(long, wanted).select("key", "text", "wanted"), size), "context_bytes")
    everywhere = F.array(F.lit(0)).alias("low"), F.array(F.lit(size)).alias("high")
    marks = known.where("n > 1").select("digest", *everywhere)
    marks = marks.union(sorted_buckets(found.where("NOT hot"), size)).union(counted_windows(found.where("hot"), size))
    marks = marks.groupBy("digest").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("high")).alias("high"))
    marked = rows.join(copies, "key", "left_anti").join(marks, "digest")
    marked = marked.groupBy("key").agg(F.collect_list(F.struct("digest", "low", "high")).alias("marks"))
    marked = staged(marked, "marks")

    def cut(batches):
        for keys, (listed,), data, offsets in _batches(batches, others=1):
            listed = [{m["digest"]: list(zip(m["low"], m["high"])) for m in row} for row in listed]
            out = [(key, finish(kept), n, k) for key, (kept, n, k) in zip(keys, kept_parts(data, offsets, listed, size))]
            made = pa.array([v for _, v, _, _ in out])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), made, pa.array([n for _, _, n, _ in out], pa.int64()), pa.array([k for _, _, _, k in out], pa.int64())],
                names=["key", name, "n_removed", "n_spans"],
            )

    parts = mapped(_with_keys(long, marked).select("key", "text", "marks"), cut, f"key binary, {name} {kind}, n_removed long, n_spans long")
    return read, copies, parts.dropDuplicates(["key"])


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are kept) for every row of ``docs``."""
    read, copies, parts = removed(docs, size, lambda raw: hashlib.sha256(raw).hexdigest(), "kept_sha256 string")
    own = read.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("same"))
    own = own.join(copies.withColumn("gone", F.lit(True)), "key", "left").join(parts, "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return own.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "same")).alias("kept_sha256"),
    )


def kept_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id and the bytes that are kept (a cut may fall inside a character) for every row of ``docs``."""
    read, copies, parts = removed(docs, size)
    own = read.join(copies.withColumn("gone", F.lit(True)), "key", "left").join(parts.select("key", "kept"), "key", "left")
    left = F.coalesce("kept", F.col("text").cast("binary"))
    return own.select("doc_id", F.when(F.col("gone"), F.lit(b"")).otherwise(left).alias("kept"))
