"""Words and word hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and the controls 9 to 13. Texts are handled in slices of
a few megabytes, so the work arrays stay small however large an Arrow batch is; one text is never cut.
"""

import hashlib

import numpy as np

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x):
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column):
    """The bytes and the offsets of an Arrow string column; a null text is empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(
        column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32
    )[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column, limit=SLICE_BYTES):
    """(first row, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data, offsets, space=SPACE):
    """Starts, ends and text numbers of the words; no word crosses the end of a text."""
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: The first so many bytes of the eight that are read at once.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Words up to this size are hashed eight bytes at a time, all words at once; longer ones one by one.
LONG = 512


def word_hashes(data, starts, ends, lane=0):
    """64-bit hashes of byte ranges; lanes are independent of each other.

    Each step scrambles all that came before, together with the next eight bytes, by a bijection, so
    ranges of equal length up to eight bytes never share a value. Ranges over ``LONG`` bytes get a BLAKE2 digest.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    value = mix(sizes.astype(np.uint64) + np.uint64(lane << 32))
    left, at, rest = slice(None), starts, sizes
    for _ in range(0, LONG, 8):
        chunk = eight[at] & _FIRST[np.minimum(rest, 8)]
        value[left] = mix((value[left] ^ chunk) * _ODD)
        more = np.flatnonzero(rest > 8)
        if not len(more):
            break
        left = more if isinstance(left, slice) else left[more]
        at, rest = at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        value[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([lane])).digest(), "little")
    return value


def counts_of(owners, n):
    return np.bincount(owners, minlength=n)


def shingles(hashes, owners, n, width):
    """Hashes and owners of the word runs of ``width`` words; a shorter text is one run."""
    per = counts_of(owners, n)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    long = np.zeros(0, np.uint64)
    own = np.zeros(0, owners.dtype)
    if len(hashes) >= width:
        k = len(hashes) - width + 1
        same = owners[:k] == owners[width - 1 :]
        value = np.zeros(k, np.uint64)
        for i in range(width):
            value += hashes[i : k + i] * factors[i]
        long, own = mix(value[same]), owners[:k][same]
    short = np.flatnonzero((per > 0) & (per < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per)])
        value = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            has = per[short] > i
            value[has] += hashes[first[short[has]] + i] * factors[i]
        value = mix(value ^ mix(np.uint64(977) + per[short].astype(np.uint64)))
        long, own = np.concatenate([long, value]), np.concatenate([own, short])
    return long, own


def distinct_per_owner(values, owners):
    """Values and owners without repeats, ordered by owner, then value."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    if len(values):
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
        values, owners = values[fresh], owners[fresh]
    return values, owners
