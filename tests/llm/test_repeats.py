"""Removal of repeated strings against a table of all windows, and the sort against Python's."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from areapanel.llm import repeats


def brute(docs, size):
    raw = [(i, (t or "").encode()) for i, t in docs]
    counts = collections.Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    found = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if counts[b[p : p + size]] > 1:
                gone[p : p + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        found.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice(["the ", "of ", "é", "in ", "x", "ab ", "\n"]) for _ in range(n))
    passage, longer = prose(260), prose(900)
    texts = [None, "", "short", "a" * 399, prose(60), prose(700), longer, longer, "b" * 1200, "cd" * 600 + "e" + "cd" * 500, "\x00" * 401]
    texts += [prose(rng.randrange(0, 200)) + passage + prose(rng.randrange(0, 200)) for _ in range(12)]
    for _ in range(6):  # near copies
        at = rng.randrange(200, 700)
        texts.append(longer[:at] + prose(2) + longer[at:])
    texts += [longer[100:650] + longer[40:800], passage[:180] + passage[-100:], prose(400) + "\x00" * 500, passage[30:] * 2]
    docs = list(enumerate(texts))
    return docs + [docs[4], (None, texts[6]), (None, "no id " * 100)]


def frame(spark, docs):
    return spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, key string").repartition(3)


@pytest.mark.parametrize("size, group, together, keys", [(400, 1 << 14, 1 << 12, 1 << 20), (400, 2, 1, 0), (100, 5, 3, 1 << 20)])
def test_without_repeats(spark, monkeypatch, corpus, size, group, together, keys):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(repeats, "TOGETHER", together)
    got = repeats.without_repeats(frame(spark, corpus), size)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(corpus, size)


def test_kept_bytes(spark, corpus):
    kept = [(r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.kept_bytes(frame(spark, corpus), 400).collect()]
    assert sorted(kept, key=repr) == sorted([(i, d) for i, _, _, _, d in brute(corpus, 400)], key=repr)


def test_empty(spark, corpus):
    assert repeats.without_repeats(frame(spark, corpus).where("false")).collect() == []


def test_pieces_of_a_long_text(monkeypatch):
    """Texts longer than a piece have the same windows led by the same tokens."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 60_000).astype(np.uint8)
    offsets = np.array([0, len(data)])
    led = lambda: {p: (h, x) for _, h, x, a, b in zip(*repeats.anchors(data, offsets)) for p in range(a, b + 1)}
    whole = led()
    monkeypatch.setattr(repeats, "PIECE", 7001)
    assert led() == whole and sorted(whole) == list(range(len(data) - 399))


def test_text_of_a_megabyte(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    docs = [(1, long), (2, "z" * 50 + long[600_000:600_500] + "y" * 300), (3, long[100:499])]
    got = {r["doc_id"]: tuple(r)[1:4] for r in repeats.without_repeats(frame(spark, docs)).collect()}
    assert got == {1: (1_200_000, 500, 1), 2: (850, 500, 1), 3: (399, 0, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_multikey_order(seed):
    rng = np.random.default_rng(seed)
    groups, rows = rng.integers(0, 5, 300), rng.integers(0, 3, (300, 40)).astype(np.uint8)
    rows[rng.integers(0, 300, 150)] = rows[rng.integers(0, 300, 150)]
    rows[rng.integers(0, 300, 60), :30] = rows[7, :30]
    order, shared = repeats.multikey_order(groups, rows)
    keys = [(g, r.tobytes()) for g, r in zip(groups.tolist(), rows)]
    assert [keys[i] for i in order] == sorted(keys)
    for k in range(1, 300):
        (g, a), (h, b) = keys[order[k - 1]], keys[order[k]]
        n = next((i for i in range(40) if a[i] != b[i]), 40)
        assert shared[k] == (n if g == h else -1)


def test_work_arrays_of_many_texts():
    """A batch of many megabytes is worked on in small slices, so a worker's arrays do not grow with it."""
    rng = np.random.default_rng(4)
    texts = [bytes(t).decode() for t in rng.integers(97, 123, (2000, 3000)).astype(np.uint8)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(len(texts))]), pa.array(texts)], names=["key", "text"])
    tracemalloc.start()
    found = sum(len(repeats.contexts(data, offsets)[0]) for _, _, data, offsets in repeats._batches([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= len(texts) and most < 48 << 20


def test_slices_do_not_change_contexts(monkeypatch):
    """Steps that meet a text in other slices must find the same contexts, also of texts longer than a slice."""
    rng = np.random.default_rng(6)
    texts = [bytes(t).decode() for n in (500, 90_000, 3000, 399, 20_000, 0, 450) for t in [rng.integers(97, 100, n).astype(np.uint8)]]

    def found(texts):
        batch = pa.RecordBatch.from_arrays([pa.array([t[:500].encode() for t in texts], pa.binary()), pa.array(texts)], names=["key", "text"])
        return sorted((keys[o], d) for keys, _, data, offsets in repeats._batches([batch]) for o, *_, d in zip(*repeats.contexts(data, offsets)))

    whole = found(texts)
    monkeypatch.setattr(repeats, "SLICE", 4000)
    assert found(texts) == whole == sorted(d for t in texts for d in found([t]))


def test_rows_are_handed_on():
    """Bands and windows of a batch of contexts leave a task in parts, in order; none without rows."""
    n = 2 * repeats.ROWS + 5
    made = list(repeats.record_batches(((i, b"x") for i in range(n)), [pa.int64(), pa.binary()], ["at", "window"]))
    assert [b.num_rows for b in made] == [repeats.ROWS, repeats.ROWS, 5]
    assert [i for b in made for i in b.column("at").to_pylist()] == list(range(n))
    assert list(repeats.record_batches([], [pa.int64()], ["at"])) == []
