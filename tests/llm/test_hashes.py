"""Words built to share one polynomial hash, through the operators that tell words apart by hashes, and a
context tree whose passes meet the rows in other tasks each time."""

import collections
import hashlib
import math
import pickle
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from areapanel.llm import byte_bpe, context_tree, cover_tree, jaccard, lexical, ratio_rules, textscan, tokens


@pytest.fixture(scope="module")
def twins():
    """A Thue-Morse word of 1024 letters and its complement: any polynomial in an odd base modulo 2^64 confuses them."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def docs(spark, twins):
    rest = " ".join(f"w{i}" for i in range(3))
    rows = [(0, twins[0]), (1, twins[1]), (2, f"{twins[0]} {rest}"), (3, f"{twins[1]} {rest}"), (4, twins[0])]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_hashes_differ(twins):
    for lane in (0, 1):
        a, b = (textscan.word_hashes(np.frombuffer(w.encode(), np.uint8), [0], [1024], lane)[0] for w in twins)
        assert a != b
    short = [textscan.word_hashes(np.frombuffer(w[:500].encode(), np.uint8), [0], [500])[0] for w in twins]
    assert short[0] != short[1]


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 16, 17, 511, 512, 513, 5000])
def test_hashes_of_ranges(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 256, 3 * size + 40).astype(np.uint8)
    data[size + 11 : 2 * size + 11] = data[3 : size + 3]
    a, b, c = textscan.word_hashes(data, [3, size + 11, 4], [size + 3, 2 * size + 11, size + 4])
    assert a == b and (a == c) == (size == 0 or (data[3 : size + 3] == data[4 : size + 4]).all())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(twins, name):
    path = public_tokenizers.path(name)
    own, library = tokens.Encoder(tokens.definition_of(path)), Tokenizer.from_file(path)
    column = pa.array([*twins, f"{twins[0]} {twins[1]}", twins[1]])
    for first, ids, ends in tokens.encoded_slices(own, column):
        for k in range(len(ends) - 1):
            want = library.encode(column[first + k].as_py(), add_special_tokens=False).ids
            assert ids[ends[k] : ends[k + 1]].tolist() == want


def test_operators(spark, docs, twins):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs, width=4, percent=85).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    decoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                              finish=lambda ids, raw: (hashlib.sha256(raw).hexdigest(),), fields="digest string")
    assert {r["doc_id"]: r["digest"] for r in decoded.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    known = {r["doc_id"]: r["n_known"] for r in context_tree.score(docs.where("doc_id IN (0, 1)"), depth=2).collect()}
    learned = [i for i in (0, 1) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert known == {i: 1 * (i in learned) + (len(learned) > 0) for i in (0, 1)}
    found = lexical.search(docs, spark.createDataFrame([(1, twins[0])], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 2, 4]


def test_labels_with_slashes(spark):
    """Labels are never parts of one another's names."""
    near = [[1.0, 0.01 * k, 0.0] for k in range(3)]
    rows = [(i, near[i % 3], label) for i, label in enumerate(["a/b", "a/c", "a", "a/b", "/", "a/", "a:3"])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(df, 0.98).collect()}
    assert got == {0: (1, 0), 3: (1, 0)} | {i: (0, i) for i in (1, 2, 4, 5, 6)}


def test_ids_with_two_texts(spark):
    """A copy of another document beside a near copy of a third, under one id: both links are kept."""
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    rows = [(1, "an exact copy of these words"), (5, "an exact copy of these words"), (5, " ".join(near)), (9, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs, width=4, percent=85).collect()} == {1: 1, 5: 1, 9: 1}
    alone = docs.where("doc_id = 5")
    assert sorted(map(tuple, jaccard.keep_first(alone).collect())) == sorted(r for r in rows if r[0] == 5)


def test_sets_of_many_shingles():
    """Counts of common shingles stay whole numbers beyond what a float holds."""
    size = 671_089
    left = np.arange(size, dtype=np.uint64)
    right = np.concatenate([left, np.arange(size, size + (size * 15) // 85, dtype=np.uint64)]) + np.uint64(0)
    for extra in (0, 1):
        whole = len(right) + extra
        near = jaccard.similar_pairs([left], [np.concatenate([right, np.arange(10**9, 10**9 + extra, dtype=np.uint64)])], 85)
        assert near[0, 0] == (100 * size >= 85 * whole)


def test_ratio_verdict(spark):
    """Scores by the same counts in plain Python, over all labelled texts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40 + i, 60)) for i in range(40)] + [None, "few words"]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").withColumn("good", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(42)] + [(0, 0), (None, 1)], "doc_id long, quality int")

    def grams(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return ratio_rules.buckets(data, np.array([0, len(data)]))[0].tolist()

    corpus, target = collections.Counter(), collections.Counter()
    for i, text in [*enumerate(texts), (None, texts[0])]:
        corpus.update(grams(text))
        if i is not None and i % 3 == 0:
            target.update(grams(text))
    n, m, b = corpus.total() + ratio_rules.BUCKETS, target.total() + ratio_rules.BUCKETS, ratio_rules.BUCKETS
    assert b == 65536
    for r in ratio_rules.judge(docs, labels, threshold=0.0).collect():
        own = grams(texts[r["doc_id"] or 0])
        score = sum(math.log((target[g] + 1) / m) - math.log((corpus[g] + 1) / n) for g in own) / max(len(own), 1)
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0)


def test_passes_in_other_tasks(spark, tmp_path, monkeypatch):
    """Every pass plans its scan anew; here each meets the rows in other splits, as after a lost executor."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 90, 30))) for i in range(80)] + [(3, "again"), (None, "none"), (81, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    cost = "spark.sql.files.openCostInBytes"

    def scores(**more):
        found = context_tree.score(spark.read.parquet(f"{tmp_path}/docs"), depth=4, **more).collect()
        return sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["score"]) for r in found), key=repr)

    whole, before, passes = scores(), spark.conf.get(cost), []
    plain = context_tree._pass

    def moved(source, shared):
        spark.conf.set(cost, str((1 << 20) * (1 + 16 * len(passes))))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << (12 + 6 * (len(passes) % 3))))
        again = spark.read.parquet(f"{tmp_path}/docs").select("doc_id", "text").orderBy("text")
        passes.append(again.rdd.getNumPartitions())
        return plain(again, shared)

    monkeypatch.setattr(context_tree, "_pass", moved)
    try:
        cut = scores(rows_at_once=800)
    finally:
        spark.conf.set(cost, before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(passes) >= 2 and len(cut) == len(whole) == docs.count()
    for a, b in zip(whole, cut):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-5)


class _Sent:
    """A broadcast as a worker sees it; counts how often its value is read."""

    def __init__(self, value):
        self.held, self.reads = value, 0

    @property
    def value(self):
        self.reads += 1
        return pickle.loads(pickle.dumps(self.held))


def test_byte_bpe_worker_memory():
    """The words of a run are read once a worker, however often it changes its step, and held narrowly."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert max(ranks.values()) < 1 << 16  # queries._digests
    vocabulary = byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    assert len(pickle.dumps(vocabulary)) < 20_000
    words = list(ranks)[:30_000]
    known = byte_bpe.Lexicon(byte_bpe._hashed(words), np.ones(len(words), np.int64), np.arange(len(words), dtype=np.uint32))
    assert len(pickle.dumps(known)) < 16 * len(words)
    assert known.ids[known.begin[known.find(byte_bpe._hashed(words[7:9]))]].tolist() == [7, 8]
    shared, sent = _Sent(vocabulary), _Sent(known)
    first = byte_bpe._splitter("one run", shared, sent)
    assert byte_bpe._splitter("one run", _Sent(vocabulary), again := _Sent(known)) is first
    assert (sent.reads, again.reads) == (1, 0)
    assert byte_bpe._splitter("another run", shared, sent) is not first
    byte_bpe._SPLITTERS.clear()
