"""Ranked search against direct scoring of every document."""

import collections
import math
import random
import re

import pytest

from areapanel.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    real = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    total, length = len(real), sum(w.total() for _, w in real)
    held = collections.Counter(t for _, w in real for t in w)
    found = []
    for item, text in items:
        hits = []
        for doc, words in real:
            score, m = 0, 25 + 75 * words.total() * total // length
            for t in terms(text):
                tf, df = words[t], held[t]
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 8 * m)) if tf else 0
            if score > 0:
                hits.append((-score, doc is None, doc or 0, doc))
        found += [(item, k, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(hits, key=lambda h: h[:3])[:top], 1)]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    stock = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(400)]
    docs = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(200, docs[0][1]), (201, docs[0][1]), (0, docs[0][1]), (None, docs[0][1]), (202, None), (203, ""), (204, "., !"),
             (205, "É É-x " * 40000), (206, "w1_W1 w1"), (207, "z" * 3000)]
    items = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(1, 12)))) for i in range(12)]
    items += [(3, items[4][1]), (20, None), (21, ""), (22, "nowhere at all"), (23, "w1 w1 W1 É"), (None, "w2 w3"), (24, docs[0][1]), (25, "z" * 3000)]
    return docs, items


@pytest.mark.parametrize("top, rows, block", [(10, 1 << 14, 1 << 22), (3, 20, 500)])
def test_search(spark, monkeypatch, corpus, top, rows, block):
    monkeypatch.setattr(lexical, "TRIE_ROWS", rows)
    docs = spark.createDataFrame([(*r, "clash") for r in corpus[0]], "doc_id long, text string, rank string").repartition(3)
    items = spark.createDataFrame([(*r, 1) for r in corpus[1]], "item_id long, text string, score int")
    got = lexical.search(docs, items, top, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(*corpus, top)


def test_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []


def test_subtrees_are_left_out():
    """The bound spares most of the documents: with one clear winner, few rows are scored."""
    import numpy as np

    n, scored = 2000, []
    held = np.array([n, 1, *[5] * 400], np.int64)
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([[0], rng.integers(2, 402, 3)])) for _ in range(n - 1)] + [np.array([0, 1])]
    vocabulary = [str(i).encode() for i in range(402)]
    queries = lexical.Queries([(0, {b"0": 1, b"1": 1})], vocabulary, n, 4 * n, held)
    trie = lexical.Trie(np.concatenate(rows), np.ones(sum(map(len, rows)), np.int64), np.cumsum([len(r) for r in rows]),
                        np.full(n, 100), list(range(n)), queries.rank)
    best, work = lexical.Best(1, 1), np.zeros(402, np.int64)
    score = lexical.Trie._score
    trie._score = lambda *a: (scored.append(a[4] - a[3]), score(trie, *a))
    trie.search(queries, best, work)
    assert best.found[0][0][2] == n - 1 and sum(scored) < n / 10
