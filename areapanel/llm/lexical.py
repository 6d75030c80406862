"""Ranked lexical search by branch and bound over an FP-tree of the documents.

Terms are runs of bytes that are neither ASCII punctuation, space nor control, A to Z in lower case. A
document's score for an item is the sum, over the item's terms with repeats, of
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``, where w falls with the number of documents that
hold the term and m grows with the document's length: whole numbers throughout, w from doubles.

One pass over the texts keeps of every document its length and the counts of the items' terms (the
restricted vector). Vectors list their terms by falling document frequency, so documents that share
their common terms share a path from the root of a trie. A subtree is a range of the vectors in
order; it bounds the score of everything below it by the largest count of each term and the smallest
m it holds. All items go down the trie together, most promising subtree first, and each leaves a
subtree whose bound does not reach its tenth best score so far. Every task returns its ten best rows an
item; ranks are taken over these.

Items are handled in blocks of about ``BLOCK_BYTES`` of text, so what is sent to the tasks is bounded
however many items there are. Terms are found by hash and then compared byte by byte.

Defined results: null texts, and texts without a term, are no documents and no queries; every row of
``items`` is ranked, also if its id repeats or is null; every row of ``docs`` is a document of its own,
so repeated rows take several ranks; null ids come after all others among equal scores; items without a
hit, empty tables and an empty corpus give no rows; texts of any length are counted whole; further
columns are ignored.
"""

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapanel.session import staged

from . import textscan
from .common import mapped

TOP = 10
BLOCK_BYTES = 4 << 20
#: Documents, and entries of their vectors, that one trie holds at most (one document is never cut).
TRIE_ROWS = 1 << 14
TRIE_ENTRIES = 1 << 21
#: Subtrees of up to so many documents are scored one by one.
LEAF = 8

#: Bytes that end a term: ASCII other than letters and digits.
BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = BREAK[128:] = False


def item_terms(text):
    """Terms of one text with their numbers, as bytes."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    data = textscan.LOWER[raw]
    starts, ends, _ = textscan.spans(data, np.array([0, len(data)]), BREAK)
    whole, counts = data.tobytes(), {}
    for a, b in zip(starts.tolist(), ends.tolist()):
        counts[whole[a:b]] = counts.get(whole[a:b], 0) + 1
    return counts


class Vocabulary:
    """The terms of a block of items; finds them among the terms of texts."""

    def __init__(self, terms):
        sizes = np.array([len(t) for t in terms], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        hashes = textscan.word_hashes(self.data, self.starts, self.ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.size = len(terms)

    def find(self, data, starts, ends):
        """The number of each term, -1 for terms of no item."""
        found = np.full(len(starts), -1, np.int64)
        if not self.size or not len(starts):
            return found
        hashes = textscan.word_hashes(data, starts, ends)
        left, right = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        while len(open_ := np.flatnonzero((left < right) & (found < 0))):
            term = self.order[left[open_]]
            same = self._same(data, starts[open_], ends[open_], term)
            found[open_[same]] = term[same]
            left[open_] += 1
        return found

    def _same(self, data, starts, ends, terms):
        sizes = ends - starts
        same = sizes == self.ends[terms] - self.starts[terms]
        rows = np.flatnonzero(same & (sizes > 0))
        many = sizes[rows]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        differs = data[np.repeat(starts[rows], many) + inside] != self.data[np.repeat(self.starts[terms[rows]], many) + inside]
        same[rows[np.repeat(np.arange(len(rows)), many)[differs]]] = False
        return same


def restricted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms of the text), terms and counts (little-endian int32), for texts with a term."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def lists(values, ends):
        offsets = (4 * np.concatenate([[0], ends])).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<i4").tobytes())])

    def rows(batches):
        own = vocabulary.value
        for batch in batches:
            for first, data, offsets in textscan.slices(batch.column(1)):
                n = len(offsets) - 1
                data = textscan.LOWER[data]
                starts, ends, owners = textscan.spans(data, offsets, BREAK)
                sizes = np.bincount(owners, minlength=n)
                term = own.find(data, starts, ends)
                hit = term >= 0
                pairs, counts = np.unique(owners[hit] * max(own.size, 1) + term[hit], return_counts=True)
                per = np.bincount(pairs // max(own.size, 1), minlength=n)
                part = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes), lists(pairs % max(own.size, 1), np.cumsum(per)), lists(counts, np.cumsum(per))],
                    names=["doc_id", "n", "terms", "counts"],
                )
                yield part.filter(pa.array(sizes > 0))

    return mapped(docs.select("doc_id", "text"), rows, f"doc_id {kind}, n long, terms binary, counts binary")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of ``size`` terms occurs: partial sums of every task, then added."""
    import pyarrow as pa

    def rows(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0):
                total[np.frombuffer(terms.as_buffer(), "<i4")] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    found = np.zeros(size, np.int64)
    counted = mapped(vectors.select("terms"), rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for term, n in counted.collect():  # at most the terms of one block of items
        found[term] = n
    return found


class Queries:
    """Items of a block as one sparse matrix: weights (w times repeats) of their terms, item by item."""

    def __init__(self, items, vocabulary, total, length, held):
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        place = {t: i for i, t in enumerate(vocabulary)}
        rows = [[(place[t], k) for t, k in terms.items()] for _, terms in items]
        self.ids = [i for i, _ in items]
        self.terms = np.array([t for row in rows for t, _ in row], np.int64)
        self.weights = np.array([k for row in rows for _, k in row], np.int64) * weight[self.terms]
        self.ends = np.cumsum([len(row) for row in rows])
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.size, self.total, self.length = len(held), total, length
        #: Place of each term in falling document frequency.
        self.rank = np.empty(len(held), np.int64)
        self.rank[np.lexsort((np.arange(len(held)), -held))] = np.arange(len(held))

    def norm(self, n):
        """m of documents of ``n`` terms; in Python's whole numbers where 64 bits might not do."""
        if len(n) and 75 * int(n.max()) * self.total >= 1 << 63:
            return np.array([25 + 75 * int(x) * self.total // self.length for x in n], np.int64)
        return 25 + 75 * n * self.total // self.length

    def scores(self, active, gains):
        """Scores of the ``active`` items, given the gain of every term."""
        if len(active) == len(self.ids):
            return np.add.reduceat(self.weights * gains[self.terms], self.starts)
        many = self.ends[active] - self.starts[active]
        first = np.cumsum(many) - many
        at = np.repeat(self.starts[active] - first, many) + np.arange(many.sum())
        return np.add.reduceat(self.weights[at] * gains[self.terms[at]], first)


def gain(tf, m):
    return 1000000000 * tf // (1000 * tf + 8 * m)


class Best:
    """The ten best (score, document) of every item that a task has met so far."""

    def __init__(self, items, top):
        self.top = top
        self.found = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # a document needs a score of at least this

    def offer(self, item, score, key, doc):
        best = self.found[item]
        best.append((-score, key, doc))
        if len(best) > self.top:
            best.sort(key=lambda x: x[:2])
            best.pop()
        if len(best) == self.top:
            self.least[item] = -max(x[0] for x in best)


class Trie:
    """Restricted vectors in the order of their terms; a subtree is a range of rows that share a path."""

    def __init__(self, terms, counts, ends, m, ids, rank):
        owners = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        order = np.lexsort((rank[terms], owners))
        terms, counts, ranked = terms[order], counts[order], rank[terms[order]]
        begins = np.concatenate([[0], ends[:-1]])
        paths = [ranked[a:b].astype(">i4").tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
        rows = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        many = (ends - begins)[rows]
        at = np.repeat(begins[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.terms, self.counts, self.ranks = terms[at], counts[at], ranked[at]
        self.ends = np.cumsum(many)
        self.starts = self.ends - many
        self.m, self.ids = m[rows], [ids[i] for i in rows.tolist()]

    def shared(self, low, high, depth):
        """How many terms all rows from ``low`` to ``high`` share: those of the first and last row."""
        a, b = self.starts[low], self.starts[high - 1]
        n = min(self.ends[low] - a, self.ends[high - 1] - b)
        differs = np.flatnonzero(self.ranks[a + depth : a + n] != self.ranks[b + depth : b + n])
        return depth + int(differs[0]) if len(differs) else int(n)

    def children(self, low, high, depth):
        """Ranges of rows with the same next term after the shared path; rows that end there come first."""
        depth = self.shared(low, high, depth)
        at = self.starts[low:high] + depth
        ended = at >= self.ends[low:high]
        following = np.where(ended, -1, self.ranks[np.minimum(at, len(self.ranks) - 1)])
        cuts = np.flatnonzero(np.diff(following)) + 1
        bounds = [low, *(low + cuts).tolist(), high]
        if len(bounds) == 2:  # equal vectors
            middle = (low + high) // 2
            return [(low, middle, depth), (middle, high, depth)]
        # Single rows among the children are scored together.
        found = []
        for a, b in zip(bounds, bounds[1:]):
            if found and b - a + found[-1][1] - found[-1][0] <= LEAF:
                found[-1] = (found[-1][0], b, depth)
            else:
                found.append((a, b, depth))
        return found

    def bound(self, queries, active, low, high, work):
        """For the ``active`` items, a score that no row from ``low`` to ``high`` exceeds."""
        part = slice(self.starts[low], self.ends[high - 1])
        np.maximum.at(work, self.terms[part], self.counts[part])
        held = self.terms[part] if high - low == 1 else np.flatnonzero(work)
        gains = np.zeros(queries.size, np.int64)
        gains[held] = gain(work[held], int(self.m[low:high].min()))
        work[held] = 0
        return queries.scores(active, gains)

    def search(self, queries, best, work):
        everything = np.arange(len(queries.ids))
        heap = [(0, len(self.ids), 0, everything, None)]
        while heap:
            low, high, depth, active, bounds = heap.pop()
            if bounds is not None:
                live = (bounds >= best.least[active]) & (bounds > 0)
                active = active[live]
                if not len(active):
                    continue
            if high - low <= LEAF:
                self._score(queries, best, active, low, high, work)
                continue
            below = []
            for a, b, d in self.children(low, high, depth):
                found = self.bound(queries, active, a, b, work)
                live = (found >= best.least[active]) & (found > 0)
                if live.any():
                    below.append((int(found.max()), (a, b, d, active[live], found[live])))
            below.sort(key=lambda x: x[0])  # the most promising is popped first
            heap += [x for _, x in below]

    def _score(self, queries, best, active, low, high, work):
        for row in range(low, high):
            found = self.bound(queries, active, row, row + 1, work)  # of one row: its scores
            doc = self.ids[row]
            for at in np.flatnonzero((found >= best.least[active]) & (found > 0)).tolist():
                best.offer(int(active[at]), int(found[at]), (doc is None, doc if doc is not None else 0), doc)


def _best_rows(vectors: DataFrame, shared, top: int, schema: str) -> DataFrame:
    import pyarrow as pa

    item_kind, doc_kind = vectors.sparkSession.createDataFrame([], schema).schema.fields[1:3]

    def rows(batches):
        queries = shared.value
        best, work = Best(len(queries.ids), top), np.zeros(queries.size, np.int64)
        held, entries = [], 0

        def search():
            terms = [np.frombuffer(t, "<i4").astype(np.int64) for _, _, t, _ in held]
            counts = [np.frombuffer(c, "<i4").astype(np.int64) for _, _, _, c in held]
            ends = np.cumsum([len(t) for t in terms])
            m = queries.norm(np.array([n for _, n, _, _ in held], np.int64))
            Trie(np.concatenate(terms), np.concatenate(counts), ends, m, [d for d, _, _, _ in held], queries.rank).search(queries, best, work)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(row[2]):
                    held.append(row)
                    entries += len(row[2]) // 4
                    if len(held) >= TRIE_ROWS or entries >= TRIE_ENTRIES:
                        search()
                        held, entries = [], 0
        if held:
            search()
        out = [(i, queries.ids[i], doc, -score) for i, found in enumerate(best.found) for score, _, doc in found]
        kinds = [pa.int64(), _arrow(item_kind), _arrow(doc_kind), pa.int64()]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["place", "item_id", "doc_id", "score"])

    return mapped(vectors, rows, schema)


def _arrow(field):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of every row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    known = items.where("text IS NOT NULL").select("item_id", "text")
    blocks = 1 + (known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    known = staged(known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    item_kind, doc_kind = (df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id")))
    schema = f"place long, item_id {item_kind}, doc_id {doc_kind}, score long"
    found = [_search_block(spark, docs, known.where(F.col("block") == b), top, schema) for b in range(blocks)]
    found = [f.withColumn("block", F.lit(b)) for b, f in enumerate(found) if f is not None]
    if not found:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search_block(spark, docs, block, top, schema):
    """Best rows of every task for one block of items (about ``block_bytes`` of text come to the driver)."""
    items = [(r["item_id"], item_terms(r["text"])) for r in block.collect()]
    items = [(i, terms) for i, terms in items if terms]
    if not items:
        return None
    vocabulary = sorted({t for _, terms in items for t in terms})
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))
    vectors = staged(restricted(docs, shared), "vectors")
    total, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    held = document_frequencies(vectors, len(vocabulary))
    queries = spark.sparkContext.broadcast(Queries(items, vocabulary, total, length, held))
    return staged(_best_rows(vectors, queries, top, schema), "best")
