"""Byte-level BPE by folding ranked merges over the bytes of distinct words, and decoding.

The merging is Spark's own: a word is an array of pieces, kept as a string with one character per
piece (token id plus ``FIRST``), beside a string of the ranks of its neighbouring pairs. A fold takes the
pair of lowest rank, the leftmost of equals, merges it and looks up the two new neighbours, until
no pair has a rank. The rank map is a literal: for every left piece a displacement, and in one long
array, at displacement plus right piece, the owner of the slot and the rank.

Words are encoded once. The corpus is asked for its distinct words and their counts; the
commonest, ``COMMON`` at most, are folded and sent to the tasks with the single tokens. A task splits
its texts, replaces known words, and passes on one row per megabyte of text: ids with marks for
the words it does not know, and those words, each once. They are folded in that row, and the next
step puts them in place. No words are joined or shuffled, and none is left out.

A word is looked up by a 64-bit hash of its bytes; words split by the same pattern as a text's, and
texts are first cut where the pattern certainly splits.

Defined results: a null text is empty and has no ids; repeated rows are encoded row by row; null ids
are kept; an empty table gives no rows; further columns are ignored. A word of n bytes takes up to n
steps of the fold, each over the whole word.
"""

import base64
import json
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged

from . import textscan, tokens
from .common import common_words, mapped

COMMON = 1 << 20
FIRST = 256
NONE = chr(0x10FFFF)
MARK = np.uint32(1 << 31)
SURROGATES = 0xD800
_CHUNK = 1 << 20
#: Distinct stretches that a worker keeps, about 40 bytes each; then it starts anew.
KNOWN_STRETCHES = 250_000


def read_ranks(path: str) -> dict:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def symbol(ids):
    """The characters of token ids (surrogates are passed over)."""
    ids = np.asarray(ids, np.int64) + FIRST
    return np.where(ids >= SURROGATES, ids + 0x800, ids).astype("<u4").tobytes().decode("utf-32-le")


def token_ids(text: str):
    """Token ids of a string of characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(codes >= SURROGATES, codes - 0x800, codes) - FIRST


@lru_cache(maxsize=2)
def pair_table(path: str):
    """Displacements by left piece, and owner and rank by slot, for all pairs that merge.

    Left pieces with most pairs are placed first, each at the first displacement without a clash.
    """
    ranks = read_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs.setdefault(left, []).append((right, rank))
    n = max(ranks.values()) + 1
    size = 4 * n + 2 * sum(map(len, pairs.values()))
    used, owner, value = np.zeros(size, bool), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    shift = np.zeros(n, np.int64)
    for left in sorted(pairs, key=lambda a: (-len(pairs[a]), a)):
        right, rank = np.array(sorted(pairs[left])).T
        offset, begin = right - right[0], 0
        while True:
            tried = np.arange(begin, begin + 4096)
            free = np.ones(4096, bool)
            for x in offset:
                free &= ~used[tried + x]
                if not free.any():
                    break
            if free.any():
                break
            begin += 4096
        at = tried[free.argmax()]
        used[at + offset], owner[at + offset], value[at + offset] = True, left, rank
        shift[left] = at - right[0]
    end = int(np.flatnonzero(used).max(initial=0)) + 1
    return shift, owner[:end], value[:end]


def _literal(values, kind):
    """A literal array; the optimiser reads the text once."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def folder(path: str):
    """A function from arrays of words (one character per byte's token) to arrays of their tokens."""
    shift, owner, value = pair_table(path)
    codes = lambda ids: [ord(c) for c in symbol(ids)]
    # Slots are addressed by character codes, so displacements absorb the two offsets.
    by_code = np.zeros(max(codes([len(shift) - 1])) + 1, np.int64)
    by_code[codes(np.arange(len(shift)))] = shift
    if len(by_code) > SURROGATES:
        raise ValueError("vocabularies beyond the basic plane need a gap in the slots")
    table = F.struct(
        _literal((by_code - FIRST).tolist(), "array<int>").alias("shifts"),
        _literal(np.where(owner < 0, -1, owner + FIRST).tolist(), "array<int>").alias("owners"),
        _literal(list(symbol(value)), "array<string>").alias("merged"),
    )

    def let(value, function):
        return F.get(F.transform(F.array(value), function), F.lit(0))

    one, rest = F.lit(1), F.lit(1 << 30)

    def lowest(state):
        at = F.call_function("locate", F.array_min(F.split(state["ranks"], "")), state["ranks"])
        return F.struct(state["pieces"].alias("pieces"), state["ranks"].alias("ranks"), at.alias("at"))

    def fold_with(word: Column, ranked: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            code = F.ascii(left)
            slot = F.get(ranked["shifts"], code) + F.ascii(right)
            return F.when(F.get(ranked["owners"], slot) == code, F.get(ranked["merged"], slot)).otherwise(F.lit(NONE))

        def merge(state, _):
            pieces, ranks, at = state["pieces"], state["ranks"], state["at"]
            new = F.substring(ranks, at, one)
            left = F.when(at > 1, rank(F.substring(pieces, at - 1, one), new)).otherwise("")
            right = F.when(at < F.length(ranks), rank(new, F.substring(pieces, at + 2, one))).otherwise("")
            after = F.struct(
                F.concat(F.substring(pieces, one, at - 1), new, F.substring(pieces, at + 2, rest)).alias("pieces"),
                F.concat(F.substring(ranks, one, at - 2), left, right, F.substring(ranks, at + 2, rest)).alias("ranks"),
            )
            return F.when((new == NONE) | (new == ""), state).otherwise(let(after, lowest))

        n = F.length(word)
        pairs = F.transform(F.sequence(one, n - 1), lambda i: rank(F.substring(word, i, one), F.substring(word, i + 1, one)))
        begin = let(F.struct(word.alias("pieces"), F.array_join(pairs, "").alias("ranks")), lowest)
        return F.when(n < 2, word).otherwise(F.aggregate(F.sequence(F.lit(2), n), begin, merge, lambda s: s["pieces"]))

    # The rank map stands once in the plan, bound to a name, however often it is asked.
    return lambda words: let(table, lambda ranked: F.transform(words, lambda word: fold_with(word, ranked)))


class Vocabulary:
    """Byte characters and the pattern, as the tasks need them."""

    def __init__(self, ranks: dict, pattern: str):
        self.pattern = pattern
        self.bytes = {b: ord(symbol([ranks[bytes([b])]])) for b in range(256)}

    def words(self, stretches):
        """The words of every stretch (bytes), flat, and how many each stretch has."""
        import regex

        find = regex.compile(self.pattern).findall
        found = [find(s.decode()) for s in stretches]
        return [w.encode() for words in found for w in words], np.fromiter(map(len, found), np.int64, len(found))

    def code(self, word: bytes) -> str:
        return word.decode("latin-1").translate(self.bytes)


def _split(data, offsets):
    """Stretches of a slice: hashes in order of place, and bounds."""
    starts = tokens.cuts(data, offsets, False)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    return textscan.word_hashes(data, starts, ends), starts, ends


def _hashed(words):
    """Hashes of a list of words (bytes)."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return textscan.word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if words else np.zeros(0, np.uint64)


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n): the distinct words and how often they occur.

    Tasks count stretches by hash and pass on each once per megabyte; the distinct ones are
    then split. Java reads the pattern a little differently for rare characters, which at worst leaves a
    word out of the lexicon; it is then folded where it occurs.
    """
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            for _, data, offsets in textscan.slices(batch.column(0), _CHUNK):
                hashes, starts, ends = _split(data, offsets)
                _, first, many = np.unique(hashes, return_index=True, return_counts=True)
                sizes = (ends - starts)[first]
                raw = ragged(data, starts[first], sizes)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([text, pa.array(many)], names=["stretch", "n"])

    stretches = mapped(docs.select("text"), count, "stretch string, n long").groupBy("stretch").agg(F.sum("n").alias("n"))
    words = stretches.select(F.explode(F.regexp_extract_all("stretch", F.lit(pattern), F.lit(0))).alias("word"), "n")
    return words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Known words by hash, with their ids one after another; numbers are as narrow as they can be."""

    def __init__(self, hashes, sizes, ids):
        narrow = lambda values: values.astype(np.min_scalar_type(values.max(initial=0)))
        order = np.argsort(hashes, kind="stable")
        begin = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.hashes, self.ids = hashes[order], narrow(ids)
        self.begin, self.sizes = begin[order], narrow(sizes[order])

    def find(self, hashes):
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def lexicon(docs: DataFrame, path: str, vocabulary: Vocabulary, ranks: dict, shared, common: int) -> Lexicon:
    """The single tokens and the corpus's commonest other words, at most ``common``, folded by Spark."""
    import pyarrow as pa

    counted = staged(distinct_words(docs, vocabulary.pattern), "words")
    least = common_words(counted, common)
    single = docs.sparkSession.sparkContext.broadcast(frozenset(ranks))

    def coded(batches):
        vocab, tokens_known = shared.value, single.value
        for batch in batches:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            words = [w for w in words if w not in tokens_known]
            if words:
                parts = [[vocab.code(w) for w in words]]
                hashes = _hashed(words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashes.tolist()], pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.string()))], names=["hashes", "words"]
                )

    rows = mapped(counted.where(F.col("n") >= least).select("word"), coded, "hashes array<long>, words array<string>")
    folded = rows.select("hashes", F.array_join(folder(path)(F.col("words")), "\n").alias("pieces"))
    hashes, sizes = [_hashed(list(ranks))], [np.ones(len(ranks), np.int64)]
    ids = [np.array(list(ranks.values()), np.uint32)]
    for batch in folded.toArrow().to_batches(max_chunksize=1):  # at most ``common`` short words in all
        pieces = batch.column(1)[0].as_py()
        spelled = token_ids(pieces)
        breaks = np.flatnonzero(spelled == ord("\n") - FIRST)
        hashes.append(batch.column(0)[0].values.to_numpy().view(np.uint64))
        sizes.append(np.diff(np.concatenate([[-1], breaks, [len(spelled)]])) - 1)
        ids.append(spelled[spelled != ord("\n") - FIRST].astype(np.uint32))
    return Lexicon(*map(np.concatenate, (hashes, sizes, ids)))


def ragged(values, begin, sizes):
    """The runs ``values[begin : begin + size]`` one after another."""
    total = np.cumsum(sizes)
    source = np.repeat(begin - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
    return values[source]


class Splitter:
    """Texts to ids with marks for unknown words; keeps the stretches it has met."""

    def __init__(self, vocabulary, known_words):
        self.vocabulary, self.words, self.known = vocabulary, known_words, tokens.Known()

    def encode(self, data, offsets):
        """(ids with marks, bounds of the texts, unknown words by number)."""
        hashes, starts, ends = _split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), []
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known.hashes) + len(values) > KNOWN_STRETCHES:
            self.known = tokens.Known()
        places = self.known.find(values)
        fresh, raw = np.flatnonzero(places < 0), data.tobytes()
        at = first[fresh]
        words, counts = self.vocabulary.words([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        keys = _hashed(words)
        found = self.words.find(keys)
        missing = np.flatnonzero(found < 0)
        odd, pick, number = np.unique(keys[missing], return_index=True, return_inverse=True)
        unknown = [words[i] for i in missing[pick].tolist()]
        # Ids of the fresh stretches: those of known words, a mark for each unknown one.
        sizes = np.where(found < 0, 1, self.words.sizes[found]).astype(np.int64)
        begin = np.where(found < 0, 0, self.words.begin[found]).astype(np.int64)
        ids = ragged(self.words.ids, begin, sizes).astype(np.uint32)
        word_at = np.cumsum(sizes) - sizes
        ids[word_at[missing]] = MARK + number.astype(np.uint32)
        owner = np.repeat(np.arange(len(fresh)), counts)
        stretch_sizes = np.bincount(owner, sizes, len(fresh)).astype(np.int64)
        whole = np.ones(len(fresh), bool)
        whole[owner[missing]] = False
        stretch_begin = np.cumsum(stretch_sizes) - stretch_sizes
        self.known.add(values[fresh[whole]], stretch_sizes[whole], ragged(ids, stretch_begin[whole], stretch_sizes[whole]))
        places = self.known.find(values)
        near = places >= 0
        size, begin = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        size[near] = self.known.starts[places[near] + 1] - self.known.starts[places[near]]
        begin[near] = self.known.starts[places[near]]
        size[fresh[~whole]], begin[fresh[~whole]] = stretch_sizes[~whole], stretch_begin[~whole] + len(self.known.ids)
        total = np.concatenate([[0], np.cumsum(size[inverse])])
        every = np.concatenate([self.known.ids, ids])
        return ragged(every, begin[inverse], size[inverse]), total[np.searchsorted(starts, offsets)], unknown


def _one_by_one(batches, rows):
    """What ``rows`` makes of each batch; a batch's memory is given back before the next is read."""
    import pyarrow as pa

    for batch in batches:
        yield from rows(batch)
        del batch
        pa.default_memory_pool().release_unused()


_SPLITTERS = {}


def _splitter(key: str, shared, known) -> "Splitter":
    """One splitter per worker process and run, so stretches stay known from task to task.

    Workers take turns at both steps of a run, and between turns Spark forgets the broadcasts of the other step. So
    the run has a name, and its words are read once a worker, after those of an earlier run are gone.
    """
    if key not in _SPLITTERS:
        _SPLITTERS.clear()
        _SPLITTERS[key] = Splitter(shared.value, known.value)
    return _SPLITTERS[key]


def encode(docs: DataFrame, path: str, pattern: str, common: int = COMMON, finish=None, fields: str = "ids binary, decoded binary") -> DataFrame:
    """doc_id and what ``finish`` makes of a text's ids; by default the ids and the decoded bytes.

    ``finish(ids, decoded)`` gets the ids as an array and the bytes that decoding them gives, and returns
    one value per field of ``fields``. Ids as bytes are little-endian unsigned 32-bit.
    """
    import pyarrow as pa

    context = docs.sparkSession.sparkContext
    ranks, run = read_ranks(path), uuid.uuid4().hex
    vocabulary = Vocabulary(ranks, pattern)
    shared = context.broadcast(vocabulary)
    known = context.broadcast(lexicon(docs, path, vocabulary, ranks, shared, common))
    tokens_by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens_by_id[rank] = token
    pieces = context.broadcast(tokens_by_id)
    id_field = docs.schema["doc_id"]
    kind = id_field.dataType.simpleString()

    def split(batches):
        splitter = _splitter(run, shared, known)

        def rows(batch):
            for first, data, offsets in textscan.slices(batch.column(1), _CHUNK):
                ids, bounds, unknown = splitter.encode(data, offsets)
                n = len(offsets) - 1
                lists = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        lists(batch.column(0).slice(first, n)),
                        lists(pa.array(np.diff(bounds))),
                        pa.array([ids.astype("<u4").tobytes()], pa.binary()),
                        lists(pa.array([splitter.vocabulary.code(w) for w in unknown], pa.string())),
                    ],
                    names=["doc_ids", "sizes", "ids", "words"],
                )

        return _one_by_one(batches, rows)

    def join(batches):
        table = pieces.value
        done = finish or (lambda ids, decoded: (ids.astype("<u4").tobytes(), decoded))
        names = ["doc_id", *[f.split()[0] for f in fields.split(", ")]]

        def rows(batch):
            for row in range(batch.num_rows):
                sizes = batch.column(1)[row].values.to_numpy()
                ids = np.frombuffer(batch.column(2)[row].as_buffer(), "<u4")
                words = batch.column(3)[row].values.to_pylist()
                marked = ids >= MARK
                if marked.any():
                    long = np.fromiter(map(len, words), np.int64, len(words))
                    spelled = token_ids("".join(words)).astype(np.uint32)
                    which = (ids[marked] - MARK).astype(np.int64)
                    step = np.ones(len(ids), np.int64)
                    step[marked] = long[which]
                    begin = np.zeros(len(ids), np.int64)
                    begin[marked] = (np.cumsum(long) - long)[which] + len(ids)
                    begin[~marked] = np.flatnonzero(~marked)
                    out = ragged(np.concatenate([ids, spelled]), begin, step)
                    after = np.concatenate([[0], np.cumsum(step)])[np.concatenate([[0], np.cumsum(sizes)])]
                else:
                    out, after = ids, np.concatenate([[0], np.cumsum(sizes)])
                doc_ids, values = batch.column(0)[row].values, []
                for a, b in zip(after.tolist(), after[1:].tolist()):
                    own = out[a:b]
                    values.append(done(own, b"".join([table[i] for i in own.tolist()])))
                for a in range(0, len(values), 1024):
                    columns = zip(*values[a : a + 1024])
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(a, min(1024, len(values) - a)), *[pa.array(list(c)) for c in columns]], names=names
                    )

        return _one_by_one(batches, rows)

    fold = folder(path)
    rows = mapped(docs.select("doc_id", "text"), split, f"doc_ids array<{kind}>, sizes array<long>, ids binary, words array<string>")
    rows = rows.select("doc_ids", "sizes", "ids", fold(F.col("words")).alias("words"))
    return mapped(rows, join, f"doc_id {kind}, {fields}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``text`` to rows with ``ids`` (little-endian unsigned 32-bit): the pieces put together."""
    import pyarrow as pa

    pieces = {rank: token for token, rank in read_ranks(path).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    place = encoded.columns.index("ids")

    def add(batches):
        for batch in batches:
            texts = [
                None if v is None else b"".join(map(shared.value.__getitem__, np.frombuffer(v, "<u4").tolist())).decode()
                for v in batch.column(place).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return mapped(encoded, add, f"{fields}, text string")
