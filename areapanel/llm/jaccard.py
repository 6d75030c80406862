"""Exact Jaccard join of word-shingle sets by partitioning the universe of shingles.

Two sets of sizes r and s whose Jaccard similarity reaches p percent differ in at most
H = (r + s)(100 - p) / (100 + p) shingles. Set sizes fall into bands; a partner is in the same band or
the one below. Every band hashes the shingles into m segments, m > H. If a document gives each
segment a budget of -1 (skip), 0 (same subset) or 1 (one shingle more or less) and the budgets plus one
add up to H + 1, then a partner meets one of them: the pigeonhole principle. The larger document of
a pair probes; it takes the budgets that cost least. An empty or small subset is common and dear, a
subset of many shingles is cheap; where small ones would be needed, segments that also index their
one-deletion neighbourhood take a budget of 1 instead.

Documents that meet in an index entry belong to the group of the entry's smallest probing document,
its pivot; two similar documents share a group. A group is cut into blocks of ``BLOCK`` documents, each
with the pivot, and all pairs inside a block are compared exactly in one task, which returns a
spanning forest of the links. A group of several blocks that is not yet one component has its
largest component set against the rest, block by block, and the rest against itself. One of more than
``ACROSS`` blocks mostly comes from an entry of one common shingle, grows with the table and holds few
links; its documents are first grouped anew by their prefixes: with shingles in one order for all, rare
ones first, two similar sets share one of the first s - ceil(s * p / 100) + 1 of each. Shingles within
one component are left out. So no link between components is missed, no pairs are written out, and a
group of near copies that the blocks already join costs one comparison per block.

Shingles are told apart by 64-bit hashes, sets of equal shingles by 128-bit digests.

Defined results: words are runs without space and the controls 9 to 13, A to Z in lower case; a text
of fewer words than a shingle is one shingle; null texts and texts without words have an empty set
and link with nothing; repeated ids count as one document for links, and every row is returned; a null
id links with nothing and its component is null; an empty table gives no rows.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapanel.session import staged

from . import textscan
from .common import common_words, components, importable, mapped, split_by_ids

#: Documents of a group that are compared in one task, and columns of a matrix of shingles.
BLOCK = 512
COLUMNS = 4096
#: Text that a worker looks at together.
SLICE_BYTES = 512 << 10
#: Blocks of a group that are compared with each other; the documents of larger groups are grouped anew.
ACROSS = 16
#: Shingles that are counted together, and shingles at most whose count orders prefixes.
COUNTED = 1 << 20
KNOWN = 1 << 17


class Bands:
    """Size bands and their segments for a similarity of ``percent``."""

    def __init__(self, percent: int, largest: int):
        self.percent, lows = percent, [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, lows[-1] * 10000 // percent**2 + 1))
        self.lows = np.array(lows, np.int64)
        self.highs = np.append(self.lows[1:] - 1, np.iinfo(np.int32).max)
        self.segments = self.gap(self.highs + self.highs * 100 // percent) + 1
        self.deletable = np.where(self.segments > 1, 1 + self.segments // 32, 0)

    def gap(self, total):
        """The largest difference of two similar sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, sizes):
        return np.searchsorted(self.lows, sizes, "right") - 1


def entries(values, owners, sizes, percent, bands=None):
    """Index entries and probes of documents: (owner, value), the lowest bit of a value marks probes.

    ``values`` and ``owners`` are distinct shingles ordered by owner; ``sizes`` are set sizes.
    """
    bands = bands or Bands(percent, int(sizes.max(initial=1)))
    found_owner, found_value = [], []
    scrambled = textscan.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    own = bands.of(np.maximum(sizes, 1))
    for below in (0, 1):
        band = own - below
        takes = sizes > 0
        if below:
            takes &= band >= 0
            band = np.maximum(band, 0)
            takes &= -(-sizes * percent // 100) <= bands.highs[band]
        if not takes.any():
            continue
        total = sizes + (bands.highs[band] if below else sizes)
        need = bands.gap(total) + 1
        many = np.where(takes, bands.segments[band], 0)
        base = np.concatenate([[0], np.cumsum(many)])
        used = takes[owners]
        value, owner = scrambled[used], owners[used]
        segment = ((value >> np.uint64(20)) % many[owner].astype(np.uint64)).astype(np.int64)
        flat = base[owner] + segment
        count = np.bincount(flat, minlength=base[-1])
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, flat, value)
        flat_owner = np.repeat(np.arange(len(sizes)), many)
        flat_segment = np.arange(base[-1]) - base[flat_owner]
        tag = textscan.mix((band[flat_owner].astype(np.uint64) << np.uint64(32)) + flat_segment.astype(np.uint64) + np.uint64(1))
        # Budgets: the cost falls with the size of a subset; every document takes its cheapest units.
        capped = np.minimum(count, 30).astype(np.float64)
        opens = np.flatnonzero(flat_segment < bands.deletable[band][flat_owner])
        cost = np.concatenate([4.0**-capped, np.maximum(count[opens], 1) * 4.0 ** (1 - capped[opens])])
        unit_owner = np.concatenate([flat_owner, flat_owner[opens]])
        order = np.lexsort((cost, unit_owner))
        units = np.bincount(unit_owner, minlength=len(sizes))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(units) - units, units)
        taken = rank < need[unit_owner]
        exact, upgraded = taken[: base[-1]], np.zeros(base[-1], bool)
        upgraded[opens] = taken[base[-1] :]
        same = textscan.mix(content + tag)
        keep = exact | upgraded if below else np.ones(base[-1], bool)
        found_owner.append(flat_owner[keep])
        found_value.append(same[keep] & ~np.uint64(1) | (exact | upgraded)[keep].astype(np.uint64))
        loses = np.zeros(base[-1], bool)
        loses[opens] = upgraded[opens] if below else True
        pick = loses[flat]
        place = flat[pick]
        less = textscan.mix(content[place] - value[pick] + tag[place])
        found_owner.append(owner[pick])
        found_value.append(less & ~np.uint64(1) | upgraded[place].astype(np.uint64))
    if not found_owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found_owner), np.concatenate(found_value)


def shingle_sets(data, offsets, width):
    """Distinct shingles and owners of a slice of texts, ordered by owner, and set sizes."""
    data = textscan.LOWER[data]
    starts, ends, owners = textscan.spans(data, offsets)
    values, owners = textscan.shingles(textscan.word_hashes(data, starts, ends), owners, len(offsets) - 1, width)
    values, owners = textscan.distinct_per_owner(values, owners)
    return values, owners, np.bincount(owners, minlength=len(offsets) - 1)


def _lists(values, sizes):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _digests(values, sizes):
    ends = np.cumsum(sizes)
    raw = values.tobytes()
    return [hashlib.blake2b(raw[8 * (e - s) : 8 * e], digest_size=16).digest() for s, e in zip(sizes.tolist(), ends.tolist())]


def set_rows(docs: DataFrame, width: int, percent: int | None = None) -> DataFrame:
    """doc_id, n_shingles and digest of the set; with ``percent`` also the set's index entries and probes."""
    import pyarrow as pa

    def rows(batches):
        bands = percent and Bands(percent, 1 << 30)
        for batch in batches:
            for first, data, offsets in textscan.slices(batch.column(1), SLICE_BYTES):
                values, owners, sizes = shingle_sets(data, offsets, width)
                found = {
                    "doc_id": batch.column(0).slice(first, len(sizes)),
                    "n_shingles": pa.array(sizes),
                    "digest": pa.array(_digests(values, sizes), pa.binary()),
                }
                if percent:
                    entry_owner, entry = entries(values, owners, sizes, percent, bands)
                    order = np.argsort(entry_owner, kind="stable")
                    found["entries"] = _lists(entry[order], np.bincount(entry_owner, minlength=len(sizes)))
                yield pa.RecordBatch.from_pydict(found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, digest binary" + (", entries array<long>" if percent else "")
    return mapped(docs.select("doc_id", "text"), rows, schema)


def _entries(docs: DataFrame, copies: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, place, probing) of every row but copies; ``probing`` is the id where the entry is a probe.

    Entries are made anew from the texts and go straight into the one shuffle that they need.
    """
    perhaps, others = split_by_ids(docs.select("doc_id", "text"), copies)
    own = set_rows(perhaps, width, percent).join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "entries")
    every = own.union(set_rows(others, width, percent).select("doc_id", "entries")).where("doc_id IS NOT NULL")
    probe = F.col("entry").bitwiseAND(F.lit(1)) == 1
    return every.select("doc_id", F.explode("entries").alias("entry")).select(
        "doc_id", F.shiftright("entry", 1).alias("place"), F.when(probe, F.col("doc_id")).alias("probing")
    )


def similar_pairs(left, right, percent):
    """Mask of the pairs (row of ``left``, row of ``right``) that reach the similarity.

    Both are lists of sets (sorted arrays of distinct 64-bit hashes). Intersections are counted by
    products of 0/1 matrices over the shingles that occur on both sides, a few thousand at a time.
    """
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right)]
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    places = []
    for k in (0, 1):
        at = np.minimum(np.searchsorted(shared, flat[k]), max(len(shared) - 1, 0))
        hit = shared[at] == flat[k] if len(shared) else np.zeros(len(flat[k]), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owners[k][hit][order]))
    inner = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, len(shared), COLUMNS):
        sides = []
        for (at, owner), n in zip(places, (len(left), len(right))):
            part = slice(*np.searchsorted(at, [begin, begin + COLUMNS]))
            matrix = np.zeros((n, min(COLUMNS, len(shared) - begin)), np.float32)
            matrix[owner[part], at[part] - begin] = 1
            sides.append(matrix)
        inner += (sides[0] @ sides[1].T).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - inner
    return (100 * inner >= percent * union) & (sizes[0] > 0)[:, None] & (sizes[1] > 0)[None, :]


def forest(near, ids_left, ids_right):
    """Edges (id, id) that join what a mask of pairs joins, at most one for each document."""
    ids = np.concatenate([ids_left, ids_right])
    root, cut, edges = np.arange(len(ids)), len(ids_left), []
    while True:
        apart = near & (root[:cut][:, None] != root[cut:][None, :])
        hit = np.flatnonzero(apart.any(axis=1))
        if not len(hit):
            return edges
        for x, y in zip(hit.tolist(), (apart[hit].argmax(axis=1) + cut).tolist()):
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((int(ids[x]), int(ids[y])))
        while (root[root] != root).any():
            root = root[root]


def _links(blocks: DataFrame, texts: DataFrame, keys: list, width: int, percent: int) -> DataFrame:
    """Spanning links (a, b) inside every block: rows (keys, doc_id, side), side 0 against side 1.

    Rows of side 2 stand on both sides. Texts travel instead of their sets: compressed they are a third as long.
    """
    import pyarrow as pa

    ready = importable(blocks.join(texts, "doc_id").select(*keys, "doc_id", "side", "text"))

    def compare(table):
        side = table.column("side").to_numpy()
        ids = table.column("doc_id").to_numpy()
        values = []
        for chunk in table.column("text").chunks:
            for _, data, offsets in textscan.slices(chunk, SLICE_BYTES):
                found, _, sizes = shingle_sets(data, offsets, width)
                values += np.split(found, np.cumsum(sizes)[:-1])
        pick = [np.flatnonzero(side != other) for other in (1, 0)]
        near = similar_pairs(*[[values[i] for i in rows] for rows in pick], percent)
        edges = forest(near, ids[pick[0]], ids[pick[1]])
        found = [(x, y) for x, y in edges if x != y]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return ready.groupBy(*keys).applyInArrow(compare, "a long, b long")


def common_shingles(texts: DataFrame, width: int):
    """Shingles that several documents hold and their counts, the ``KNOWN`` commonest, ordered by shingle.

    Shingles are counted in pieces of ``COUNTED``, and one that a piece holds once is not counted: the counts
    only order shingles, and common ones recur in a piece.
    """
    import pyarrow as pa

    def counted(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts > 1
        return pa.RecordBatch.from_pydict({"shingle": pa.array(values[many].view(np.int64)), "n": pa.array(counts[many])})

    def rows(batches):
        held = []
        for batch in batches:
            for _, data, offsets in textscan.slices(batch.column(0), SLICE_BYTES):
                held.append(shingle_sets(data, offsets, width)[0])
                if sum(map(len, held)) >= COUNTED:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    counts = mapped(texts.select("text"), rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = staged(counts, "common")
    found = counts.where(F.col("n") >= common_words(counts, KNOWN)).toArrow()
    values = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], found.column("n").to_numpy()[order]


def prefixes(values, owners, sizes, percent, common):
    """Shingles (value, owner) of every set's prefix; ``common`` are shingles and counts, ordered by shingle.

    All sets are in the same order, by count and value, and two similar sets share a shingle of both prefixes.
    """
    known, counts = common
    weights = np.zeros(len(values), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        weights = np.where(known[at] == values, counts[at], 0)
    order = np.lexsort((values, weights, owners))
    owners = owners[order]
    place = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[owners]
    first = place < (sizes + sizes * -percent // 100 + 1)[owners]
    return values[order][first], owners[first]


def _prefix_members(texts: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """Distinct (pivot, doc_id): documents of ``placed`` (doc_id, root) that share a shingle of their prefixes with the pivot
    and with a document of another root. The pivot is the shingle's smallest document."""
    import pyarrow as pa

    common = common_shingles(texts, width)

    def rows(batches):
        for batch in batches:
            for first, data, offsets in textscan.slices(batch.column(1), SLICE_BYTES):
                values, owners, sizes = shingle_sets(data, offsets, width)
                values, owners = prefixes(values, owners, sizes, percent, common)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(first, len(sizes)),
                        "shingles": _lists(values, np.bincount(owners, minlength=len(sizes))),
                    }
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = mapped(texts.select("doc_id", "text"), rows, f"doc_id {kind}, shingles array<long>").join(placed, "doc_id")
    same = Window.partitionBy("shingle")
    found = found.select("doc_id", "root", F.explode("shingles").alias("shingle")).select(
        "doc_id",
        F.min("doc_id").over(same).alias("pivot"),
        F.min("root").over(same).alias("low"),
        F.max("root").over(same).alias("high"),
    )
    return found.where("low <> high AND doc_id <> pivot").select("pivot", "doc_id").distinct()


def _in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (pivot, block, doc_id, side) that compare every block of a group with itself and the pivot; (pivot, blocks)."""
    many = members.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    many = staged(many, "blocks")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    own = members.join(many, "pivot").select("pivot", block.alias("block"), "doc_id", F.lit(2).alias("side"))
    heads = many.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("doc_id"), F.lit(2).alias("side"))
    return own.union(heads).withColumn("block", F.col("block").cast("string")), many


def _open_groups(members: DataFrame, many: DataFrame, roots: DataFrame) -> DataFrame:
    """(pivot, doc_id, root, main, mains, others) of groups of several blocks that are not yet one component: ``main`` is
    the largest component, ``mains`` and ``others`` the blocks that it and the rest take."""
    large = members.join(many.where("blocks > 1").select("pivot"), "pivot")
    large = large.join(roots, F.col("doc_id") == F.col("node"), "left").select("pivot", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    large = staged(large, "large")
    per_root = large.groupBy("pivot", "root").agg(F.count("*").alias("n"))
    totals = per_root.groupBy("pivot").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")
    )
    open_groups = totals.where("roots > 1").select(
        "pivot",
        F.col("main.root").alias("main"),
        F.ceil(F.col("main.n") / F.lit(BLOCK)).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.col("main.n")) / F.lit(BLOCK)).cast("int").alias("others"),
    )
    return staged(large.join(open_groups, "pivot"), "open")


def _across(large: DataFrame) -> DataFrame:
    """Rows (pivot, block, doc_id, side) that compare all pairs of different components of open groups."""
    is_main, spread = F.col("root") == F.col("main"), F.xxhash64("doc_id")
    other = F.pmod(spread, F.col("others")).cast("int")
    through = lambda n: F.sequence(F.lit(0), n - 1)
    # Blocks: m<i>:<j> is main block i against other block j, o<i>:<j> (i <= j) others against others.
    main_names = F.transform(
        through(F.col("others")), lambda j: F.struct(F.concat(F.lit("m"), F.pmod(spread, F.col("mains")), F.lit(":"), j).alias("block"), F.lit(0).alias("side"))
    )
    against_main = F.transform(
        through(F.col("mains")), lambda i: F.struct(F.concat(F.lit("m"), i, F.lit(":"), other).alias("block"), F.lit(1).alias("side"))
    )
    among = F.transform(
        through(F.col("others")),
        lambda j: F.struct(
            F.concat(F.lit("o"), F.least(j, other), F.lit(":"), F.greatest(j, other)).alias("block"),
            F.when(j == other, 2).when(other < j, 0).otherwise(1).alias("side"),
        ),
    )
    placed = F.when(is_main, main_names).otherwise(F.concat(against_main, among))
    return large.select("pivot", "doc_id", F.explode(placed).alias("at")).select("pivot", "at.block", "doc_id", "at.side")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) for every row of ``docs``."""
    rows = staged(set_rows(docs, width), "sizes")
    real = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = staged(real.join(classes, "digest").groupBy("doc_id", "digest", "first").agg(F.count("*").alias("n")), "equal")
    copies, repeated = equal.where("doc_id <> first"), not equal.where("n > 1").isEmpty()
    # Entries are shuffled once: the pivot of a place is found where its entries lie.
    pivot = F.min("probing").over(Window.partitionBy("place"))
    members = _entries(docs, copies, width, percent).withColumn("pivot", pivot)
    members = staged(members.where("doc_id <> pivot").select("pivot", "doc_id").distinct(), "members")

    def texts(ids):
        found, _ = split_by_ids(docs.select("doc_id", "text"), ids)
        return found.dropDuplicates() if repeated else found

    def links(blocks, ids):
        wanted = staged(ids.distinct(), "wanted")
        return staged(_links(blocks, texts(wanted), ["pivot", "block"], width, percent), "links")

    def joined(roots, found):
        known = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        return roots if found.isEmpty() else staged(components(known.union(found)), "roots")

    blocks, many = _in_blocks(members)
    found = links(blocks, members.select("doc_id").union(many.select("pivot")))
    copied = copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    roots = staged(components(copied.union(found)), "roots")
    large = _open_groups(members, many, roots)
    if not large.isEmpty():
        few = F.col("mains") + F.col("others") <= ACROSS
        blocks, ids, wide = _across(large.where(few)), large.where(few).select("doc_id"), large.where(~few)
        placed = staged(wide.select("doc_id", "root").distinct(), "placed")
        anew = not placed.isEmpty()
        if anew:
            members = staged(_prefix_members(texts(placed.select("doc_id")), placed, width, percent), "members")
            own, many = _in_blocks(members)
            blocks, ids = blocks.union(own), ids.union(members.select("doc_id")).union(many.select("pivot"))
        roots = joined(roots, links(blocks, ids))
        large = _open_groups(members, many, roots) if anew else large.where(F.lit(False))
        if not large.isEmpty():
            roots = joined(roots, links(_across(large), large.select("doc_id")))
    named = roots.select(F.col("node").alias("doc_id"), "root")
    return rows.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the rows whose id is their component's; of rows with equal ids and texts one.

    Rows with a null id are not compared and stay.
    """
    found = staged(similar_documents(docs, width, percent), "classes")
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = staged(repeated, "repeated")
    perhaps, kept = split_by_ids(docs, gone.union(repeated))
    perhaps = perhaps.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not repeated.isEmpty():
        once = perhaps.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        perhaps = perhaps.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.unionByName(perhaps).select(*docs.columns)
