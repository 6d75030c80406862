"""Exact cosine near duplicates of vectors with a nested cover and a dual traversal.

Vectors are scaled to length one, where cosine >= c means a distance of at most t = sqrt(2 - 2c).
Equal vectors of a label are one point with a weight. The upper levels of the tree are tables: a
node with more than ``LEAF`` points is covered by balls of half its radius around centres picked
from a bounded sample of its points, as far as ``CENTRES`` balls suffice (else they stay larger, which
prunes less and changes no link), every point goes to its nearest centre, and the true covering
radius of a child is measured over all of its points. Pairs of nodes are then followed from the
root down: a pair lives on if the distance of its centres minus both radii is at most t. Only leaf
pairs that survive are brought together, one task per pair, where the same halving goes on inside
the two leaves: pairs too far apart are pruned, pairs that are wholly within t are counted without
looking at their points, and the rest are compared exactly in double precision.

What leaves a task is a number of links per point and a spanning forest of the links, never the
links themselves, so a group of near copies stays linear.

Defined results: a vector that is null, of length zero, or holds null or non-finite components, and a
vector with a null label or id, links with nothing and is its own component; vectors of different
dimension never link; repeated ids link like other rows, and each row is returned; an empty table
gives no rows; further columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapanel.session import staged

from .common import components, importable, mapped

LEAF = 4096
#: Sampled points of a node among which its children's centres are picked, and centres at most.
SAMPLE = 512
CENTRES = 32
LEVELS = 24
SMALL = 96
#: Slack of the pruning bounds for rounding, far above double precision.
SLACK = 1e-9


def unit_rows(vectors):
    """Rows of length one in double precision."""
    vectors = np.asarray(vectors, np.float64)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cover(points, limit=CENTRES):
    """Centres (row numbers) that cover ``points`` with balls of half their radius, ``limit`` at most.

    Farthest point first, from row 0; returns the centres in the order of picking.
    """
    gap = np.sqrt(np.maximum(((points - points[0]) ** 2).sum(axis=1), 0))
    goal, picked = gap.max() / 2, [0]
    while len(picked) < limit and gap.max() > goal:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(np.maximum(((points - points[picked[-1]]) ** 2).sum(axis=1), 0)))
    return picked


class Node:
    """A ball: rows of ``points``, centre and covering radius; children are made when asked for."""

    def __init__(self, points, rows):
        self.points, self.rows = points, rows
        self.centre = points[rows[0]]
        self.radius = float(np.sqrt(np.maximum(((points[rows] - self.centre) ** 2).sum(axis=1), 0).max()))
        self.parts = None

    def children(self):
        if self.parts is None:
            own = self.points[self.rows]
            centres = cover(own)
            nearest = (own @ own[centres].T).argmax(axis=1)
            nearest[centres] = np.arange(len(centres))
            order = np.argsort(nearest, kind="stable")
            cuts = np.flatnonzero(np.diff(nearest[order])) + 1
            self.parts = []
            for rows, centre in zip(np.split(order, cuts), np.unique(nearest)):
                rows = np.concatenate([[centres[centre]], rows[rows != centres[centre]]])
                self.parts.append(Node(self.points, self.rows[rows]))
        return self.parts


def dual(left, right, cosine):
    """Pairs of row sets (rows, rows, mask or None for all) that hold every link of two nodes.

    For a node with itself only pairs of different rows are meant, each once.
    """
    reach = np.sqrt(2 - 2 * cosine)
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        gap = float(np.sqrt(np.maximum(((a.centre - b.centre) ** 2).sum(), 0)))
        if a is not b and gap - a.radius - b.radius > reach + SLACK:
            continue
        widest = 2 * a.radius if a is b else gap + a.radius + b.radius
        if widest < reach - SLACK:
            yield a, b, None
        elif len(a.rows) <= SMALL and len(b.rows) <= SMALL:
            near = a.points[a.rows] @ b.points[b.rows].T >= cosine
            yield a, b, np.triu(near, 1) if a is b else near
        elif a is b:
            parts = a.children()
            if not _shrinks(a, parts, reach):
                yield from _flat(a, a, cosine)
            else:
                stack += [(x, y) for i, x in enumerate(parts) for y in parts[i:]]
        else:
            wide, other = (a, b) if len(a.rows) >= len(b.rows) else (b, a)
            parts = wide.children()
            if not _shrinks(wide, parts, reach):
                yield from _flat(a, b, cosine)
            else:
                stack += [(x, other) for x in parts]


def _shrinks(node, parts, reach):
    """Whether a cover helps: its balls are clearly smaller, or already so small that they can be
    counted without looking at their points."""
    widest = max(p.radius for p in parts)
    return len(parts) > 1 and (widest <= 0.75 * node.radius or widest <= reach)


def _flat(a, b, cosine, block=1024):
    """Nodes that no cover shrinks: compared block by block."""
    for i in range(0, len(a.rows), block):
        for j in range(i if a is b else 0, len(b.rows), block):
            x, y = _Rows(a, i, i + block), _Rows(b, j, j + block)
            near = a.points[x.rows] @ b.points[y.rows].T >= cosine
            yield x, y, np.triu(near, 1) if a is b and i == j else near


class _Rows:
    def __init__(self, node, start, end):
        self.rows = node.rows[start:end]


def links_of(left, right, cosine):
    """Weighted link counts and a spanning forest between two sets of (ids, weights, points).

    ``right`` is None for the links inside ``left``.
    """
    ids, weights, points = left
    cut = len(ids)
    if right is not None:
        ids, weights = np.concatenate([ids, right[0]]), np.concatenate([weights, right[1]])
        points = np.concatenate([points, right[2]])
    first = Node(points, np.arange(cut))
    second = first if right is None else Node(points, np.arange(cut, len(ids)))
    counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def join(pairs):
        """Unites the ends of pairs of rows."""
        nonlocal root
        for x, y in pairs:
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while True:
            above = root[root]
            if (above == root).all():
                return
            root = above

    for a, b, near in dual(first, second, cosine):
        if near is None:
            if a is b:
                counts[a.rows] += weights[a.rows].sum() - weights[a.rows]
            else:
                counts[a.rows] += weights[b.rows].sum()
                counts[b.rows] += weights[a.rows].sum()
            whole = np.concatenate([a.rows, b.rows])
            join((whole[0], x) for x in whole[root[whole] != root[whole[0]]])
        elif near.any():
            counts[a.rows] += near @ weights[b.rows]
            counts[b.rows] += near.T @ weights[a.rows]
            while True:
                apart = near & (root[a.rows][:, None] != root[b.rows][None, :])
                hit = apart.any(axis=1)
                if not hit.any():
                    break
                join(zip(a.rows[hit], b.rows[apart[hit].argmax(axis=1)]))
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids, counts, list(zip(ids[moved].tolist(), ids[root[moved]].tolist()))


def _scaled(points: DataFrame) -> DataFrame:
    """Adds ``unit``, the vector scaled to length one."""
    import pyarrow as pa

    def scale(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            out = np.empty_like(flat)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                at = (ends[rows] - size)[:, None] + np.arange(size)
                out[at] = unit_rows(flat[at])
            unit = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], unit], names=[*batch.schema.names[:-1], "unit"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields[:-1])
    return mapped(points, scale, f"{kinds}, unit array<double>")


def _distance(a, b):
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v), F.lit(0.0)))


def _centres(sample: DataFrame) -> DataFrame:
    """Centres of every node from its sampled points (``SAMPLE`` rows a node at most), as many as give
    leaves of about half the allowed size."""

    def pick(rows):
        import pandas as pd

        points = np.array(rows["unit"].tolist())
        picked = cover(points, min(CENTRES, 2 * -(-int(rows["n"].iloc[0]) // LEAF)))
        return pd.DataFrame({"node": [rows["node"].iloc[0]] * len(picked), "child": np.arange(len(picked)), "centre": [points[i] for i in picked]})

    return importable(sample).groupBy("node").applyInPandas(pick, "node string, child int, centre array<double>")


def _split(points: DataFrame):
    """Points with the path of their leaf; a node that is small enough is not split any more."""
    rows = points.withColumn("node", F.concat_ws(":", F.hex(F.col("label").cast("string").cast("binary")), F.size("unit").cast("string")))
    rows = rows.withColumn("done", F.lit(False))
    for level in range(LEVELS):
        rows = staged(rows, "cover")
        sizes = staged(rows.where("NOT done").groupBy("node").agg(F.count("*").alias("n")), "cover_sizes")
        large = sizes.where(F.col("n") > LEAF)
        if level == LEVELS - 1 or large.isEmpty():
            break
        share = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE) / F.col("n"))
        ordered = F.pmod(F.xxhash64("vec_id", "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.join(F.broadcast(large) if large.count() <= 1 << 14 else large, "node").where(ordered < share)
        sample = sample.withColumn("o", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("vec_id"), "vec_id")))
        centres = _centres(sample.where(F.col("o") <= SAMPLE).select("node", "unit", "n"))
        centres = staged(centres.groupBy("node").agg(F.collect_list(F.struct("child", "centre")).alias("centres")), "centres")
        best = F.array_min(F.transform("centres", lambda c: F.struct(_distance(F.col("unit"), c["centre"]).alias("gap"), c["child"].alias("child"))))
        moved = rows.join(centres, "node", "left").withColumn("best", F.when(F.col("centres").isNotNull(), best))
        rows = moved.select(
            "vec_id", "weight", "label", "unit",
            F.when(F.col("best").isNotNull(), F.concat_ws("/", "node", F.col("best.child").cast("string"))).otherwise(F.col("node")).alias("node"),
            F.col("best").isNull().alias("done"),
        )
    return rows


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    import pyarrow as pa

    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    every = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    valid = every.where(F.coalesce(usable, F.lit(False)))
    # One point per distinct vector of a label; hot vectors are combined before the shuffle.
    groups = staged(
        valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")), "vectors"
    )
    points = _scaled(groups.select(F.col("first").alias("vec_id"), "weight", "label", "embedding"))
    rows = _split(points)
    blocks = staged(rows.select("node", "vec_id", "weight", "unit"), "leaves")
    pairs = _leaf_pairs(blocks, cosine)

    left = blocks.join(pairs, blocks.node == pairs.a).select("a", "b", F.lit(0).alias("side"), "vec_id", "weight", "unit")
    right = blocks.join(pairs.where("a <> b"), blocks.node == F.col("b")).select("a", "b", F.lit(1).alias("side"), "vec_id", "weight", "unit")

    def compare(group):
        import pandas as pd

        def part(side):
            own = group[group["side"] == side].sort_values("vec_id")
            return own["vec_id"].to_numpy(), own["weight"].to_numpy(), np.array(own["unit"].tolist())

        inside = group["a"].iloc[0] == group["b"].iloc[0]
        ids, counts, forest = links_of(part(0), None if inside else part(1), cosine)
        hit = counts > 0
        found = pd.DataFrame({"vec_id": ids[hit], "n": counts[hit], "other": pd.array([None] * int(hit.sum()), "Int64")})
        edges = pd.DataFrame(forest, columns=["vec_id", "other"]).assign(n=0)
        edges["other"] = edges["other"].astype("Int64")
        return pd.concat([found, edges[["vec_id", "n", "other"]]])

    found = staged(importable(left.union(right)).groupBy("a", "b").applyInPandas(compare, "vec_id long, n long, other long"), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "first")
    roots = components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    known = (
        groups.select("label", "embedding", "first", "weight")
        .join(counts, "first", "left")
        .join(roots.withColumnRenamed("node", "first"), "first", "left")
        .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("root", "first").alias("root"))
    )
    keyed = every.withColumn("valid", F.coalesce(usable, F.lit(False)))
    with_links = keyed.where("valid").join(known, ["label", "embedding"])
    alone = keyed.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("root"))
    result = with_links.select("vec_id", "n", "root").unionByName(alone)
    return result.select(
        "vec_id", F.col("n").alias("n_links"), F.col("root").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("root")).alias("kept")
    )


def _leaf_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """Pairs of leaves that may hold links, followed from the roots down level by level.

    Every node of the tree is a prefix of its leaves' names. Its ball has the first point of its
    smallest id as centre; the radius is measured over all its points.
    """
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    depth = blocks.select(F.max(F.size(F.split("node", "/")))).first()[0] or 1
    pairs = None
    for level in range(1, depth + 1):
        at = F.array_join(F.slice(F.split("node", "/"), 1, level), "/")
        named = blocks.withColumn("at", at)
        centre = named.groupBy("at").agg(F.min(F.struct("vec_id", "unit")).alias("c")).select("at", F.col("c.unit").alias("centre"))
        balls = staged(
            named.join(centre, "at").groupBy("at").agg(F.max(_distance(F.col("unit"), F.col("centre"))).alias("radius"), F.first("centre").alias("centre")),
            "balls",
        )
        parent = F.array_join(F.slice(F.split("at", "/"), 1, level - 1), "/") if level > 1 else F.lit("")
        shallow = F.size(F.split("at", "/")) < level
        balls = balls.withColumn("parent", F.when(shallow, F.col("at")).otherwise(parent))
        if pairs is None:
            pairs = balls.select(F.col("at").alias("a"), F.col("at").alias("b"))
        else:
            one = balls.select(F.col("parent").alias("pa"), F.col("at").alias("a2"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
            two = balls.select(F.col("parent").alias("pb"), F.col("at").alias("b2"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
            near = _distance(F.col("ca"), F.col("cb")) - F.col("ra") - F.col("rb") <= reach
            pairs = (
                pairs.join(one, F.col("a") == F.col("pa"))
                .join(two, F.col("b") == F.col("pb"))
                .where(((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))) & (near | (F.col("a2") == F.col("b2"))))
                .select(F.col("a2").alias("a"), F.col("b2").alias("b"))
            )
        pairs = staged(pairs, "node_pairs")
    return pairs
