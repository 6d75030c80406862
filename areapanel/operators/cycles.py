"""Cycles in many graphs at once, by counting instead of walking.

A graph has a cycle exactly when it has more links than nodes less components. Links and nodes are counted;
components are only counted where those two leave the answer open, by contraction in rounds of joins and
minima, so no task ever holds a graph.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged


def _nodes(links: DataFrame, keys) -> DataFrame:
    return links.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()


def component_counts(links: DataFrame, keys) -> DataFrame:
    """(keys, components): of the graph of ``links`` (keys, a, b) with whole-number nodes, one graph per key.

    In every round each node takes the label of the neighbour, or itself, whose hash of that round is the
    smallest; links between equal labels go. About half of the nodes are left after a round, so rounds grow with the
    logarithm of the longest chain. Only linked nodes are counted; a link of a node with itself makes it one.
    """
    keys = list(keys)
    label = staged(_nodes(links, keys).withColumn("label", F.col("node")), "labels")
    left = staged(links.select(*keys, "a", "b").where("a <> b").distinct(), "links")
    turn = 0
    while not left.isEmpty():
        near = left.unionByName(left.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda node: F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("to"))  # noqa: E731, B023
        hook = near.groupBy(*keys, "a").agg(F.min(order("b")).alias("low"), F.min(order("a")).alias("own"))
        hook = staged(hook.select(*keys, F.col("a").alias("label"), F.least("low", "own")["to"].alias("to")), "hooks")
        label = label.join(hook, [*keys, "label"], "left")
        label = staged(label.select(*keys, "node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            left = left.join(hook.withColumnRenamed("label", end), [*keys, end]).withColumn(end, F.col("to")).drop("to")
        left = staged(left.where("a <> b").distinct(), "links")
        turn += 1
    return label.select(*keys, "label").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("components"))


def cyclic(links: DataFrame, keys) -> DataFrame:
    """The keys whose graph has a cycle; every row of ``links`` (keys, a, b) is a link, equal rows are parallel ones.

    At least as many links as nodes, or parallel links, are a cycle. Fewer than four different links, less in
    number than the nodes, are none: the smallest cycle that nodes elsewhere can hide is a triangle beside
    one link. An empty table gives no keys.
    """
    keys = list(keys)
    ends = links.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = staged(ends.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("times")), "pairs")
    counted = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.sum("times").alias("links"))
    nodes = _nodes(ends, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))
    counted = staged(counted.join(nodes, keys), "counted")
    sure = (F.col("links") > F.col("pairs")) | (F.col("links") >= F.col("nodes"))
    found = counted.where(sure).select(*keys)
    undecided = counted.where(~sure & (F.col("links") >= 4))
    if undecided.isEmpty():
        return found
    parts = component_counts(ends.join(undecided.select(*keys), keys, "left_semi"), keys)
    more = undecided.join(parts, keys).where(F.col("links") > F.col("nodes") - F.col("components"))
    return found.unionByName(more.select(*keys))
