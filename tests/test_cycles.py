import random

from pyspark.sql import functions as F

from areapanel.operators import cycles

LINKS = "area string, part int, a int, b int"


def has_cycle(links):
    """Whether a link joins two nodes that earlier links have joined already; and the number of components."""
    root = {n: n for link in links for n in link}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    found = False
    for a, b in links:
        a, b = top(a), top(b)
        found |= a == b
        root[a] = b
    return found, sum(root[n] == n for n in root)


def test_random_graphs(spark):
    """Forests, forests with one more link and parallel links, all at once against a walk over each."""
    rng = random.Random(5)
    graphs = {}
    for k in range(150):
        n = rng.randint(2, 14)
        links = [(i, rng.randrange(i)) for i in range(1, n) if rng.random() < 0.8]
        if rng.random() < 0.4 and links:
            links.append(rng.choice(links) if rng.random() < 0.3 else tuple(rng.sample(range(n), 2)))
        names = rng.sample(range(1000), n)
        graphs[f"area {k // 2}", k % 2] = [tuple(rng.sample((names[a], names[b]), 2)) for a, b in links]
    df = spark.createDataFrame([(*key, *link) for key, links in graphs.items() for link in links], LINKS)
    want = {key: has_cycle(links) for key, links in graphs.items() if links}
    got = {tuple(r) for r in cycles.cyclic(df, ["area", "part"]).collect()}
    assert got == {key for key, (cycle, _) in want.items() if cycle} and 10 < len(got) < 140
    counts = {(r["area"], r["part"]): r["components"] for r in cycles.component_counts(df, ["area", "part"]).collect()}
    assert counts == {key: n for key, (_, n) in want.items()}


def test_hidden_cycle(spark):
    """A triangle beside other links has fewer links than nodes."""
    triangle, beside = [(0, 1), (1, 2), (2, 0)], [(3, 4), (5, 6)]
    df = spark.createDataFrame([("x", 0, a, b) for a, b in triangle + beside] + [("y", 0, a, b) for a, b in beside], LINKS)
    assert [tuple(r) for r in cycles.cyclic(df, ["area", "part"]).collect()] == [("x", 0)]
    assert cycles.cyclic(df.where("false"), ["area", "part"]).collect() == []


def test_long_chains(spark):
    """100,000 holes in a chain: one area without a cycle, one with a triangle of its own far from the chain."""
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    apart = spark.createDataFrame([(200_000 + i, 200_000 + (i + 1) % 3) for i in range(3)], "a long, b long")
    more = spark.createDataFrame([(300_000, 300_001), (300_002, 300_003)], "a long, b long")
    df = chain.withColumn("area", F.lit("x")).unionByName(chain.unionByName(apart).unionByName(more).withColumn("area", F.lit("y")))
    assert [r["area"] for r in cycles.cyclic(df, ["area"]).collect()] == ["y"]
