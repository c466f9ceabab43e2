"""Connected components by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each step
is two shuffles of the edges, and the number of steps grows with the logarithm of
the longest path at most, in practice less. Nothing is gathered in one place; the
edges of a node with ``CROWDED`` or more are dealt over ``SALTS`` tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, small_enough

SALTS, CROWDED = 16, 10_000


def _with_least(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) with m, the least of u and its neighbours. A minimum per task
    comes first; only a crowded node's goes to shares of its pairs, and only such nodes
    are looked up to know their shares: they are few, as each has ``CROWDED`` pairs."""
    least = cut(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    if least.where(F.col("n") >= CROWDED).isEmpty():
        return pairs.join(least.select("u", "m"), "u")
    crowded = cut(least.where(F.col("n") >= CROWDED).select("u", F.col("m").alias("_m")), "crowded")
    marked = pairs.join(small_enough(crowded), "u", "left")
    shares = crowded.select("u", F.col("_m").alias("m")).withColumn("_s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = marked.where("_m is not null").select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("_s")).join(shares, ["u", "_s"]).select("u", "v", "m")
    return marked.where("_m is null").select("u", "v").join(least.where(F.col("n") < CROWDED).select("u", "m"), "u").union(salted)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _with_least(down).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater end u to the lesser end v, without loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every component is a star around its least node: no node has two lesser
    neighbours, or one beside a greater one."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low = 1 and high = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; edges: columns u and v. The
    component is its least node. Null ends are ignored; loops and repeated edges do
    no harm; without edges the result is empty. Every step is written to the shared
    folder."""
    edges = cut(_downward(edges.where("u is not null and v is not null")), "edges")
    while not _settled(edges):
        edges = cut(_downward(_small_star(cut(_large_star(edges), "star"))), "edges")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
