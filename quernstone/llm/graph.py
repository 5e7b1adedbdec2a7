"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import discard, join_hot, materialize


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its component's smallest; root is the smallest.

    Alternating large-star and small-star steps: each links the neighbours of a node to the smallest of them, first
    the larger ones, then the smaller ones. The minimum is a partial aggregate; it comes back by a join in which the
    nodes with the most neighbours are broadcast (``join_hot``), so that no node's neighbours meet in one row or task.
    The second minimum is found alike. Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.

    Null ends and links of a node with itself are left out; repeated links count once; no links give an empty result.
    """
    e = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(spark, e, "links")
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(e.select(F.col("v").alias("u"), F.col("u").alias("v")), least, "u", 2 * before[0])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, lower, "u", 2 * before[0]).select("u", "v", "m")
        nxt = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = materialize(spark, nxt, "links")
        discard(spark, e)
        e, now = nxt, mark(nxt)
        if now == before:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._quern_path = e._quern_path  # for discard, once the result is read
            return out
        before = now
