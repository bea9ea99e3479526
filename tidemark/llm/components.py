"""Connected components of a links table, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the component's smallest node.

    Alternates two star steps until no link changes: every node hands its larger neighbours to the
    smallest node it knows, then its smaller ones.  Links only ever shrink towards the root, each
    round is stored in the shared folder, and no node's neighbours are gathered in one row.
    """
    edges = _canonical(links.select("a", "b"))
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"),
                                                          F.col("low").alias("b"))
        large = _canonical(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("low").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = materialize(_canonical(small), "links")
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(own)


def _canonical(edges: DataFrame) -> DataFrame:
    """Each link once, larger node first, without loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                        F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and checksum: equal ones mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
