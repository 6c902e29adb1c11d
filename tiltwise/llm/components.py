"""Connected components of an edge table, without a driver-side copy of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def roots_of(parents: DataFrame) -> DataFrame:
    """``node, to`` with ``to`` the root above each node: pointers double until all are at a root, log2 of the depth times.

    ``parents`` (``node, to``, stored, with ``to <= node``) has a row for every node, a root being its own parent.
    """
    while True:
        above = parents.select(F.col("node").alias("to"), F.col("to").alias("up"))
        further = materialise(parents.join(above, "to").select("node", F.col("up").alias("to"), (F.col("up") < F.col("to")).alias("moved")), "parents")
        discard(parents)
        parents = further
        if parents.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``, longs): root is the smallest node it is linked with.

    Each round points every node at its smallest neighbour, if that is smaller, and doubles the pointers until they are at
    the roots; edges then join roots.  A root has no smaller neighbour, so no two roots are linked before the round, and two
    rounds at least halve the nodes: rounds and doublings are logarithmic, on chains too.  Smallest neighbours are summed
    before the shuffle, so a hub costs no more than its edges.  Null ends and loops are ignored.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        roots = roots_of(materialise(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")), "parents"))
        left, right = roots.select(F.col("node").alias("a"), F.col("to").alias("na")), roots.select(F.col("node").alias("b"), F.col("to").alias("nb"))
        joined = edges.join(left, "a").join(right, "b").where("na <> nb").select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b"))
        rest = materialise(joined.distinct(), "edges")
        moved = materialise(labels.join(roots.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        discard(edges, labels, roots)
        edges, labels = rest, moved
    discard(edges)
    return labels
