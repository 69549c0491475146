"""Connected components of a graph held as a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import drop_written, written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and links a-b: the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return label


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (node, root): the smallest node reachable. Nodes without a link to another have no row.

    Each round links every node to the smallest of its neighbours, first to those larger, then to those smaller than it;
    the links become stars after few rounds, in number about the logarithm of the longest path. Only the smallest
    neighbour of a node is aggregated, never its list of neighbours, and each round is written to the shared folder.
    """
    stars = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = mark(stars)
    while now[0]:
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        new = written(small.distinct(), "stars")
        before, now = now, mark(new)
        drop_written(stars)
        stars = new
        if now == before:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
