"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.store import kept


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp`` for every node in ``links`` (columns ``a``, ``b``); nodes without links are not listed.

    Each round points a node to its smallest neighbour, follows pointers, and joins the pointed-to nodes into one; a star is done
    in two rounds, a path of n links in about log n. Links, pointers and labels stay in tables, written after each round.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = kept(links.select(low.alias("a"), high.alias("b")).where("a != b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        up = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "up")
        hop = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
        for _ in range(2):
            up = up.join(hop, "up").select("node", F.col("next").alias("up"))
        up = kept(up, "up")
        if labels is None:
            labels = up.select("node", F.col("up").alias("comp"))
        else:
            step = up.select(F.col("node").alias("comp"), "up")
            labels = kept(labels.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        ends = [up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        edges = kept(moved.where("a != b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("comp"))
    return labels
