"""Connected components by alternating large and small stars, each round a written table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.plans.staging import drop, settle

#: A node with more than this part of all edges is joined by broadcast.
HOT_NODES = 1000


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) to (id, root), root being the least id of the component; for ids that an edge names.

    Per star only a minimum is gathered, so a node with very many edges costs one row a task in the shuffle that finds
    its minimum; as such nodes are at most one or two thousand, the join that brings it back is a broadcast for them.
    Loops give their id as its own root. A round's table goes when the next is written.
    """
    ids = settle(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = _mark(now)
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        most = max(2 * mark[0] // HOT_NODES, 64)
        hot = F.broadcast(least.where(F.col("n") > most))
        above = both.where("b > a")
        met = above.join(hot, "a").unionByName(above.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("n") <= most), "a"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(least)
        before, now = now, settle(small.distinct())
        drop(before)
        if (new := _mark(now)) == mark:
            break
        mark = new
    else:
        raise RuntimeError("components have not settled")
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    """The number of edges and the exclusive or of their hashes: equal for equal sets."""
    got = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return got["n"], got["x"]
