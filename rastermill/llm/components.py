"""Connected components over an edge table, as joins and aggregations only.

Each round lets every node pick the smallest-priority node among itself and its neighbours, then
renames the edges by that choice and drops the ones that became loops. Priorities are hashes that
change from round to round, so chains of ordered ids contract as fast as stars. No node's neighbours
are ever gathered: the choice is a partial minimum, and the renaming joins read two written tables,
which lets adaptive execution split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, save


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another node.

    `root` is some member of the component, the same for all of its members. Null ends, loops and
    repeated edges have no effect; an empty table gives an empty table.
    """
    now = save(_tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    hops: list[DataFrame] = []
    while not now.isEmpty():
        hops.append(save(_choose(now, len(hops)), "hop"))
        left = save(_tidy(_rename(_rename(now, hops[-1], "a"), hops[-1], "b")), "edges")
        drop(now)
        now = left
    if not hops:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    drop(now)
    end = hops.pop()
    while hops:
        hop, later = hops.pop(), end.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        whole = save(hop.join(later, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to")), "roots")
        drop(end, hop)
        end = whole
    return end.withColumnRenamed("to", "root")


def component_ids(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """(node, component_id) for every distinct node: the smallest node that can be reached, itself included."""
    roots = connected_components(edges)
    all_nodes = nodes.select(F.col(node).alias("_v")).distinct()
    placed = save(all_nodes.join(roots, F.col("_v") == F.col("node"), "left").select("_v", F.coalesce("root", "_v").alias("_r")), "placed")
    least = save(placed.groupBy("_r").agg(F.min("_v").alias("component_id")).withColumnRenamed("_r", "_least"), "least")
    return save(placed.join(least, F.col("_r") == F.col("_least")).select(F.col("_v").alias("node"), "component_id"), "components")


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _choose(edges: DataFrame, round_no: int) -> DataFrame:
    def ranked(c):
        return F.struct(F.xxhash64(F.lit(round_no), F.col(c)).alias("p"), F.col(c).alias("n"))

    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(ranked("b")).alias("m"))
    return best.select(F.col("a").alias("node"), F.least(F.col("m"), ranked("a")).getField("n").alias("to"))


def _rename(edges: DataFrame, hop: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    return edges.join(hop, edges[end] == hop["node"]).select(F.col("to").alias(end), other)
