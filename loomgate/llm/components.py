"""Connected components by repeated contraction, all in DataFrames.

In each round every node joins the neighbour (or itself) with the smallest hash; joined nodes become one, edges are
rewritten between them and made distinct, until none is left. A constant share of the nodes goes in each round,
whatever the shape of the graph. Every intermediate is written into the shared folder, so both sides of each join are
plain exchanges: AQE splits a hub's rows. A side is broadcast only in rounds of MOST_HELD edges at most: long columns of
few values make files far smaller than the rows that the driver would hold. Nothing is collected but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, whole_rows

#: Edges of a round whose nodes a join may broadcast, if Spark finds their files small.
MOST_HELD = 100_000


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """edges: a, b of one type, undirected, repeats and loops allowed. Returns node, component (some node of its own) for all their ends.

    Null ends are left out. No edges give no rows.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = materialize(e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct())
    e = materialize(e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps, held = [], []
    for turn in range(most_rounds):
        if not (n := e.count()):
            break
        # nodes are twice the edges at most
        held.append((lambda df: df) if n <= MOST_HELD else whole_rows)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        joins = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["id"].alias("to")))
        maps.append(joins)
        new = e.join(held[-1](joins.withColumnsRenamed({"node": "a", "to": "x"})), "a").select("x", "b")
        new = new.join(held[-1](joins.withColumnsRenamed({"node": "b", "to": "y"})), "b").filter("x <> y")
        new = materialize(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(e)
        e = new
    else:
        raise RuntimeError("components did not contract")
    discard(e)
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    # from the last round back: where a node went, and where that went later
    whole = maps[-1].withColumnRenamed("to", "component")
    for joins, hold in zip(reversed(maps[:-1]), reversed(held[1:])):
        later = hold(whole.withColumnsRenamed({"node": "to", "component": "later"}))
        longer = materialize(joins.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("component")))
        discard(joins, *([whole] if hasattr(whole, "_written") else [maps[-1]]))
        whole = longer
    return nodes.join(held[0](whole), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
