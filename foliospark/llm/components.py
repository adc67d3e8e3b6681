"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.scratch import Workspace, dropped


def connected_components(edges: DataFrame, kept: Workspace, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is its smallest node, or
    after a number of ``rounds`` some smaller node that it is connected to.

    Each round gives a node the smallest label among its neighbours and then the label of that
    label, so trees halve in depth. State goes through a stored table each round: rounds don't
    stack up in the plan, and a lost executor costs one round. Only a count reaches the driver.
    A hub's edges are many rows of one key on one side of a join, whose other side has a row for a
    node, so they can be split."""
    spark = edges.sparkSession
    rows = 2 * edges.count()
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, edges_path = kept.table(both, "edges", rows, narrow=True)
    state, path = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), None
    while rounds is None or rounds > 0:
        rounds = rounds and rounds - 1
        near = both.join(state, both.b == state.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        own = state.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        over = state.select(F.col("node").alias("label"), F.col("component").alias("beyond"))
        after = own.join(over, "label").select("node", F.least("label", "beyond").alias("component"), "was")
        after, next_path = kept.table(after, "components", rows, narrow=True)
        changed = after.where("component <> was").count()
        if path:
            dropped(spark, path)
        state, path = after.drop("was"), next_path
        if not changed:
            break
    if path:
        dropped(spark, edges_path)
    return state
