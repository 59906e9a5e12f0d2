"""Connected components by min-label hooking, pointer jumping and contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsieve.functions.session import cut, drop, prepare

#: Nodes that a task remembers before it gives out what it has and begins anew.
NODES = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected (a, b) edges; the component is its smallest node.

    Every node hooks to its smallest neighbour below it, parents are shortened to roots, and edges are
    contracted to the roots until none are left: stars vanish in one round, chains in a logarithmic number.
    Before that, each task leaves out edges whose ends its other edges join already, so what is shuffled grows
    with nodes rather than edges. Tables of a round are deleted after the next.
    """
    prepare(edges.sparkSession)
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    e = cut(e.mapInArrow(forest, e.schema))
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        if e.isEmpty():
            return labels
        last = (e, labels)  # at first both are read from one table
        up = _to_roots(cut(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))), max_rounds)
        labels = cut(_relabel(labels, "component", up).select("node", "component"))
        e = _relabel(_relabel(e, "a", up), "b", up)
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        drop(up, *last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def forest(batches, most: int = NODES):
    """Of (a, b) rows those that join what the rows before did not: union by size with halved paths."""
    up: dict = {}
    size: dict = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        keep = []
        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            x, y = root(a), root(b)
            if x != y:
                keep.append(i)
                n, m = size.pop(x, 1), size.pop(y, 1)
                x, y = (x, y) if n >= m else (y, x)
                up[y], size[x] = x, n + m
        if keep:
            yield batch.take(pa.array(keep))
        if len(up) > most:
            up.clear()
            size.clear()


def _relabel(df: DataFrame, column: str, up: DataFrame) -> DataFrame:
    to = up.select(F.col("node").alias("_n"), F.col("root").alias("_to"))
    return df.join(to, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_to", column)).drop("_n", "_to")


def _to_roots(up: DataFrame, max_rounds: int) -> DataFrame:
    for _ in range(max_rounds):
        nxt = cut(up.join(up.select(F.col("node").alias("_n"), F.col("root").alias("_to")), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")))
        drop(up)
        up = nxt.select("node", "root")
        if nxt.where("moved").isEmpty():
            return up
    raise RuntimeError("parent links form a cycle")
