"""Connected components of an edge table, on Spark all the way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spent, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a task's own edges as edges to each component's least member, one for each other member."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a least spanning forest: in each round every component takes its lightest edge."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.lexsort((b, a, weight))
    x, y = at[: len(a)][order], at[len(a) :][order]
    label, left, taken = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, label[x[left]], left)
        np.minimum.at(best, label[y[left]], left)
        own = np.unique(best[best < len(order)])
        taken.append(own)
        far, near = forest(label[x[own]], label[y[own]])
        to = np.arange(len(nodes))
        to[far] = near
        label = to[label]


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it can reach) for every node of edges(a, b).

    Each round a node takes the least label among its neighbours' and then its label's label, so labels run along
    paths in jumps. Every round is a table in the shared folder: no lineage grows, and a lost executor costs a task.
    A node with very many edges is counted down by partial aggregation first, and the joins have plain stored tables on
    both sides, which adaptive execution may split where one key is large.
    """
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    both = written(pairs.union(pairs.select("b", "a")).toDF("a", "b"), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        near = written(seen, "near")
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        hooked = written(hooked, "labels")
        up = hooked.select(F.col("node").alias("n"), F.col("label").alias("up"))
        jumped = hooked.join(up, hooked["label"] == up["n"]).select("node", F.col("up").alias("label"), (F.col("moved") | (F.col("up") < F.col("label"))).alias("moved"))
        spent(labels, near)
        labels, old = written(jumped, "labels"), hooked
        spent(old)
        if labels.filter("moved").isEmpty():
            spent(pairs, both)
            return labels.drop("moved").withColumnRenamed("label", "component")
