"""Connected components of a link table by local union-find and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewright.llm.common import cut_lineage


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes but the smallest ones themselves, for the edges u-v."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(step := new[new], new):
            new = step
        if np.array_equal(new, label):
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[rest], names[label[rest]]


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) as one edge from each of its nodes to the smallest node it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            u, v = roots_of(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two nodes; component is the smallest node that it reaches.

    Partitions first contract their own edges, so that a hot node keeps one edge a partition. Each round then brings a
    node's edges together, contracts again, and lets every edge point at its target's own target. A hot target is the
    key of a join alone, whose rows Spark splits. It ends when every node points at one node that points nowhere.
    """
    e = contracted(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(f"{a} <> {b}"))
    while True:
        near = contracted(e.repartition("u"))
        up = near.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("up"))
        e = cut_lineage(near.join(up, "v", "left").select("u", F.coalesce("up", "v").alias("v"), F.col("up").isNotNull().alias("moved")))
        busy = e.groupBy("u").agg((F.max("moved") | (F.min("v") != F.max("v"))).alias("busy")).agg(F.bool_or("busy")).first()[0]
        if not busy:
            break
    tree = e.select("u", "v").distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
