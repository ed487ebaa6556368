"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import discard, stored

#: Edges that a task holds at once.
HELD = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that are not the smallest of their component, each with the smallest."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    low, (x, y) = np.arange(len(nodes)), np.split(place, 2)
    while len(x):
        x, y = low[x], low[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != low[low]).any():
            low = low[low]
    own = low < np.arange(len(nodes))
    return nodes[own], nodes[low[own]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components, where those that one task reads together are stars."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flat() -> pa.RecordBatch:
            a, b = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in range(2))
            return pa.record_batch([pa.array(c, pa.int64()) for c in stars(a, b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= HELD:
                yield flat()
                held, rows = [], 0
        if rows:
            yield flat()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(each, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its larger ones; at most as many edges as before."""
    around = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = around.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
    return around.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node (``a``) hands its smallest neighbour to its smaller ones (``b``) and itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b``, which is no ``a`` itself."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("up"))
    ends = ends.union(edges.select("b", F.lit(None).cast("long")))
    nodes = ends.groupBy("node").agg(
        F.min("up").alias("low"), F.max("up").alias("high"), F.count(F.lit(1)).alias("rows"), F.count("up").alias("ups")
    )
    return nodes.where("low < high or ups > 0 and ups < rows").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for nodes with edges ``a``, ``b``.

    Loops and repeated edges do no harm. Before each round every task joins what it reads, so that only chains across
    tasks take rounds. Every round is written to the shared folder; the rounds grow with the logarithm of the longest
    chain, and none is made once all edges lead to their smallest node. A hub's neighbours meet its minimum in a join that
    the adaptive plan can split.
    """
    edges = stored(_contracted(edges.where("a <> b")), "edges")
    while not _are_stars(edges):
        last, moved = edges, stored(_small_star(_large_star(edges)).distinct(), "edges")
        edges = stored(_contracted(moved), "edges")
        discard(last, moved)
    return edges.union(edges.select("b", "b")).toDF("node", "component").distinct()
