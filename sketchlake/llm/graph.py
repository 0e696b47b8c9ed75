"""Connected components of an edge table: local contraction, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchlake.llm.runtime import checkpoint, ship

#: Edges that one task contracts at once.
TASK_EDGES = 500_000


def local_roots(group: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """Nodes 0 to n - 1 and the smallest node that each is joined with through shared groups."""
    label = np.arange(n)
    while True:
        least = np.full(group.max() + 1 if len(group) else 0, n)
        np.minimum.at(least, group, label[node])
        new = label.copy()
        np.minimum.at(new, node, least[group])
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the smallest node of each local component."""
    held = [np.stack([b.column(i).to_numpy() for i in range(2)]) for b in batches]
    edges = np.unique(np.concatenate(held, 1), axis=1) if held else np.zeros((2, 0), np.int64)
    name, at = np.unique(edges, return_inverse=True)
    root = local_roots(np.tile(np.arange(edges.shape[1]), 2), at.ravel(), len(name))
    far = np.flatnonzero(root != np.arange(len(name)))
    yield pa.RecordBatch.from_arrays([pa.array(name[far]), pa.array(name[root[far]])], ["u", "v"])


def _pointed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger end ``u`` to the smaller ``v``."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node that has an edge and isn't its component's smallest; label is that smallest.

    ``edges`` has bigint columns ``u`` and ``v``. Tasks of at most TASK_EDGES edges
    first contract what they hold, while that halves the edges; a graph that fits
    one task so is done. What is larger goes through the star steps: both steps only take a
    minimum per node and join it back, so a node with very many edges is
    pre-aggregated and, as the minima are written first, its join is one that AQE can split. Rounds grow with the
    logarithm of the longest path. Lineage is cut after each round.
    """
    ship(edges.sparkSession)
    edges = checkpoint(edges.select("u", "v"))
    n = edges.count()
    while n:
        # a task's edges become a spanning star per local component; few enough edges are one task's, and then done
        parts = -(-n // TASK_EDGES)
        edges = checkpoint(edges.repartition(parts).mapInArrow(_contract, "u long, v long"))
        if parts == 1:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before, n = n, edges.count()
        if n > before // 2:
            break
    edges = checkpoint(_pointed(edges))
    seen = _fingerprint(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpoint(small.where("u <> v").distinct())
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
