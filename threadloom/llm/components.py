"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node that isn't the least of its own."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if not (other := lo != hi).any():
            break
        np.minimum.at(up, hi[other], lo[other])
        while (two := up[up]).tobytes() != up.tobytes():
            up = two
    child = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[child], nodes[up[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's edges to stars: as many edges as it has nodes at most, the same components."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        u, v = forest(np.concatenate([u, b["u"].to_numpy()]), np.concatenate([v, b["v"].to_numpy()]))
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(u long, v long)``; the root is its component's least node
    and stands for itself too.

    Edges are contracted inside tasks, then large and small stars alternate until nothing changes:
    logarithmically many rounds, each with its tables in the shared folder.  The least neighbour
    is summed up before it moves, and joins on a hot node have a bare exchange on both sides, so
    that Spark can split it.
    """
    links = stash(edges.select("u", "v").filter("u <> v").mapInArrow(_contract, "u long, v long"), "edges")
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stash(both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        down = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        spent = (links, least, large, down)
        links = stash(small.select("e.*").filter("u <> v").distinct(), "edges")
        discard(*spent)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
