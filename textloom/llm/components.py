"""Connected components of a link table: of few links in one task, otherwise by alternating large-star and small-star steps
on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, staged

#: Links that one task takes at most (some 30 MB of arrays); more go through the star steps, each of which is a handful of
#: shuffles however few the links are.
ONE_TASK = 2**18


def _of_arrays(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:  # of a component's roots, all but local minima hook onto a smaller one: at most half of them stay
        new, low = root.copy(), np.minimum(root[i], root[j])
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]:
            found = _of_arrays(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")


def _large_star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Each node hands the smallest node it sees to its larger neighbours.

    The smallest nodes are staged, so that both sides of the join are plain shuffles and adaptive execution can split the
    rows of a hub.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of its smaller neighbours to the others and to itself. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of links (a long, b long); a component is named by its smallest node.

    Links to itself and repeated links are allowed; without links the result is empty. Links are read twice, so they had
    better be staged. Up to ONE_TASK of them are joined in one task; beyond, every step is a shuffle of the remaining edges
    and the number of steps grows with the logarithm of the node count.
    """
    links = links.where("a <> b").select("a", "b")
    if links.count() <= ONE_TASK:
        return _in_one_task(links)
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        if not before[0]:
            break
        stars, least = _large_star(edges, name)
        after = staged(_small_star(stars), name)
        discard(edges)
        discard(least)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
