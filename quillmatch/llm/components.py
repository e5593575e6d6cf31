"""Connected components of a graph whose edges are pairs of longs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.common import Scratch, ship

#: Edges that a file of a round has, about, and with how many at most a graph is small.
ROWS_OF_FILE, SMALL = 200_000, 200_000
NODES = "node long, root long"


def _minima(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each u, from edges (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest node of the component of each, by passing smaller labels along edges and halving the way to them."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def small_components(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph of at most SMALL edges, which one task has in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            found = united(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "root"])

    ship(edges.sparkSession)
    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, NODES)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "edges", small: int = SMALL, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    A graph of at most ``small`` edges, some MB, is settled by one task. A larger one alternates the large-star and small-star steps,
    which needs a number of rounds of the order of the squared logarithm of the component size, whatever the diameter.
    Each step finds minima by aggregation, with partial sums before the shuffle, and joins them back to a written table; so the star
    of a large component is a skewed join that adaptive execution splits, and never one group in one task. Rounds are written to the
    shared folder, in a number of files that follows that of the edges, and the last round alone stays. Loops and repeated edges are
    harmless; an empty graph gives an empty table.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before = _state(now)
    if before[0] <= small:
        return small_components(now)
    for i in range(1, max_rounds):
        files = 4 + before[0] // ROWS_OF_FILE
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(_minima(both).select("u", F.least("u", "m").alias("m")), f"{name}-low-{i}", files)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"{name}-large-{i}", files)
        low = scratch.keep(_minima(large), f"{name}-small-{i}", files)
        hop = large.join(low, "u")
        small_star = hop.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small_star, f"{name}-{i}", files)
        state = _state(after)
        scratch.drop(f"{name}-low-{i}", f"{name}-large-{i}", f"{name}-small-{i}", f"{name}-{i - 1}")
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def more_linked(linked: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """linked (node, root) after more edges, of which only those between roots are looked at; the first time all."""
    if linked is None:
        return connected_components(edges, scratch, name)
    for end in ("u", "v"):
        of = linked.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = edges.join(of, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    found = scratch.keep(connected_components(edges, scratch, name), f"{name}-roots")
    of_root = found.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    renamed = linked.join(of_root, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return renamed.unionByName(found.join(linked.select("node"), "node", "left_anti"))
