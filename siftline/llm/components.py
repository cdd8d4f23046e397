"""Consolidating pairwise matches into groups: union-find forests, merged in levels.

Each edge partition is reduced to a spanning forest by union-find in bounded memory. Forests of at
most ``bound`` edges are merged by one task. Larger ones are merged in ranges of their roots, then
nodes are brought together to link the roots they have in several ranges; these links are all that
is left. Where that is more than half, so that identifiers tell nothing about groups, the nodes left
are contracted: each leads to a local minimum, at most half of the nodes. The links left go through
the union-find of partitions again, and their groups are handed down. Joins on a hub are salted. No
edge is dropped; beside counts, only a table of at most ``SENT`` rows goes through the driver.

Rows with a null end or two equal ends are no links; repeated and reversed links count once; an
empty table gives no groups. A group's identifier is its smallest record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.runtime import cut, small, spread_join

#: Most edges that one task merges at a time.
BOUND = 2_000_000
#: Most rows of contracted nodes that are sent to every executor (16 bytes each).
SENT = 1_000_000
#: Links of a node beyond which a join on it is salted.
HOT = 100_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    parent = np.arange(len(nodes))
    while True:  # roots hook to smaller ones, then pointers are halved until all lead to roots
        rx, ry = parent[x], parent[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[parent]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _forests(bound: int, with_roots: bool, in_parts: bool = False):
    """Links of a partition to (node, root) links, with their roots or without; with roots as one forest, or ``in_parts``, in bounded memory."""

    def run(batches):
        def made(nodes, roots):
            keep = slice(None) if with_roots else nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(roots[keep], pa.int64())], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count >= bound and (in_parts or not with_roots):
                nodes, roots = union_find(*map(np.concatenate, zip(*held)))
                held, count = [(nodes, roots)], len(nodes)
                if count > bound // 2:
                    yield made(nodes, roots)
                    held, count = [], 0
        if held:
            nodes, roots = union_find(*map(np.concatenate, zip(*held)))
            for i in range(0, len(nodes), 100_000):
                yield made(nodes[i : i + 100_000], roots[i : i + 100_000])

    return run


def _meet(batches):
    """Every node of a partition and its smallest root (``kind`` 0); the links of its other roots to that one (1)."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not held:
        return
    a, b = map(np.concatenate, zip(*held))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    least = np.repeat(b[first], np.diff(np.r_[first, len(a)]))
    other = b != least
    for kind, x, y in ((0, a[first], b[first]), (1, b[other], least[other])):
        for i in range(0, len(x), 100_000):
            n = len(x[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(x[i : i + n], pa.int64()), pa.array(y[i : i + n], pa.int64())], ["kind", "a", "b"])


def _narrow(forest: DataFrame, parts: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """``a, p``: the smallest root that each node has in forests of neighbouring roots; ``a, b``: the links left between roots.

    Where groups keep to a range of identifiers, few links are left; no pointers are followed.
    """
    near = forest.repartitionByRange(parts, "b").mapInArrow(_forests(bound, True, True), "a bigint, b bigint")
    met = cut(near.repartition(parts, "a").mapInArrow(_meet, "kind int, a bigint, b bigint"))
    return met.where("kind = 0").select("a", F.col("b").alias("p")), met.where("kind = 1").select("a", "b")


def _contract(forest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, p``: the local minimum each node leads to; ``a, b``: the links left between local minima."""
    both = forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")))
    while True:  # chains of pointers are halved until all lead to their ends
        over = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = cut(spread_join(up, over, "p", "a", hot=HOT).select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
        moved = up.where("moved").limit(1).count()
        up = up.select("a", "p")
        if not moved:
            break
    rest = spread_join(forest, up.select("a", F.col("p").alias("x")), "a", "b", hot=HOT)
    rest = spread_join(rest, up.select(F.col("a").alias("b"), F.col("p").alias("y")), "b", "a", hot=HOT)
    return up, rest.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", bound: int = BOUND) -> DataFrame:
    """``record_id`` and ``group_id`` of every record that has a link."""
    links = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    levels: list[DataFrame] = []
    while True:
        forest = cut(links.mapInArrow(_forests(bound, False), "a bigint, b bigint"))
        if (count := forest.count()) <= bound:
            break
        up, links = _narrow(forest, -(-2 * count // bound), bound)
        levels.append(up)
        if links.count() > count // 2:
            up, links = _contract(links)
            levels.append(up)
    whole = forest.repartition(1).mapInArrow(_forests(bound, True), "a bigint, b bigint")
    for up in reversed(levels):  # a root or local minimum without links left is its group's
        to = cut(whole).select(F.col("a").alias("p"), F.col("b").alias("g"))
        sent = small(to, SENT)
        joined = up.join(sent, "p", "left") if sent is not to else spread_join(up, to, "p", "a", "left", HOT)
        whole = joined.select("a", F.coalesce("g", "p").alias("b"))
    return whole.select(F.col("b").alias("group_id"), F.col("a").alias("record_id"))


def sim_groups(sims: DataFrame, least: float = 0.5) -> DataFrame:
    """Groups of records linked by similarity results: ``sim`` a number from ``least`` to 1."""
    return components(sims.where((F.col("sim") >= least) & (F.col("sim") <= 1)), "source", "target")
