"""Linked records as trees: components, single-linkage trees, exemplars, nested JSON.

``sims`` is ``sim, src, dst``. Null or equal ends are no links. A component's tree is built in one
task, as the linkage depends on the order of its links; they reach it packed by the tasks that found
them, without those that change no tree. Components themselves are found by joins, after the links of each partition have been reduced
to a forest.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators import linkage
from siftline.runtime import cut, small

#: Links that one task joins to components; links that are packed together.
TASK_LINKS = PACK_LINKS = 2_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the links, the numbers of both ends and of each node's root, the smallest of its component: roots hook to smaller ones, then pointers are halved."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = left, right = ends.reshape(2, -1)
    up = np.arange(len(nodes))
    while True:
        rx, ry = up[x], up[y]
        apart = rx != ry
        if not apart.any():
            return nodes, left, right, up
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
        while (up[up] != up).any():
            up = up[up]


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest of each one's component."""
    nodes, _, _, up = _roots(a, b)
    return nodes, nodes[up]


def _locally(final: bool):
    """Links of a partition to (node, root) links; without ``final``, roots themselves are left out and memory is bounded."""

    def run(batches):
        held, count = [], 0

        def made():
            nodes, roots = _labels(*map(np.concatenate, zip(*held)))
            keep = slice(None) if final else nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(roots[keep], pa.int64())], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count >= TASK_LINKS and not final:
                yield made()
                held, count = [], 0
        if held:
            yield made()

    return run


#: What ``forest_of`` yields: links of a forest, and with a null ``a`` the number of links read.
FOREST = "a bigint, b bigint"


def forest_of(batches):
    """Batches of ``sim, src, dst`` of different nodes to links of a forest and their number."""
    read = [0]

    def pairs():
        for batch in batches:
            read[0] += batch.num_rows
            yield pa.RecordBatch.from_arrays(batch.columns[1:3], ["a", "b"])

    yield from _locally(False)(pairs())
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(read, pa.int64())], ["a", "b"])


def joined(forest: DataFrame) -> DataFrame:
    """``id``, ``component`` of what ``forest_of`` made."""
    return components(forest.where("a is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def forest_info(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """``graph_info`` of what ``forest_of`` made."""
    forest = cut(forest)
    n, e = nodes.agg(F.count("*").alias("nodes")), forest.where("a is null").agg(F.coalesce(F.sum("b"), F.lit(0).cast("bigint")).alias("edges"))
    c = joined(forest).agg(F.count_distinct("component").alias("components"))
    return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c))  # one row each


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (its smallest id).

    Links are first reduced to forests within their partitions; if these hold at most ``TASK_LINKS``
    links together, one task joins them, else they are contracted.
    """
    forest = links.where("src <> dst").select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")).mapInArrow(_locally(False), "a bigint, b bigint")
    forest = cut(forest)
    if forest.count() > TASK_LINKS:
        return contracted(forest)
    return forest.coalesce(1).mapInArrow(_locally(True), "a bigint, b bigint").select(F.col("a").alias("id"), F.col("b").alias("component"))


def contracted(links: DataFrame) -> DataFrame:
    """``id``, ``component`` of links ``a, b`` by contraction.

    In each round every node points to its smallest neighbour if that is smaller, chains of pointers
    are halved until all lead to their ends, and links are redrawn between the ends. Only local
    minima stay, at most half of the nodes, so rounds and halvings are logarithmic.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")))
        while True:
            over = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = cut(up.join(over, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moved = up.where("moved").limit(1).count()
            up = up.select("a", "p")
            if not moved:
                break
        if labels is None:
            labels = up.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            to = up.select(F.col("a").alias("component"), F.col("p").alias("top"))
            labels = cut(labels.join(to, "component", "left").select("id", F.coalesce("top", "component").alias("component")))
        pa, pb = up.select("a", F.col("p").alias("x")), up.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = cut(edges.join(pa, "a").join(pb, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if not edges.limit(1).count():
            return labels.select("id", "component")


class _Forest:
    """Trees under construction: ``up`` leads to parents, ``down`` to (child, sim) in order of adding."""

    def __init__(self, names: dict[int, list[str]], close: float):
        self.names, self.close = names, close
        self.up: dict[str, str] = {}
        self.down: dict[str, list[tuple[str, float]]] = {}
        self.tokens: dict[str, list[str]] = {}
        self.labels: dict[str, str] = {}

    def root(self, node: str) -> str:
        while node in self.up:
            node = self.up[node]
        return node

    def leaf(self, i: int) -> str:
        node = str(i)
        if node not in self.tokens:
            self.tokens[node] = self.names.get(i) or []
            self.labels[node] = ":".join(t for t in self.tokens[node] if t is not None)
        return node

    def join(self, sim: float, a: str, b: str) -> None:
        ra, rb = self.root(a), self.root(b)
        meta = f"{a}_{b}"
        self.down[meta] = [(ra, sim), (rb, sim)]
        self.up[ra] = self.up[rb] = meta
        shared = set(self.tokens[rb])
        self.tokens[meta] = [t for t in self.tokens[ra] if t in shared]
        self.labels[meta] = ":".join(t for t in self.tokens[meta] if t is not None) or "---"

    def attach(self, sim: float, new: str, old: str) -> None:
        """Hang a new leaf below the other's root if their levels are close, else join them."""
        top = self.root(old)
        if abs(sim - self.down[top][0][1]) <= self.close:
            self.down[top].append((new, sim))
            self.up[new] = top
        else:
            self.join(sim, new, old)


def link(sims: list[tuple[float, int, int]], names: dict[int, list[str]], close: float) -> _Forest:
    """Single linkage over similarities from the highest down (ties: higher ids first)."""
    sims = sorted(sims, reverse=True)
    near: dict[int, list[tuple[int, float]]] = {}
    for sim, a, b in sims:
        near.setdefault(a, []).append((b, sim))
        near.setdefault(b, []).append((a, sim))
    forest = _Forest(names, close)
    known = lambda i: str(i) in forest.tokens
    other = lambda i, sim: next((t for t, s in near[i] if known(t) and abs(s - sim) <= close), None)
    for sim, a, b in sims:
        if not known(a) and not known(b):
            if (via := other(a, sim)) is not None:
                b = via
            elif (via := other(b, sim)) is not None:
                a = via
            else:
                forest.join(sim, forest.leaf(a), forest.leaf(b))
                continue
        if known(a) and known(b):
            if forest.root(str(a)) != forest.root(str(b)):
                forest.join(sim, str(a), str(b))
        elif known(b):
            forest.attach(sim, forest.leaf(a), str(b))
        else:
            forest.attach(sim, forest.leaf(b), str(a))
    return forest


#: What ``packed`` yields: for links that hang together their smallest node, nodes and levels in order, and ``n`` times the numbers of level, src and dst.
PACKED = "root bigint, nodes array<bigint>, levels array<double>, n bigint, links binary"
#: What ``thinned`` yields: the links that can change a tree, with their flags of ``linkage.thin``.
THINNED = PACKED + ", flags binary"


def thinned(close: float) -> Callable:
    """``packed`` for pairs whose links ``packed_trees`` can find again, without links that change no tree of that ``close``."""
    return lambda batches: packed(batches, close)


def packed(batches, close: float | None = None):
    """Batches of ``sim, src, dst`` of different nodes to all their links, packed by what hangs together."""
    held, count = [], 0

    def made():
        sim, a, b = (np.concatenate(c) for c in zip(*held))
        flags = None if close is None else np.zeros(len(a), np.uint8)
        if close is not None:
            nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            levels, level = np.unique(sim, return_inverse=True)
            if (bits := linkage.width(len(nodes), len(levels))) is not None:
                x, y = ends.reshape(2, -1).astype(np.uint64)
                keys = (level.astype(np.uint64) << np.uint64(2 * bits)) | (x << np.uint64(bits)) | y
                order = np.argsort(keys)
                stay, flags = linkage.thin(keys[order], bits, levels, len(nodes), close)
                order, flags = order[stay], flags[stay]
                sim, a, b = sim[order], a[order], b[order]
        nodes, x, y, up = _roots(a, b)
        levels, level = np.unique(sim, return_inverse=True)
        names, own = np.unique(up, return_inverse=True)
        order = np.argsort(own, kind="stable")
        begin = np.searchsorted(own[order], np.arange(len(names) + 1))
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes)) - begin[own[order]]
        by = np.argsort(own[x], kind="stable")
        cuts = np.searchsorted(own[x][by], np.arange(len(names) + 1))
        rows = np.stack([level[by], place[x][by], place[y][by]]).astype(np.int32)
        for at in range(0, len(names), 10_000):
            out = []
            for k in range(at, min(at + 10_000, len(names))):
                part = rows[:, cuts[k] : cuts[k + 1]]
                own_levels, part[0] = np.unique(part[0], return_inverse=True)
                out.append((nodes[names[k]], nodes[order[begin[k] : begin[k + 1]]], levels[own_levels], part.shape[1], pa.compress(part.tobytes(), "zstd", asbytes=True)))
                if flags is not None:
                    out[-1] += (pa.compress(flags[by[cuts[k] : cuts[k + 1]]].tobytes(), "zstd", asbytes=True),)
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.binary(), pa.binary()
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["root", "nodes", "levels", "n", "links", "flags"][: len(columns)])

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
        if count >= PACK_LINKS:
            yield from made()
            held, count = [], 0
    if held:
        yield from made()


def _unpacked(packs: pa.Table, ids: np.ndarray):
    """All levels, and for each row its links' levels and ends as numbers of levels and ids, and their flags."""
    levels = np.unique(packs["levels"].combine_chunks().flatten().to_numpy())

    def rows():
        flagged = packs["flags"] if "flags" in packs.column_names else [None] * len(packs)
        for nodes, own, n, links, flags in zip(*(packs[c] for c in ("nodes", "levels", "n", "links")), flagged):
            level, x, y = np.frombuffer(pa.decompress(links.as_buffer(), 12 * n.as_py(), "zstd"), np.int32).reshape(3, -1)
            place = np.searchsorted(ids, nodes.values.to_numpy())
            yield np.searchsorted(levels, own.values.to_numpy())[level], place[x], place[y], flags and np.frombuffer(pa.decompress(flags.as_buffer(), n.as_py(), "zstd"), np.uint8)

    return levels, rows()


def _shared(lists: pa.Array) -> list[list | None]:
    """The lists, with one object for equal tokens."""
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    words, at = [*coded.dictionary.to_pylist(), None], 0
    flat, out = coded.indices.fill_null(len(words) - 1).to_pylist(), []
    for n in pa.compute.list_value_length(lists).to_pylist():
        out.append(None if n is None else [words[k] for k in flat[at : at + n]])
        at += n or 0
    return out


def _alike(members: pa.Table, threshold: float) -> Callable:
    """A search for all links of a member as ``pair_blocks.alike`` finds them: ``sims, ends`` of its number."""
    members = members.sort_by("id").combine_chunks()
    ws, ks = members["ws"].chunk(0), members["ks"].chunk(0)
    m, starts = np.diff(ws.offsets.to_numpy()), ws.offsets.to_numpy() - ws.offsets[0].as_py()
    flat = np.unique(ws.flatten().to_numpy(), return_inverse=True)[1].astype(np.int32)
    holders = np.repeat(np.arange(len(m), dtype=np.int32), m)[np.argsort(flat, kind="stable")]
    begin = np.searchsorted(np.sort(flat), np.arange(int(flat.max(initial=-1)) + 2))
    keys = None if ks.null_count else ks.flatten().to_numpy().reshape(len(m), -1)

    def links(node: int) -> tuple[np.ndarray, np.ndarray]:
        shared = np.bincount(np.concatenate([holders[begin[w] : begin[w + 1]] for w in flat[starts[node] : starts[node + 1]]]), minlength=len(m))
        shared[node] = 0
        ends = np.flatnonzero(shared > threshold * m[node])
        larger = np.maximum(m[ends], m[node])
        ok = shared[ends] > threshold * larger
        if keys is not None:
            ok &= (keys[ends] == keys[node]).any(axis=1)
        return shared[ends[ok]] / larger[ok], ends[ok]

    return links


def _built(packs: pa.Table, members: pa.Table, close: float, threshold: float | None = None) -> pa.Table:
    """The tree's rows of one component; with a threshold, links were thinned and the members have ``ws`` and ``ks``."""
    ids, names = np.unique(members["id"].to_numpy()), dict(zip(members["id"].to_pylist(), _shared(members["tokens"].combine_chunks())))
    levels, rows = _unpacked(packs, ids)
    component, bits = packs["component"][0].as_py(), linkage.width(len(ids), len(levels))
    if bits is None:  # too many for numbers of 64 bits
        if threshold is not None:
            raise OverflowError("a component of so many nodes needs all of its links")
        forest = link([(levels[s], int(ids[x]), int(ids[y])) for part in rows for s, x, y in zip(*part[:3])], {i: t or [] for i, t in names.items()}, close)
        out = [(p, c, s, c in forest.down, forest.labels[c]) for p, kids in forest.down.items() for c, s in kids]
        out += [(None, c, None, c in forest.down, forest.labels[c]) for c in forest.tokens if c not in forest.up]
        parents, children, weights, metas, labels = zip(*out)
    else:
        keys, at, below = np.empty(sum(packs["n"].to_pylist()), np.uint64), 0, None
        for level, x, y, flags in rows:
            keys[at : at + len(x)] = (level << 2 * bits) | (x << bits) | y
            if flags is not None:
                below = np.zeros(len(ids), np.uint64) if below is None else below
                for bit, ends in ((1, x), (2, y)):
                    hit = np.flatnonzero(flags & bit)
                    np.maximum.at(below, ends[hit], keys[at + hit])
            at += len(x)
        keys.sort()
        known = ids.tolist()
        parent, weight, tokens, named = linkage.grow(keys, bits, levels, [names.get(i) or [] for i in known], close, lambda i: str(known[i]), below, None if threshold is None else _alike(members, threshold))
        label = lambda i: ":".join(t for t in tokens[i] if t is not None) or "---" * (i >= len(known))
        rows = [i for i, n in enumerate(named) if n is not None]
        parents, children, weights = [named[parent[i]] if parent[i] >= 0 else None for i in rows], [named[i] for i in rows], [weight[i] for i in rows]
        metas, labels = [i >= len(known) for i in rows], pa.array(map(label, rows), pa.string())
    inverse = [None if w is None else 1 - w for w in weights]
    columns = [pa.array([component] * len(metas), pa.int64()), pa.array(parents, pa.string()), pa.array(children, pa.string()), pa.array(weights, pa.float64()), pa.array(inverse, pa.float64()), pa.array(labels, pa.string()), pa.array(metas, pa.bool_())]
    return pa.table(columns, ["component", "parent", "child", "weight", "inv_weight", "label", "is_meta"])


def trees(sims: DataFrame, records: DataFrame, close: float = 0.0) -> DataFrame:
    """``component, parent, child, weight, inv_weight, label, is_meta`` of each component's tree; the root has a null parent."""
    links = sims.where("src <> dst").select(F.col("sim").cast("double"), F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    return packed_trees(links.mapInArrow(packed, PACKED), records, close)


def packed_trees(packs: DataFrame, records: DataFrame, close: float = 0.0, lists: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """``trees`` of what ``packed`` made, or ``thinned`` of the jaccard pairs of ``lists`` above the threshold (``pair_blocks.alike``, banded if they have band keys)."""
    packs = cut(packs)
    comp = cut(components(packs.select(F.col("root").alias("src"), F.explode("nodes").alias("dst"))))
    tops = packs.select("root").distinct().join(comp.withColumnRenamed("id", "root"), "root")
    edges = packs.join(small(cut(tops), PACK_LINKS), "root").select("component", *[c for c in packs.columns if c != "root"])
    named = comp.join(records.select("id", "tokens"), "id", "left").select(F.col("component").alias("tree"), "id", "tokens")
    if lists is not None:
        named = named.join(lists.select("id", "ws", "ks"), "id")
    schema = "component bigint, parent string, child string, weight double, inv_weight double, label string, is_meta boolean"
    return edges.groupBy("component").cogroup(named.groupBy("tree")).applyInArrow(lambda e, n: _built(e, n, close, threshold), schema)


def exemplars(tree: DataFrame) -> DataFrame:
    """The root of each component: ``component, node, label``."""
    return tree.where("parent is null").select("component", F.col("child").alias("node"), "label")


def wire_exemplars(roots: DataFrame, sim: Column) -> DataFrame:
    """A star from the first root (largest component first is the caller's order by ``rank``) to all others.

    ``roots`` has rank, node, tokens; ``sim`` is over columns ta and tb. Similar roots get a meta
    node as common parent, others hang below 'Root'.
    """
    first = roots.where("rank = 1").select(F.col("node").alias("hub"), F.col("tokens").alias("ta"))
    rest = roots.where("rank > 1").select("node", F.col("tokens").alias("tb")).crossJoin(F.broadcast(first))  # one hub
    scored = rest.select("hub", "node", sim.alias("sim"))
    parent = F.when(F.col("sim") > 0, F.concat_ws("_", "hub", "node")).otherwise("Root")
    return scored.select(parent.alias("parent"), F.explode(F.array("hub", "node")).alias("child"), "sim").distinct()


def one_tree(tree: DataFrame, sim) -> DataFrame:
    """The edges of all components' trees and a star that wires their exemplars into one.

    The hub is the exemplar of the component with most leaves (ties: the smallest component);
    ``sim`` compares the token lists of two exemplars, as their labels hold them.
    """
    roots = exemplars(tree)
    sizes = tree.where("not is_meta").groupBy("component").agg(F.count("*").alias("leaves"))
    hub = roots.join(sizes, "component").orderBy(F.desc("leaves"), "component").limit(1).select("component", F.lit(1).alias("rank"))
    ranked = roots.join(F.broadcast(hub), "component", "left").select(F.coalesce("rank", F.lit(2)).alias("rank"), "node", F.split("label", ":").alias("tokens"))  # one hub
    star = wire_exemplars(ranked, sim(F.col("ta"), F.col("tb")))
    inside = tree.where("parent is not null").select("parent", "child", F.col("weight").alias("sim"))
    return inside.unionByName(star)


def graph_info(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges, components among linked nodes."""
    n, e = nodes.agg(F.count("*").alias("nodes")), links.agg(F.count("*").alias("edges"))
    c = components(links).agg(F.count_distinct("component").alias("components"))
    return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c))  # one row each


def to_json(tree: DataFrame, component: int) -> str:
    """Nested JSON of one component's tree, as tree views read it."""
    rows = tree.where(F.col("component") == component).collect()
    kids: dict[str | None, list] = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r)
    root = kids[None][0]
    out = {"id": root["child"], "label": root["label"]}
    stack = [out]
    while stack:
        node = stack.pop()
        if below := kids.get(node["id"]):
            node["children"] = [{"id": r["child"], "label": r["label"]} for r in below]
            stack += node["children"]
    return json.dumps(out)
