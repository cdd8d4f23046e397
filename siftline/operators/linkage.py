"""Single linkage of one component's links, sorted as numbers of 16 bytes each, and links that can be left out of it."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

#: Links that are looked at together.
CHUNK = 65_536


def width(nodes: int, levels: int) -> int | None:
    """Bits of a node's number if a level and two nodes fit into 64 bits."""
    bits = max(1, (nodes - 1).bit_length())
    return bits if 2 * bits + levels.bit_length() <= 64 else None


def turned(keys: np.ndarray, bits: int) -> np.ndarray:
    """Sorted numbers ``level, dst, src`` of the numbers ``level, src, dst``."""
    out, one, two, mask = np.empty_like(keys), np.uint64(bits), np.uint64(2 * bits), np.uint64(2**bits - 1)
    for at in range(0, len(keys), 16 * CHUNK):
        k = keys[at : at + 16 * CHUNK]
        out[at : at + 16 * CHUNK] = (k >> two << two) | ((k & mask) << one) | (k >> one & mask)
    out.sort()
    return out


#: Links that ``thin`` compares with what is known before it takes them one by one.
STEP = 4_096


def thin(keys: np.ndarray, bits: int, levels: np.ndarray, nodes: int, close: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of some links, sorted numbers ``level, src, dst``, can change a tree of all links; flags of the links below which a node has others (1: src, 2: dst).

    Whatever other links there are: after a link to a node that is in a tree, both ends are in one tree. After a link
    one of the ends is in a tree, so a src that has had a close link before is in one too, as ``grow`` reroutes it at
    the latest. A link between nodes that are in one tree by this changes nothing; the first one of each node stays.
    """
    mask, count = np.uint64(2**bits - 1), len(keys)
    stay, flags = np.ones(count, bool), np.zeros(count, np.uint8)
    known, up, last = bytearray(nodes), array("q", range(nodes)), [-1] * nodes
    seen, labels, sims = np.frombuffer(known, np.uint8), np.frombuffer(up, np.int64), levels.tolist()
    marked = np.zeros(nodes, bool)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for high in range(count, 0, -STEP):
        part = keys[max(0, high - STEP) : high][::-1]
        x, y = (part >> np.uint64(bits) & mask).astype(np.int64), (part & mask).astype(np.int64)
        for ends in (x, y):  # shorter ways to the roots
            while ((to := labels[labels[ends]]) != labels[ends]).any():
                labels[ends] = to
        idle = (seen[x] & seen[y] != 0) & (labels[x] == labels[y])
        todo = np.flatnonzero(~idle)
        for at, level, a, b in zip(todo.tolist(), (part[todo] >> np.uint64(2 * bits)).tolist(), x[todo].tolist(), y[todo].tolist()):
            if known[a] and known[b]:
                ra, rb = root(a), root(b)
                if ra == rb:
                    idle[at] = True
                else:
                    up[rb] = ra
            elif known[a] or known[b]:
                known[a] = known[b] = 1
                up[root(b)] = root(a)
            else:
                if last[a] >= 0 and abs(sims[last[a]] - sims[level]) <= close:
                    known[a] = 1
                last[a] = last[b] = level
        gone = np.flatnonzero(idle)
        if len(gone):
            rows = high - 1 - gone
            ends, place = np.unique(np.stack([x[gone], y[gone]], 1).ravel(), return_index=True)
            new = ~marked[ends]
            marked[ends] = True
            stay[rows] = False
            np.bitwise_or.at(flags, rows[place[new] // 2], (1 + place[new] % 2).astype(np.uint8))
    stay |= flags > 0
    return stay, flags


def _near(keys: np.ndarray, starts: np.ndarray, node: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``starts`` and other end of the links with ``node`` in front, for the levels that begin at ``starts``."""
    low = np.searchsorted(keys, starts | np.uint64(node << bits))
    n = np.searchsorted(keys, (starts | np.uint64(node << bits)) + np.uint64(1 << bits)) - low
    row = np.repeat(np.arange(len(n)), n)
    return row, (keys[np.arange(len(row)) + (low - np.cumsum(n) + n)[row]] & np.uint64(2**bits - 1)).astype(np.int64)


def grow(keys: np.ndarray, bits: int, levels: np.ndarray, tokens: list[list], close: float, name: Callable[[int], str], below: np.ndarray | None = None, links: Callable | None = None):
    """``graph.link`` over sorted numbers ``level, src, dst``: parents, weights, tokens and names of leaves (by number) and meta nodes; a leaf that was never reached has the name None.

    A link whose ends are known and in one tree changes nothing; these are passed over many at a time.
    ``below`` has for each node the number of the link below which others were left out (0 for none); where
    these might be asked for, ``links`` finds all ``sims, ends`` of the node.
    """
    count, mask, back = len(tokens), np.uint64(2**bits - 1), turned(keys, bits)
    starts = np.arange(len(levels), dtype=np.uint64) << np.uint64(2 * bits)
    known, up = bytearray(count), array("q", range(count))
    seen, labels = np.frombuffer(known, np.uint8), np.frombuffer(up, np.int64)
    top, parent, weight, first = list(range(count)), [-1] * count, [None] * count, [None] * count
    tokens, names, sims = list(tokens), [None] * count, levels.tolist()

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def leaf(i: int) -> None:
        known[i], names[i] = 1, name(i)

    def join(sim: float, a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        x, y, meta = top[ra], top[rb], len(parent)
        parent[x] = parent[y] = meta
        weight[x] = weight[y] = first_of_meta = sim
        shared = set(tokens[y])
        tokens.append([t for t in tokens[x] if t in shared])
        names.append(f"{names[a]}_{names[b]}")
        parent.append(-1), weight.append(None), first.append(first_of_meta)
        up[rb], top[ra] = ra, meta

    def attach(sim: float, new: int, old: int) -> None:
        leaf(new)
        r = root(old)
        if abs(sim - first[top[r]]) <= close:
            parent[new], weight[new], up[new] = top[r], sim, r
        else:
            join(sim, new, old)

    def other(node: int, sim: float) -> int | None:
        """The first known node, from the highest link down, at a close level."""
        some = np.flatnonzero(np.abs(levels - sim) <= close)
        best, left = None, 0 if below is None else int(below[node])
        for side in (keys, back):
            row, end = _near(side, starts[some], node, bits)
            hit = np.flatnonzero(seen[end])
            if len(hit):
                r, t = int(row[hit[-1]]), int(end[hit[-1]])
                got = (r, node, t) if side is keys else (r, t, node)
                best = max(best, (*got, t)) if best else (*got, t)
        if left and (levels[left >> 2 * bits] >= sim or abs(levels[left >> 2 * bits] - sim) <= close) and (best is None or (int(some[best[0]]) << 2 * bits | best[1] << bits | best[2]) < left):
            near, ends = links(node)
            hit = np.flatnonzero((np.abs(near - sim) <= close) & (seen[ends] != 0))
            return max(zip(near[hit].tolist(), np.minimum(ends[hit], node).tolist(), np.maximum(ends[hit], node).tolist(), ends[hit].tolist()))[-1] if len(hit) else None
        return best[-1] if best else None

    for high in range(len(keys), 0, -CHUNK):
        part = keys[max(0, high - CHUNK) : high][::-1]
        x, y = (part >> np.uint64(bits) & mask).astype(np.int64), (part & mask).astype(np.int64)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]
        todo = np.flatnonzero((seen[x] & seen[y] == 0) | (labels[x] != labels[y]))
        for level, a, b in zip((part[todo] >> np.uint64(2 * bits)).tolist(), x[todo].tolist(), y[todo].tolist()):
            if known[a] and known[b]:
                if root(a) != root(b):
                    join(sims[level], a, b)
                continue
            sim = sims[level]
            if not known[a] and not known[b]:
                if (via := other(a, sim)) is not None:
                    b = via
                elif (via := other(b, sim)) is not None:
                    a = via
                else:
                    leaf(a), leaf(b)
                    join(sim, a, b)
                    continue
            if known[b]:
                attach(sim, a, b)
            else:
                attach(sim, b, a)
    return parent, weight, tokens, names
