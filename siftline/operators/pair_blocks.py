"""Pairs of token lists, found and scored in one pass: each pair comes from one task, once, with its score.

Lists are indexed by the tokens of their prefixes (rare tokens first) or by their band keys. The lists of
an index key meet in a task as a block of a matrix; a pair is taken where its rarest shared token (its
first shared band) is that key, so nothing is shuffled but the index. Crowded keys are cut into a grid
of cells of ``SIDE`` x ``SIDE`` lists. ``then`` reduces the pairs of a task before they leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.runtime import cut, small

#: Lists on a side of a cell; rows of a cell that are scored at a time.
SIDE, TILE = 8192, 512
#: A token's code: its count (at most 2 ** 20 - 1) above 43 bits that are its own.
OWN = 43
PAIR = "sim double, src bigint, dst bigint"


def coded(lists: DataFrame, items: Column, keys: DataFrame | None = None) -> DataFrame:
    """``id``, ``ws`` (sorted codes of the items, rare ones first), ``seq`` (hashes of the tokens in order, null for null) and ``ks`` (band keys, if given; lists without are left out)."""
    each = lists.select("id", F.explode(items).alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("n"))
    own = F.monotonically_increasing_id()  # 10 bits of partition, 33 of row; it follows the order
    counts = cut(counts.orderBy("n", "w").coalesce(1024).select("w", (F.shiftleft(F.least(F.col("n"), F.lit(2**20 - 1)), OWN) + own).alias("code")))
    ws = each.join(counts, "w").groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("ws"))
    seq = lists.select("id", F.transform("tokens", lambda t: F.when(t.isNotNull(), F.xxhash64(t))).alias("seq"))
    out = ws.join(seq, "id")
    return cut(out.join(keys, "id") if keys is not None else out.withColumn("ks", F.lit(None).cast("array<bigint>")))


def band_keys(sigs: DataFrame, p) -> DataFrame:
    """``id``, ``ks``: a number for each band's key; exact for bands of one or two rows, else its 64-bit hash."""
    h = lambda i, k: F.get("sig", F.lit(i * p.rows + k))
    one = {1: lambda i: h(i, 0), 2: lambda i: F.shiftleft(h(i, 0), 32).bitwiseOR(h(i, 1))}.get(p.rows, lambda i: F.xxhash64(F.slice("sig", i * p.rows + 1, p.rows)))
    return sigs.select("id", F.array(*[one(i) for i in range(p.bands)]).alias("ks"))


def _cells(index: DataFrame) -> DataFrame:
    """The index ``band, w, ...`` with cells (i, j), i <= j, of crowded keys; ``side`` 0 holds block i, 1 block j; the band is in the upper halves of i and j."""
    crowd = index.groupBy("band", "w").agg(F.count("*").alias("n")).where(F.col("n") > SIDE).select("band", "w", F.ceil(F.col("n") / SIDE).alias("g"))
    b = index.join(small(cut(crowd)), ["band", "w"], "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("g", F.lit(1).cast("bigint"))))
    b = b.withColumn("o", F.explode(F.expr("sequence(0L, coalesce(g, 1L) - 1)"))).withColumn("side", (F.col("own") > F.col("o")).cast("int"))
    top = F.col("band") * F.lit(2**32)
    return b.withColumns({"i": F.least("own", "o") + top, "j": F.greatest("own", "o") + top}).drop("g", "own", "o", "band")


def _matrix(column: pa.Array, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, padded; their lengths."""
    n = np.diff(column.offsets.to_numpy())
    out = np.full((len(n), int(n.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().fill_null(fill).to_numpy(zero_copy_only=False)
    return out, n


def edit_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of rows; 0 stands for null, which equals nothing."""
    out = np.zeros(len(la), np.int32)
    order = np.lexsort((lb, la))
    for at in np.array_split(order, max(1, len(order) // 20_000)):
        na, nb = la[at], lb[at]
        x, y = a[at, : na.max(initial=0)].T.copy(), b[at, : nb.max(initial=0)].T.copy()
        rows = np.repeat(np.arange(len(y) + 1, dtype=np.int16)[:, None], len(at), 1)
        out[at[na == 0]] = nb[na == 0]
        every = np.arange(len(at))
        for i in range(len(x)):
            diagonal, rows[0] = rows[0].copy(), i + 1
            for j in range(len(y)):
                best = diagonal + ((x[i] != y[j]) | (x[i] == 0))
                diagonal = rows[j + 1].copy()
                rows[j + 1] = np.minimum(best, np.minimum(diagonal, rows[j]) + 1)
            done = na == i + 1
            if done.any():
                out[at[done]] = rows[nb[done], every[done]]
    return out


def tapered_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``edit_distances`` with the falling costs of ``similarity.tapered``."""
    out = lb.astype(float)
    order = np.lexsort((lb, la))
    for at in np.array_split(order, max(1, len(order) // 10_000)):
        na, nb = la[at], lb[at]
        x, y = a[at, : na.max(initial=0)].T.copy(), b[at, : nb.max(initial=0)].T.copy()
        longest, every = np.maximum(np.maximum(na, nb), 1).astype(float), np.arange(len(at))
        falls = [k / longest for k in range(min(len(x), len(y)))]
        rows = np.repeat(np.arange(len(y) + 1, dtype=float)[:, None], len(at), 1)
        for i in range(len(x)):
            diagonal, rows[0] = rows[0].copy(), i + 1
            for j in range(len(y)):
                fall = falls[min(i, j)]
                cost = 1 - fall
                best = diagonal + np.where((x[i] == y[j]) & (x[i] != 0), 0.0, cost)
                diagonal = rows[j + 1].copy()
                rows[j + 1] = np.minimum(np.minimum(best, diagonal + cost), rows[j] + 1 - fall)  # sums in the order of the expression
            done = na == i + 1
            if done.any():
                out[at[done]] = rows[nb[done], every[done]]
    return out


#: Pairs of the same two lengths from which on patterns are compared.
ALIKE = 256


def by_pattern(distances: Callable, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``distances``, once for all pairs with the same lengths and the same places of equal tokens, on which alone a distance depends."""
    out, rest = np.empty(len(la)), []
    if not len(la):
        return out
    sizes = la.astype(np.int64) * (int(lb.max(initial=0)) + 1) + lb
    order = np.argsort(sizes.astype(np.int16) if sizes.max(initial=0) < 2**15 else sizes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(sizes[order]) != 0, True])
    for s, e in zip(cuts[:-1], cuts[1:]):
        na, nb = int(la[order[s]]), int(lb[order[s]])
        if e - s < ALIKE or not na or not nb:
            rest.append(order[s:e])
            continue
        for at in np.array_split(order[s:e], -(-(e - s) // 50_000)):
            x, y = a[at, :na].T.copy(), b[at, :nb].T.copy()
            null, words = x == 0, -(-na * nb // 64)
            bits = np.zeros((8 * words, len(at)), np.uint8)
            for i in range(na):
                some = null[i].any()
                for j in range(nb):
                    same = x[i] == y[j]
                    if some:
                        same &= ~null[i]
                    bits[(i * nb + j) // 8] |= same.view(np.uint8) << np.uint8((i * nb + j) % 8)
            kind = None
            for word in bits.T.copy().view(np.uint64).T:
                code, values = pd.factorize(word)
                kind = code if kind is None else pd.factorize(kind * len(values) + code)[0]
            one = np.empty(int(kind.max()) + 1, np.int64)
            one[kind] = np.arange(len(at))
            k = at[one]
            out[at] = distances(a[k], la[k], b[k], lb[k])[kind]
    if rest:
        at = np.concatenate(rest)
        out[at] = distances(a[at], la[at], b[at], lb[at])
    return out


#: Vectorised metrics, and which of them are distances.
DISTANCES = {"levenshtein": edit_distances, "levenshtein_D": partial(by_pattern, edit_distances), "l_tapered_sim": partial(by_pattern, tapered_distances), "levenshtein_tapered": partial(by_pattern, tapered_distances)}
BELOW = {"levenshtein_D", "levenshtein_tapered"}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole cells, in batches of several."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(3)])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        if held and [c[0].as_py() for c in held[-1].slice(held[-1].num_rows - 1).columns[:3]] != key[:, 0].tolist():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1] + 1)]).combine_chunks().to_batches()[0]
            held, batch = [], batch.slice(new[-1] + 1)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _scored(metric: str, threshold: float, banded: bool, by_band: bool):
    """Batches of cells to batches of ``sim, src, dst``."""

    def run(batches):
        for got in _groups(batches):
            w, i, j, side, ids = (got.column(k).to_numpy() for k in range(5))
            starts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.r_[starts[1:], len(w)]
            keep = ends - starts > 1
            names = got.schema.names
            for s, e in zip(starts[keep], ends[keep]):
                part = lambda c, fill: _matrix(got.column(c).slice(s, e - s), fill) if c in names else (None, None)  # noqa: B023, E731
                (ws, m), (seq, n), (ks, _) = part("ws", -1), part("seq", 0), part("ks", 0)
                first, second = (np.flatnonzero(side[s:e] == k) for k in (0, 1)) if i[s] != j[s] else (np.arange(e - s), None)
                for x, y, shared in _block(ws, m, ks, int(w[s]), int(i[s]) >> 32, first, second, threshold, metric, by_band):
                    if metric == "jaccard":
                        sim = shared / np.maximum(m[x], m[y])
                    elif metric == "candidates":
                        sim = shared.astype(float)
                    else:
                        sim = DISTANCES[metric](seq[x], n[x], seq[y], n[y]).astype(float)
                        if metric not in BELOW:
                            larger = np.maximum(n[x], n[y])
                            sim = 1 - sim / larger
                        ok = sim < threshold if metric in BELOW else sim > threshold
                        x, y, sim = x[ok], y[ok], sim[ok]
                    if banded and not by_band:
                        ok = (ks[x] == ks[y]).any(axis=1)
                        x, y, sim = x[ok], y[ok], sim[ok]
                    x, y = ids[s:e][x], ids[s:e][y]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(sim), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["sim", "src", "dst"])

    return run


def _block(ws, m, ks, w, band, first, second, threshold, metric, by_band):
    """Row numbers of the pairs of a cell that may pass, with the number of their shared items (1 for candidates), tile by tile."""
    many, prefix = [], None
    if ws is not None:
        flat, row, column = ws[ws >= 0], np.repeat(np.arange(len(m)), m), np.nonzero(ws >= 0)[1]
        order = np.argsort(flat, kind="stable")
        flat, row, column = flat[order], row[order], column[order]
        cuts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
        many = [(int(flat[a]), row[a:b], column[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
        kind = np.int16 if m.max() < 15_000 else np.int32
        prefix = m - np.floor(m * threshold).astype(int) if metric == "candidates" and not by_band else None
    others = first if second is None else second
    size = len(ks) if m is None else len(m)
    place = np.full(size, -1)
    place[others] = np.arange(len(others))
    for at in range(0, len(first), TILE):
        mine = first[at : at + TILE]
        theirs, shift = (others[at:], at) if second is None else (others, 0)
        local = np.full(size, -1)
        local[mine] = np.arange(len(mine))
        shape = len(mine), len(theirs)
        barred = np.tril(np.ones(shape, bool)) if second is None else np.zeros(shape, bool)
        if by_band:  # the pair belongs to its first shared band
            for k in range(band):
                barred |= ks[mine, k][:, None] == ks[theirs, k][None]
        if by_band and ws is None:
            ok, c = ~barred, None
        else:
            c = np.zeros(shape, bool if prefix is not None else kind)
            c += not by_band and prefix is None
            larger = np.maximum(m[mine][:, None], m[theirs][None])
            for code, rows, columns in many:
                if code == w and not by_band and prefix is None:
                    continue
                if prefix is not None and code >= w:
                    inside = columns < prefix[rows]
                    rows, columns = rows[inside], columns[inside]
                x, y = local[rows], place[rows] - shift
                of_x, of_y = x >= 0, y >= 0
                x, y = x[of_x], y[of_y]
                if not len(x) or not len(y):
                    continue
                cell = np.ix_(x, y)
                if code < w and not by_band:
                    barred[cell] = True
                elif prefix is not None:
                    px, py = columns[of_x][:, None], columns[of_y][None]
                    left = np.minimum(m[mine[x]][:, None] - px, m[theirs[y]][None] - py) + np.minimum(px, py)  # tokens that can be shared yet
                    c[cell] |= left > threshold * larger[cell]
                else:
                    c[cell] += 1
            if prefix is not None:
                ok = c & (np.minimum(m[mine][:, None], m[theirs][None]) > threshold * larger)
            else:
                ok = larger - c < threshold if metric in BELOW else c > threshold * larger
            ok &= ~barred
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 500_000):
            p, q = x[k : k + 500_000], y[k : k + 500_000]
            yield mine[p], theirs[q], np.ones(len(p)) if c is None else c[p, q]


def alike(lists: DataFrame, metric: str, threshold: float, banded: bool = False, then: Callable | None = None, schema: str = PAIR) -> DataFrame:
    """``sim, src, dst`` of all pairs of the ``coded`` lists with a similarity above the threshold, by prefixes; if ``banded``, of those that share a band key.

    The shared items of two lists must exceed threshold x items of the larger one. With ``metric``
    "candidates", the pairs that pass the positional filter at any shared item of their prefixes.
    """
    m = F.size("ws")
    prefix = F.explode(F.slice("ws", 1, m - F.floor(m * threshold).cast("int")))
    index = lists.select(F.lit(0).cast("bigint").alias("band"), prefix.alias("w"), "id", "ws", *["seq"] * (metric in DISTANCES), *["ks"] * banded).where(F.col("w") >= F.lit(2).cast("bigint") * 2**OWN)
    return _run(_cells(index), _scored(metric, threshold, banded, False), then, schema)


def banded(lists: DataFrame, metric: str = "candidates", threshold: float = 0.0, then: Callable | None = None, schema: str = PAIR) -> DataFrame:
    """``sim, src, dst`` of all pairs of the ``coded`` lists that share a band key (``id, ks`` is enough for candidates), with distances below the threshold or similarities above it."""
    need = {"candidates": ["ks"], "levenshtein_D": ["ws", "seq", "ks"]}.get(metric, ["seq", "ks"])
    index = lists.select(F.posexplode("ks").alias("band", "w"), "id", *need).withColumn("band", F.col("band").cast("bigint"))
    return _run(_cells(index), _scored(metric, threshold, True, True), then, schema)


def _run(cells: DataFrame, work: Callable, then: Callable | None, schema: str) -> DataFrame:
    parts = 4 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in cells.columns if c not in ("w", "i", "j", "side", "id")]
    cells = cells.select("w", "i", "j", "side", "id", *rest).repartition(parts, "w", "i", "j").sortWithinPartitions("w", "i", "j")
    return cells.mapInArrow(work if then is None else lambda batches: then(work(batches)), schema)


def counted(batches):
    """The number of rows of all batches."""
    yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["n"])
