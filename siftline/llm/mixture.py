"""Similarity clusters of numeric records under a Gaussian mixture.

``fits`` standardises the features, reduces them to the principal axes and fits mixtures of several
sizes by expectation-maximisation over all rows, with a ridge on every covariance. ``chosen``
doubles the size until the Bayesian information criterion rises and takes the size where it was
least. ``clusters`` assigns each record to its likeliest component and describes each by size and
members of highest density. ``neighbour_groups`` gives the groups of an exact rule of neighbours,
which no mixture can give; ``described_groups`` tells each one's size and its members of highest
density under the mixture.

Records with a null, NaN or -99 feature take no part; repeated ids count once (their smallest
values); an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.components import components
from siftline.runtime import cut

#: Sizes that are fitted first, tolerance of a round a row, ridge, rows that seed the means, variance kept.
SIZES, TOLERANCE, RIDGE, SEED_ROWS, KEPT_VARIANCE = (4, 8, 16, 32), 1e-3, 1e-3, 2048, 0.999
#: Rounds of EM at most (a fit short of its tolerance by then is taken as it is), cells of a matrix of densities.
LIMIT, CELLS = 25, 4_000_000
FEATURES = ("number_of_sections", "sec_entropy_text", "size_code", "number_of_import_symbols")
MISSING = -99


@dataclass
class Mixture:
    """Means, precisions and log weights in the reduced space; ``centre``, ``axes`` lead there."""

    centre: np.ndarray
    axes: np.ndarray  # reduced = (x - centre) @ axes
    means: np.ndarray
    precisions: np.ndarray
    offsets: np.ndarray  # log weight and normalising constant
    bic: float = math.inf

    def reduce(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.axes

    def log_density(self, p: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
        """Log of weight times density, one column a component, by products of matrices."""
        linear = np.einsum("kij,kj->ki", self.precisions, self.means)
        squares = _squares(p) if squares is None else squares
        return self.offsets - 0.5 * np.einsum("ki,ki->k", linear, self.means) + p @ linear.T - 0.5 * squares @ self.precisions.reshape(len(self.means), -1).T


def _squares(p: np.ndarray) -> np.ndarray:
    return (p[:, :, None] * p[:, None, :]).reshape(len(p), -1)


def samples_of(df: DataFrame, id_col: str = "sample_id", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``id`` and the features of the records that have them all, each id once."""
    have = df.where(F.col(id_col).isNotNull())
    for f in features:
        have = have.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.col(f) != MISSING))
    return have.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(F.struct(*features)).alias("v")).select("id", "v.*")


def vectors(samples: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """What the mixture sees: sizes and counts by logarithm (of at least 1)."""
    sections, entropy, size, imports = features
    log = F.log(F.greatest(F.col(size), F.lit(1)).cast("double"))
    return samples.select("id", F.col(sections).cast("double").alias("x0"), F.col(entropy).cast("double").alias("x1"), log.alias("x2"), F.col(imports).cast("double").alias("x3"))


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def _seed_means(p: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Seeds spread by squared distance (k-means++)."""
    means = [p[rng.integers(len(p))]]
    far = ((p - means[0]) ** 2).sum(axis=1)
    while len(means) < k:
        at = rng.integers(len(p)) if far.sum() == 0 else rng.choice(len(p), p=far / far.sum())
        means.append(p[at])
        far = np.minimum(far, ((p - means[-1]) ** 2).sum(axis=1))
    return np.array(means)


def _with(base: Mixture, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> Mixture:
    precs = np.linalg.inv(covs)
    offs = np.log(np.maximum(weights, 1e-300)) - 0.5 * (means.shape[1] * math.log(2 * math.pi) + np.linalg.slogdet(covs)[1])
    return Mixture(base.centre, base.axes, means, precs, offs)


def chosen(x: DataFrame, names: tuple[str, ...] = ("x0", "x1", "x2", "x3"), seed: int = 7) -> Mixture | None:
    """The mixture of least criterion among 4, 8, 16, 32, 64 .. components, each fitted to the tolerance or for ``LIMIT`` rounds, doubled until the criterion rises. None if no rows."""
    seen, sizes = [], SIZES
    while True:
        models = fits(x, names, sizes, seed, LIMIT)
        seen += models
        if not seen:
            return None
        best = min(seen, key=lambda m: m.bic)
        if len(models) < len(sizes) or len(seen[-1].means) < sizes[-1] or best is not seen[-1]:  # the first: a component for every row
            return best
        sizes = (2 * sizes[-1],)


def fits(x: DataFrame, names: tuple[str, ...], sizes: tuple[int, ...], seed: int, rounds: int) -> list[Mixture]:
    """A mixture of each size, smallest first, after ``rounds`` at most."""
    names = list(names)
    d = len(names)
    sums = [F.count("*")] + [F.avg(n) for n in names] + [F.covar_pop(a, b) for a in names for b in names]
    n, *rest = x.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()
    if not n:
        return []
    centre, cov = np.array(rest[:d]), np.array(rest[d:]).reshape(d, d)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vecs = np.linalg.eigh(cov / np.outer(std, std))
    order = np.argsort(-values)
    keep = int(np.searchsorted(np.cumsum(values[order]) / max(values.sum(), 1e-12), KEPT_VARIANCE) + 1)
    base = Mixture(centre, (vecs[:, order[:keep]] / std[:, None]), np.zeros((0, keep)), np.zeros((0, keep, keep)), np.zeros(0))
    rows = x.orderBy(F.xxhash64("id"), "id").limit(max(SEED_ROWS, 8 * max(sizes))).select(*names).collect()
    seeds, rng, r = base.reduce(np.array(rows, dtype=float)), np.random.default_rng(seed), base.axes.shape[1]
    ks = sorted({min(k, len(rows)) for k in sizes})
    models = [_with(base, np.full(k, 1 / k), _seed_means(seeds, k, rng), np.tile(np.eye(r), (k, 1, 1))) for k in ks]
    width = 1 + r + r * r
    last = [-math.inf] * len(models)
    for _ in range(rounds):

        def sums_of(batches, models=models):
            total = [np.zeros((len(m.means), width)) for m in models]
            like = np.zeros(len(models))
            for batch in batches:
                whole = models[0].reduce(_matrix(batch, names))
                step = max(1, CELLS // max(len(m.means) for m in models))
                for at in range(0, len(whole), step):
                    p = whole[at : at + step]
                    squares = _squares(p)
                    for i, m in enumerate(models):
                        f = m.log_density(p, squares)
                        top = f.max(axis=1, keepdims=True)
                        e = np.exp(f - top)
                        s = e.sum(axis=1, keepdims=True)
                        like[i] += float((np.log(s) + top).sum())
                        resp = e / s
                        total[i][:, 0] += resp.sum(axis=0)
                        total[i][:, 1 : 1 + r] += resp.T @ p
                        total[i][:, 1 + r :] += resp.T @ squares
            flat = np.concatenate([like, *(t.ravel() for t in total)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

        got = x.select(*names).mapInArrow(sums_of, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(len(got))
        for row in got:
            flat[row["i"]] = row["v"]
        like, at, after = flat[: len(models)], len(models), []
        for m in models:
            k = len(m.means)
            t = flat[at : at + k * width].reshape(k, width)
            at += k * width
            nk = np.maximum(t[:, 0], 1e-9)
            means = t[:, 1 : 1 + r] / nk[:, None]
            covs = t[:, 1 + r :].reshape(k, r, r) / nk[:, None, None] - means[:, :, None] * means[:, None, :]
            covs = (covs + covs.transpose(0, 2, 1)) / 2
            floor = np.linalg.eigvalsh(covs)[:, 0]
            covs += (RIDGE + np.maximum(0, -floor))[:, None, None] * np.eye(r)
            after.append(_with(base, nk / nk.sum(), means, covs))
        for i, m in enumerate(models):
            k = len(m.means)
            m.bic = -2 * like[i] + (k * (1 + r + r * (r + 1) / 2) - 1) * math.log(n)
        if all(abs(a - b) <= TOLERANCE * n for a, b in zip(like, last)):
            break
        last, models, fitted = list(like), after, models
    else:
        models = fitted
    return models


def scores(x: DataFrame, model: Mixture, names: tuple[str, ...] = ("x0", "x1", "x2", "x3")) -> DataFrame:
    """``id``, ``component`` and ``log_density`` (of the whole mixture) of each record."""

    def run(batches):
        for batch in batches:
            f = model.log_density(model.reduce(_matrix(batch, list(names))))
            top = f.max(axis=1) if len(f) else np.zeros(0)
            dens = top + np.log(np.exp(f - top[:, None]).sum(axis=1)) if len(f) else top
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(f.argmax(axis=1) if len(f) else [], pa.int32()), pa.array(dens, pa.float64())], ["id", "component", "log_density"])

    return x.mapInArrow(run, "id bigint, component int, log_density double")


def _described(scored: DataFrame, key: str, typical: int) -> DataFrame:
    """``key``, ``size``, ``typical`` (ids of highest density, densest first)."""
    top = Window.partitionBy(key).orderBy(F.desc("log_density"), "id")  # limited before the shuffle
    best = scored.withColumn("r", F.row_number().over(top)).where(F.col("r") <= typical)
    best = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical"))
    return scored.groupBy(key).agg(F.count("*").alias("size")).join(best, key).select(key, "size", "typical")


def _scored(df: DataFrame) -> DataFrame:
    x = cut(vectors(samples_of(df)))
    model = chosen(x)
    if model is None:
        return x.select("id", F.lit(0).alias("component"), F.lit(0.0).alias("log_density"))
    return cut(scores(x, model))


def clusters(df: DataFrame, typical: int = 5) -> DataFrame:
    """``component``, ``size``, ``typical`` (ids of highest density, densest first)."""
    return _described(_scored(df), "component", typical)


def described_groups(df: DataFrame, typical: int = 5) -> DataFrame:
    """``group_id``, ``size``, ``typical`` of the groups of ``neighbour_groups``; density is that of the whole mixture."""
    groups = neighbour_groups(df).select("group_id", F.col("sample_id").alias("id"))
    return _described(cut(groups.join(_scored(df), "id")), "group_id", typical)


def neighbour_groups(df: DataFrame, entropy: float = 0.05, size_percent: int = 3, imports: int = 2, least: int = 5) -> DataFrame:
    """``group_id``, ``sample_id``: groups of ``least`` or more samples joined by neighbours.

    Neighbours have the same number of sections, and entropy, size (relative to the larger) and
    imports within the limits. A cell of the limits' width holds only neighbours and counts as
    one node; of two touching cells only the samples on the facing fronts are compared.
    Entropy is taken in millionths, so that decimal limits hold exactly.
    """
    micro, width = round(entropy * 1e6), -math.log(1 - size_percent / 100)
    s = samples_of(df)
    size = F.col("size_code")
    s = s.select(
        "id", F.col("number_of_sections").alias("cn"), F.round(F.col("sec_entropy_text") * 1e6).cast("bigint").alias("e"), size.alias("z"), F.col("number_of_import_symbols").alias("m"),
    )
    s = s.withColumn("ce", F.floor(F.col("e") / micro)).withColumn("cm", F.floor(F.col("m") / (imports + 1)))
    s = cut(s.withColumn("cz", F.when(F.col("z") > 0, F.floor(F.log(F.col("z").cast("double")) / width)).otherwise(F.col("z") - F.lit(1 << 40))))
    key = ["cn", "ce", "cz", "cm"]
    cells = cut(s.groupBy(*key).agg(F.min("id").alias("cid"), F.count("*").alias("n")))
    # the front of a cell: for each count of imports and each pair of directions, samples that no other one surpasses
    edge = s.groupBy(*key, "m", "e").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    fronts = []
    for se in (1, -1):
        for sz in (1, -1):
            value = F.col("hi") if sz > 0 else -F.col("lo")
            before = Window.partitionBy(*key, "m").orderBy(F.desc("e") if se > 0 else F.asc("e")).rowsBetween(Window.unboundedPreceding, -1)
            front = edge.withColumn("v", value).withColumn("top", F.max("v").over(before)).where("top is null or v > top")
            fronts.append(front.select(*key, "m", "e", F.abs("v").alias("z") if sz > 0 else (-F.col("v")).alias("z"), F.lit(se).alias("se"), F.lit(sz).alias("sz")))
    front = fronts[0].union(fronts[1]).union(fronts[2]).union(fronts[3]).join(cells, key)
    front = cut(front.select("cid", *key, "m", "e", "z", "se", "sz"))
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in steps])).alias("s")
    sign = lambda c: F.when(F.col(c) >= 0, 1).otherwise(-1)
    a = front.select("cid", *key, "m", "e", "z", "se", "sz", step).where((F.col("se") == sign("s.i")) & (F.col("sz") == sign("s.j")))
    a = a.select(F.col("cid").alias("a"), "cn", (F.col("ce") + F.col("s.i")).alias("ce"), (F.col("cz") + F.col("s.j")).alias("cz"), (F.col("cm") + F.col("s.k")).alias("cm"), (-F.col("se")).alias("se"), (-F.col("sz")).alias("sz"), F.col("m").alias("ma"), F.col("e").alias("ea"), F.col("z").alias("za"))
    b = front.select(F.col("cid").alias("b"), *key, "se", "sz", F.col("m").alias("mb"), F.col("e").alias("eb"), F.col("z").alias("zb"))
    links = a.join(b, [*key, "se", "sz"]).where((F.abs(F.col("ea") - F.col("eb")) <= micro) & (100 * F.abs(F.col("za") - F.col("zb")) <= size_percent * F.greatest("za", "zb")) & (F.abs(F.col("ma") - F.col("mb")) <= imports))
    groups = components(links.select("a", "b").distinct())
    cells = cells.join(groups, F.col("cid") == F.col("record_id"), "left").select(*key, "n", F.coalesce("group_id", "cid").alias("group_id"))
    large = cells.groupBy("group_id").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    kept = cells.join(large, "group_id").select(*key, "group_id")
    return s.join(kept, key).select("group_id", F.col("id").alias("sample_id"))
