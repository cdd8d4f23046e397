"""Scaling, principal components and clusterings of numeric frames.

``df`` has ``id`` and numeric columns. Rows with a null feature take no part. Fits read all rows;
what comes to the driver has the size of the columns or the clusters.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.graph import components
from siftline.runtime import cut


def _clean(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("id", *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centred by the mean, divided by the population deviation (by 1 where it is 0)."""
    x = _clean(df, columns)
    stats = x.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns])
    out = x.crossJoin(F.broadcast(stats))  # one row
    return out.select("id", *[((F.col(c) - F.col(f"_{c}.m")) / F.when(F.col(f"_{c}.s") > 0, F.col(f"_{c}.s")).otherwise(1.0)).alias(c) for c in columns])


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, cov`` (population) of all pairs of columns."""
    x = _clean(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = x.agg(*[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def pca(df: DataFrame, columns: list[str], k: int | None = None) -> DataFrame:
    """``id, pc1..``: projection on the k leading axes, or on those of variance above 1. The largest loading of an axis is positive."""
    x = _clean(df, columns)
    cov = np.zeros((len(columns),) * 2)
    at = {c: i for i, c in enumerate(columns)}
    for r in covariance(x, columns).collect():
        cov[at[r["x"]], at[r["y"]]] = cov[at[r["y"]], at[r["x"]]] = r["cov"] or 0.0
    means = x.agg(*[F.avg(c).alias(c) for c in columns]).first()
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    k = k or max(1, int((values > 1).sum()))
    axes = [v * np.sign(v[np.abs(v).argmax()] or 1) for v in vectors[:, order[:k]].T]
    project = lambda v: sum(((F.col(c) - F.lit(float(means[c] or 0))) * float(w) for c, w in zip(columns, v)), F.lit(0.0))
    return x.select("id", *[project(v).alias(f"pc{i + 1}") for i, v in enumerate(axes)])


def assign(df: DataFrame, columns: list[str], centres: list[list[float]]) -> DataFrame:
    """``id, cluster, distance`` to the nearest of the given centres (the first of equals)."""
    x = _clean(df, columns)
    dist = [F.struct(sum(((F.col(c) - float(v)) ** 2 for c, v in zip(columns, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("k")) for i, centre in enumerate(centres)]
    best = x.select("id", F.array_min(F.array(*dist)).alias("b"))
    return best.select("id", F.col("b.k").alias("cluster"), F.sqrt("b.d").alias("distance"))


def kmeans(df: DataFrame, columns: list[str], k: int | None = None, seed: int = 1) -> DataFrame:
    """``id, cluster``; k defaults to the root of half the rows."""
    x = _clean(df, columns)
    vec = VectorAssembler(inputCols=columns, outputCol="v").transform(x)
    k = k or max(2, int(math.sqrt(x.count() // 2)))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(vec).transform(vec).select("id", "cluster")


def elbow(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 7, 12), seed: int = 1) -> DataFrame:
    """``k, cost``: mean distance to the nearest centre."""
    x = cut(_clean(df, columns))
    vec = VectorAssembler(inputCols=columns, outputCol="v").transform(x)
    rows = []
    for k in ks:
        centres = [c.tolist() for c in KMeans(k=k, seed=seed, featuresCol="v").fit(vec).clusterCenters()]
        rows.append((k, assign(x, columns, centres).agg(F.avg("distance")).first()[0]))
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


def _neighbours(x: DataFrame, columns: list[str], eps: float) -> DataFrame:
    """``a, b`` within eps of each other, both ways and with itself, and b's ``_n``: cells of width eps over three columns at most meet their neighbours."""
    grid = columns[:3]
    keyed = x.select("id", "_n", *columns, *[F.floor(F.col(c) / eps).alias(f"g{i}") for i, c in enumerate(grid)])
    probe = keyed.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns], *[f"g{i}" for i in range(len(grid))])
    for i in range(len(grid)):
        probe = probe.withColumn(f"g{i}", F.explode(F.array(*[F.col(f"g{i}") + k for k in (-1, 0, 1)])))
    both = probe.join(keyed.withColumnRenamed("id", "b"), [f"g{i}" for i in range(len(grid))])
    return both.where(sum(((F.col(f"a_{c}") - F.col(c)) ** 2 for c in columns), F.lit(0.0)) <= eps * eps).select("a", "b", "_n")


def dbscan(df: DataFrame, columns: list[str], eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """``id, cluster, is_core``: cluster is the smallest core id it hangs together with; -1 is noise. A border point takes its smallest cluster.

    Rows at one point are counted there, by its smallest id, so pairs are those of different points.
    """
    x = cut(_clean(df, columns))
    points = cut(x.groupBy(*columns).agg(F.min("id").alias("id"), F.count("*").alias("_n")))
    near = cut(_neighbours(points, columns, eps))
    core = cut(near.groupBy("a").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= min_samples).select("a"))
    links = near.select("a", "b").join(core, "a").join(core.withColumnRenamed("a", "b"), "b").where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    grown = components(links)
    label = cut(core.join(grown, F.col("a") == F.col("id"), "left").select("a", F.coalesce("component", "a").alias("_cluster")))
    border = near.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("_cluster").alias("_reach"))
    at = points.drop("_n").join(label, F.col("id") == F.col("a"), "left").drop("a").join(border, F.col("id") == F.col("a"), "left").select(*columns, "_cluster", "_reach")
    out = x.join(at, columns, "left")
    return out.select("id", F.coalesce("_cluster", "_reach", F.lit(-1)).alias("cluster"), F.col("_cluster").isNotNull().alias("is_core"))


def _cells(x: DataFrame, columns: list[str], width: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of the rows in each occupied cell of a grid."""
    grid = x.groupBy(*[F.floor(F.col(c) / width).alias(f"g{i}") for i, c in enumerate(columns)])
    got = np.array([list(r) for r in grid.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], F.count("*").alias("n")).select(*[f"m{i}" for i in range(len(columns))], "n").toLocalIterator()], dtype=float)
    got = got.reshape(-1, len(columns) + 1)
    got = got[np.lexsort(got.T[::-1])]
    return got[:, :-1], got[:, -1]


def _blocks(points: np.ndarray, others: np.ndarray):
    """Squared distances, for some of the points at a time."""
    step = max(1, 4_000_000 // max(1, len(others)))
    for at in range(0, len(points), step):
        p = points[at : at + step]
        yield at, sum((p[:, None, i] - others[None, :, i]) ** 2 for i in range(points.shape[1]))


def mean_shift(df: DataFrame, columns: list[str], bandwidth: float | None = None, quantile: float = 0.3) -> DataFrame:
    """``id, cluster``: flat-kernel mean shift of all rows, until no mode moves.

    Rows enter by the means and counts of grid cells, whose diagonal is at most a tenth of the
    bandwidth; every occupied cell seeks its mode, and each row goes to the nearest. The bandwidth
    is the mean distance within which a row has ``quantile`` of the rows.
    """
    x = cut(_clean(df, columns))
    ends = x.agg(*[F.max(c) - F.min(c) for c in columns]).first()
    if ends[0] is None:
        return x.select("id", F.lit(0).alias("cluster"))
    spread = max(ends) or 1.0
    points, counts = _cells(x, columns, spread / 128 if bandwidth is None else bandwidth / 10 / math.sqrt(len(columns)))
    if bandwidth is None:
        near, least = np.zeros(len(points)), max(1, int(counts.sum() * quantile))
        for at, d in _blocks(points, points):
            order = np.argsort(d, axis=1)
            reached = np.argmax(np.cumsum(counts[order], axis=1) >= least, axis=1)
            near[at : at + len(d)] = np.sqrt(np.take_along_axis(d, order, axis=1)[np.arange(len(d)), reached])
        bandwidth = float((near * counts).sum() / counts.sum()) or 1.0
        if (width := bandwidth / 10 / math.sqrt(len(columns))) < spread / 128:  # cells too coarse for what they showed
            points, counts = _cells(x, columns, width)
    weighted, moving, modes = points * counts[:, None], points.copy(), []
    while len(moving):
        moved = np.empty_like(moving)
        for at, d in _blocks(moving, points):
            within = (d <= bandwidth**2).astype(float)
            moved[at : at + len(d)] = (within @ weighted) / np.maximum(within @ counts, 1)[:, None]
        still = np.abs(moved - moving).max(axis=1) < 1e-3 * bandwidth
        modes.append(moved[still])
        moving = np.unique(moved[~still], axis=0)  # seeds that met go on as one
    found = np.unique(np.concatenate(modes), axis=0)
    weight = np.concatenate([(d <= bandwidth**2) @ counts for _, d in _blocks(found, points)])
    kept: list[np.ndarray] = []
    for i in np.argsort(-weight, kind="stable"):
        if all(((found[i] - m) ** 2).sum() > bandwidth**2 for m in kept):
            kept.append(found[i])
    return assign(x, columns, [m.tolist() for m in kept]).select("id", "cluster")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """One row: clusters (noise counts as one), labelled, unlabelled."""
    return labels.agg(F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("cluster") != -1).alias("labelled"), F.count_if(F.col("cluster") == -1).alias("unlabelled"))


def members(labels: DataFrame, frame: DataFrame, key: str = "filename") -> DataFrame:
    """The frame's rows of each cluster; a name that repeats repeats its rows."""
    return labels.join(frame, key)


def importances(model, names: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())], "feature string, importance double")


