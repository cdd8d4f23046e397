"""Counting and association: value counts, contingency tables, G-test, pivots, correlation.

Nulls are a value of their own in counts, and take no part in contingency tables and pivots.
Empty tables give empty results. Ties are broken by value, ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.runtime import small


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c)


def top_values(df: DataFrame, c: str, k: int) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``count``, ``unique``, ``top``, ``freq`` of each column, without nulls."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("t")).select("column", "count", "unique", F.col("t.v").alias("top"), (-F.col("t.m")).alias("freq"))


def isin_top(df: DataFrame, c: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent."""
    return df.join(F.broadcast(top_values(df, c, k).select(c)), c, "left_semi")  # k rows


def contingency(df: DataFrame, a: str, b: str, n: int = 0, matches: int = 0, keep_top: bool = False) -> DataFrame:
    """Long table ``a, b, n`` with zeros for absent cells.

    ``n`` > 0 keeps the rows of the n most frequent ``a``. ``matches`` > 0 keeps the columns that
    rank 2 to ``matches`` in some row (the classic rule; from 1 with ``keep_top``).
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    if n > 0:
        rows = isin_top(rows, "a", n)
    counts = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    ka, kb = counts.select("a").distinct(), counts.select("b").distinct()
    grid = ka.crossJoin(small(kb))  # a contingency table is a grid of distinct values by definition
    full = grid.join(counts, ["a", "b"], "left").na.fill(0, ["n"])
    if matches > 0:
        w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
        kept = full.withColumn("r", F.row_number().over(w)).where((F.col("r") >= (1 if keep_top else 2)) & (F.col("r") <= matches)).select("b").distinct()
        full = full.join(kept, "b", "left_semi")
    return full.select("a", "b", "n")


def gtest(df: DataFrame, a: str, b: str, n: int = 0, matches: int = 0, min_volume: int = 0, keep_top: bool = False, absent: bool = True) -> DataFrame:
    """``a, b, n, total, cd, exp, g``: conditional share, expected count and G score of each cell.

    Totals are over all values of b in the kept rows. Rows of at most ``min_volume`` keep their
    counts and have null in the other columns. Without ``absent`` only cells that occur come out, and
    no grid of values is made.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    if n > 0:
        rows = isin_top(rows, "a", n)
    cells = contingency(rows, "a", "b", 0, matches, keep_top) if absent or matches else rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    ta, tb = rows.groupBy("a").agg(F.count("*").alias("row_total")), rows.groupBy("b").agg(F.count("*").alias("col_total"))
    all_ = rows.agg(F.count("*").alias("grand"))
    x = cells.join(ta, "a").join(tb, "b").crossJoin(F.broadcast(all_))  # one row
    total = F.when(F.col("row_total") > min_volume, F.col("row_total"))
    exp = total * F.col("col_total") / F.col("grand")
    g = F.when(F.col("n") == 0, F.when(total.isNotNull(), F.lit(0.0))).otherwise(2 * F.col("n") * F.log(F.col("n") / exp))
    x = x if absent else x.where("n > 0")
    return x.select("a", "b", "n", total.alias("total"), (F.col("n") / total).alias("cd"), exp.alias("exp"), g.alias("g"))


def wide(cells: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """A long table with one column for each given b."""
    return cells.groupBy("a").pivot("b", columns).agg(F.first(value)).na.fill(0)


def presence_pivot(df: DataFrame, ts: str, kind: str, kinds: list[str], fill: float = 0.0) -> DataFrame:
    """A row each timestamp, a column each kind: 1 where it occurs (the mean of ones), else ``fill``."""
    return df.groupBy(ts).pivot(kind, kinds).agg(F.avg(F.lit(1.0))).na.fill(fill)


def period_sums(pivoted: DataFrame, keys: list[Column], kinds: list[str]) -> DataFrame:
    """Sums of a pivot by periods: so repeated events of one timestamp count once."""
    return pivoted.groupBy(*keys).agg(*[F.sum(f"`{k}`").alias(k) for k in kinds])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x``, ``y``, ``corr`` of all pairs of columns, in one aggregate."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    one = df.agg(*[F.corr(F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("corr")) for i, (x, y) in enumerate(pairs)])).alias("s")).select("s.*")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``label, predicted, n, pct``: counts and shares of each label in percent."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def constant_columns(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """``cluster, column, n_values, value``: value where a column has one value in a cluster."""
    long = df.select(F.col(cluster).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("cluster", "x.*").where("v is not null")
    return long.groupBy("cluster", "column").agg(F.count_distinct("v").alias("n_values"), F.min("v").alias("lo")).select("cluster", "column", "n_values", F.when(F.col("n_values") == 1, F.col("lo")).alias("value"))


def volume_correlations(df: DataFrame, period: Column, kind: str, k: int = 20) -> DataFrame:
    """``x``, ``y``, ``corr`` of the volumes by period of the k most frequent kinds; a period without a kind counts 0."""
    rows = df.where(F.col(kind).isNotNull())
    kinds = sorted(r[kind] for r in top_values(rows, kind, k).collect())
    volumes = rows.where(F.col(kind).isin(kinds)).groupBy(period.alias("_period")).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0)
    return correlations(volumes, kinds)
