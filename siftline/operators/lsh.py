"""Banded MinHash search over token lists.

Signatures are minima over exploded tokens (combined before the shuffle); candidates come from an
equi-join on bands. ``bin_limit`` reproduces the classic cap on buckets by id order; it is off by
default, and ``overflow`` returns what a limit would leave out, so that nothing is lost unseen.
Null lists take no part; an empty list has no signature. Of equal lists the smallest id stays
where duplicates are dropped; ``memberships`` names the representative of every record.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.similarity import METRICS, jaccard, levenshtein_sim, token_hash
from siftline.operators.pair_blocks import edit_distances
from siftline.runtime import small


@dataclass(frozen=True)
class MinHash:
    """Number of hashes, bands and rows (their product must be the number of hashes), salts."""

    num_hashes: int = 20
    bands: int = 5
    rows: int = 4
    bin_limit: int | None = None
    salts: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.bands * self.rows != self.num_hashes:
            raise ValueError("bands times rows must be the number of hashes")

    def salt_list(self) -> tuple[str, ...]:
        return self.salts or tuple(str(i) for i in range(self.num_hashes))


def memberships(df: DataFrame) -> DataFrame:
    """``id`` and the smallest id with the same list, ``rep_id``."""
    keyed = df.where("id is not null and tokens is not null").select("id", F.md5(F.to_json("tokens")).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("id").alias("rep_id")), "k").select("id", "rep_id").distinct()


def deduplicate(df: DataFrame) -> DataFrame:
    return df.where("id is not null and tokens is not null").groupBy(F.md5(F.to_json("tokens")).alias("k")).agg(F.min_by(F.struct("id", "tokens"), "id").alias("s")).select("s.*")


def signatures(df: DataFrame, p: MinHash) -> DataFrame:
    """``id``, ``sig``: one hash minimum for each salt."""
    tokens = df.select("id", F.explode(F.array_distinct("tokens")).alias("tok")).where("tok is not null")
    minima = [F.min(token_hash(F.col("tok"), s)).alias(f"h{i}") for i, s in enumerate(p.salt_list())]
    return tokens.groupBy("id").agg(*minima).select("id", F.array(*[f"h{i}" for i in range(p.num_hashes)]).alias("sig"))


def slow_signatures(df: DataFrame, salts: tuple[str, ...]) -> DataFrame:
    """``id``, ``sig``: minima of whole md5 texts."""
    tokens = df.select("id", F.explode("tokens").alias("tok"))
    return tokens.groupBy("id").agg(*[F.min(F.md5(F.concat("tok", F.lit(s)))).alias(f"h{i}") for i, s in enumerate(salts)]).select("id", F.array(*[f"h{i}" for i in range(len(salts))]).alias("sig"))


def bands(sigs: DataFrame, p: MinHash) -> DataFrame:
    """``band``, ``key``, ``id``."""
    parts = [F.struct(F.lit(i).alias("band"), F.array_join(F.slice("sig", i * p.rows + 1, p.rows).cast("array<string>"), ",").alias("key")) for i in range(p.bands)]
    return sigs.select("id", F.explode(F.array(*parts)).alias("b")).select("b.band", "b.key", "id")


def _ranked(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("r", F.row_number().over(Window.partitionBy("band", "key").orderBy("id")))


def limited(buckets: DataFrame, p: MinHash) -> DataFrame:
    return buckets if p.bin_limit is None else _ranked(buckets).where(F.col("r") <= p.bin_limit).drop("r")


def overflow(buckets: DataFrame, p: MinHash) -> DataFrame:
    """Entries that the limit leaves out."""
    return _ranked(buckets).where(F.col("r") > (p.bin_limit or 0)).drop("r") if p.bin_limit else buckets.limit(0)


def candidate_pairs(buckets: DataFrame, rows: int = 1024) -> DataFrame:
    """Distinct ``src`` < ``dst`` that share a bucket.

    A bucket of more than ``rows`` entries is cut into blocks of about that size, and each pair of
    blocks is joined on its own, so that no task takes a whole crowded bucket.
    """
    crowded = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("band", "key", F.ceil(F.col("n") / rows).alias("g"))
    b = buckets.join(small(crowded), ["band", "key"], "left").withColumn("g", F.coalesce("g", F.lit(1).cast("bigint")))
    own, other = F.pmod(F.xxhash64("id"), F.col("g")), F.explode(F.expr("sequence(0L, g - 1)"))
    left = b.select("band", "key", F.col("id").alias("src"), own.alias("i"), other.alias("j"))
    right = b.select("band", "key", F.col("id").alias("dst"), other.alias("i"), own.alias("j"))
    return left.join(right, ["band", "key", "i", "j"]).where("src < dst").select("src", "dst").distinct()


def similarities(df: DataFrame, pairs: DataFrame, metric: str = "jaccard", threshold: float = 0.5) -> DataFrame:
    """``sim``, ``src``, ``dst``: similarities strictly above the threshold, or distances strictly below it."""
    if metric not in METRICS:
        raise NotImplementedError(metric)
    fn, alike = METRICS[metric]
    one = df.select("id", "tokens")
    joined = pairs.join(one.select(F.col("id").alias("src"), F.col("tokens").alias("ta")), "src").join(one.select(F.col("id").alias("dst"), F.col("tokens").alias("tb")), "dst")
    sim = joined.select(fn(F.col("ta"), F.col("tb")).cast("double").alias("sim"), "src", "dst")
    return sim.where(F.col("sim") > threshold if alike else F.col("sim") < threshold)


def batch(df: DataFrame, p: MinHash = MinHash(), metric: str = "jaccard", threshold: float = 0.5) -> DataFrame:
    """The whole run over deduplicated lists."""
    one = deduplicate(df)
    return similarities(one, candidate_pairs(limited(bands(signatures(one, p), p), p)), metric, threshold)


def query(index: DataFrame, records: DataFrame, queries: DataFrame, p: MinHash, metric: str = "jaccard", threshold: float = 0.1) -> DataFrame:
    """``qid``, ``id``, ``sim`` of each query against the bucket index ``band, key, id``."""
    fn = {"jaccard": jaccard, "levenshtein": levenshtein_sim}[metric]
    probe = bands(signatures(queries, p), p).withColumnRenamed("id", "qid")
    found = index.join(small(probe), ["band", "key"]).select("qid", "id").distinct()
    found = found.join(records.select("id", F.col("tokens").alias("tb")), "id").join(queries.select(F.col("id").alias("qid"), F.col("tokens").alias("ta")), "qid")
    return found.select("qid", "id", fn(F.col("ta"), F.col("tb")).alias("sim")).where(F.col("sim") > threshold)


def _items(tokens: Column) -> Column:
    """Tokens with their null as a value of its own, as the metrics count it."""
    return F.transform(tokens, lambda t: F.coalesce(F.concat(F.lit("="), t), F.lit("0")))


def _counted(tokens: Column) -> Column:
    """Distinct items: the k-th repeat of a token is one of its own."""
    items = _items(tokens)
    return F.transform(items, lambda t, i: F.concat(F.size(F.filter(F.slice(items, 1, i), lambda u: u == t)).cast("string"), t))


def items_of(metric: str) -> Column:
    """The items whose overlap bounds a metric: with repeats for edit distances."""
    return _counted(F.col("tokens")) if metric.startswith("levenshtein") else F.array_distinct(_items(F.col("tokens")))


def exact_pairs(df: DataFrame, threshold: float, repeats: bool = False) -> DataFrame:
    """All ``src`` < ``dst`` whose shared tokens exceed ``threshold`` x tokens of the larger list (sets, or with repeats), by prefix join.

    Tokens go from rare to frequent; two such lists share one of the first m - floor(threshold * m).
    """
    sets = df.where("id is not null and tokens is not null").select("id", (_counted(F.col("tokens")) if repeats else F.array_distinct(_items(F.col("tokens")))).alias("ws"))
    each = sets.select("id", F.explode("ws").alias("w"))
    rare = each.join(each.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("ws"))
    m = F.size("ws")
    prefix = rare.select("id", m.alias("m"), F.posexplode(F.slice("ws", 1, m - F.floor(m * threshold).cast("int"))).alias("at", "s")).select("id", "m", "at", F.xxhash64("s.w").alias("w"))
    a, b = prefix.toDF("src", "ma", "pa", "w"), prefix.toDF("dst", "mb", "pb", "w")
    larger = F.greatest("ma", "mb")
    left = F.least(F.col("ma") - F.col("pa"), F.col("mb") - F.col("pb")) + F.least("pa", "pb")  # tokens that can be shared yet
    return a.join(b, "w").where((F.col("src") < F.col("dst")) & (F.least("ma", "mb") > threshold * larger) & (left > threshold * larger)).select("src", "dst").distinct()


def exact_query(records: DataFrame, queries: DataFrame, threshold: float, n: int | None = None, repeats: bool = False, block: tuple[int, int] = (2048, 8192), metric: str = "overlap") -> DataFrame:
    """``qid``, ``id``, ``sim`` of all records that share more than ``threshold`` of the larger list with a query (only the n best of a query, if given).

    Queries and records meet in a grid of blocks; each looks its records' tokens up in the lists of its queries.
    With band keys ``ks`` in both tables only those that share one count; with ``metric`` "levenshtein" (and
    repeats) that similarity is given, which must exceed the threshold too.
    """
    banded, edit = "ks" in records.columns, metric == "levenshtein"
    tokens = (_counted if repeats else lambda c: F.array_distinct(_items(c)))(F.col("tokens")).alias("ws")
    seq = F.transform("tokens", lambda t: F.when(t.isNotNull(), F.xxhash64(t)).otherwise(0)).alias("seq")
    nq, nr = (-(-df.count() // size) or 1 for df, size in zip((queries, records), block))
    grid = lambda df, own, other, k, ko: df.select("id", tokens, *[seq] * edit, *["ks"] * banded, F.pmod(F.xxhash64("id"), F.lit(k)).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ko - 1).cast("bigint"))).alias(other))

    def padded(rows: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in rows], int)
        out = np.zeros((len(rows), int(sizes.max(initial=0))), np.int64)
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return out, sizes

    def look(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"qid": np.zeros(0, int), "id": np.zeros(0, int), "sim": np.zeros(0)})
        qids, lists, posted = q["id"].to_numpy(), list(q["ws"]), defaultdict(list)
        for i, ws in enumerate(lists):
            for w in ws:
                posted[w].append(i)
        sizes, posted = np.array([len(ws) for ws in lists]), {w: np.array(v) for w, v in posted.items()}
        qk = np.array([*q["ks"]]) if banded else None
        (qs, ql), (rs, rl) = (padded(list(x["seq"])) if edit else (None, None) for x in (q, r))
        out, held, rids = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], [], r["id"].to_numpy()

        def measured() -> None:
            x, y = (np.concatenate(k) for k in zip(*held))
            sim = 1 - edit_distances(qs[x], ql[x], rs[y], rl[y]) / np.maximum(ql[x], rl[y])
            ok = sim > threshold
            out.append((qids[x[ok]], rids[y[ok]], sim[ok]))
            held.clear()

        for k, (ws, rk) in enumerate(zip(r["ws"], r["ks"] if banded else [None] * len(r))):
            if hits := [posted[w] for w in ws if w in posted]:
                sim = np.bincount(np.concatenate(hits), minlength=len(sizes)) / np.maximum(sizes, len(ws))
                at = np.flatnonzero(sim > threshold)
                if banded:
                    at = at[(qk[at] == rk).any(axis=1)]
                if not edit:
                    out.append((qids[at], np.full(len(at), rids[k]), sim[at]))
                    continue
                held.append((at, np.full(len(at), k)))
                if len(held) == 64:
                    measured()
        if held:
            measured()
        found = pd.DataFrame(dict(zip(("qid", "id", "sim"), map(np.concatenate, zip(*out)))))
        return found if n is None else found.sort_values(["sim", "id"], ascending=False).groupby("qid").head(n)

    q, r = grid(queries, "q", "r", nq, nr), grid(records, "r", "q", nr, nq)
    return q.groupBy("q", "r").cogroup(r.groupBy("q", "r")).applyInPandas(lambda a, b: look(a, b), "qid bigint, id bigint, sim double")


def top_n(found: DataFrame, n: int = 5) -> DataFrame:
    """The n most alike of each query, by similarity and id, both falling."""
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), F.desc("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def averaged_top(queries: DataFrame, found: DataFrame, n: int = 5) -> DataFrame:
    """``qid``, ``score``: sum of the n best similarities / n; 0 without a match."""
    best = top_n(found, n).groupBy("qid").agg((F.sum("sim") / n).alias("score"))
    return queries.select(F.col("id").alias("qid")).join(best, "qid", "left").select("qid", F.coalesce("score", F.lit(0.0)).alias("score"))


def reduction(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: records, candidate pairs, all pairs. ``pairs`` may be counts ``n`` of pairs instead."""
    n = df.agg(F.count("*").alias("records"))
    count = F.coalesce(F.sum("n"), F.lit(0).cast("bigint")) if pairs.columns == ["n"] else F.count("*")
    return n.crossJoin(F.broadcast(pairs.agg(count.alias("pairs")))).withColumn("all_pairs", F.col("records") * (F.col("records") - 1) / 2)


def save(path: str, buckets: DataFrame, sigs: DataFrame, pairs: DataFrame, p: MinHash) -> None:
    """A model is four tables below one folder."""
    spark = sigs.sparkSession
    spark.createDataFrame([(i, s) for i, s in enumerate(p.salt_list())], "i int, salt string").write.mode("overwrite").parquet(f"{path}/salts")
    for name, df in (("buckets", buckets), ("sigs", sigs), ("pairs", pairs)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str, names: tuple[str, ...] = ("buckets", "sigs", "pairs")) -> tuple[tuple[str, ...], dict[str, DataFrame]]:
    salts = tuple(r["salt"] for r in spark.read.parquet(f"{path}/salts").orderBy("i").collect())
    return salts, {n: spark.read.parquet(f"{path}/{n}") for n in names}
