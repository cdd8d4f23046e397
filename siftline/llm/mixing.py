"""Mixing the documents of several sources to target shares of the total size.

Each document of a source gets the same expected number of copies, so that the source's expected
size is its share of the total; the fraction over whole copies is a probability. Pivotal rounding
takes two fractional documents at a time and moves size from one to the other at random until one
is whole, so that the source's size stays what it was. Documents of a source are hashed to buckets
by their ids, as many as its number of documents asks for; every bucket does this on its own and
passes on at most one fractional document; these are combined by a reduction tree of bounded
fan-in. A source misses its size by less than one document. The draw depends on the seed, ids and
sizes only, not on partitions or the cluster.

Without a given total the largest one is taken that every source with documents can meet under its
cap. Documents of unlisted or null sources, and those without tokens, get no copies; a target
source without documents has a reached share of 0; empty tables give an empty mix.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.bpe import count_tokens
from siftline.runtime import collect_small, cut

#: Documents of a bucket (about), buckets that one task of the tree combines.
BUCKET, FAN_IN = 50_000, 64
_MASK = (1 << 64) - 1
SCHEMA = "source string, bucket bigint, doc_id bigint, n_tokens bigint, copies bigint, frac double, settled boolean"


def _uniform(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) that depends on the two documents only (splitmix64)."""
    z = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & _MASK
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ (z >> shift)) * mult) & _MASK
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def _pivot(rows, seed: int, last: bool):
    """Round the fractions of (doc_id, n_tokens, copies, frac) rows of one source; settled rows and the open one."""
    out, open_ = [], None
    for doc, w, copies, p in rows:
        if p <= 0 or p >= 1:
            out.append((doc, w, copies + (p >= 1), 0.0, True))
            continue
        if open_ is None:
            open_ = (doc, w, copies, p)
            continue
        d2, w2, c2, q = open_
        up = min((1 - p) * w, q * w2)  # size that may move to this document
        down = min(p * w, (1 - q) * w2)  # and from it
        move = up if _uniform(seed, doc, d2) * (up + down) < down else -down
        p, q = p + move / w, q - move / w2
        open_ = None
        for d, x, c, r in ((doc, w, copies, p), (d2, w2, c2, q)):
            if r < 1e-9 or r > 1 - 1e-9:
                out.append((d, x, c + (r > 0.5), 0.0, True))
            else:
                open_ = (d, x, c, r)
    if open_ is not None:
        d, x, c, r = open_
        out.append((d, x, c + (_uniform(seed, d, d) < r), 0.0, True) if last else (d, x, c, r, False))
    return out


def _rounded(seed: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"])
        got = _pivot(zip(*(pdf[c].tolist() for c in ("doc_id", "n_tokens", "copies", "frac"))), seed, last)
        return pd.DataFrame([(*key, *r) for r in got], columns=["source", "bucket", "doc_id", "n_tokens", "copies", "frac", "settled"])

    return run


def draw(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> tuple[DataFrame, list]:
    """Copies of each document of ``sized`` (doc_id, source, n_tokens); and the plan by source."""
    wanted = collect_small(targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")))
    counted = sized.where("n_tokens > 0").join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n")).collect()
    sums, most = {r["source"]: r["size"] for r in counted}, max((r["n"] for r in counted), default=0)
    buckets = {r["source"]: -(-r["n"] // BUCKET) for r in counted}
    plan = [(r["source"], float(r["share"] or 0), int(r["cap"] or 0), int(sums.get(r["source"]) or 0)) for r in wanted]
    if total_tokens is None:
        total_tokens = min((size * cap / share for _, share, cap, size in plan if share > 0 and size > 0), default=0)
    rate = {source: min(float(cap), share * total_tokens / size) for source, share, cap, size in plan if size > 0}
    spark = sized.sparkSession
    rates = spark.createDataFrame([(s, r, buckets[s]) for s, r in rate.items()], "source string, rate double, buckets bigint")
    docs = sized.join(F.broadcast(rates), "source").where("n_tokens > 0 and rate > 0")  # as many rows as targets has sources
    bucket = F.pmod(F.xxhash64("doc_id"), F.col("buckets")).alias("bucket")
    left = docs.select("source", bucket, "doc_id", "n_tokens", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("frac"))
    settled, width = [], max(1, -(-most // BUCKET))
    while True:
        level = cut(left.groupBy("source", "bucket").applyInPandas(_rounded(seed, width == 1), SCHEMA))
        settled.append(level.where("settled"))
        if width == 1:
            break
        width = -(-width // FAN_IN)
        left = level.where("not settled").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).drop("settled")
    drawn = settled[0]
    for part in settled[1:]:
        drawn = drawn.union(part)
    return drawn.where("copies > 0").select("doc_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies")), plan


def sizes_of(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` of the documents of target sources, written once; no other document is encoded."""
    wanted = F.broadcast(targets.where("source is not null and target_share > 0").select("source").distinct())
    return cut(count_tokens(documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi")))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``copies`` of the documents drawn."""
    return draw(sizes_of(documents, targets), targets, total_tokens, seed)[0]


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """The shares that ``mix`` reached, a row for each target source."""
    drawn, plan = draw(sizes_of(documents, targets), targets, total_tokens, seed)
    by = drawn.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    goal = drawn.sparkSession.createDataFrame([(s, share, cap) for s, share, cap, _ in plan], "source string, target_share double, max_repeats int")
    total = by.agg(F.sum("tokens").alias("total"))
    out = goal.join(by, "source", "left").crossJoin(F.broadcast(total))  # one row
    reached = F.when(F.col("total") > 0, F.coalesce("tokens", F.lit(0)) / F.col("total")).otherwise(0.0)
    return out.select("source", "target_share", reached.alias("actual_share"), "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_copies")])
