"""Pairs of items that meet in the same basket more often than chance.

Heavy-light decomposition. Items of at least ``heavy`` baskets are heavy; each block of baskets
makes a bit matrix of its heavy items, and the pairs' counts are popcounts of conjunctions. Pairs
of light items are counted by hash over the baskets' light items, wide baskets being spread over
several tasks; pairs of a heavy and a light item are counted by probing, for each entry of a light
item's list, the heavy items of its basket. The three parts don't overlap and are united.
Items that no reported pair can hold (fewer than ``least`` baskets, or more than N / lift) are left
out beforehand, which loses no pair.

Items and baskets are told apart by 64-bit hashes (xxHash): two of a billion share one with a chance of about 3 %.
An item counts once a basket; null baskets and items are none; an empty table has no pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.runtime import cut, small

#: Most heavy items (they fill a matrix of counts in each block), baskets a block, light items a task takes of a basket.
HEAVY_ITEMS, BLOCK, WIDE = 2048, 32_768, 512


def host_of(domain: Column) -> Column:
    """The host of a URI without scheme; null if there is none."""
    host = F.regexp_replace(F.lower(F.trim(F.regexp_replace(domain, r"[\s\p{Z}]+", " "))), r"[/?#].*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r":[^:]*$", ""), r"\.+$", "")
    return F.when((host != "") & (host != "-"), host)


def mdl_items(mdl: DataFrame) -> DataFrame:
    """``basket``, ``item``: hosts with their descriptions and ASNs."""
    desc = F.trim(F.lower(F.regexp_replace("description", r"[\s\p{Z}]+", " ")))
    asn = F.regexp_extract(F.trim("asn"), r"(\d+)", 1)
    items = F.array(F.when((desc != "") & (desc != "-"), F.concat(F.lit("desc:"), desc)), F.when(asn != "", F.concat(F.lit("asn:"), F.regexp_replace(asn, r"^0+(?=\d)", ""))))
    return mdl.select(host_of(F.col("domain")).alias("basket"), F.explode(items).alias("item")).where("basket is not null and item is not null")


def _popcounts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of all pairs of heavy items that meet in one block of baskets."""
    baskets, col = np.unique(pdf["basket"].to_numpy(), return_inverse=True)
    items, row = np.unique(pdf["item"].to_numpy(), return_inverse=True)
    bits = np.zeros((len(items), (len(baskets) + 63) // 64 * 64), dtype=bool)
    bits[row, col] = True
    words = np.packbits(bits, axis=1).view(np.uint64)
    out = []
    for i in range(len(items) - 1):
        counts = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1)
        met = np.flatnonzero(counts)
        out.append((np.full(len(met), items[i]), items[i + 1 + met], counts[met].astype(np.int64)))
    if not out:
        return pd.DataFrame({"a": [], "b": [], "n": []})
    a, b, n = map(np.concatenate, zip(*out))
    return pd.DataFrame({"a": a, "b": b, "n": n})


def pairs(entries: DataFrame, least: int = 4, lift: int = 3, heavy_items: int = HEAVY_ITEMS, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """``item_a`` < ``item_b``, ``n_ab``, ``n_a``, ``n_b``, ``n_baskets`` of pairs in at least ``least`` baskets with n_ab * N >= lift * n_a * n_b."""
    entries = cut(entries.distinct())
    total = entries.select("basket").distinct().count()
    item_counts = cut(entries.groupBy("item").agg(F.count("*").alias("n_item")).where((F.col("n_item") >= least) & (F.col("n_item") * lift <= total)))
    # the count from which at most heavy_items items are heavy; below one basket in 64 bits a list is shorter than a row of the matrix
    cutoff = item_counts.groupBy("n_item").agg(F.count("*").alias("c")).orderBy(F.desc("n_item")).limit(heavy_items + 1).collect()
    heavy, have = total + 1, 0
    for r in cutoff:
        have += r["c"]
        if have > heavy_items or r["n_item"] * 64 < total and r["n_item"] < 64:
            break
        heavy = r["n_item"]
    # items by number, so that counting moves no text; numbers follow the texts' order within a pair by the final swap
    known = item_counts.select("item", "n_item", F.xxhash64("item").alias("i"))
    e = entries.join(known, "item").select(F.xxhash64("basket").alias("basket"), F.col("i").alias("item"), (F.col("n_item") >= heavy).alias("heavy"))
    e = cut(e)
    blocks = max(1, -(-total // block))
    dense = e.where("heavy").select(F.pmod(F.col("basket"), F.lit(blocks)).alias("block"), "basket", "item")
    dense = dense.groupBy("block").applyInPandas(lambda pdf: _popcounts(pdf), "a bigint, b bigint, n bigint")
    light = e.where("not heavy").select("basket", "item")
    # wide baskets: an item goes to one row and one column of a grid of tasks; its heavy partners go with each row
    spread = light.groupBy("basket").agg(F.ceil(F.count("*") / wide).cast("int").alias("g")).where("g > 1")
    spread = small(cut(spread))
    g = F.coalesce("g", F.lit(1))
    li = light.join(spread, "basket", "left").select("basket", "item", g.alias("g"), F.pmod(F.hash("item"), g).alias("s"))
    all_parts = F.explode(F.expr("sequence(0, g - 1)"))
    la = li.select("basket", F.col("item").alias("a"), F.col("s").alias("x"), all_parts.alias("y"))
    lb = li.select("basket", F.col("item").alias("b"), F.col("s").alias("y"), all_parts.alias("x"))
    rare = la.join(lb, ["basket", "x", "y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    lists = e.where("heavy").groupBy("basket").agg(F.collect_list("item").alias("hs"))  # at most heavy_items each
    lists = lists.join(spread, "basket", "left").withColumn("g", g).select("basket", "hs", all_parts.alias("s"))
    mixed = li.join(lists, ["basket", "s"]).select(F.col("item").alias("l"), F.explode("hs").alias("h"))
    mixed = mixed.select(F.least("l", "h").alias("a"), F.greatest("l", "h").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    counted = dense.union(rare).union(mixed).groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)
    ka = known.select(F.col("i").alias("a"), F.col("item").alias("ta"), F.col("n_item").alias("ca"))
    kb = known.select(F.col("i").alias("b"), F.col("item").alias("tb"), F.col("n_item").alias("cb"))
    named = counted.join(ka, "a").join(kb, "b").where(F.col("n_ab") * total >= F.lit(lift) * F.col("ca") * F.col("cb"))
    swap = F.col("ta") > F.col("tb")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return named.select(pick("ta", "tb").alias("item_a"), pick("tb", "ta").alias("item_b"), "n_ab", pick("ca", "cb").alias("n_a"), pick("cb", "ca").alias("n_b"), F.lit(total).cast("bigint").alias("n_baskets"))
