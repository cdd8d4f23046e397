"""All pairs of records whose sets of values are alike, within one table or between two.

Likeness is shared values / values in the larger set. Records with equal sets form a class and one
member of each class is joined. Values are ordered by rarity; only the prefix that a partner must
meet is indexed, without values that no other set holds; the join key also has a bucket of set
sizes (length filter), candidates pass a positional filter, and the overlap of those left is
counted in full. Values are compared by a 64-bit hash. ``class_pairs`` gives pairs of classes and
membership, ``expanded`` all pairs of members. Keys that many rows share are cut into blocks.

A null array is an empty set; null and empty elements are no values; repeats, letter case and
surrounding blanks don't count. An id with several different sets counts once, with the set of
the smallest digest. Null ids and sets below the least size have no pairs; nor have empty tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.runtime import cut, small

#: Rows of a key that one task of a join takes; crowded keys are cut into blocks.
GROUP = 2048
BLANKS = " \t\n\r\x0b\x0c "


def values_of(col: Column) -> Column:
    """The set of values of an array, sorted."""
    trimmed = F.transform(col, lambda x: F.lower(F.btrim(x, F.lit(BLANKS))))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))


def _members(df: DataFrame, id_col: str, set_col: str, least: int, side: int) -> DataFrame:
    values = df.where(F.col(id_col).isNotNull() & F.col(set_col).isNotNull())
    values = values.select(F.col(id_col).cast("bigint").alias("id"), values_of(F.col(set_col)).alias("v")).where(F.size("v") >= max(1, least))
    keyed = values.select("id", F.md5(F.array_join("v", "\x1f")).alias("key"), F.transform("v", lambda x: F.xxhash64(x)).alias("toks"))
    return keyed.groupBy("id").agg(F.min(F.struct("key", "toks")).alias("s")).select("id", "s.key", "s.toks", F.lit(side).alias("side"))


@dataclass(frozen=True)
class Alike:
    """Alike sets without their copies: ``pairs`` (a, b) of class numbers, ``members`` (side, cid, id) of every class.

    Records with equal sets are one class, numbered by its smallest id; in one table all members of
    a class are alike too. ``single`` says whether both sides are one table.
    """

    pairs: DataFrame
    members: DataFrame
    single: bool


def _blocks(rows: DataFrame, keys: list[str], by: str, sizes: DataFrame, first: str, second: str) -> DataFrame:
    """``rows`` with their cells (i, j) of a grid, where ``sizes`` has the blocks ``g`` of crowded keys: own block ``first``, all blocks ``second``."""
    r = rows.join(sizes, keys, "left").withColumn("g", F.coalesce("g", F.lit(1).cast("bigint")))
    return r.withColumn(first, F.pmod(F.xxhash64(by), F.col("g"))).withColumn(second, F.explode(F.expr("sequence(0L, g - 1)"))).drop("g")


def _crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than ``GROUP`` rows and the number of blocks they are cut into."""
    return small(cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select(*keys, F.ceil(F.col("n") / GROUP).alias("g"))))


def class_pairs(left: DataFrame, left_id: str, left_set: str, threshold: str, right: DataFrame | None = None, right_id: str = "", right_set: str = "", least: int = 1, least_right: int = 1) -> Alike:
    """Alike classes and their members.

    ``threshold`` is a decimal in text ("0.8"), so that no rounding decides a tie.
    """
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    single = right is None
    members = _members(left, left_id, left_set, least, 0)
    if not single:
        members = members.union(_members(right, right_id, right_set, least_right, 1))
    members = cut(members)
    # a class is held once a side; its number is its smallest id
    sets = members.groupBy("side", "key").agg(F.min(F.struct("id", "toks")).alias("s")).select("side", F.col("s.id").alias("cid"), "s.toks")
    single_tok = sets.select("side", "cid", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    seen = single_tok.groupBy("tok").agg(F.count("*").alias("c"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    met = seen.where("c >= 2" if single else "lo <> hi").select("tok", "c")
    ordered = single_tok.join(met, "tok").groupBy("side", "cid", "n").agg(F.array_sort(F.collect_list(F.struct("c", "tok"))).alias("o"))
    ordered = cut(ordered.select("side", "cid", "n", F.transform("o", lambda x: x["tok"]).alias("toks")))
    need = lambda n: F.expr(f"cast((({n}) * {num} + {den - 1}) div {den} as int)")
    alone = F.col("n") - F.size("toks")  # values no other set holds come first
    prefix = F.col("n") - need("n") + 1
    index = ordered.where(prefix > alone).select("side", "cid", "n", alone.alias("alone"), F.slice("toks", F.lit(1), prefix - alone).alias("p"))
    index = index.select("side", "cid", "n", "alone", F.posexplode("p").alias("i", "tok")).select("side", "cid", "n", (F.col("alone") + F.col("i")).alias("pos"), "tok")
    width = math.log(1 / float(t)) * 1.000001 if t < 1 else 1e-9
    bucket = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    near = [0, -1] if single else [-1, 0, 1]
    if t == 1:
        bucket, near = F.col("n"), [0]
    a = index.where("side = 0").select("tok", bucket.alias("bucket"), F.col("cid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = index.where(f"side = {0 if single else 1}").select("tok", F.explode(F.array(*[bucket + F.lit(k) for k in near])).alias("bucket"), F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    crowd = _crowded(a if single else b, ["tok", "bucket"])
    a, b = _blocks(a, ["tok", "bucket"], "a", crowd, "i", "j"), _blocks(b, ["tok", "bucket"], "b", crowd, "j", "i")
    both = a.join(b, ["tok", "bucket", "i", "j"]).where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")
    if single:
        both = both.where("na < nb or (na = nb and a < b)")
    both = both.where(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need("greatest(na, nb)"))
    candidates = both.select("a", "b").distinct()
    sa = ordered.where("side = 0").select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    sb = ordered.where(f"side = {0 if single else 1}").select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    alike = candidates.join(sa, "a").join(sb, "b").where(F.size(F.array_intersect("ta", "tb")) * den >= F.greatest("na", "nb") * num).select("a", "b")
    ids = members.select("id", "side", "key")
    named = ids.join(ids.groupBy("side", "key").agg(F.min("id").alias("cid")), ["side", "key"]).select("side", "cid", "id")
    return Alike(alike, named, single)


def expanded(found: Alike) -> DataFrame:
    """``id_a``, ``id_b`` of all members: those of alike classes, and in one table those of one class.

    A class of more than ``GROUP`` members is cut into blocks, and every pair of blocks is joined on its own.
    """
    named = cut(found.members)
    crowd = _crowded(named, ["side", "cid"])
    other = 0 if found.single else 1
    sizes = lambda side, name: crowd.where(f"side = {side}").select(F.col("cid").alias(name), "g")
    every = lambda rows, name, side, at: rows.join(sizes(side, name), name, "left").withColumn(at, F.explode(F.expr("sequence(0L, coalesce(g, 1L) - 1)"))).drop("g")
    own = lambda side, name, value, at: named.where(f"side = {side}").select(F.col("cid").alias(name), F.col("id").alias(value)).join(sizes(side, name), name, "left").select(name, value, F.pmod(F.xxhash64(value), F.coalesce("g", F.lit(1))).alias(at))
    cells = every(every(found.pairs, "a", 0, "i"), "b", other, "j")
    pairs = cells.join(own(0, "a", "x", "i"), ["a", "i"]).join(own(other, "b", "y", "j"), ["b", "j"]).select("x", "y")
    if not found.single:
        return pairs.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    mx, my = every(own(0, "a", "x", "i"), "a", 0, "j"), every(own(0, "a", "y", "j"), "a", 0, "i")
    same = mx.join(my, ["a", "i", "j"]).where("x < y").select("x", "y")
    return pairs.union(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def set_pairs(left: DataFrame, left_id: str, left_set: str, threshold: str, right: DataFrame | None = None, right_id: str = "", right_set: str = "", least: int = 1, least_right: int = 1) -> DataFrame:
    """``id_a``, ``id_b`` of alike sets. In one table id_a < id_b, else id_a is the left table's."""
    return expanded(class_pairs(left, left_id, left_set, threshold, right, right_id, right_set, least, least_right))


def _parts(syslog: DataFrame, samples: DataFrame, packers: DataFrame) -> dict[str, Alike]:
    return {
        "features": class_pairs(syslog, "line_id", "features", "0.8", least=10),
        "imported_symbols": class_pairs(samples, "sample_id", "imported_symbols", "0.7", least=8),
        "section_names": class_pairs(packers, "packer_id", "section_names", "0.6", samples, "sample_id", "section_names"),
    }


def alike_classes(syslog: DataFrame, samples: DataFrame, packers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The three joins of the project without copies: ``field_name, a, b`` of classes, and ``field_name, side, cid, id`` of members."""
    parts = _parts(syslog, samples, packers)
    named = lambda kind: reduce(DataFrame.union, [getattr(p, kind).select(F.lit(name).alias("field_name"), "*") for name, p in parts.items()])
    return named("pairs"), named("members")


def alike_records(syslog: DataFrame, samples: DataFrame, packers: DataFrame) -> DataFrame:
    """The three joins of the project: log lines, imports of samples, packers against samples."""
    named = [expanded(p).select(F.lit(name).alias("field_name"), "id_a", "id_b") for name, p in _parts(syslog, samples, packers).items()]
    return named[0].union(named[1]).union(named[2])
