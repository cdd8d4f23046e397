"""Similarity of token lists as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_hash(value: Column, salt: str) -> Column:
    """First four bytes, little-endian and unsigned, of md5(value + salt)."""
    m = F.md5(F.concat(value, F.lit(salt)))
    return F.conv(F.concat(F.substring(m, 7, 2), F.substring(m, 5, 2), F.substring(m, 3, 2), F.substring(m, 1, 2)), 16, 10).cast("bigint")


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens / tokens of the larger set (not of the union); null for two empty lists."""
    larger = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(larger > 0, F.size(F.array_intersect(a, b)) / larger)


#: Distinct tokens of a pair that have code points below the surrogates.
_CODES = 55_000


def _spelled(tokens: Column, vocabulary: Column, missing: int) -> Column:
    """A string with one character for each token; a null is no token of the other list."""
    codes = F.transform(tokens, lambda t: F.lpad(F.hex(F.coalesce(F.array_position(vocabulary, t) + 2, F.lit(missing))), 4, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance of two token lists, by the built-in distance of strings that spell each token as one character."""
    vocabulary = F.array_distinct(F.concat(a, b))
    return F.when(F.size(vocabulary) <= _CODES, F.levenshtein(_spelled(a, vocabulary, 1), _spelled(b, vocabulary, 2))).otherwise(_levenshtein_rows(a, b))


def _levenshtein_rows(a: Column, b: Column) -> Column:
    """The same for lists of more tokens than there are characters: one row of the table is carried through the first list."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(acc: Column, x: Column) -> Column:
        # acc: the previous row; costs of deleting and replacing first, then a running minimum for inserting
        base = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: F.when(j == 0, F.get(acc, j) + 1).otherwise(F.least(F.get(acc, j) + 1, F.get(acc, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1))))
        return F.aggregate(base, F.array().cast("array<int>"), lambda out, v: F.when(F.size(out) == 0, F.array(v)).otherwise(F.concat(out, F.array(F.least(v, F.element_at(out, -1) + 1)))))

    return F.element_at(F.aggregate(a, first, row), -1)


def levenshtein_sim(a: Column, b: Column) -> Column:
    """1 - distance / longer length; null for two empty lists."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer > 0, 1 - levenshtein(a, b) / longer)


def tapered(a: Column, b: Column) -> Column:
    """Edit distance whose costs fall towards the end of the lists; the table's edges cost 1 a step."""
    longest = F.greatest(F.size(a), F.size(b)).cast("double")
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j.cast("double"))

    def row(acc: Column, x: Column) -> Column:
        i = F.get(acc, F.lit(0)).cast("int")  # rows done so far
        cost = lambda j: 1 - F.least(i, j - 1) / longest
        base = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: F.when(j == 0, F.get(acc, j) + 1).otherwise(F.least(F.get(acc, j) + cost(j), F.get(acc, j - 1) + F.when(F.get(b, j - 1) == x, F.lit(0.0)).otherwise(cost(j)))))
        step = lambda out, v: F.when(F.size(out) == 0, F.array(v)).otherwise(F.concat(out, F.array(F.least(v, F.element_at(out, -1) + 1 - F.least(i, F.size(out) - 1) / longest))))
        return F.aggregate(base, F.array().cast("array<double>"), step)

    return F.element_at(F.aggregate(a, first, row), -1)


def tapered_sim(a: Column, b: Column) -> Column:
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer > 0, 1 - tapered(a, b) / longer)


#: Metrics by name; for distances less is more alike.
METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "jaccard": (jaccard, True),
    "levenshtein": (levenshtein_sim, True),
    "l_tapered_sim": (tapered_sim, True),
    "levenshtein_D": (levenshtein, False),
    "levenshtein_tapered": (tapered, False),
}


def common_ordered(a: Column, b: Column) -> Column:
    """Tokens of the first list that the second holds, in order, with repeats."""
    return F.filter(a, lambda x: F.array_contains(b, x))
