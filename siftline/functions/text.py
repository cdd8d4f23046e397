"""Column expressions on text: entropy, character n-grams, domains, labels, hex and masks.

All return null for null input unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes the domain functions know, longest match first (fixed values; more can be passed in).
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "com", "net", "org", "edu", "gov", "info", "biz", "io", "ru", "cn", "de", "fr", "uk", "example", "test", "invalid")


def entropy(s: Column) -> Column:
    """Shannon entropy in bits over the characters; 0 for the empty string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def char_ngrams(s: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """All n-grams of the lower-cased text, shortest sizes first, with repeats; blanks collapse to one."""
    low = F.regexp_replace(F.lower(s), r"\s+", " ")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1)))
        return F.when(F.length(low) >= n, F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in sizes]
    return F.when(s.isNotNull(), F.flatten(F.array(*grams)))


def netloc(uri: Column) -> Column:
    """Host with port and user part of a URI without scheme."""
    return F.regexp_extract(uri, r"^([^/?#]*)", 1)


def host(uri: Column) -> Column:
    """Host of a URI with or without scheme, lower case, without port and user part."""
    bare = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(bare), r"^.*@", ""), r":\d*$", ""))


def registered_label(uri: Column, suffixes: tuple[str, ...] = SUFFIXES, lenient: bool = False) -> Column:
    """The label before the public suffix. Without a known suffix: null, or when lenient the last label."""
    h = host(uri)
    known = "|".join(x.replace(".", r"\.") for x in sorted(suffixes, key=lambda x: (-x.count("."), -len(x), x)))
    label = F.regexp_extract(h, rf"(?:^|\.)([^.]+)\.(?:{known})$", 1)
    return F.when(label != "", label).when(F.lit(lenient) & (h != ""), F.element_at(F.split(h, r"\."), -1))


def first_label(raw: Column) -> Column:
    """Text before the first dot, trimmed, lower case."""
    return F.lower(F.trim(F.substring_index(raw, ".", 1)))


def alpha_word(raw: Column) -> Column:
    """Lower-cased word if the untrimmed text is letters only, else null."""
    return F.when(raw.rlike(r"^\p{L}+$"), F.lower(F.trim(raw)))


def strip_lower(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"^\s+", ""), r"\s+$", ""))


def feed_timestamp(s: Column) -> Column:
    """Timestamp text with an underscore between date and time; null if it isn't one."""
    return F.try_to_timestamp(F.replace(F.trim(s), F.lit("_"), F.lit(" ")), F.lit("yyyy/MM/dd HH:mm"))


def make_label(tokens: Column, width: int = 6) -> Column:
    """First characters of each token joined by colons, without non-ASCII characters."""
    return F.regexp_replace(F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, width)), ":"), r"[^\x00-\x7F]", "")


def hex_le(v: Column, width: int = 4) -> Column:
    """Little-endian hex of an unsigned integer of ``width`` bytes."""
    big = F.lower(F.lpad(F.hex(v), 2 * width, "0"))
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])


def nibble_mask(hexes: Column, width: int = 8) -> Column:
    """Hex characters equal in all values, ``?`` elsewhere; null if nothing is equal."""

    def kinds(i: int) -> Column:
        return F.size(F.array_distinct(F.transform(hexes, lambda v: F.substring(v, i, 1))))

    at = [kinds(i) for i in range(1, width + 1)]
    mask = F.concat(*[F.when(n == 1, F.substring(F.get(hexes, F.lit(0)), i, 1)).otherwise("?") for i, n in enumerate(at, 1)])
    return F.when(mask != "?" * width, mask)


def rule_name(s: Column) -> Column:
    """Text fit for a rule identifier: other signs become ``_``, one leading digit goes, 128 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"^\d", ""), r"[^A-Za-z0-9_]", "_"), 1, 128)


def const_strings(strings: Column) -> Column:
    """Strings longer than five printable characters without blanks, quotes and backslashes."""
    return F.filter(strings, lambda x: x.rlike(r"^[!#-&(-\[\]-~]{6,}$"))


def printable_runs(content: Column) -> Column:
    """Printable runs of at least eight bytes of a binary."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"([\x09-\x0D\x20-\x7E]{8,})"), F.lit(1))


def major_minor(version: Column) -> Column:
    """``10.7.5`` as 10.7."""
    return F.substring_index(version, ".", 2).try_cast("double")


def friendly_name(seed: Column, adjectives: tuple[str, ...], nouns: tuple[str, ...], digits: int = 4) -> Column:
    """A name of an adjective, a noun and the seed's first characters; the same seed gives the same name."""
    pick = lambda start, words: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.conv(F.substring(F.md5(seed), start, 8), 16, 10).cast("bigint"), F.lit(len(words))).cast("int"))
    return F.concat_ws(" ", pick(1, adjectives), pick(9, nouns), F.lower(F.substring(seed, 1, digits)))
