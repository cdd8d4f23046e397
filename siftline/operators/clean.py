"""Cleaning of feeds: dashes and nulls, text, duplicates, labels, prefix fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import strip_lower


def dash_to_null(df: DataFrame, mark: str = "-") -> DataFrame:
    """Text cells that are exactly ``mark`` become null."""
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit(mark)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a null."""
    return df.na.drop("any")


def normalise_text(df: DataFrame) -> DataFrame:
    """All text columns trimmed of white space and in lower case."""
    return df.select(*[strip_lower(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def relabel(df: DataFrame, column: str, condition: Column, value: str) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def fill_by_prefix(df: DataFrame, prefixes: dict[str, float], default: float = -1) -> DataFrame:
    """Fill nulls of numeric columns: by the first prefix of their name, else ``default``."""
    fills = {f.name: next((v for p, v in prefixes.items() if f.name.startswith(p)), default) for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return df.na.fill(fills) if fills else df


def without(df: DataFrame, part: str) -> DataFrame:
    """Without the columns whose name has ``part``."""
    return df.drop(*[c for c in df.columns if part in c])


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """A fixed random order of rows."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def hash_split(df: DataFrame, key: str, percent: int = 80) -> DataFrame:
    """Add ``part``: 'train' for about ``percent`` of the keys, 'test' for the rest; the same on every run."""
    return df.withColumn("part", F.when(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(100)) < percent, "train").otherwise("test"))
