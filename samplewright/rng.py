"""Uniform draws from a hash of seed and id: independent of partitioning, equal in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(seed: str | Column, key: Column) -> Column:
    """52 bits of the MD5 of seed|key as 13 hex digits, which sort as their number does."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.substring(F.md5(F.concat(seed.cast("string"), F.lit("|"), key.cast("string"))), 1, 13)


def uniform(seed: str | Column, key: Column) -> Column:
    """A double in (0, 1) for each (seed, key)."""
    return (F.conv(digits(seed, key), 16, 10).cast("double") + 0.5) / F.lit(4503599627370496.0)


def uniform_sql(seed: str, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def digits_sql(seed: str, key: str) -> str:
    return f"substr(md5('{seed}|' || {key}), 1, 13)"
