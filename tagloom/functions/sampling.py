"""Seeded draws as pure functions of seed, row and purpose: the same in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, row: Column, purpose: str, *more: Column) -> Column:
    """32-bit number from md5 of seed|row|purpose|..."""
    text = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(purpose), *[m.cast("string") for m in more])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, row: Column, purpose: str, *more: Column) -> Column:
    """Uniform number in [0, 1)."""
    return draw(seed, row, purpose, *more) / F.lit(4294967296.0)


def shuffled(seed: int, row: Column, purpose: str, items: Column) -> Column:
    """items in the order of their draws."""
    keyed = F.transform(items, lambda x: F.struct(draw(seed, row, purpose, x).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def between(seed: int, row: Column, purpose: str, low: int, high: Column) -> Column:
    """Whole number from low to high."""
    return (F.lit(low) + F.floor(uniform(seed, row, purpose) * (high - low + 1))).cast("int")
