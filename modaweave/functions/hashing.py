"""Seeded, engine-independent ordering keys: every random choice is a hash order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(key: str | Column, seed: int | str | Column = 42) -> Column:
    """``md5(seed|key)`` as hex: uniform, and its text order is a reproducible shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string")))


def hash_slot(text: Column, slots: int) -> Column:
    """Stable slot number 0..slots-1 from the first 32 bits of md5."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(slots))


def unit_interval(key: Column) -> Column:
    """Map a hex digest to [0, 1) with 32 bits of resolution."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
