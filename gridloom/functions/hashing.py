"""Deterministic splits and ids: hashes in place of random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SALT, FRACTION = "wordle-split-v1", 0.1  # fixed values: splits must come out as published


def split_of(key: Column, fraction: float = FRACTION, salt: str = SALT) -> Column:
    """'val' for about `fraction` of keys, by the first 8 hex digits of a salted sha256."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(share < fraction, "val").otherwise("train")


def opaque_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 14))


def history_key(history: Column) -> Column:
    """guess:feedback of each turn, joined by |."""
    return F.array_join(F.transform(history, lambda h: F.concat(h["guess"], F.lit(":"), h["feedback"])), "|")
