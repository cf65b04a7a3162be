"""Splits and samples that depend on a key, never on row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
_STEPS = 1_000_000


def unit_hash(*keys: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by the key and the seed."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(_STEPS)).cast("double") / _STEPS


def train_test(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = SEED):
    """80/20 by default; the same key always lands on the same side."""
    score = unit_hash(*keys, seed=seed)
    return df.where(score >= test_size), df.where(score < test_size)


def split_by_number(df: DataFrame, key: str, parts: int = 5, held_out: int = 0):
    """Split on an integer key, for checks that another engine must repeat."""
    fold = F.pmod(F.col(key), F.lit(parts))
    return df.where(fold != held_out), df.where(fold == held_out)


def pick(df: DataFrame, keys: list[str], n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement, the ones with the smallest key hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def evenly_spread(df: DataFrame, keys: list[str], size: int = 800, above: int = 2000, seed: int = SEED) -> DataFrame:
    """About `size` rows spread over the table once it has more than `above`; all rows otherwise."""
    rows = df.count()
    if rows <= above:
        return df
    step = -(-rows // size)
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(step)) == 0)
