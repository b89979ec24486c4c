"""Joins that survive hot keys, and broadcasts behind a check of size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows that a looked-up table may have to be broadcast (a few dozen bytes each).
BROADCAST_ROWS = 200_000
#: A key is heavy when it holds more than this share of all rows: there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1e-4
#: Keys with fewer rows are never heavy.
HEAVY_ROWS = 50_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def _on(keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys with the renamed ones; by name, as both sides may come from one table."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return cond


def lookup(rows: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left", salt: Column | None = None, salts: int = 16, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` with ``dim`` (unique in ``keys``, null-safe).

    A table of at most ``most`` rows is broadcast. A larger one is repeated ``salts`` times and joined on the keys and a
    salt of the row, so the rows of one key spread over that many tasks (and AQE splits them further).
    """
    renamed = dim.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    drop = [f"_r_{k}" for k in keys]
    if fits(dim, most):
        return rows.join(F.broadcast(renamed), _on(keys), how).drop(*drop)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt) if salt is not None else F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    renamed = renamed.withColumn("_r_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(renamed, _on(keys) & (F.col("_salt") == F.col("_r_salt")), how).drop(*drop, "_salt", "_r_salt")


def counted_join(rows: DataFrame, dim: DataFrame, keys: Sequence[str], count: str, salt: Column, how: str = "inner", share: float = HEAVY_SHARE, least: int = HEAVY_ROWS) -> DataFrame:
    """Shuffle join of ``rows`` with ``dim`` (unique in ``keys``), where ``dim[count]`` is the number of rows of each key.

    Keys above ``share`` of all rows (never more than 1 / share of them, so their list is broadcast) are cut into salts of
    about that many rows; all other keys keep one. ``dim`` is read several times and should be checkpointed.
    """
    total = dim.agg(F.sum(count)).first()[0] or 0
    most = max(least, int(total * share))
    pieces = F.ceil(F.col(count) / F.lit(most)).cast("int")
    heavy = dim.filter(F.col(count) > most).select(*[F.col(k).alias(f"_r_{k}") for k in keys], pieces.alias("_pieces"))
    salted = rows.join(F.broadcast(heavy), _on(keys), "left").drop(*[f"_r_{k}" for k in keys])
    salted = salted.withColumn("_salt", F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(salt), F.col("_pieces")).cast("int")).otherwise(0)).drop("_pieces")
    wide = dim.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop(count)
    wide = wide.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return salted.join(wide, _on(keys) & (F.col("_salt") == F.col("_r_salt")), how).drop(*[f"_r_{k}" for k in keys], "_salt", "_r_salt")
