"""Ordered work over groups of any size.

A window over one group runs in one task, so a group with a third of all rows would too. Here the rows are range-partitioned
by (keys, order) instead; each range partition is a *chunk*, and what a chunk must know of the earlier chunks of its group is
carried over in a small table. A range partition holds the tail of at most one group that began in an earlier one, so carry
tables have at most one row per chunk, whatever the data: they are safe to broadcast.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
#: Local folders of sessions without a shared one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``, which all executors reach; only where that is unset (tests) a
    local one is made, once a session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lodestrata-"))
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder, so that lost executors and random partition bounds do no harm."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def range_chunks(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned by ``by``, with the partition's number as ``_chunk``, fixed by a checkpoint.

    Rows that are equal in ``by`` share a chunk, so ``by`` should end in something nearly unique.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in by]
    return checkpointed(df.repartitionByRange(*cols).withColumn(CHUNK, F.spark_partition_id()))


def join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a carry table (at most one row per chunk) on the null-safe keys and the chunk."""
    renamed = carry.select(*[F.col(k).alias(f"_r_{k}") for k in [*keys, CHUNK]], *[c for c in carry.columns if c not in {*keys, CHUNK}])
    cond = F.lit(True)
    for k in [*keys, CHUNK]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(F.broadcast(renamed), cond, "left").drop(*[f"_r_{k}" for k in [*keys, CHUNK]])


def running_carry(summary: DataFrame, keys: Sequence[str], carries: dict[str, Column]) -> DataFrame:
    """From one row per (keys, chunk), the aggregate of all earlier chunks of the group.

    Only chunks that continue a group are returned: at most one row per chunk. ``carries`` maps the new column to an
    aggregate over the earlier rows.
    """
    w = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(w)
    out = summary.withColumn("_before", n).withColumns({c: e.over(w) for c, e in carries.items()})
    return out.filter("_before > 0").select(*keys, CHUNK, *carries)


def row_numbers(chunked: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, weight: Column | None = None) -> DataFrame:
    """Running sum of ``weight`` (1: row numbers from 1) in each group of a ``range_chunks`` table, across its chunks."""
    weight = F.lit(1).cast("long") if weight is None else weight
    summary = chunked.groupBy(*keys, CHUNK).agg(F.sum(weight).alias("_n"))
    carry = running_carry(summary, keys, {"_carry": F.sum("_n")})
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chunked.withColumn(name, F.sum(weight).over(w))
    return join_carry(local, carry, keys).withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")
