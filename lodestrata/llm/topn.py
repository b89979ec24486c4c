"""First N rows of every group, groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import CHUNK, checkpointed, join_carry, range_chunks, running_carry
from ..plans.skew import BROADCAST_ROWS

#: A group is heavy, and cut by ranges of the sort order, if it holds more than this share of all rows, but at least ...
HEAVY_SHARE, LEAST_HEAVY = 1 / 200, 2_000
#: ... and in any case if it holds more than this: a window sorts a group in one task.
MOST_LIGHT = 1_000_000


def heavy_limit(rows: int) -> int:
    """Most rows of a light group of a table of so many rows."""
    return min(MOST_LIGHT, max(LEAST_HEAVY, int(rows * HEAVY_SHARE)))


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: str | int, heavy_rows: int | None = None, rank: str = "_rank") -> DataFrame:
    """The first ``n`` rows (a number or a column) of each group in ``order``, with their ``rank`` from 1.

    ``order`` must settle every tie. A null group key is a group of its own; a null or non-positive ``n`` keeps nothing; an
    empty table gives an empty one. Exact group counts split the groups at ``heavy_rows``, by default ``heavy_limit`` of the
    number of rows: light ones go through an ordinary window. The rows of heavy ones are range-partitioned by (group, order); a chunk whose predecessors already hold ``n`` rows of the group is
    dropped unsorted, the others are numbered from where their predecessors end. ``df`` is read twice (counts, rows) and
    should be cheap to read or checkpointed. The union of both halves is the result.
    """
    group = list(group)
    cols = df.columns
    limit = F.lit(n) if isinstance(n, int) else F.col(n)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    heavy_rows = heavy_limit(df.count()) if heavy_rows is None else heavy_rows
    # The sum of all sizes bounds this list: it has at most (rows of df) / heavy_rows entries, 200 up to 200 million rows.
    heavy = checkpointed(sizes.filter(F.col("_size") > heavy_rows).select(*[F.col(g).alias(f"_r_{g}") for g in group], F.lit(True).alias("_heavy")))
    number = heavy.count()
    if number:
        cond = F.lit(True)
        for g in group:
            cond = cond & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
        # A longer list than this is shuffled: no single key of it can then hold a large share of all rows.
        tagged = df.join(F.broadcast(heavy) if number <= BROADCAST_ROWS else heavy, cond, "left").drop(*[f"_r_{g}" for g in group])
        light = tagged.filter("_heavy is null").drop("_heavy")
    else:
        light = df
    w = Window.partitionBy(*group).orderBy(*order)
    out = light.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= limit)
    if not number:
        return out
    chunked = range_chunks(tagged.filter("_heavy").drop("_heavy"), [*group, *order])
    counts = chunked.groupBy(*group, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    carry = running_carry(counts, group, {"_carry": F.sum("_n")})
    reached = join_carry(chunked, carry, group).withColumn("_carry", F.coalesce("_carry", F.lit(0).cast("long"))).filter(F.col("_carry") < limit)
    local = F.row_number().over(Window.partitionBy(*group, CHUNK).orderBy(*order)).cast("long")
    hot = reached.withColumn(rank, local + F.col("_carry")).filter(F.col(rank) <= limit)
    return out.unionByName(hot.select(*cols, rank))


def tie_order(value_num: str, value_text: str, smallest: str, then: Sequence[str]) -> list[Column]:
    """Sort order of a mixed-direction ranking: by value (ascending with missing first where ``smallest``, else descending
    with missing last), then ascending by ``then``. The value is a number, or a text where the number is null."""
    missing = F.col(value_num).isNull() & F.col(value_text).isNull()
    return [
        F.when(missing, F.when(F.col(smallest), 0).otherwise(2)).otherwise(1).asc(),
        F.when(F.col(smallest), F.col(value_num)).otherwise(-F.col(value_num)).asc(),
        F.when(F.col(smallest), F.col(value_text)).asc(),
        F.when(~F.col(smallest), F.col(value_text)).desc(),
        *[F.col(c).asc() for c in then],
    ]
