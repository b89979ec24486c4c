"""Overlapping, nested and gapped intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import CHUNK, join_carry, range_chunks, running_carry


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, limit: str) -> DataFrame:
    """Rows (keys, piece, start, limit): ``period`` for each longest continuous range, ``gap`` for each hole between two.

    Intervals are half-open; touching ones are continuous. Rows with a null bound or ``start >= limit`` cover nothing;
    an entity with only such rows gives no row. A null key is an entity of its own. Repeated rows, ties and further
    columns change nothing; an empty table gives an empty result.

    Sorted by start, a row opens an island when its start lies above the running maximum of the earlier ends; the island's
    label is its first start, carried forward. The rows are range-partitioned by (keys, start), so that an entity of any
    size spreads over many tasks; the running maximum and the last label of the earlier chunks come from carry tables of
    at most one row per chunk.
    """
    keys = list(keys)
    spans = df.filter(F.col(start) < F.col(limit)).groupBy(*keys, F.col(start).alias("_s")).agg(F.max(limit).alias("_e"))
    chunked = range_chunks(spans, [*keys, "_s"])

    ends = running_carry(chunked.groupBy(*keys, CHUNK).agg(F.max("_e").alias("_m")), keys, {"_carry_end": F.max("_m")})
    w = Window.partitionBy(*keys, CHUNK).orderBy("_s")
    seen = chunked.withColumn("_local_end", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seen = join_carry(seen, ends, keys).withColumn("_prev", F.greatest("_local_end", "_carry_end"))
    opens = F.col("_prev").isNull() | (F.col("_s") > F.col("_prev"))
    seen = seen.withColumn("_opens", opens).withColumn("_label", F.max(F.when(F.col("_opens"), F.col("_s"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    labels = running_carry(seen.groupBy(*keys, CHUNK).agg(F.max("_label").alias("_m")), keys, {"_carry_label": F.max("_m")})
    islands = (
        join_carry(seen, labels, keys)
        .withColumn("_label", F.coalesce("_label", "_carry_label"))
        .groupBy(*keys, "_label")
        .agg(F.max("_e").alias("_end"), F.max(F.when(F.col("_opens"), F.col("_prev"))).alias("_gap_from"))
    )
    pieces = F.array(
        F.struct(F.lit("period").alias("piece"), F.col("_label").alias(start), F.col("_end").alias(limit)),
        F.struct(F.lit("gap").alias("piece"), F.col("_gap_from").alias(start), F.col("_label").alias(limit)),
    )
    return islands.select(*keys, F.explode(pieces).alias("_p")).select(*keys, "_p.*").filter(F.col(start).isNotNull())
