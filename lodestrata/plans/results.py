"""Results for people: small frames of one query each, and which collections to compact next."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import decode

#: Smallest backlog that is compacted, and most rows of one compaction.
LEAST_BACKLOG, MOST_ROWS = 10, 10_000


def to_frames(found: DataFrame) -> list[pd.DataFrame]:
    """One pandas frame per query of a query result, by rank; a get result is one frame. Metadata becomes plain values."""
    pdf = found.toPandas()
    if "metadata" in pdf:
        pdf["metadata"] = [None if m is None else {k: decode(v) for k, v in m.items()} for m in pdf["metadata"]]
    if "query_id" not in pdf:
        return [pdf]
    return [g.sort_values("rank", ignore_index=True) for _, g in pdf.groupby("query_id")]


def due(backlogs: DataFrame, slots: int, least: int = LEAST_BACKLOG, skip: Sequence[str] = ()) -> DataFrame:
    """The collections to compact next: of (collection, waiting, oldest) those with at least ``least`` operations waiting, the
    longest waiting first, at most ``slots``; collections in ``skip`` (being compacted) are left out."""
    open_ = backlogs.filter((F.col("waiting") >= least) & ~F.col("collection").isin(*skip)) if skip else backlogs.filter(F.col("waiting") >= least)
    return open_.orderBy(F.col("oldest").asc(), F.col("collection").asc()).limit(slots)
