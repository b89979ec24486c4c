"""Compaction of the collections of a database in the background: which are due, and a loop that works them off."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .collection import Collection
from .plans.results import LEAST_BACKLOG, MOST_ROWS, due
from .sources.catalog import DEFAULT_DATABASE, DEFAULT_TENANT, Catalog, Conflict

#: Seconds between two rounds, and compactions of a round.
PAUSE, SLOTS = 10.0, 8


def backlogs(catalog: Catalog, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> DataFrame:
    """(collection, waiting, oldest): operations of each collection that are not folded, and minus the seconds that they wait."""
    rows = []
    for v in catalog.list_collections(tenant=tenant, database=database):
        oldest = max((catalog.store.age(*n.split("/")) for n in v.logs), default=0.0)
        rows.append((v.name, v.log_end - v.log_position, -oldest))
    return catalog.spark.createDataFrame(rows, "collection string, waiting long, oldest double")


def compact_due(catalog: Catalog, slots: int = SLOTS, least: int = LEAST_BACKLOG, most_rows: int = MOST_ROWS, skip: Sequence[str] = (), tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> list[str]:
    """Compact the collections that wait longest, at most ``slots``, each by at most ``most_rows`` operations; gives their names.

    A collection that another writer changes meanwhile is left for the next round.
    """
    done = []
    for r in due(backlogs(catalog, tenant, database), slots, least, skip).collect():  # at most ``slots``
        try:
            Collection(catalog, catalog.get_collection(r["collection"], tenant, database)).compact(most_rows)
        except Conflict:
            continue
        done.append(r["collection"])
    return done


def run(catalog: Catalog, rounds: int | None = None, pause: float = PAUSE, **how) -> int:
    """``compact_due`` round after round, without end or ``rounds`` times; gives the number of compactions."""
    n = count = 0
    while rounds is None or n < rounds:
        count += len(compact_due(catalog, **how))
        n += 1
        if rounds is None or n < rounds:
            time.sleep(pause)
    return count
