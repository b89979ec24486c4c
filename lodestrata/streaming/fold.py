"""Structured Streaming forms: a stateful fold of the log, and incremental compaction with attached functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id string, last_log_offset long, live boolean, document string, embedding array<float>, metadata string"
STATE = "state string"
#: Below any sequence number.
NEVER = -(1 << 62)
#: Names of the fields of an operation: that it took place, document, embedding; metadata keys have a prefix.
_SEQ, _DOC, _EMB, _META = "s", "d", "e", "m:"


def new_state() -> dict[str, Any]:
    """State of a record without operations.

    ``dead`` is the last delete, kept as a tombstone against late changes; above it, ``starts`` has the sequence numbers of
    the upserts, ``adds`` the fields of each add, and ``upsert`` and ``update`` the last (sequence, value) of each field. Every
    part is a maximum or a set, so neither the order of operations nor repetitions matter, within a micro-batch or across them.
    """
    return {"dead": NEVER, "top": NEVER, "starts": [], "adds": {}, "upsert": {}, "update": {}}


def _keep(cells: dict[str, list], name: str, seq: int, value: str) -> None:
    held = cells.get(name)
    if held is None or (held[0], held[1]) < (seq, value):
        cells[name] = [seq, value]


def apply(state: dict[str, Any], row: Mapping[str, Any]) -> None:
    """Take one operation into a record's state; unknown operations and those at or below the tombstone change nothing."""
    op, seq = (row["op"] or "").lower(), int(row["log_offset"])
    if op not in ("add", "update", "upsert", "delete"):
        return
    state["top"] = max(state["top"], seq)
    if op == "delete":
        state["dead"] = max(state["dead"], seq)
    if op == "delete" or seq <= state["dead"]:
        return
    fields = {_SEQ: ""}
    if row["document"] is not None:
        fields[_DOC] = json.dumps(row["document"])
    if row["embedding"] is not None:
        fields[_EMB] = json.dumps([float(x) for x in row["embedding"]])
    if row["metadata"]:
        try:
            given = json.loads(row["metadata"])
        except ValueError:
            given = None
        if isinstance(given, dict):
            fields.update({_META + k: json.dumps(v) for k, v in given.items()})
    cells = state["adds"].setdefault(str(seq), {}) if op == "add" else state[op]
    for name, value in fields.items():
        _keep(cells, name, seq, value)
    if op == "upsert":
        state["starts"].append(seq)


def settle(state: dict[str, Any], late: int | None = None) -> None:
    """Drop what the tombstone covers; with ``late``, also what only a delete that comes more than so many sequence numbers
    late could bring back."""
    dead = state["dead"]
    starts = sorted({s for s in state["starts"] if s > dead})
    adds = {k: v for k, v in state["adds"].items() if int(k) > dead}
    if late is not None:
        first = min([*starts[:1], *map(int, adds)], default=None)
        floor = state["top"] - late
        starts = [s for s in starts if s >= floor or s == first]
        adds = {k: v for k, v in adds.items() if int(k) >= floor or int(k) == first}
    state["starts"], state["adds"] = starts, adds
    for op in ("upsert", "update"):
        state[op] = {n: c for n, c in state[op].items() if c[0] > dead}


def record(state: dict[str, Any]) -> dict[str, Any]:
    """The record that a settled state stands for: last_log_offset, live, document, embedding, metadata."""
    first = min([*state["starts"][:1], *map(int, state["adds"])], default=None)
    if first is None:
        return {"last_log_offset": None if state["dead"] == NEVER else state["dead"], "live": False, "document": None, "embedding": None, "metadata": {}}
    cells: dict[str, list] = {}
    for source in (state["adds"].get(str(first), {}), state["upsert"], {n: c for n, c in state["update"].items() if c[0] > first}):
        for name, (seq, value) in source.items():
            _keep(cells, name, seq, value)
    value = lambda name: json.loads(cells[name][1]) if name in cells else None
    meta = {n[len(_META) :]: value(n) for n in cells if n.startswith(_META)}
    return {"last_log_offset": cells[_SEQ][0], "live": True, "document": value(_DOC), "embedding": value(_EMB), "metadata": {k: v for k, v in meta.items() if v is not None}}


def fold_stream(log: DataFrame, late: int | None = None) -> DataFrame:
    """Updates of records (id, last_log_offset, live, document, embedding, metadata) as a streaming log comes in.

    Operations may come in any order and repeatedly, across micro-batches too: every update is the record that the batch fold
    makes of all operations up to then. The state of a record holds its last value of each field and, of each upsert since
    its last delete, the sequence number, as a late delete may make any of them the first; ``late``, if given, promises that
    no operation comes more than so many sequence numbers after a later one of its record, and bounds this. A micro-batch is
    taken in operation by operation, not gathered. Rows without id or log_offset have no effect. Output mode ``update``.
    """
    ops = log.filter("id is not null and log_offset is not null").select("id", "log_offset", "op", "document", "embedding", "metadata")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else new_state()
        for batch in batches:
            for row in zip(*(batch[c] for c in ("log_offset", "op", "document", "embedding", "metadata")), strict=True):
                apply(s, {c: None if isinstance(v, float) and pd.isna(v) else v for c, v in zip(("log_offset", "op", "document", "embedding", "metadata"), row, strict=True)})
            settle(s, late)
        state.update((json.dumps(s),))
        r = record(s)
        yield pd.DataFrame([{"id": key[0], **r, "metadata": json.dumps(r["metadata"], sort_keys=True)}])

    return ops.groupBy("id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def compact_stream(log: DataFrame, compact: Callable[[DataFrame, int], None], checkpoint: str, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Run ``compact(batch, epoch)`` over every micro-batch: with an idempotent function (one that skips folded offsets)
    each operation counts exactly once. ``trigger``: as of ``DataStreamWriter.trigger``; default: all there is, then stop."""
    return log.writeStream.foreachBatch(lambda df, epoch: compact(df, epoch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_stream(log: DataFrame) -> DataFrame:
    """Running number of operations by kind (output mode ``complete`` or ``update``)."""
    return log.groupBy(F.lower("op").alias("op")).agg(F.count(F.lit(1)).alias("n"))
