"""Functions over a collection's changes: each takes its earlier output and a batch of changes and gives the new output.

Changes are rows (id, mat_op, old metadata, new metadata) as ``operators.oplog.materialize`` and the segment give them; earlier
outputs are small tables, so applying batch after batch equals one run over everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import range_chunks, row_numbers
from . import metadata as M

SUMMARY, TOTAL = "summary", "total_count"
#: Most keys of a statistics request.
MOST_KEYS = 30

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Make a function known under a name, so that it can be attached to a collection."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _REGISTRY[name] = f
        return f

    return add


def registered(name: str) -> Callable[..., DataFrame]:
    """The function of that name."""
    if name not in _REGISTRY:
        raise KeyError(f"no function {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def changes(materialized: DataFrame, segment: DataFrame) -> DataFrame:
    """(id, mat_op, old, new) of the touched records; ``old`` and ``new`` are META maps."""
    before = segment.select("id", M.from_json(F.col("metadata")).alias("old"))
    after = materialized.select("id", "mat_op", M.from_json_values(F.col("metadata")).alias("new"))
    return after.join(before, "id", "left").select("id", "mat_op", "old", F.when(F.col("mat_op") != "delete_existing", F.col("new")).alias("new"))


@register("record_counter")
def record_counter(changed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row ``total_count``: the count before plus new records minus deleted ones."""
    step = F.when(F.col("mat_op") == "add_new", 1).when(F.col("mat_op") == "delete_existing", -1).otherwise(0)
    now = changed.agg(F.coalesce(F.sum(step), F.lit(0)).cast("long").alias("total_count"))
    return now if before is None else now.unionByName(before.select("total_count")).agg(F.sum("total_count").alias("total_count"))


def value_rows(m: Column) -> Column:
    """Array of (key, type, value, value_label) of every value of a META map; arrays and sparse vectors give one each."""
    row = lambda k, t, v, label=None: F.struct(k.alias("key"), F.lit(t).alias("type"), v.cast("string").alias("value"), (F.lit(None) if label is None else label).cast("string").alias("value_label"))

    def one(k: Column, v: Column) -> Column:
        each = lambda f, t: F.transform(v[f], lambda x: row(k, t, x))
        sparse = F.transform(v["sv"]["indices"], lambda x, i: row(k, "sparse", x, F.get(v["sv"]["tokens"], i)))
        out = F.when(v["t"] == M.BOOL, F.array(row(k, "bool", v["b"]))).when(v["t"] == M.INT, F.array(row(k, "int", v["i"])))
        out = out.when(v["t"] == M.FLOAT, F.array(row(k, "float", v["f"]))).when(v["t"] == M.STR, F.array(row(k, "str", v["s"])))
        out = out.when(v["t"] == M.SPARSE_T, sparse).when(v["t"] == M.BOOLS, each("ba", "bool")).when(v["t"] == M.INTS, each("ia", "int"))
        return out.when(v["t"] == M.FLOATS, each("fa", "float")).when(v["t"] == M.STRS, each("sa", "str"))

    return F.flatten(F.transform(F.map_entries(m), lambda e: F.coalesce(one(e["key"], e["value"]), F.array().cast("array<struct<key:string,type:string,value:string,value_label:string>>"))))


@register("statistics")
def statistics(changed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(key, type, value, value_label, count): how many records hold each typed value, plus the total under ``summary``.

    Deleted records and replaced values count down; values that no record holds any more are left out, the total stays.
    Counts are summed per partition before the shuffle.
    """
    down = F.when((F.col("mat_op") != "add_new") & F.col("old").isNotNull(), F.transform(value_rows(F.col("old")), lambda r: F.struct(r.alias("r"), F.lit(-1).alias("n"))))
    up = F.when(F.col("new").isNotNull(), F.transform(value_rows(F.col("new")), lambda r: F.struct(r.alias("r"), F.lit(1).alias("n"))))
    total = F.when(F.col("mat_op") == "add_new", 1).when(F.col("mat_op") == "delete_existing", -1)
    name = lambda v: F.lit(v).cast("string")
    summary = F.when(total.isNotNull(), F.array(F.struct(F.struct(name(SUMMARY).alias("key"), name("str").alias("type"), name(TOTAL).alias("value"), name(None).alias("value_label")).alias("r"), total.alias("n"))))
    empty = F.array().cast("array<struct<r:struct<key:string,type:string,value:string,value_label:string>,n:int>>")
    rows = changed.select(F.explode(F.concat(F.coalesce(down, empty), F.coalesce(up, empty), F.coalesce(summary, empty))).alias("_x")).select("_x.r.*", F.col("_x.n").cast("long").alias("count"))
    if before is not None:
        rows = rows.unionByName(before.select("key", "type", "value", "value_label", "count"))
    out = rows.groupBy("key", "type", "value", "value_label").agg(F.sum("count").alias("count"))
    return out.filter((F.col("count") != 0) | (F.col("key") == SUMMARY))


def read_statistics(stats: DataFrame, keys: str | Sequence[str] | None = None) -> dict[str, Any]:
    """{"statistics": {key: {value: {"count": n}}}, "summary": {"total_count": n}}; a label stands in for its value."""
    keys = [keys] if isinstance(keys, str) else keys
    if keys is not None and len(keys) > MOST_KEYS:
        raise ValueError(f"at most {MOST_KEYS} keys")
    rows = stats if keys is None else stats.filter(F.col("key").isin(*keys, SUMMARY))
    out: dict[str, Any] = {"statistics": {}}
    for r in rows.toLocalIterator():
        if r["key"] == SUMMARY:
            out["summary"] = {TOTAL: r["count"]}
        else:
            out["statistics"].setdefault(r["key"], {})[r["value"] if r["value_label"] is None else r["value_label"]] = {"count": r["count"]}
    return out


def _versions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Versions of writes in (id, log_offset) order; ``shift`` is source version minus version in the current generation."""
    id, top, shift = None, 0, None
    for b in batches:
        out: list[tuple] = []
        for row in b.itertuples(index=False):
            if row.id != id:
                id, top, shift = row.id, int(row.top), None if pd.isna(row.start) else int(row.start)
            given = None if pd.isna(row.source_version) else int(row.source_version)
            if given is None:
                version = top + 1
            else:
                if shift is None or given < top + shift:
                    shift = given - top - 1
                version = given - shift
            if version > top:
                out.append((id, version, given, row.is_delete, row.document))
                top = version
        yield pd.DataFrame(out, columns=["id", "version", "source_version", "is_delete", "document"]).astype({"version": "int64", "source_version": "Int64"})


@register("revision_history")
def revision_history(log: DataFrame, before: DataFrame | None = None, version_key: str | None = None) -> DataFrame:
    """(id, original_id, version, source_version, is_delete, document): one row per effective write of each record.

    ``log``: id, log_offset, op, document, source_version (or null); deletes are kept as tombstones. Versions count from 1
    per record in log order, after those of ``before``. Where writes bring an own version number it is mapped linearly from
    the start of its generation: a smaller number than expected begins a new generation (the record was made anew), a number
    that is already kept is skipped, so folding the same rows again changes nothing. Ids are ``original::v<version>``.
    """
    ops = log.filter(F.lower("op").isin("add", "update", "upsert", "delete") & F.col("id").isNotNull())
    rows = ops.select("id", "log_offset", (F.lower("op") == "delete").alias("is_delete"), "document", (F.col("source_version") if version_key or "source_version" in log.columns else F.lit(None)).cast("long").alias("source_version"))
    rows = rows.withColumn("source_version", F.when(~F.col("is_delete"), F.col("source_version"))).dropDuplicates(["id", "log_offset"])
    last = None if before is None else before.groupBy("original_id").agg(F.max("version").alias("_max"), F.max_by(F.struct("version", "source_version"), F.when(F.col("source_version").isNotNull(), F.col("version"))).alias("_last"))
    rows = rows.withColumns({"_max": F.lit(0).cast("long"), "_start": F.lit(None).cast("long")}) if last is None else rows.join(last.select(F.col("original_id").alias("id"), "_max", F.when(F.col("_last.source_version").isNotNull(), F.col("_last.source_version") - F.col("_last.version")).alias("_start")), "id", "left").withColumn("_max", F.coalesce("_max", F.lit(0).cast("long")))

    if version_key is None and "source_version" not in log.columns:
        n = row_numbers(range_chunks(rows, ["id", "log_offset"]), ["id"], [F.col("log_offset").asc()], "_n")
        new = n.select("id", (F.col("_n") + F.col("_max")).alias("version"), F.lit(None).cast("long").alias("source_version"), "is_delete", "document")
    else:
        # Each record's writes go by in order; what is kept of them is the last version and its generation.
        ordered = rows.select("id", "log_offset", "source_version", "is_delete", "document", F.col("_max").alias("top"), F.col("_start").alias("start")).repartition("id").sortWithinPartitions("id", "log_offset")
        new = ordered.mapInPandas(_versions, "id string, version long, source_version long, is_delete boolean, document string")
    new = new.select(F.concat("id", F.lit("::v"), F.col("version")).alias("id"), F.col("id").alias("original_id"), "version", "source_version", "is_delete", "document")
    return new if before is None else before.unionByName(new)


@register("count_to_file")
def count_to_file(changed: DataFrame, before: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """As ``record_counter``; with ``path`` the count is also written there as a one-line text file folder."""
    out = record_counter(changed, before)
    if path:
        out.select(F.col("total_count").cast("string")).coalesce(1).write.mode("overwrite").text(path)
    return out


@register("no_op")
def no_op(changed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Nothing of the changes."""
    return changed.limit(0) if before is None else before
