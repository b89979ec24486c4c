"""Fold of a change log (add, update, upsert, delete) onto base rows, by commutative aggregates.

No step sorts or collects the operations of a key. What decides a record's state are maxima and minima of structs led by the
sequence number, so late, repeated and shuffled rows, partial aggregation and hot keys are all harmless:

1. per key, the last delete (its *tombstone*, kept against late changes) and the last operation that sets presence; the key
   is live if that is not a delete;
2. per key and field, over the rows above the tombstone: the first starter (base row, add or upsert), the last upsert and the
   last update that carry the field. An add counts only as the starter, an update only above it, an upsert always.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import checkpointed
from ..plans.skew import HEAVY_ROWS, HEAVY_SHARE

#: Sequence number of base rows: below any of the log.
BASE = -(1 << 62)
_SEQ, _DOC, _EMB, _META = "s", "d", "e", "m"


def json_entries(metadata: Column) -> Column:
    """Entries (key, value as JSON text or null) of a JSON object; null for null and for what is no object."""
    parsed = F.map_entries(F.from_json(metadata, "map<string,variant>"))
    return F.transform(parsed, lambda e: F.struct(e["key"].alias("key"), F.nullif(F.to_json(e["value"]), F.lit("null")).alias("value")))


def log_presence(log: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key (keys, _dead, _live, _n): last delete, whether the key is live at the end, number of rows."""
    rows = log.select(*keys, "_seq", "_op").unionByName(base.select(*keys, F.lit(BASE).alias("_seq"), F.lit("base").alias("_op")))
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_op") == "delete", F.col("_seq"))).alias("_dead"),
        F.max(F.when(F.col("_op") != "update", F.struct("_seq", (F.col("_op") != "delete").alias("live")))).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    ).withColumn("_live", F.coalesce("_last.live", F.lit(False))).drop("_last")


def fold_log(log: DataFrame, base: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Live records (keys, last_seq, first_seq, document, embedding, metadata) after ``log`` is applied to ``base``.

    ``log``: keys, ``_seq`` (long), ``_op``, ``document``, ``embedding``, ``metadata`` (JSON object; null values delete the
    key); ``base``: keys, document, embedding, metadata. ``_op`` ignores case; other operations than the four and rows
    without ``_seq`` or without the last of the keys have no effect. Null document, embedding or metadata provide nothing;
    unreadable metadata neither. Rows repeated with the same sequence number count once; should they differ, the larger
    payload wins per field. ``last_seq`` is null where no log row took effect, ``first_seq`` (the
    operation that made the record live) where it has been live since the base. Result metadata is a map of JSON texts.
    """
    keys = list(keys)
    log = log.select(*keys, F.col("_seq").cast("long").alias("_seq"), F.lower("_op").alias("_op"), "document", "embedding", "metadata")
    log = log.filter(F.col("_op").isin("add", "update", "upsert", "delete") & F.col("_seq").isNotNull() & F.col(keys[-1]).isNotNull())
    base = base.select(*keys, "document", "embedding", "metadata").filter(F.col(keys[-1]).isNotNull())

    # One struct as key: in it a null equals a null, so a plain equi-join on it hashes rows just as the aggregates need.
    log, base = (x.select(F.struct(*keys).alias("_key"), *[c for c in x.columns if c not in keys]) for x in (log, base))
    alive = checkpointed(log_presence(log, base, ["_key"]).filter("_live").select("_key", "_dead", "_n"))
    rows = log.filter("_op <> 'delete'").unionByName(base.withColumns({"_seq": F.lit(BASE), "_op": F.lit("base")}))
    total, largest = alive.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    most = max(heavy_rows, int(total * HEAVY_SHARE))
    heavy = alive.filter(F.col("_n") > most)  # at most 1 / HEAVY_SHARE keys
    above = F.col("_dead").isNull() | (F.col("_seq") > F.col("_dead"))
    if largest <= most:
        done = _states(rows.join(alive.drop("_n"), "_key").filter(above))
    else:
        listed = F.broadcast(heavy.drop("_n"))
        light = rows.join(listed.select("_key"), "_key", "left_anti").join(alive.filter(F.col("_n") <= most).drop("_n"), "_key")
        done = _states(light.filter(above)).unionByName(_states(rows.join(listed, "_key").filter(above)))
    return done.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *[c for c in done.columns if c != "_key"])


def _states(rows: DataFrame) -> DataFrame:
    """Records of the rows above each key's tombstone (step 2). Rows that a join has hashed by key are not shuffled again;
    those of heavy keys come unshuffled and are combined per partition first."""
    no_text, no_vec = F.lit(None).cast("string"), F.lit(None).cast("array<float>")

    def item(kind: str, text: Column = no_text, vec: Column = no_vec, name: Column = F.lit("")) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), text.alias("text"), vec.alias("vec"))

    none = F.array().cast("array<struct<kind:string,name:string,text:string,vec:array<float>>>")
    items = F.concat(
        F.array(item(_SEQ)),
        F.when(F.col("document").isNotNull(), F.array(item(_DOC, F.col("document")))).otherwise(none),
        F.when(F.col("embedding").isNotNull(), F.array(item(_EMB, vec=F.col("embedding").cast("array<float>")))).otherwise(none),
        F.coalesce(F.transform(json_entries(F.col("metadata")), lambda e: item(_META, e["value"], name=e["key"])), none),
    )
    cell = F.struct("_seq", "_i.text", "_i.vec")
    fields = (
        rows.select("_key", "_seq", "_op", F.explode(items).alias("_i"))
        .groupBy("_key", "_i.kind", "_i.name")
        .agg(
            F.min(F.when(F.col("_op").isin("base", "add", "upsert"), cell)).alias("_start"),
            F.max(F.when(F.col("_op") == "upsert", cell)).alias("_upsert"),
            F.max(F.when(F.col("_op") == "update", cell)).alias("_update"),
        )
    )
    records = fields.groupBy("_key").agg(
        F.max(F.when(F.col("kind") == _SEQ, F.col("_start._seq"))).alias("_g"),
        F.collect_list(F.struct("kind", "name", "_start", "_upsert", "_update")).alias("_fields"),
    )

    def latest(f: Column) -> Column:
        starts = F.when(f["_start"]["_seq"] == F.col("_g"), f["_start"])
        later = F.when(f["_update"]["_seq"] > F.col("_g"), f["_update"])
        return F.struct(f["kind"].alias("kind"), f["name"].alias("name"), F.array_max(F.array(starts, f["_upsert"], later)).alias("v"))

    records = records.withColumn("_fields", F.transform("_fields", latest))
    one = lambda kind: F.get(F.filter("_fields", lambda f: f["kind"] == kind), F.lit(0))["v"]
    kept = F.filter("_fields", lambda f: (f["kind"] == _META) & f["v"]["text"].isNotNull())
    return records.select(
        "_key",
        F.nullif(one(_SEQ)["_seq"], F.lit(BASE)).alias("last_seq"),
        F.nullif(F.col("_g"), F.lit(BASE)).alias("first_seq"),
        one(_DOC)["text"].alias("document"),
        one(_EMB)["vec"].alias("embedding"),
        F.map_from_entries(F.array_sort(F.transform(kept, lambda f: F.struct(f["name"].alias("key"), f["v"]["text"].alias("value"))))).alias("metadata"),
    )
