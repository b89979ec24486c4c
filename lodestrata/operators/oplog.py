"""The operation log of a collection: partitions, read levels, the fold with internal offsets, and what it changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..plans.chunks import CHUNK, join_carry, range_chunks, row_numbers, running_carry
from ..plans.skew import fits
from .fold import fold_log, log_presence

INDEX_AND_WAL, INDEX_ONLY, BOUNDED_WAL = "index_and_wal", "index_only", "index_and_bounded_wal"
#: Rows of the log that a bounded read takes.
BOUND = 250


def fetch_log(log: DataFrame, after: int = 0, upto: int | None = None, most: int | None = None) -> DataFrame:
    """Log rows with ``after < log_offset <= upto``, at most ``most`` of the first; bounds reach the scan as pushed filters."""
    out = log.filter(F.col("log_offset") > after)
    out = out if upto is None else out.filter(F.col("log_offset") <= upto)
    return out if most is None else out.orderBy("log_offset").limit(most)


def read_level(log: DataFrame, level: str, folded_upto: int = 0, bound: int = BOUND) -> DataFrame:
    """The part of the log that a read of that level folds onto the segment."""
    if level == INDEX_ONLY:
        return log.limit(0)
    if level == BOUNDED_WAL:
        return fetch_log(log, folded_upto, folded_upto + bound)
    if level == INDEX_AND_WAL:
        return fetch_log(log, folded_upto)
    raise ValueError(f"unknown read level {level!r}")


def partition_key(id: Column, chunk_siblings: bool = False) -> Column:
    """Key that keeps all operations of a record together, and with ``chunk_siblings`` those of ``base-0``, ``base-1``, ..."""
    return F.regexp_replace(id, r"-\d+$", "") if chunk_siblings else id


def partition_log(log: DataFrame, partitions: int | None = None, chunk_siblings: bool = False, id: str = "id", most_rows: int | None = None) -> DataFrame:
    """The log with all operations of a record in one partition: of a number of partitions, or of as many as hold about
    ``most_rows`` rows each (a record with more stays whole)."""
    if (partitions is None) == (most_rows is None):
        raise ValueError("give either partitions or most_rows")
    partitions = max(1, -(-log.count() // most_rows)) if partitions is None else partitions
    return log.repartition(partitions, partition_key(F.col(id), chunk_siblings))


def shard_of(id: Column, shards: int) -> Column:
    """Shard of a record."""
    return F.pmod(F.xxhash64(id), F.lit(shards)).cast("int")


def touched(log: DataFrame, segment: DataFrame, how: str = "left_semi") -> DataFrame:
    """The segment's records that the log has operations on (``left_anti``: the others)."""
    ids = log.select(F.col("id").alias("_touched")).distinct()
    return segment.join(F.broadcast(ids) if fits(ids) else ids, F.col("id") == F.col("_touched"), how)


def _fold(log: DataFrame, segment: DataFrame) -> DataFrame:
    return fold_log(log.select("id", F.col("log_offset").alias("_seq"), F.col("op").alias("_op"), "document", "embedding", "metadata"), segment.select("id", "document", "embedding", "metadata"), ["id"])


def materialize(log: DataFrame, segment: DataFrame) -> DataFrame:
    """The touched records with their state after the log: id, offset_id, mat_op, last_log_offset, document, embedding, metadata.

    ``log``: id, log_offset (unique), op, document, embedding, metadata (JSON); ``segment``: id, offset_id, document,
    embedding, metadata (JSON). ``mat_op`` is add_new, overwrite_existing, update_existing or delete_existing; records that no
    operation took effect on, and records made and deleted within the log, are left out. A segment record keeps its offset
    id even if it is deleted and added again; every other appearance takes the next one, in log order.

    Appearances are found from the operation that sets presence before each one: within range chunks of (id, offset), with the
    last of the earlier chunks carried over, so no record's history has to fit a task.
    """
    log = log.withColumn("op", F.lower("op")).filter(F.col("op").isin("add", "update", "upsert", "delete") & F.col("id").isNotNull() & F.col("log_offset").isNotNull())
    held = touched(log, segment)
    base, state = held.select("id", "offset_id"), _fold(log, held)

    presence = log.filter("op <> 'update'").select("id", "log_offset", (F.col("op") == "delete").alias("_dead")).distinct()
    chunked = range_chunks(presence, ["id", "log_offset"])
    last = chunked.groupBy("id", CHUNK).agg(F.max_by("_dead", "log_offset").alias("_d"))
    carry = running_carry(last, ["id"], {"_carry": F.last("_d")})
    w = Window.partitionBy("id", CHUNK).orderBy("log_offset")
    before = join_carry(chunked.withColumn("_lag", F.lag("_dead").over(w)), carry, ["id"]).withColumn("_before", F.coalesce("_lag", "_carry"))
    new = before.filter(~F.col("_dead") & (F.coalesce("_before", F.lit(True)))).select("id", "log_offset").join(base.select("id"), "id", "left_anti")
    top = segment.agg(F.coalesce(F.max("offset_id"), F.lit(0)).alias("_top"))
    placed = row_numbers(range_chunks(new, ["log_offset"]), [], [F.col("log_offset").asc()], "_k").groupBy("id").agg(F.max("_k").alias("_k"))
    deleted = log.filter("op = 'delete'").select("id").distinct()

    alive = state.join(base, "id", "left").join(placed, "id", "left").join(deleted.withColumn("_deleted", F.lit(True)), "id", "left").crossJoin(F.broadcast(top))
    op = F.when(F.col("offset_id").isNull(), "add_new").when(F.col("_deleted"), "overwrite_existing").when(F.col("last_seq").isNotNull(), "update_existing")
    live = alive.select("id", F.coalesce("offset_id", F.col("_top") + F.col("_k")).alias("offset_id"), op.alias("mat_op"), F.col("last_seq").alias("last_log_offset"), "document", "embedding", "metadata").filter("mat_op is not null")
    gone = base.join(deleted, "id", "left_semi").join(state.select("id"), "id", "left_anti")
    none = lambda c: F.lit(None).cast(dict(live.dtypes)[c]).alias(c)
    return live.unionByName(gone.select("id", "offset_id", F.lit("delete_existing").alias("mat_op"), *map(none, ("last_log_offset", "document", "embedding", "metadata"))))


def segment_records(segment: DataFrame) -> DataFrame:
    """The records of a segment alone, as ``current_records`` gives them; nothing is folded."""
    return segment.select("id", "offset_id", "document", "embedding", F.coalesce(M.from_json(F.col("metadata")), F.create_map().cast(M.META)).alias("metadata"))


def segment_as_log(segment: DataFrame, shards: int | None = None, shard: int | None = None) -> DataFrame:
    """The records of a segment as log rows, from which an index or another segment can be built anew: an add each, with the
    offset id as its place; with ``shards``, by the shard of each record, of all shards or of ``shard`` only."""
    out = segment.select("id", F.col("offset_id").alias("log_offset"), F.lit("add").alias("op"), "document", "embedding", "metadata")
    if shards is None:
        return out
    out = out.withColumn("shard", shard_of(F.col("id"), shards))
    return out.repartition("shard") if shard is None else out.filter(F.col("shard") == shard)


def current_records(log: DataFrame, segment: DataFrame) -> DataFrame:
    """All live records after the log: id, offset_id, document, embedding, metadata (META map).

    Only what the log touches is folded. A record that is not in the segment yet has the segment's largest offset id plus
    the log offset that made it live: the order of the offset ids that ``materialize`` gives, without numbering anything.
    """
    seg = segment.select("id", "offset_id", "document", "embedding", "metadata")
    held = touched(log, seg)
    state = _fold(log, held).join(held.select("id", "offset_id"), "id", "left")
    top = seg.agg(F.coalesce(F.max("offset_id"), F.lit(0)).alias("_top"))
    place = F.coalesce("offset_id", F.col("_top") + F.col("first_seq")).alias("offset_id")
    new = state.crossJoin(F.broadcast(top)).select("id", place, "document", "embedding", M.from_json_values(F.col("metadata")).alias("metadata"))
    return segment_records(touched(log, seg, "left_anti")).unionByName(new)


def count_records(log: DataFrame, segment: DataFrame) -> DataFrame:
    """One row ``n``: live records over segment and log, from presence alone (no payload is read)."""
    slim = log.select("id", F.col("log_offset").alias("_seq"), F.lower("op").alias("_op")).filter(F.col("_op").isin("add", "upsert", "delete") & F.col("id").isNotNull())
    return log_presence(slim, segment.select("id"), ["id"]).filter("_live").agg(F.count(F.lit(1)).alias("n"))


def indexing_status(log: DataFrame, folded_upto: int) -> DataFrame:
    """One row: operations already folded and not yet, and the progress (1 for an empty log)."""
    n = log.agg(F.count(F.when(F.col("log_offset") <= folded_upto, 1)).alias("indexed_ops"), F.count(F.when(F.col("log_offset") > folded_upto, 1)).alias("unindexed_ops"))
    return n.withColumn("progress", F.coalesce(F.try_divide(F.col("indexed_ops").cast("double"), F.col("indexed_ops") + F.col("unindexed_ops")), F.lit(1.0)))


def delete_operations(ids: DataFrame, next_offset: int) -> DataFrame:
    """Log rows that delete the given ids, numbered from ``next_offset`` in id order."""
    n = row_numbers(range_chunks(ids.select("id").distinct(), ["id"]), [], [F.col("id").asc()], "_n")
    none: Sequence[tuple[str, str]] = (("document", "string"), ("embedding", "array<float>"), ("metadata", "string"))
    return n.select("id", (F.col("_n") + next_offset - 1).alias("log_offset"), F.lit("delete").alias("op"), *[F.lit(None).cast(t).alias(c) for c, t in none])
