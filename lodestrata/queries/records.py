"""Queries of problems 1, 2 and 7: intervals, change log, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import fold_log
from ..operators.intervals import periods_and_gaps
from ..operators.nested import NodeType, inside, node_table
from ..plans.skew import lookup
from ..sources.tables import table

#: Shape of a snapshot body.
SNAPSHOT_TYPES = {"snapshot": NodeType(lists={"fragments": "fragment", "snapshots": "pointer"}), "pointer": NodeType(objects={"snapshot": "snapshot"}), "fragment": NodeType()}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous periods and gaps of every log."""
    return periods_and_gaps(table(spark, sf, "manifest_spans"), ["log_id"], "start_offset", "limit_offset")


def live_records(spark: SparkSession, sf: str) -> DataFrame:
    """Live records of every collection, with last_seq, document, embedding and metadata.

    A shard without a row in scans has no bounds; null bounds count as none.
    """
    log = table(spark, sf, "oplog").select("collection_id", "shard_index", "record_id", F.col("log_offset").alias("_seq"), F.col("op").alias("_op"), F.col("doc_text").alias("document"), "embedding", "metadata")
    scans = table(spark, sf, "scans").groupBy("collection_id", "shard_index").agg(F.max("log_position").alias("_from"), F.max("log_upper_bound").alias("_to"))
    log = lookup(log.filter("record_id is not null"), scans, ["collection_id", "shard_index"], salt=F.col("_seq"))
    log = log.filter((F.col("_seq") > F.coalesce("_from", F.lit(0))) & ((F.coalesce("_to", F.lit(0)) == 0) | (F.col("_seq") <= F.col("_to"))))
    base = table(spark, sf, "segment_records").select("collection_id", "record_id", F.col("doc_text").alias("document"), "embedding", "metadata")
    return fold_log(log, base, ["collection_id", "record_id"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Live records with the offset of the last log row that took effect."""
    return live_records(spark, sf).select("collection_id", "record_id", F.coalesce("last_seq", F.lit(0).cast("long")).alias("last_log_offset"))


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """Live records with their document, embedding and metadata (``key=value`` lines, sorted by key)."""
    r = live_records(spark, sf)
    lines = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    vec = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")
    return r.select("collection_id", "record_id", F.col("document").alias("doc_text"), vec.alias("embedding_milli"), lines.alias("metadata_lines"))


def _snapshot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return node_table(table(spark, sf, "snapshot_files"), "snapshot_no", "body", "snapshot", SNAPSHOT_TYPES)


#: Columns by which nodes are linked.
LABEL = ("snapshot_no", "_doc_hash", "pre", "post", "level")


def _held(nodes: DataFrame, kind: str, holder: str, how: str = "inner") -> DataFrame:
    """Nodes of one kind with ``parent_pre``, the label of the node of kind ``holder`` that directly holds them."""
    holders = nodes.filter(F.col("node_type") == holder).select(*LABEL, F.col("pre").alias("parent_pre"))
    return inside(nodes.filter(F.col("node_type") == kind), holders, "snapshot_no", how)


def _attr(name: str):
    return F.get_json_object("attrs", f"$.{name}")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Who lists whom: every entry of a fragments or snapshots array with the path of the listing snapshot."""
    nodes = _snapshot_nodes(spark, sf)
    pointers = nodes.filter("node_type = 'pointer'").select(*LABEL, _attr("path_to_snapshot").alias("_hangs_under"))
    snapshots = nodes.filter("node_type = 'snapshot'").select(*LABEL, _attr("path").alias("_path"))
    listing = inside(snapshots, pointers, "snapshot_no", "left").select(*LABEL, F.coalesce("_path", "_hangs_under").alias("parent_path"))
    child_path = F.coalesce(F.when(F.col("node_type") == "fragment", _attr("path")).otherwise(_attr("path_to_snapshot")), F.lit(""))
    entries = nodes.filter("node_type <> 'snapshot'").select(*LABEL, "field", "pos", child_path.alias("child_path"))
    found = inside(entries, listing, "snapshot_no")
    return found.select("snapshot_no", "parent_path", F.col("field").alias("child_array"), F.col("pos").alias("child_pos"), "child_path").distinct()


def p7_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of fragments, with the label of the snapshot that lists them."""
    n = _held(_snapshot_nodes(spark, sf), "fragment", "snapshot")
    longs = {"start_offset": "start.offset", "limit_offset": "limit.offset", "num_bytes": "num_bytes", "seq_no": "seq_no"}
    return n.select("snapshot_no", "pre", "post", "parent_pre", "pos", _attr("path").alias("path"), *[_attr(p).try_cast("long").alias(c) for c, p in longs.items()], _attr("fragment_id.uuid").alias("fragment_uuid"), _attr("setsum").alias("setsum"))


def p7_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of pointers to snapshots."""
    n = _held(_snapshot_nodes(spark, sf), "pointer", "snapshot")
    longs = {"start_offset": "start.offset", "limit_offset": "limit.offset", "num_bytes": "num_bytes", "depth": "depth"}
    return n.select("snapshot_no", "pre", "post", "parent_pre", "pos", _attr("path_to_snapshot").alias("path_to_snapshot"), *[_attr(p).try_cast("long").alias(c) for c, p in longs.items()], _attr("setsum").alias("setsum"))


def p7_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of snapshots, at any depth."""
    n = _held(_snapshot_nodes(spark, sf), "snapshot", "pointer", "left")
    return n.select("snapshot_no", "pre", "post", "parent_pre", "level", _attr("path").alias("path"), _attr("depth").try_cast("long").alias("depth"), _attr("setsum").alias("setsum"), _attr("writer").alias("writer"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_records, p7_found, p7_fragments, p7_pointers, p7_snapshots)}

ROWS = """
    bounded AS (SELECT DISTINCT o.collection_id, o.record_id, o.log_offset AS seq, lower(o.op) AS op, o.doc_text, o.embedding, o.metadata
      FROM oplog o LEFT JOIN scans s ON o.collection_id = s.collection_id AND o.shard_index = s.shard_index
      WHERE o.record_id IS NOT NULL AND lower(o.op) IN ('add', 'update', 'upsert', 'delete') AND o.log_offset > coalesce(s.log_position, 0)
        AND (coalesce(s.log_upper_bound, 0) = 0 OR o.log_offset <= s.log_upper_bound)),
    every AS (SELECT * FROM bounded UNION ALL SELECT collection_id, record_id, 0, 'base', doc_text, embedding, metadata FROM segment_records),
    dead AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER k AS d FROM every WINDOW k AS (PARTITION BY collection_id, record_id)),
    after AS (SELECT * FROM dead WHERE op <> 'delete' AND (d IS NULL OR seq > d)),
    gen AS (SELECT *, min(CASE WHEN op <> 'update' THEN seq END) OVER k AS g FROM after WINDOW k AS (PARTITION BY collection_id, record_id)),
    eff AS (SELECT * FROM gen WHERE g IS NOT NULL AND (seq = g OR seq > g AND op IN ('update', 'upsert')))
"""

# Nodes by their place (field and position at every step); the labels follow from the order of the places and the nodes below.
_NODES = """
    files AS (SELECT DISTINCT snapshot_no, body FROM snapshot_files WHERE body <> '' AND json_valid(body)),
    docs AS (SELECT row_number() OVER () AS d, snapshot_no, body::JSON AS b FROM files),
    node AS (SELECT d, snapshot_no, 'snapshot' AS kind, []::INTEGER[] AS place, NULL::INTEGER AS pos, b AS e FROM docs WHERE json_type(b) = 'OBJECT'
      UNION ALL
      SELECT d, snapshot_no, kind, list_concat(place, [f, i::INTEGER - 1]), CASE WHEN kind <> 'snapshot' THEN i::INTEGER - 1 END, es[i]
      FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i
        FROM (SELECT n.d, n.snapshot_no, v.kind, n.place, v.f, CASE json_type(e, '$.' || name) WHEN 'ARRAY' THEN CASE WHEN v.kind <> 'snapshot' THEN (e->name)::JSON[] END WHEN 'OBJECT' THEN [e->name] END AS es
          FROM node n JOIN (VALUES ('fragment', 'fragments', 0, 'snapshot'), ('pointer', 'snapshots', 1, 'snapshot'), ('snapshot', 'snapshot', 0, 'pointer')) v(kind, name, f, above) ON n.kind = v.above))),
    below AS (SELECT d, place[1 : 2 * k] AS place, count(*) AS size FROM (SELECT d, place, unnest(range(0, len(place) // 2 + 1)) AS k FROM node) GROUP BY ALL),
    label AS (SELECT n.*, 2 * (row_number() OVER (PARTITION BY n.d ORDER BY n.place) - 1) - len(n.place) // 2 AS pre, len(n.place) // 2 AS level, b.size FROM node n JOIN below b ON n.d = b.d AND n.place = b.place),
    held AS (SELECT c.snapshot_no, c.kind, c.pre, c.pre + 2 * c.size - 1 AS post, p.pre AS parent_pre, c.level, c.pos, c.e FROM label c LEFT JOIN label p ON c.d = p.d AND len(c.place) > 0 AND p.place = c.place[1 : len(c.place) - 2])
"""

SQL = {
    "p1_found": """
    WITH s AS (SELECT log_id, start_offset AS a, max(limit_offset) AS b FROM manifest_spans WHERE start_offset < limit_offset GROUP BY ALL),
      p AS (SELECT *, max(b) OVER (PARTITION BY log_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
      i AS (SELECT *, sum(CASE WHEN prev IS NULL OR a > prev THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY a) AS island FROM p)
    SELECT log_id, 'period' AS piece, min(a) AS start_offset, max(b) AS limit_offset FROM i GROUP BY log_id, island
    UNION ALL SELECT log_id, 'gap', prev, a FROM p WHERE a > prev
    """,
    "p2_found": f"WITH {ROWS} SELECT collection_id, record_id, max(seq) AS last_log_offset FROM eff GROUP BY ALL",
    "p2_records": f"""
    WITH {ROWS},
      body AS (SELECT collection_id, record_id, arg_max(doc_text, seq) FILTER (doc_text IS NOT NULL) AS doc_text,
          arg_max(embedding, seq) FILTER (embedding IS NOT NULL) AS embedding FROM eff GROUP BY ALL),
      entry AS (SELECT collection_id, record_id, seq, unnest(json_keys(metadata)) AS k, metadata FROM eff WHERE metadata IS NOT NULL),
      merged AS (SELECT collection_id, record_id, k, arg_max(json_extract(metadata, '$."' || k || '"'), seq) AS v FROM entry GROUP BY ALL),
      lines AS (SELECT collection_id, record_id, string_agg(k || '=' || v::VARCHAR, chr(10) ORDER BY k) AS m FROM merged WHERE v::VARCHAR <> 'null' GROUP BY ALL)
    SELECT b.collection_id, b.record_id, doc_text,
      list_reduce(list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT::VARCHAR), lambda x, y: x || ',' || y) AS embedding_milli, coalesce(m, '') AS metadata_lines
    FROM body b LEFT JOIN lines l ON b.collection_id = l.collection_id AND b.record_id = l.record_id
    """,
    "p7_found": """
    WITH RECURSIVE files AS (SELECT DISTINCT snapshot_no, body::JSON AS b FROM snapshot_files WHERE body <> '' AND json_valid(body)),
      snap AS (SELECT snapshot_no, b, b->>'path' AS path FROM files WHERE json_type(b) = 'OBJECT'
        UNION ALL
        SELECT snapshot_no, e->'snapshot', coalesce(e->'snapshot'->>'path', e->>'path_to_snapshot')
        FROM (SELECT snapshot_no, unnest(CASE json_type(b, '$.snapshots') WHEN 'ARRAY' THEN (b->'snapshots')::JSON[] WHEN 'OBJECT' THEN [b->'snapshots'] END) AS e FROM snap)
        WHERE json_type(e, '$.snapshot') = 'OBJECT'),
      lists AS (SELECT snapshot_no, path, f, CASE json_type(b, '$.' || f) WHEN 'ARRAY' THEN (b->f)::JSON[] WHEN 'OBJECT' THEN [b->f] END AS es
        FROM snap, (VALUES ('fragments'), ('snapshots')) v(f)),
      one AS (SELECT snapshot_no, path, f, generate_subscripts(es, 1) - 1 AS pos, unnest(es) AS e FROM lists)
    SELECT DISTINCT snapshot_no, path AS parent_path, f AS child_array, pos::INTEGER AS child_pos,
      coalesce(CASE f WHEN 'fragments' THEN e->>'path' ELSE e->>'path_to_snapshot' END, '') AS child_path FROM one
    """,
    "p7_fragments": f"""
    WITH RECURSIVE {_NODES}
    SELECT snapshot_no, pre, post, parent_pre, pos, e->>'path' AS path, try_cast(e->'start'->>'offset' AS BIGINT) AS start_offset, try_cast(e->'limit'->>'offset' AS BIGINT) AS limit_offset,
      try_cast(e->>'num_bytes' AS BIGINT) AS num_bytes, try_cast(e->>'seq_no' AS BIGINT) AS seq_no, e->'fragment_id'->>'uuid' AS fragment_uuid, e->>'setsum' AS setsum FROM held WHERE kind = 'fragment'
    """,
    "p7_pointers": f"""
    WITH RECURSIVE {_NODES}
    SELECT snapshot_no, pre, post, parent_pre, pos, e->>'path_to_snapshot' AS path_to_snapshot, try_cast(e->'start'->>'offset' AS BIGINT) AS start_offset,
      try_cast(e->'limit'->>'offset' AS BIGINT) AS limit_offset, try_cast(e->>'num_bytes' AS BIGINT) AS num_bytes, try_cast(e->>'depth' AS BIGINT) AS depth, e->>'setsum' AS setsum FROM held WHERE kind = 'pointer'
    """,
    "p7_snapshots": f"""
    WITH RECURSIVE {_NODES}
    SELECT snapshot_no, pre, post, parent_pre, level, e->>'path' AS path, try_cast(e->>'depth' AS BIGINT) AS depth, e->>'setsum' AS setsum, e->>'writer' AS writer FROM held WHERE kind = 'snapshot'
    """,
}
