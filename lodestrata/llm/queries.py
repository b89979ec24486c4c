"""Queries of the problems of training-data pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .encoding import repairs
from .hits import first_wanted, grouped_top_k
from .mix import mix_sources
from .neighbours import nearest_pairs
from .split import BOUNDARY, LIMIT, OVERLAP, split_corpus
from .tokens import decode_corpus, encode_corpus


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Hits kept by the group-by of each search."""
    return grouped_top_k(table(spark, sf, "search_hits"), table(spark, sf, "searches")).select("search_id", "offset_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of vectors of which one is among the other's five nearest."""
    return nearest_pairs(table(spark, sf, "record_vectors"), table(spark, sf, "collections"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """First wanted records of each search by all four leaves."""
    return first_wanted(table(spark, sf, "search_hits"), table(spark, sf, "searches")).select("search_id", "offset_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that are split, and whether a stretch had to be cut by force."""
    return split_corpus(table(spark, sf, "documents"), "doc_id", "text").filter("piece = 1").select("doc_id", "forced").distinct()


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of the split texts."""
    return split_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p6_whole(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each split text come to: the text put together again, and cuts, overlaps and lengths as they must be."""
    pieces = split_corpus(table(spark, sf, "documents"), "doc_id", "text").repartition("doc_id")
    before = Window.partitionBy("doc_id").orderBy("piece")
    p = pieces.withColumn("_shared", F.coalesce(F.lag("end").over(before) - F.col("start"), F.lit(0)))
    p = p.withColumn("_new", F.expr("substring(body, _shared + 1)")).withColumn("_last", F.expr("substring(lag(body) over (partition by doc_id order by piece), -1)"))
    natural = F.col("_last").isNull() | (F.col("cut") == "forced") | F.instr(F.lit(BOUNDARY), F.col("_last")).cast("boolean")
    alike = F.col("piece").eqNullSafe(0) | (F.col("_shared") == OVERLAP)
    return p.groupBy("doc_id").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "_new"))), lambda s: s["_new"]), "")).alias("text_md5"),
        F.max("forced").alias("forced"),
        (F.max(F.length("body")) <= LIMIT).alias("within_limit"),
        F.every(alike).alias("overlaps"),
        F.every(natural).alias("natural_cuts"),
    )


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every text."""
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts decoded from their ids: as the originals, and empty for null."""
    return decode_corpus(encode_corpus(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "ids")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the mix with how often each is used."""
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "doc_id", "text")[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached and shortfalls of the mix."""
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), "doc_id", "text")[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with text read in a wrong encoding."""
    return p10_repairs(spark, sf).select("doc_id").distinct()


def p10_repairs(spark: SparkSession, sf: str) -> DataFrame:
    """The garbled spans of these documents, and their restored texts."""
    return repairs(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.size("spans").alias("n_spans"), "spans", "restored")


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p5_found, p6_found, p6_pieces, p6_whole, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_repairs)}

_FIELD = "CASE {key} " + " ".join(f"WHEN '{'#score' if c == 'score' else c}' THEN {c}::DOUBLE" for c in ("score", "pub_year", "priority", "leaf_dense", "leaf_sparse", "leaf_age", "leaf_clicks", "offset_id", "shard_index")) + " END"

SQL = {
    "p3_found": f"""
    WITH r AS (SELECT search_id, offset_id, min(score) AS score, any_value(category) AS category, any_value(pub_year) AS pub_year, any_value(priority) AS priority,
        any_value(leaf_dense) AS leaf_dense, any_value(leaf_sparse) AS leaf_sparse, any_value(leaf_age) AS leaf_age, any_value(leaf_clicks) AS leaf_clicks, min(shard_index) AS shard_index
        FROM search_hits WHERE score IS NOT NULL GROUP BY ALL),
      j AS (SELECT r.*, s.agg_op, s.agg_k, {_FIELD.format(key="s.agg_key")} AS num, CASE s.agg_key WHEN 'category' THEN category END AS txt,
        CASE WHEN list_contains(group_keys, 'category') THEN category END AS g1, CASE WHEN list_contains(group_keys, 'pub_year') THEN pub_year END AS g2,
        CASE WHEN list_contains(group_keys, 'priority') THEN priority END AS g3 FROM r JOIN searches s ON r.search_id = s.search_id),
      n AS (SELECT *, row_number() OVER (PARTITION BY search_id, g1, g2, g3 ORDER BY
          CASE WHEN num IS NULL AND txt IS NULL THEN CASE agg_op WHEN '$min_k' THEN 0 ELSE 2 END ELSE 1 END,
          CASE agg_op WHEN '$min_k' THEN num ELSE -num END, CASE agg_op WHEN '$min_k' THEN txt END, CASE agg_op WHEN '$max_k' THEN txt END DESC, score, offset_id) AS k FROM j)
    SELECT search_id, offset_id FROM n WHERE k <= agg_k
    """,
    "p6_found": r"""
    SELECT DISTINCT doc_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\n\r.!?。！？]'), lambda w: length(w))) > 1200 THEN 1 ELSE 0 END AS forced
    FROM documents WHERE length(text) > 1200
    """,
    "p6_whole": r"""
    SELECT doc_id, md5(text) AS text_md5,
      CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\n\r.!?。！？]'), lambda w: length(w))) > 1200 THEN 1 ELSE 0 END AS forced,
      true AS within_limit, true AS overlaps, true AS natural_cuts
    FROM documents WHERE length(text) > 1200
    """,
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
