"""Search hits: grouped top-k and one ranking from several leaves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import checkpointed, range_chunks, row_numbers
from ..plans.skew import counted_join, lookup
from .topn import heavy_limit, tie_order, top_n

#: Columns of a hit that may group or be aggregated: as numbers, and as texts.
NUMBERS = ("score", "pub_year", "priority", "leaf_dense", "leaf_sparse", "leaf_age", "leaf_clicks", "offset_id", "shard_index")
TEXTS = ("category",)
#: A loading below this is lifted to it; four leaves that count alike would have 0.5 each.
LEAST_LOADING = 0.25


def _by_name(name: Column, columns: Sequence[str], cast: str) -> Column:
    out = F.lit(None).cast(cast)
    for c in columns:
        v = F.col(c).cast(cast)
        if cast == "double":
            v = F.nanvl(v, F.lit(None).cast("double"))
        out = F.when(name == ("#score" if c == "score" else c), v).otherwise(out)
    return out


def grouped_top_k(hits: DataFrame, searches: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """(search_id, offset_id, rank): the hits that each search's aggregate keeps per group.

    A record counts once per search, with its smallest score; records without any score and hits of unknown searches take no
    part. Its group is the list of the values of all ``group_keys``, a missing or unknown one being a value; no keys: one
    group. ``$min_k`` keeps the ``agg_k`` smallest ``agg_key`` values, missing first; ``$max_k`` the largest, missing last;
    NaN counts as missing. Ties go to the smaller score, then the smaller offset_id. Searches with another operation or
    without a positive ``agg_k`` keep nothing. Repeated searches must not differ.
    """
    kept = [c for c in (*NUMBERS, *TEXTS) if c not in ("score", "offset_id")]
    scored = hits.select("search_id", "offset_id", "score", *kept).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    records = scored.groupBy("search_id", "offset_id").agg(F.min("score").alias("score"), *[F.min(c).alias(c) for c in kept])
    plans = searches.filter(F.col("agg_op").isin("$min_k", "$max_k") & (F.col("agg_k") > 0)).select("search_id", "group_keys", "agg_op", "agg_key", "agg_k").dropDuplicates(["search_id"])
    r = lookup(records, plans, ["search_id"], "inner", salt=F.col("offset_id"))
    value = lambda k: F.coalesce(_by_name(k, NUMBERS, "double").cast("string"), _by_name(k, TEXTS, "string"))
    r = r.select(
        "search_id",
        "offset_id",
        "score",
        "agg_k",
        (F.col("agg_op") == "$min_k").alias("_min"),
        F.transform("group_keys", value).alias("_group"),
        _by_name(F.col("agg_key"), NUMBERS, "double").alias("_num"),
        _by_name(F.col("agg_key"), TEXTS, "string").alias("_text"),
    )
    ranked = top_n(checkpointed(r), ["search_id", "_group"], tie_order("_num", "_text", "_min", ["score", "offset_id"]), "agg_k", heavy_rows)
    return ranked.select("search_id", "offset_id", F.col("_rank").alias("rank"))


def _light_ranks(sized: DataFrame, group: str, item: str, names: Sequence[str]) -> DataFrame:
    """(group, item, _size, _r0, ...): mean ranks of the leaves' values within each group, null for null."""
    rows = sized.repartition(group)

    def rank(c: str) -> Column:
        first = F.rank().over(Window.partitionBy(group).orderBy(F.col(c).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(group, c))
        return F.when(F.col(c).isNotNull(), first + (ties - 1) / 2)

    return rows.select(group, item, "_size", *[rank(c).alias(f"_r{i}") for i, c in enumerate(names)])


def _heavy_ranks(sized: DataFrame, group: str, item: str, names: Sequence[str]) -> DataFrame:
    """The same across range chunks."""
    long = sized.select(group, item, F.explode(F.array(*[F.struct(F.lit(i).alias("_leaf"), F.col(c).alias("_v")) for i, c in enumerate(names)])).alias("_x")).select(group, item, "_x.*")
    values = long.filter("_v is not null").groupBy(group, "_leaf", "_v").agg(F.count(F.lit(1)).alias("_n"))
    numbered = row_numbers(range_chunks(values, [group, "_leaf", "_v"]), [group, "_leaf"], [F.col("_v").asc()], "_upto", F.col("_n"))
    ranks = checkpointed(numbered.select(group, "_leaf", "_v", "_n", (F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank")))
    ranked = counted_join(long.filter("_v is not null"), ranks, [group, "_leaf", "_v"], "_n", F.col(item))
    wide = ranked.groupBy(group, item).agg(*[F.max(F.when(F.col("_leaf") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(names))])
    missing = sized.filter(" and ".join(f"`{c}` is null" for c in names)).select(group, item, *[F.lit(None).cast("double").alias(f"_r{i}") for i in range(len(names))])
    return lookup(wide.unionByName(missing), sized.select(group, "_size").distinct(), [group], "inner", salt=F.col(item))


def component_ranking(items: DataFrame, group: str, item: str, leaves: dict[str, bool], least_loading: float = LEAST_LOADING, heavy_rows: int | None = None) -> DataFrame:
    """(group, item, key): one ranking key per item and group from several leaves; smaller is better.

    ``leaves`` maps each score column to whether larger is better. Within a group every leaf is replaced by its ranks (ties
    get their mean rank, missing and NaN the worst one), so neither range, shape nor outliers matter. The key is the
    projection on the first principal component of the ranks' correlation matrix, its loadings oriented to the declared
    directions (all positive). A loading under ``least_loading`` is lifted to it: with nearly uncorrelated leaves the
    component is arbitrary, and a leaf must not drop out. A leaf that is constant in a group has no say there; if all are,
    all keys are 0. Repeated items must agree and count once. A null group or item is a value of its own.

    Ranks are exact for groups of any size: light groups (see ``topn``) are ranked by windows after one shuffle for all leaves;
    of heavy ones distinct values with their counts are range-partitioned and numbered across chunks, then joined back with
    hot values salted. The correlation matrices are sums per group (partial aggregation).
    """
    names = list(leaves)
    once = checkpointed(items.groupBy(group, item).agg(*[F.max(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) * (-1.0 if leaves[c] else 1.0)).alias(c) for c in names]))
    # Ranks, in one shuffle of whole groups where these are light, across range chunks where they are heavy.
    sizes = checkpointed(once.groupBy(group).agg(F.count(F.lit(1)).alias("_size")))
    if heavy_rows is None:
        heavy_rows = heavy_limit(sizes.agg(F.sum("_size")).first()[0] or 0)
    sized = lookup(once, sizes, [group], "inner", salt=F.col(item))
    wide = _light_ranks(sized.filter(F.col("_size") <= heavy_rows), group, item, names)
    if sizes.filter(F.col("_size") > heavy_rows).limit(1).count():
        wide = wide.unionByName(_heavy_ranks(sized.filter(F.col("_size") > heavy_rows), group, item, names))
    r = [f"_r{i}" for i in range(len(names))]
    # Ranks relative to the size, centred near 0, keep the sums of products exact enough.
    wide = checkpointed(wide.select(group, item, *[(F.coalesce(c, "_size") / F.col("_size") - 0.5).alias(c) for c in r]))

    pairs = [(i, j) for i in range(len(r)) for j in range(i, len(r))]
    sums = wide.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(r)], *[F.sum(F.col(r[i]) * F.col(r[j])).alias(f"p{i}_{j}") for i, j in pairs])

    def loadings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                mean = np.array([row[f"s{i}"] for i in range(len(r))]) / row["n"]
                cov = np.zeros((len(r), len(r)))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / row["n"] - mean[i] * mean[j]
                out.append((row["g"], *component(cov, least_loading), *mean))
            yield pd.DataFrame(out, columns=["g", *[f"w{i}" for i in range(len(r))], *[f"m{i}" for i in range(len(r))]])

    kind = items.schema[group].dataType.simpleString()
    schema = f"g {kind}, " + ", ".join(f"{x}{i} double" for x in "wm" for i in range(len(r)))
    weights = sums.withColumnRenamed(group, "g").mapInPandas(loadings, schema).withColumnRenamed("g", group)
    key = sum((F.col(f"w{i}") * (F.col(c) - F.col(f"m{i}")) for i, c in enumerate(r)), F.lit(0.0))
    return lookup(wide, checkpointed(weights), [group], "inner", salt=F.col(item)).select(group, item, F.round(key, 9).alias("key"))


def component(cov: np.ndarray, least: float) -> np.ndarray:
    """Weights of the raw columns: oriented loadings of the correlation matrix's first component over the deviations."""
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    live = sd > 1e-9
    w = np.zeros(len(sd))
    if live.any():
        corr = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        v = np.abs(np.linalg.eigh(corr)[1][:, -1])
        w[live] = np.maximum(v, least) / sd[live]
    return w


def first_wanted(hits: DataFrame, searches: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """(search_id, offset_id, rank, key): the first ``want`` records of each search by ``component_ranking``."""
    keys = component_ranking(hits, "search_id", "offset_id", {"leaf_dense": False, "leaf_sparse": True, "leaf_age": False, "leaf_clicks": True}, heavy_rows=heavy_rows)
    wants = searches.filter("want > 0").select("search_id", "want").dropDuplicates(["search_id"])
    r = checkpointed(lookup(keys, wants, ["search_id"], "inner", salt=F.col("offset_id")))
    return top_n(r, ["search_id"], [F.col("key").asc(), F.col("offset_id").asc()], "want", heavy_rows, rank="rank").drop("want")


