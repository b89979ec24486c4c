"""Mixing sources to target shares of the total number of tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import checkpointed
from ..plans.layout import spread
from .tokens import PATTERN, TOKENIZERS

#: Tokens of a block, tokens of a shard and most shards of a source (this bounds the tables of quotas).
BLOCK, SHARD, MOST_SHARDS = 256, 4_000_000, 4096


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats of each party: one after another to the highest quotient weight / (2 * seats + 1) among those below their cap.

    Ties go to the earlier party. Gives fewer seats than asked only if all parties with a weight are at their caps. The
    bulk of the seats follows from the divisor found by bisection, the last few are handed out one by one.
    """
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64).copy()
    caps[w <= 0] = 0
    seats = int(min(seats, caps.sum()))
    got = np.zeros(len(w), np.int64)
    if seats <= 0:
        return got

    def at(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.minimum(np.floor(w / divisor + 0.5), 2.0**62).astype(np.int64))

    low, high = w[w > 0].min() / (4.0 * (seats + 1)), w.max() * 4 + 1
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while got.sum() < seats:
        quotient = np.where(got < caps, w / (2 * got + 1), -1.0)
        got[int(quotient.argmax())] += 1
    return got


_TOKENIZERS: dict[str, tiktoken.Encoding] = {}


def _tokenizer(ranks: bytes, name: str) -> tiktoken.Encoding:
    if name not in _TOKENIZERS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _TOKENIZERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _TOKENIZERS[name]


def token_counts(df: DataFrame, text: str, out: str = "tokens", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with its ``text`` column replaced by the text's number of tokens; 0 for null and empty texts."""
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokenizer(shared.value, vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, out])

    return spread(df.select(*keep, text)).mapInArrow(run, schema)


def _source(c: str):
    return F.lower(F.trim(F.col(c), F.lit(" \t\r\n\f\v")))


def mix_sources(docs: DataFrame, targets: DataFrame, key: str, text: str, block: int = BLOCK, shard: int = SHARD, seed: int = 17, most_shards: int = MOST_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): which documents the mix uses how often, and what each source reaches.

    ``docs`` has key, text and ``source``; ``targets`` source, target_share, max_repeats (a small table that a person wrote;
    it is read by the driver). Sources compare after trimming and lower-casing; documents without a source or with one
    that has no target take no part, as do those without tokens. The mix has as many tokens as the documents of the
    targeted sources hold, in blocks of ``block``: each goes to the source with the highest Sainte-Laguë quotient of its
    share, until the source has used all its documents ``max_repeats`` times (null or less than 1: not at all); what it
    cannot fill goes to the others, and is its shortfall. Then every source's blocks go to its shards (hashes of the key)
    by the same rule with the shards' tokens, so quotas are integers everywhere. Within a shard documents are put in a
    seeded order and cut into blocks; whole rounds use all of them, the rest of the quota the first blocks. A document
    belongs to the block of its middle token, so a shard's tokens differ from its quota by half a document at most.

    ``mix``: key, source, tokens, uses (at least 1). ``shares``: source, target_share, max_repeats, available_tokens,
    mix_tokens, reached_share, target_tokens, shortfall_tokens, one row per target. Repeated keys count as documents of
    their own. Without documents all tokens are 0 and reached_share is null.
    """
    spark = docs.sparkSession
    wanted = targets.select(_source("source").alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = wanted.toPandas().sort_values("source", ignore_index=True)
    plan["target_share"] = plan["target_share"].fillna(0.0).clip(lower=0)
    plan["max_repeats"] = plan["max_repeats"].fillna(0).clip(lower=0).astype("int64")
    mine = docs.select(key, _source("source").alias("source"), text).filter(F.col("source").isin(plan["source"].tolist()))
    sized = checkpointed(token_counts(mine, text).filter("tokens > 0"))

    totals = sized.groupBy("source").agg(F.sum("tokens").alias("available")).toPandas()
    plan = plan.merge(totals, "left", "source")
    plan["available"] = plan["available"].fillna(0).astype("int64")
    total = int(plan["available"].sum())
    quota = sainte_lague(plan["target_share"].to_numpy(), total // block, plan["available"].to_numpy() * plan["max_repeats"].to_numpy() // block)
    plan["blocks"], plan["shards"] = quota, np.clip(-(-plan["available"] // shard), 1, most_shards)

    per_source = spark.createDataFrame(plan[["source", "shards"]].astype({"shards": "int32"}), "source string, shards int")
    placed = sized.join(F.broadcast(per_source), "source").withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.col("shards")).cast("int")).drop("shards")
    held = placed.groupBy("source", "_shard").agg(F.sum("tokens").alias("held")).toPandas()  # at most targets * most_shards rows
    rows = []
    for p in plan.itertuples():
        h = held[held["source"] == p.source].sort_values("_shard")
        have = h["held"].to_numpy("int64")
        blocks = sainte_lague(have, p.blocks, have * p.max_repeats // block)
        # What the floors of the shards' caps leave goes where repeats are left, by parts of a block.
        take = np.minimum(blocks * block, have * p.max_repeats)
        left = min(p.blocks * block, int((have * p.max_repeats).sum())) - int(take.sum())
        for n in np.argsort(-(have * p.max_repeats - take), kind="stable"):
            more = min(left, int(have[n] * p.max_repeats - take[n]))
            take[n], left = take[n] + more, left - more
            if left <= 0:
                break
        rows += [(p.source, int(s), int(t // a), int(t % a)) for s, t, a in zip(h["_shard"], take, have, strict=True)]
    quotas = spark.createDataFrame(pd.DataFrame(rows, columns=["source", "_shard", "_rounds", "_rest"]), "source string, _shard int, _rounds long, _rest long")

    order = [F.xxhash64(F.lit(seed + 1), F.col(key)).asc(), F.col(key).asc(), F.col("tokens").asc()]
    w = Window.partitionBy("source", "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.withColumn("_middle", F.sum("tokens").over(w) - F.col("tokens") / 2).join(F.broadcast(quotas), ["source", "_shard"])
    used = cut.withColumn("uses", (F.col("_rounds") + F.when(F.col("_middle") < F.col("_rest"), 1).otherwise(0)).cast("long")).filter("uses > 0")
    mix = checkpointed(used.select(key, "source", "tokens", "uses"))

    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mix_tokens"))
    base = spark.createDataFrame(plan[["source", "target_share", "max_repeats", "available"]], "source string, target_share double, max_repeats long, available_tokens long")
    shares = base.join(F.broadcast(got), "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0).cast("long")))
    shares = shares.withColumn("reached_share", F.col("mix_tokens") / F.nullif(F.sum("mix_tokens").over(Window.partitionBy()), F.lit(0)))
    shares = shares.withColumn("target_tokens", F.round(F.col("target_share") * total).cast("long"))
    return mix, shares.withColumn("shortfall_tokens", F.greatest(F.col("target_tokens") - F.col("mix_tokens"), F.lit(0).cast("long")))
