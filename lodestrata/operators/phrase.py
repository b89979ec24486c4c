"""Phrases in texts through positional postings of character trigrams.

A posting is (gram, id, pos). A text holds a phrase if all trigrams of the phrase stand there at their distances from one start:
the postings of these trigrams, moved back by their places in the phrase, are grouped by (id, start), which aggregates partially
and joins nothing. Written in the order of their grams, postings serve a phrase from a few of their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def trigram_postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(gram, id, pos): every trigram of every text with its place, from 1; texts of less than three characters have none."""
    grams = docs.select(F.col(id).alias("id"), T.grams(F.col(text)).alias("_g")).filter("_g is not null")
    return grams.select("id", F.posexplode("_g").alias("pos", "gram")).select("gram", "id", (F.col("pos") + 1).alias("pos"))


def phrase_ids(postings: DataFrame, phrase: str) -> DataFrame:
    """(id): the texts that hold ``phrase``, of at least three characters; upper and lower case differ."""
    if len(phrase) < 3:
        raise ValueError("a phrase needs three characters")
    places: dict[str, list[int]] = {}
    for n in range(len(phrase) - 2):
        places.setdefault(phrase[n : n + 3], []).append(n)
    at = F.create_map(*[x for g, ns in places.items() for x in (F.lit(g), F.array(*[F.lit(n) for n in ns]))])
    met = postings.filter(F.col("gram").isin(*places)).select("id", "pos", F.explode(F.element_at(at, F.col("gram"))).alias("_n"))
    starts = met.groupBy("id", (F.col("pos") - F.col("_n")).alias("_start")).agg(F.count_distinct("_n").alias("_k"))
    return starts.filter(F.col("_k") == len(phrase) - 2).select("id").distinct()
