"""Arithmetic over scores of nearest-neighbour leaves.

A value is a partial function of the record id, with an optional default for all other records. Two values with defaults meet on
the union of their records, one without a default restricts the result to its own, two without meet on the common ones. Lower is
better; the result has only records of the final support.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .where import EMBEDDING


class RankError(ValueError):
    """A malformed rank expression."""


class Rank:
    """An expression; Python's arithmetic operators build larger ones."""

    def __add__(self, o: Any) -> Rank:
        return _nary("$sum", self, o)

    __radd__ = lambda self, o: _nary("$sum", _wrap(o), self)

    def __mul__(self, o: Any) -> Rank:
        return _nary("$mul", self, o)

    __rmul__ = lambda self, o: _nary("$mul", _wrap(o), self)

    def __sub__(self, o: Any) -> Rank:
        return Op("$sub", (self, _wrap(o)))

    __rsub__ = lambda self, o: Op("$sub", (_wrap(o), self))

    def __truediv__(self, o: Any) -> Rank:
        return Op("$div", (self, _wrap(o)))

    __rtruediv__ = lambda self, o: Op("$div", (_wrap(o), self))

    def __neg__(self) -> Rank:
        return _nary("$mul", Val(-1.0), self)

    def __abs__(self) -> Rank:
        return Op("$abs", (self,))

    def abs(self) -> Rank:
        return Op("$abs", (self,))

    def exp(self) -> Rank:
        return Op("$exp", (self,))

    def log(self) -> Rank:
        return Op("$log", (self,))

    def max(self, o: Any) -> Rank:
        return _nary("$max", self, o)

    def min(self, o: Any) -> Rank:
        return _nary("$min", self, o)


@dataclass(frozen=True)
class Val(Rank):
    """A constant: no records of its own, ``value`` for all."""

    value: float

    def to_dict(self) -> dict:
        return {"$val": self.value}


@dataclass(frozen=True)
class Knn(Rank):
    """The ``limit`` nearest records of ``query`` under ``key``: their distance, or their rank from 0."""

    query: Any
    key: str = EMBEDDING
    limit: int = 16
    default: float | None = None
    return_rank: bool = False

    def __post_init__(self) -> None:
        if self.limit < 1:
            raise RankError("limit must be positive")

    def to_dict(self) -> dict:
        out = {"query": self.query, "key": self.key, "limit": self.limit, "return_rank": self.return_rank}
        return {"$knn": out | ({"default": self.default} if self.default is not None else {})}


@dataclass(frozen=True)
class Op(Rank):
    """An operation on its arguments."""

    op: str
    args: tuple[Rank, ...]

    def to_dict(self) -> dict:
        a = [x.to_dict() for x in self.args]
        return {self.op: {"left": a[0], "right": a[1]} if self.op in ("$sub", "$div") else a[0] if self.op in UNARY else a}


def _wrap(v: Any) -> Rank:
    if isinstance(v, Rank):
        return v
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise RankError(f"not a rank expression: {v!r}")
    return Val(float(v))


def _nary(op: str, a: Any, b: Any) -> Op:
    parts = [p for x in (a, b) for p in (x.args if isinstance(x, Op) and x.op == op else (_wrap(x),))]
    return Op(op, tuple(parts))


def rrf(ranks: Sequence[Rank], weights: Sequence[float] | None = None, k: float = 60.0, normalize: bool = False) -> Rank:
    """Reciprocal rank fusion: minus the sum of ``weight / (k + rank)``; the leaves should return ranks."""
    weights = list(weights) if weights is not None else [1.0] * len(ranks)
    if not ranks or len(weights) != len(ranks) or k <= 0 or any(w < 0 for w in weights):
        raise RankError("rrf needs ranks, as many weights that are not negative, and a positive k")
    if normalize:
        if not (total := sum(weights)):
            raise RankError("the weights add up to 0")
        weights = [w / total for w in weights]
    terms = [Val(float(w)) / (Val(float(k)) + r) for w, r in zip(weights, ranks, strict=True)]
    return -functools.reduce(lambda a, b: a + b, terms)


def parse_rank(tree: Mapping[str, Any] | Rank | None) -> Rank | None:
    """The expression of a JSON object."""
    if tree is None or isinstance(tree, Rank):
        return tree
    if isinstance(tree, (int, float)) and not isinstance(tree, bool):
        return Val(float(tree))
    if not isinstance(tree, Mapping) or len(tree) != 1:
        raise RankError(f"a rank expression is an object with one key, not {tree!r}")
    ((op, v),) = tree.items()
    if op == "$val":
        return _wrap(v)
    if op == "$knn":
        if not isinstance(v, Mapping) or "query" not in v or set(v) - {"query", "key", "limit", "default", "return_rank"}:
            raise RankError(f"malformed $knn: {v!r}")
        return Knn(**v)
    if op in UNARY:
        return Op(op, (_need(v),))
    if op in ("$sub", "$div"):
        if not isinstance(v, Mapping) or set(v) != {"left", "right"}:
            raise RankError(f"{op} needs left and right")
        return Op(op, (_need(v["left"]), _need(v["right"])))
    if op in FOLDS:
        if not isinstance(v, (list, tuple)) or not v:
            raise RankError(f"{op} needs a non-empty list")
        return Op(op, tuple(map(_need, v)))
    raise RankError(f"unknown rank operator {op!r}")


def _need(v: Any) -> Rank:
    r = parse_rank(v)
    if r is None:
        raise RankError("a rank expression is missing")
    return r


def leaves(r: Rank) -> list[Knn]:
    """The nearest-neighbour leaves, depth first."""
    return [r] if isinstance(r, Knn) else [k for a in getattr(r, "args", ()) for k in leaves(a)]


_INF = float("inf")


def _quotient(a: Column, b: Column) -> Column:
    """IEEE division: by zero it gives an infinity, or NaN for 0 / 0."""
    at_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, _INF).otherwise(-_INF)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _log(a: Column) -> Column:
    return F.when(F.isnan(a) | (a < 0), float("nan")).when(a == 0, -_INF).otherwise(F.ln(a))


def _pick(larger: bool) -> Callable[[Column, Column], Column]:
    """Maximum or minimum that leaves NaN out of account."""
    best = F.greatest if larger else F.least
    return lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(best(a, b))


FOLDS: dict[str, Callable[[Column, Column], Column]] = {"$sum": lambda a, b: a + b, "$mul": lambda a, b: a * b, "$max": _pick(True), "$min": _pick(False)}
PAIRS = {"$sub": lambda a, b: a - b, "$div": _quotient}
UNARY: dict[str, Callable[[Column], Column]] = {"$abs": F.abs, "$exp": F.exp, "$log": _log}


@dataclass(frozen=True)
class Scores:
    """``frame`` (id, score) and the value of all other records; no frame: no records."""

    frame: DataFrame | None
    default: Column | None


def _meet(a: Scores, b: Scores, f: Callable[[Column, Column], Column]) -> Scores:
    default = f(a.default, b.default) if a.default is not None and b.default is not None else None
    if a.frame is None or b.frame is None:
        if a.frame is None and b.frame is None:
            return Scores(None, default)
        own, other = (a, b) if a.frame is not None else (b, a)
        if other.default is None:
            return Scores(own.frame.limit(0), default)
        value = f(F.col("score"), other.default) if own is a else f(other.default, F.col("score"))
        # Without a default of its own the constant's side has no records, so the frame's records are the support.
        return Scores(own.frame.select("id", value.alias("score")), default)
    how = {(True, True): "full", (False, True): "left", (True, False): "right", (False, False): "inner"}[(a.default is not None, b.default is not None)]
    left, right = a.frame.withColumnRenamed("score", "_a"), b.frame.withColumnRenamed("score", "_b")
    x = F.col("_a") if a.default is None else F.coalesce("_a", a.default)
    y = F.col("_b") if b.default is None else F.coalesce("_b", b.default)
    return Scores(left.join(right, "id", how).select("id", f(x, y).alias("score")), default)


def evaluate(r: Rank, knn_leaf: Callable[[Knn], DataFrame]) -> Scores:
    """The value of an expression; ``knn_leaf`` gives (id, distance, rank from 1) of a leaf."""
    if isinstance(r, Val):
        return Scores(None, F.lit(r.value).cast("double"))
    if isinstance(r, Knn):
        found = knn_leaf(r)
        score = (F.col("rank") - 1).cast("double") if r.return_rank else F.col("distance").cast("double")
        return Scores(found.select("id", score.alias("score")), None if r.default is None else F.lit(float(r.default)))
    if not isinstance(r, Op):
        raise RankError(f"not a rank expression: {r!r}")
    args = [evaluate(a, knn_leaf) for a in r.args]
    if r.op in UNARY:
        f = UNARY[r.op]
        a = args[0]
        return Scores(None if a.frame is None else a.frame.select("id", f(F.col("score")).alias("score")), None if a.default is None else f(a.default))
    return functools.reduce(lambda a, b: _meet(a, b, FOLDS.get(r.op) or PAIRS[r.op]), args)


def rank_rows(r: Rank, knn_leaf: Callable[[Knn], DataFrame], empty: DataFrame) -> DataFrame:
    """(id, score) of the expression's support; a constant alone has none (``empty``: id, score)."""
    found = evaluate(r, knn_leaf).frame
    return empty.limit(0) if found is None else found


def fuse(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: float = 60.0, default: float | None = None, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion of many queries at once, the ``limit`` best of each.

    ``lists`` have query_id, id and rank (from 1) with at most one row per query and id. The score is minus the sum of
    ``weight / (k + rank - 1)``; a list without the id counts as ``weight / (k + default)``, or nothing. Ties go to the smaller
    id. The lists are summed in one aggregation, whatever their number; nothing is joined.
    """
    weights = [1.0] * len(lists) if weights is None else list(weights)
    if len(weights) != len(lists) or not lists:
        raise RankError("lists and weights differ in number")
    kinds = list(zip(lists, weights, strict=True))
    rows = [x.select("query_id", "id", (F.lit(w) / (k + F.col("rank") - 1)).alias("_s"), F.lit(w).alias("_w")) for x, w in kinds]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    missing = F.lit(0.0) if default is None else (F.lit(float(sum(weights))) - F.sum("_w")) / (k + default)
    summed = every.groupBy("query_id", "id").agg((-(F.sum("_s") + missing)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12), "id")
    return summed.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
