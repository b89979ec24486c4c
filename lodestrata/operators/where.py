"""Metadata and document predicates: a small tree, its JSON form, and its compilation to two-valued columns.

Every leaf is true or false, never null: a missing key or document fails a positive predicate and passes its negation. Integer
and float values compare as numbers; other types never equal one another.
"""

from __future__ import annotations

import functools
import operator
import re
import re._parser as regex_parser
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..plans.skew import fits

DOCUMENT, EMBEDDING, METADATA, SCORE, ID = "#document", "#embedding", "#metadata", "#score", "#id"
RANGES = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
_OPPOSITE = {"$eq": "$ne", "$in": "$nin", "$contains": "$not_contains", "$regex": "$not_regex"}
NEGATIVE = {v: k for k, v in _OPPOSITE.items()}


class WhereError(ValueError):
    """A predicate that is malformed or not allowed."""


@dataclass(frozen=True)
class Where:
    """A predicate tree."""

    def __and__(self, other: Where) -> Where:
        return Group("$and", (*_parts(self, "$and"), *_parts(other, "$and")))

    def __or__(self, other: Where) -> Where:
        return Group("$or", (*_parts(self, "$or"), *_parts(other, "$or")))


@dataclass(frozen=True)
class Group(Where):
    """``$and`` (all, true if empty) or ``$or`` (any, false if empty) of its members."""

    op: str
    members: tuple[Where, ...]

    def to_dict(self) -> dict:
        return {self.op: [m.to_dict() for m in self.members]}


@dataclass(frozen=True)
class Leaf(Where):
    """``op`` applied to the field ``key``."""

    key: str
    op: str
    value: Any

    def to_dict(self) -> dict:
        return {self.key: {self.op: list(self.value) if isinstance(self.value, tuple) else self.value}}


def _parts(w: Where, op: str) -> tuple[Where, ...]:
    return w.members if isinstance(w, Group) and w.op == op else (w,)


class Key:
    """A field in the expression language: ``Key("year") > 2020``, ``K.DOCUMENT.contains("cat")``."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __eq__(self, v: object) -> Where:  # type: ignore[override]
        return leaf(self.name, "$eq", v)

    def __ne__(self, v: object) -> Where:  # type: ignore[override]
        return leaf(self.name, "$ne", v)

    __hash__ = None  # type: ignore[assignment]

    def __gt__(self, v: Any) -> Where:
        return leaf(self.name, "$gt", v)

    def __ge__(self, v: Any) -> Where:
        return leaf(self.name, "$gte", v)

    def __lt__(self, v: Any) -> Where:
        return leaf(self.name, "$lt", v)

    def __le__(self, v: Any) -> Where:
        return leaf(self.name, "$lte", v)

    def is_in(self, v: Sequence) -> Where:
        return leaf(self.name, "$in", v)

    def not_in(self, v: Sequence) -> Where:
        return leaf(self.name, "$nin", v)

    def contains(self, v: Any) -> Where:
        return leaf(self.name, "$contains", v)

    def not_contains(self, v: Any) -> Where:
        return leaf(self.name, "$not_contains", v)

    def regex(self, v: str) -> Where:
        return leaf(self.name, "$regex", v)

    def not_regex(self, v: str) -> Where:
        return leaf(self.name, "$not_regex", v)


class K(Key):
    """Short name of ``Key``, with the fields that every record has."""

    DOCUMENT, ID, SCORE, METADATA, EMBEDDING = Key(DOCUMENT), Key(ID), Key(SCORE), Key(METADATA), Key(EMBEDDING)


def _scalar(v: Any) -> bool:
    return isinstance(v, (bool, int, float, str))


def leaf(key: str, op: str, value: Any) -> Leaf:
    """A checked leaf."""
    if not isinstance(key, str) or not key:
        raise WhereError("a predicate needs a field name")
    if op in ("$regex", "$not_regex") or (key == DOCUMENT and op in ("$contains", "$not_contains")):
        if key != DOCUMENT:
            raise WhereError(f"{op} is for documents only")
        if not isinstance(value, str) or not value:
            raise WhereError(f"{op} needs a non-empty text")
        if op.endswith("regex"):
            check_regex(value)
    elif key == DOCUMENT:
        raise WhereError(f"{op} is not for documents")
    elif op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple, set, frozenset)) or not value:
            raise WhereError(f"{op} needs a non-empty list")
        value = tuple(value)
        if not all(map(_scalar, value)) or len({type(v) for v in value}) > 1:
            raise WhereError(f"{op} needs values of one type")
    elif op in RANGES:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise WhereError(f"{op} needs a number")
    elif op in ("$eq", "$ne", "$contains", "$not_contains"):
        if not _scalar(value):
            raise WhereError(f"{op} needs a bool, number or text")
    else:
        raise WhereError(f"unknown operator {op!r}")
    return Leaf(key, op, value)


def check_regex(pattern: str) -> None:
    """Refuse patterns without a meaning in linear-time engines: look-around and back-references."""
    try:
        tree = regex_parser.parse(pattern)
    except (re.error, OverflowError) as e:
        raise WhereError(f"bad pattern {pattern!r}: {e}") from None
    stack = [tree]
    while stack:
        for name, arg in stack.pop():
            if str(name) in ("ASSERT", "ASSERT_NOT", "GROUPREF", "GROUPREF_EXISTS"):
                raise WhereError(f"look-around and back-references are not supported: {pattern!r}")
            todo = list(arg) if isinstance(arg, (tuple, list)) else [arg]
            while todo:
                x = todo.pop()
                if isinstance(x, regex_parser.SubPattern):
                    stack.append(x)
                elif isinstance(x, (tuple, list)):
                    todo.extend(x)


def matches_empty(pattern: str) -> bool:
    """Whether the pattern can match the empty text: then it holds for every row."""
    return regex_parser.parse(pattern).getwidth()[0] == 0


def parse_where(tree: Mapping[str, Any] | Where | None) -> Where | None:
    """The predicate of a JSON object; None and {} are no predicate."""
    if tree is None or isinstance(tree, Where) or tree == {}:
        return tree or None
    if not isinstance(tree, Mapping) or len(tree) != 1:
        raise WhereError(f"a predicate is an object with one key, not {tree!r}")
    ((key, v),) = tree.items()
    if key in ("$and", "$or"):
        if not isinstance(v, (list, tuple)) or not v:
            raise WhereError(f"{key} needs a non-empty list")
        return Group(key, tuple(parse_where(m) for m in v if m) if all(v) else _empty(key))
    if isinstance(v, Mapping):
        if len(v) != 1:
            raise WhereError(f"one operator per field, not {v!r}")
        ((op, value),) = v.items()
        return leaf(key, op, value)
    return leaf(key, "$eq", v)


def _empty(key: str) -> tuple:
    raise WhereError(f"{key} has an empty member")


def parse_where_document(tree: Mapping[str, Any] | None) -> Where | None:
    """The predicate of a document filter: ``$contains``, ``$not_contains``, ``$regex``, ``$not_regex``, ``$and``, ``$or``."""
    if not tree:
        return None
    if not isinstance(tree, Mapping) or len(tree) != 1:
        raise WhereError(f"a document predicate is an object with one key, not {tree!r}")
    ((op, v),) = tree.items()
    if op in ("$and", "$or"):
        if not isinstance(v, (list, tuple)) or not v:
            raise WhereError(f"{op} needs a non-empty list")
        return Group(op, tuple(parse_where_document(m) or _empty(op) for m in v))
    return leaf(DOCUMENT, op, v)


def combined(where: Any, where_document: Any) -> Where | None:
    """Both filters, joined by AND."""
    parts = [w for w in (parse_where(where), parse_where_document(where_document)) if w is not None]
    return None if not parts else functools.reduce(operator.and_, parts)


def fields_of(w: Where) -> list[Leaf]:
    """All leaves of the tree."""
    return [w] if isinstance(w, Leaf) else [x for m in w.members for x in fields_of(m)]


class Binding(Protocol):
    """Where a record's fields are: how a positive leaf reads as a column that may be null."""

    def positive(self, key: str, op: str, value: Any) -> Column: ...


def _literal(v: Any) -> Column:
    return F.lit(v)


@dataclass(frozen=True)
class FlatBinding:
    """Fields are top-level typed columns, so that comparisons reach the Parquet scan as pushed filters."""

    df: DataFrame
    columns: Mapping[str, str]
    document: str = "document"
    id: str = "id"

    def positive(self, key: str, op: str, value: Any) -> Column:
        name = {DOCUMENT: self.document, ID: self.id}.get(key) or self.columns.get(key)
        if name is None:
            return F.lit(False)
        col, kind = F.col(name), dict(self.df.dtypes)[name]
        inner = kind[6:-1] if kind.startswith("array<") else kind
        if key == DOCUMENT:
            return _text(col, op, value)
        if op == "$contains":
            return F.array_contains(col, _literal(value)) if kind.startswith("array<") and _fits(inner, value) else F.lit(False)
        if op == "$in":
            fit = [v for v in value if _fits(kind, v)]
            return col.isin(*fit) if fit else F.lit(False)
        if not _fits(kind, value):
            return F.lit(False)
        return RANGES[op](col, _literal(value)) if op in RANGES else col == _literal(value)


def _fits(kind: str, v: Any) -> bool:
    if isinstance(v, bool):
        return kind == "boolean"
    if isinstance(v, (int, float)):
        return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    return kind == "string"


def _text(col: Column, op: str, value: str) -> Column:
    if op == "$contains":
        return col.contains(value)
    return F.lit(True) if matches_empty(value) else col.rlike(value)


@dataclass(frozen=True)
class MapBinding:
    """Fields are entries of a map of dynamically typed values (``functions.metadata.META``)."""

    metadata: str = "metadata"
    document: str = "document"
    id: str = "id"

    def positive(self, key: str, op: str, value: Any) -> Column:
        if key == DOCUMENT:
            return _text(F.col(self.document), op, value)
        if key == ID:
            col = F.col(self.id)
            return col.isin(*value) if op == "$in" else col == value
        v = F.try_element_at(F.col(self.metadata), F.lit(key))
        if op == "$contains":
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                ints = F.array_contains(v["ia"], int(value)) if float(value).is_integer() else F.lit(False)
                return F.when(v["t"] == M.INTS, ints).otherwise(F.array_contains(v["fa"], float(value)))
            return F.array_contains(v["ba" if isinstance(value, bool) else "sa"], value)
        if op == "$in":
            return functools.reduce(operator.or_, [F.coalesce(self._compare(v, "$eq", x), F.lit(False)) for x in value])
        return self._compare(v, op, value)

    def _compare(self, v: Column, op: str, value: Any) -> Column:
        test = RANGES.get(op, operator.eq)
        if isinstance(value, bool):
            return test(v["b"], F.lit(value))
        if isinstance(value, str):
            return test(v["s"], F.lit(value))
        return F.when(v["t"] == M.INT, test(v["i"], F.lit(value))).when(v["t"] == M.FLOAT, test(v["f"], F.lit(float(value))))


def compile_where(w: Where | None, binding: Binding) -> Column:
    """A column that is true for the rows that satisfy the tree, and else false."""
    if w is None:
        return F.lit(True)
    if isinstance(w, Group):
        start = F.lit(w.op == "$and")
        return functools.reduce(operator.and_ if w.op == "$and" else operator.or_, [compile_where(m, binding) for m in w.members] or [start])
    negative = w.op in NEGATIVE
    hit = F.coalesce(binding.positive(w.key, NEGATIVE.get(w.op, w.op), w.value), F.lit(False))
    return ~hit if negative else hit


def filter_ids(df: DataFrame, ids: DataFrame | Sequence[str] | None, column: str = "id") -> DataFrame:
    """Only the rows whose id is in ``ids`` (None: all rows, empty: none); unknown and repeated ids do no harm.

    Short lists become a pushed ``IN``; a DataFrame a left-semi join, broadcast only if it is small.
    """
    if ids is None:
        return df
    if not isinstance(ids, DataFrame):
        ids = list(dict.fromkeys(ids))
        if len(ids) <= 1000:
            return df.filter(F.col(column).isin(*ids)) if ids else df.limit(0)
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], f"{column} string")
    ids = ids.select(F.col(ids.columns[0]).alias("_allowed"))
    return df.join(F.broadcast(ids) if fits(ids) else ids, F.col(column) == F.col("_allowed"), "left_semi")


@dataclass(frozen=True)
class IndexSchema:
    """Which predicates are legal: per key the disabled value types (``*``: default for all keys), and full text on or off."""

    disabled: Mapping[str, frozenset[str]]
    full_text: bool = True
    vector_keys: frozenset[str] = frozenset({EMBEDDING})

    def check(self, w: Where | None) -> None:
        """Raise WhereError if the tree needs an index that is off."""
        for x in fields_of(w) if w is not None else ():
            if x.key == DOCUMENT:
                if not self.full_text:
                    raise WhereError("full-text search is disabled")
                continue
            kinds = {M.TYPE_NAMES[M.type_of(v)] for v in (x.value if isinstance(x.value, tuple) else (x.value,))}
            if bad := kinds & (self.disabled.get(x.key, frozenset()) | self.disabled.get("*", frozenset())):
                raise WhereError(f"no index for {x.key!r} with values of type {', '.join(sorted(bad))}")

    def without(self, key: str, *types: str) -> IndexSchema:
        """The schema with these value types of ``key`` (``*``: of all keys) switched off."""
        return IndexSchema({**self.disabled, key: self.disabled.get(key, frozenset()) | set(types)}, self.full_text, self.vector_keys)

    def having(self, key: str, *types: str) -> IndexSchema:
        """The schema with these value types of ``key`` switched on again."""
        return IndexSchema({**self.disabled, key: self.disabled.get(key, frozenset()) - set(types)}, self.full_text, self.vector_keys)

    def check_key(self, key: str) -> None:
        """Raise WhereError if vectors under ``key`` are not indexed."""
        if key not in self.vector_keys:
            raise WhereError(f"no vector index for {key!r}")
