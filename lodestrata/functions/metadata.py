"""Dynamically typed metadata: values that carry their own type, in one map per record."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of a sparse vector, and of a metadata value. ``t`` tells which field holds the value; its order is that of mixed types.
SPARSE = "struct<indices:array<bigint>,values:array<float>,tokens:array<string>>"
META_VALUE = f"struct<t:tinyint,b:boolean,i:bigint,f:double,s:string,ba:array<boolean>,ia:array<bigint>,fa:array<double>,sa:array<string>,sv:{SPARSE}>"
META = f"map<string,{META_VALUE}>"
BOOL, INT, FLOAT, STR, SPARSE_T, BOOLS, INTS, FLOATS, STRS = range(9)
FIELDS = ("b", "i", "f", "s", "sv", "ba", "ia", "fa", "sa")
TYPE_NAMES = ("bool", "int", "float", "str", "sparse", "bool[]", "int[]", "float[]", "str[]")
#: Key under which a JSON object says that it is a sparse vector, and its value there.
TAG, SPARSE_TAG = "#type", "sparse_vector"


@dataclass(frozen=True)
class SparseVector:
    """Parallel indices (strictly increasing, not negative) and values, with optional tokens."""

    indices: tuple[int, ...]
    values: tuple[float, ...]
    tokens: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if len(self.indices) != len(self.values) or (self.tokens is not None and len(self.tokens) != len(self.indices)):
            raise ValueError("a sparse vector's parts differ in length")
        if any(i < 0 for i in self.indices) or any(a >= b for a, b in zip(self.indices, self.indices[1:], strict=False)):
            raise ValueError("a sparse vector's indices must be strictly increasing and not negative")


def type_of(v: Any) -> int:
    """Type number of a Python value; ValueError for what metadata cannot hold (empty, mixed or nested lists, other types)."""
    if isinstance(v, bool):
        return BOOL
    if isinstance(v, int):
        return INT
    if isinstance(v, float):
        return FLOAT
    if isinstance(v, str):
        return STR
    if isinstance(v, SparseVector) or (isinstance(v, Mapping) and v.get(TAG) == SPARSE_TAG):
        return SPARSE_T
    if isinstance(v, (list, tuple)) and v:
        kinds = {type_of(x) for x in v}
        if len(kinds) == 1 and (k := kinds.pop()) <= STR:
            return BOOLS + k
    raise ValueError(f"not a metadata value: {v!r}")


def encode(v: Any) -> tuple | None:
    """The META_VALUE row of a Python value; None (delete the key) stays None."""
    if v is None:
        return None
    t = type_of(v)
    if isinstance(v, Mapping):
        v = SparseVector(tuple(v["indices"]), tuple(v["values"]), tuple(v["tokens"]) if v.get("tokens") else None)
    if t == SPARSE_T:
        v = (list(v.indices), [float(x) for x in v.values], None if v.tokens is None else list(v.tokens))
    row: dict[str, Any] = dict.fromkeys(("t", "b", "i", "f", "s", "ba", "ia", "fa", "sa", "sv"))
    row["t"], row[FIELDS[t]] = t, list(v) if t > SPARSE_T else v
    return tuple(row.values())


def decode(row: Any) -> Any:
    """The Python value of a META_VALUE row."""
    if row is None:
        return None
    d = row.asDict() if hasattr(row, "asDict") else dict(row)
    v = d[FIELDS[d["t"]]]
    if d["t"] == SPARSE_T:
        s = v.asDict() if hasattr(v, "asDict") else dict(v)
        return SparseVector(tuple(s["indices"]), tuple(s["values"]), tuple(s["tokens"]) if s["tokens"] else None)
    return list(v) if d["t"] > SPARSE_T else v


def validate(metadata: Mapping[str, Any]) -> None:
    """Raise ValueError unless keys are non-empty, do not start with # or $, and values fit (NaN and infinities do not)."""
    for k, v in metadata.items():
        if not isinstance(k, str) or not k or k[0] in "#$":
            raise ValueError(f"bad metadata key {k!r}")
        if v is not None:
            type_of(v)
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"bad number under {k!r}")


def encode_map(metadata: Mapping[str, Any] | None) -> dict[str, tuple | None] | None:
    """A validated META map."""
    if metadata is None:
        return None
    validate(metadata)
    return {k: encode(v) for k, v in metadata.items()}


def of_variant(x: Column) -> Column:
    """META value of a variant; null for null and for what metadata cannot hold."""
    kind = F.schema_of_variant(x)
    num = lambda t: F.try_variant_get(x, "$", t)
    is_int = kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT")
    is_num = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    t = F.when(kind == "BOOLEAN", BOOL).when(is_int, INT).when(is_num, FLOAT).when(kind == "STRING", STR)
    t = t.when(kind == "ARRAY<BOOLEAN>", BOOLS).when(kind.isin("ARRAY<BIGINT>", "ARRAY<INT>"), INTS).when(kind.startswith("ARRAY<DECIMAL") | kind.isin("ARRAY<DOUBLE>"), FLOATS).when(kind == "ARRAY<STRING>", STRS)
    t = t.when(kind.startswith("OBJECT") & (F.try_variant_get(x, f"$['{TAG}']", "string") == SPARSE_TAG), SPARSE_T).cast("tinyint")
    fields = [("b", "boolean", BOOL), ("i", "bigint", INT), ("f", "double", FLOAT), ("s", "string", STR), ("ba", "array<boolean>", BOOLS), ("ia", "array<bigint>", INTS), ("fa", "array<double>", FLOATS), ("sa", "array<string>", STRS)]
    part = lambda n, c: F.try_variant_get(x, f"$.{n}", c).alias(n)
    sparse = F.struct(part("indices", "array<bigint>"), part("values", "array<float>"), part("tokens", "array<string>"))

    def row(k: Column) -> Column:
        return F.when(k.isNotNull(), F.struct(k.alias("t"), *[F.when(k == n, num(c)).alias(f) for f, c, n in fields], F.when(k == SPARSE_T, sparse).alias("sv")))

    # The type is worked out once: as the only element of an array it is a variable of the lambda.
    return F.get(F.transform(F.array(t), row), F.lit(0))


def from_json(text: Column) -> Column:
    """META map of a column of JSON objects with scalar, homogeneous list or sparse vector values; null members are kept as null."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, x: of_variant(x)).cast(META)


def from_json_values(m: Column) -> Column:
    """META map of a map of JSON texts."""
    return F.transform_values(m, lambda _, v: of_variant(F.parse_json(v))).cast(META)


def merged(old: Column, new: Column) -> Column:
    """Old metadata with the non-null entries of ``new`` put over it and the keys of its null entries deleted."""
    old, new = F.coalesce(old, F.create_map().cast(META)), F.coalesce(new, F.create_map().cast(META))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull()))


def delta(old: Column, new: Column) -> Column:
    """Struct of what changes from ``old`` to ``new``: inserts and deletes (maps), updates (map of old and new value)."""
    empty = F.create_map().cast(META)
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    both = F.map_filter(F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new"))), lambda _, p: p["old"].isNotNull() & p["new"].isNotNull() & (p["old"] != p["new"]))
    return F.struct(
        F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k)).alias("inserts"),
        F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)).alias("deletes"),
        both.alias("updates"),
    )
