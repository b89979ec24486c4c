"""Nested JSON records as flat node tables with interval labels.

Every node of a record gets a pre-order and a post-order number from one depth-first traversal, so node ``a`` holds node ``b``
exactly if ``a.pre < b.pre and b.post < a.post`` (same record). The tables of the node types are linked by these labels alone:
no node knows its holder. Intervals of one level do not overlap, so the one that may hold a node is the last that begins
before it, which one sweep in pre-order finds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import checkpointed

NODE_SCHEMA = "_doc_hash long, node_type string, pre long, post long, level int, field string, pos int, attrs string"
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?|true|false|null|-?Infinity|NaN")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
#: Deepest nesting of a field that is kept as it is; Spark's JSON functions give null for a text of more than 1,000 levels.
DEEPEST = 900
_SURROGATES = re.compile("[\ud800-\udfff]")


@dataclass(frozen=True)
class NodeType:
    """What lies below a node: ``lists`` (field -> type of its entries; a lone object counts as a list of one) and
    ``objects`` (field -> type of the object there)."""

    lists: Mapping[str, str] = field(default_factory=dict)
    objects: Mapping[str, str] = field(default_factory=dict)


def parse_json(text: str) -> Any:
    """The JSON value of ``text``, at any depth of nesting; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> Any:
    """As ``json.loads``, with a stack of its own in place of recursion."""
    root: list[Any] = []
    stack: list[Any] = [root]
    keys: list[str | None] = [None]
    i, want = 0, "value"  # value, first (value or the end of an empty container), next (comma or end)

    def put(v: Any) -> None:
        top = stack[-1]
        if isinstance(top, dict):
            top[keys[-1]] = v
        else:
            top.append(v)

    while True:
        i = _SPACE.match(text, i).end()
        top = stack[-1]
        if want == "next":
            if len(stack) == 1:
                if i != len(text):
                    raise ValueError("text after the value")
                return root[0]
            c = text[i : i + 1]
            if c == ("}" if isinstance(top, dict) else "]"):
                stack.pop(), keys.pop()
                i += 1
                continue
            if c != ",":
                raise ValueError("comma or end expected")
            i = _SPACE.match(text, i + 1).end()
        elif want == "first" and text[i : i + 1] == ("}" if isinstance(top, dict) else "]"):
            stack.pop(), keys.pop()
            i, want = i + 1, "next"
            continue
        if isinstance(top, dict):
            if text[i : i + 1] != '"':
                raise ValueError("key expected")
            keys[-1], i = scanstring(text, i + 1)
            i = _SPACE.match(text, i).end()
            if text[i : i + 1] != ":":
                raise ValueError("colon expected")
            i = _SPACE.match(text, i + 1).end()
        c = text[i : i + 1]
        if c in ("{", "[") and c:
            v: Any = {} if c == "{" else []
            put(v)
            stack.append(v), keys.append(None)
            i, want = i + 1, "first"
        elif c == '"':
            v, i = scanstring(text, i + 1)
            put(v)
            want = "next"
        elif c and (m := _SCALAR.match(text, i)):
            s = m.group()
            put(_WORDS[s] if s in _WORDS else float(s) if m[1] or m[2] else int(s))
            i, want = m.end(), "next"
        else:
            raise ValueError("value expected")


def _deep(v: Any) -> bool:
    """Whether ``v`` nests deeper than ``DEEPEST``."""
    level = [v]
    for _ in range(DEEPEST):
        level = [x for c in level if isinstance(c, (dict, list)) for x in (c.values() if isinstance(c, dict) else c)]
        if not level:
            return False
    return True


def _dumps(v: Any) -> str:
    """As ``json.dumps``, with a stack of its own in place of recursion."""
    out: list[str] = []
    stack: list[Any] = [v]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):  # text as it stands
            out.append(x[0])
        elif isinstance(x, dict):
            parts: list[Any] = [("{",)]
            for n, (k, y) in enumerate(x.items()):
                parts += [(", " * (n > 0) + json.dumps(k, ensure_ascii=False) + ": ",), y]
            stack += reversed([*parts, ("}",)])
        elif isinstance(x, list):
            parts = [("[",)]
            for n, y in enumerate(x):
                parts += [(", ",), y] if n else [y]
            stack += reversed([*parts, ("]",)])
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _text(attrs: dict[str, Any]) -> str:
    """JSON of a node's fields; one that nests deeper than Spark can read is kept as the string of its JSON."""
    s = json.dumps({k: _dumps(v) if isinstance(v, (dict, list)) and _deep(v) else v for k, v in attrs.items()}, ensure_ascii=False)
    return _SURROGATES.sub("�", s)


def label_nodes(body: Any, root: str, types: Mapping[str, NodeType]) -> Iterator[tuple]:
    """(type, pre, post, level, field, pos, attrs) of every typed node below ``body``, by one traversal."""
    if not isinstance(body, dict):
        return
    clock = 0
    stack: list[Any] = [(body, root, 0, None, None)]
    while stack:
        item = stack.pop()
        if item[0] is None:  # leaving a node
            _, row = item
            yield (row[0], row[1], clock, *row[2:])
            clock += 1
            continue
        node, kind, level, at, pos = item
        t = types.get(kind, NodeType())
        below = {*t.lists, *t.objects}
        pre, clock = clock, clock + 1
        attrs = {k: v for k, v in node.items() if k not in below} if isinstance(node, dict) else {"value": node}
        stack.append((None, (kind, pre, level, at, pos, _text(attrs))))
        children = []
        if isinstance(node, dict):
            for f, child in t.lists.items():
                v = node.get(f)
                entries = v if isinstance(v, list) else [v] if isinstance(v, dict) else []
                children += [(e if isinstance(e, dict) else {"value": e}, child, level + 1, f, n) for n, e in enumerate(entries)]
            for f, child in t.objects.items():
                if isinstance(node.get(f), dict):
                    children.append((node[f], child, level + 1, f, None))
        stack.extend(reversed(children))


def node_table(df: DataFrame, doc: str, body: str, root: str, types: Mapping[str, NodeType]) -> DataFrame:
    """One row per node: doc, _doc_hash, node_type, pre, post, level, field, pos, attrs (JSON of the other fields).

    Null, empty and unreadable bodies and bodies that are no object give no rows. Repeated rows (same doc and body) count
    once; the same doc with another body is a record of its own (``_doc_hash`` tells them apart). Entries of a list that
    are no objects are nodes with the single attribute ``value``. The result is checkpointed, as its tables are joined
    with one another.
    """
    slim = df.select(F.col(doc).alias("_doc"), F.col(body).alias("_body"), F.xxhash64(body).alias("_doc_hash"))
    slim = slim.filter("_body is not null").dropDuplicates(["_doc", "_doc_hash"])
    doc_type = slim.schema["_doc"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in f"_doc x, {NODE_SCHEMA}".split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for d, text, h in zip(batch["_doc"], batch["_body"], batch["_doc_hash"], strict=True):
                try:
                    value = parse_json(text)
                except ValueError:
                    continue
                rows += [(d, h, *n) for n in label_nodes(value, root, types)]
                if len(rows) > 50_000:
                    yield _frame(rows, names)
                    rows = []
            yield _frame(rows, names)

    nodes = slim.mapInPandas(walk, f"_doc {doc_type}, {NODE_SCHEMA}").withColumnRenamed("_doc", doc)
    return checkpointed(nodes)


def _frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=list(names), dtype=object)
    return f.astype({"pos": "Int32", "pre": "int64", "post": "int64", "level": "int32", "_doc_hash": "int64"})


def inside(children: DataFrame, parents: DataFrame, doc: str, how: str = "inner") -> DataFrame:
    """``children`` with the further columns of the ``parents`` rows that directly hold them, by interval containment.

    Both have doc, _doc_hash, pre, post and level; the further columns of ``parents`` must not clash with those of
    ``children``. Of the parents one level above a child only the last to begin before it can hold it, and does if it ends
    after it. A child without such a parent is left out (``inner``) or has nulls (``left``). A record's rows are swept in one
    task, as a running last value: no list of them is built, and a record was one row before.
    """
    label = [doc, "_doc_hash"]
    more = [c for c in parents.columns if c not in (*label, "pre", "post", "level")]
    p = parents.select(*label, F.col("level").alias("_at"), F.col("pre").alias("_pre"), F.struct("pre", "post", *more).alias("_holder"))
    c = children.select(*label, (F.col("level") - 1).alias("_at"), F.col("pre").alias("_pre"), F.struct(*children.columns).alias("_child"))
    both = p.unionByName(c, allowMissingColumns=True)
    sweep = Window.partitionBy(*label, "_at").orderBy("_pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_holder", F.last("_holder", ignorenulls=True).over(sweep)).filter("_child is not null")
    holds = (F.col("_holder.pre") < F.col("_child.pre")) & (F.col("_child.post") < F.col("_holder.post"))
    if how == "inner":
        swept = swept.filter(holds)
    return swept.select("_child.*", *[F.when(holds, F.col(f"_holder.{m}")).alias(m) for m in more])
