"""Encoding and decoding of whole corpora with a public byte-level BPE vocabulary.

Each partition is encoded by recursive queries of an in-process DuckDB: the rows (word, position, token) of all distinct words
join the merge table, every word contracts its minimum-rank pair from the left, until no word changes. Decoding joins the rows (text, position, token) with
the vocabulary and aggregates the symbols of each text in the order of their positions. The vocabulary file (a
few MB, whatever the corpus) is read by the driver and broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import spread

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
#: Word boundaries of the byte-level vocabularies (fixed value of the public format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text encoded at once, and distinct words kept with their ids, per Python worker.
SLICE_CHARS, CACHE_WORDS = 4_000_000, 300_000

#: The recursion. ``words`` has (w, toks); all occurrences of a word's minimum-rank pair are contracted at once, from the
#: left and without overlap, which is what contracting the leftmost one again and again comes to: a pair with the new token
#: has a higher rank than the merge that makes the token.
CONTRACT = """
WITH RECURSIVE st(w, toks) USING KEY (w) AS (
    SELECT w, toks FROM words
    UNION
    (WITH pos AS MATERIALIZED (SELECT w, i, toks[i] AS t, toks[i + 1] AS u FROM (SELECT w, toks, unnest(range(1, len(toks) + 1)) AS i FROM st)),
        pair AS MATERIALIZED (SELECT p.w, p.i, m.rank, m.id FROM pos p JOIN merges m ON p.t = m.l AND p.u = m.r),
        best AS MATERIALIZED (SELECT w, min(rank) AS rank FROM pair GROUP BY w),
        hit AS (SELECT p.w, p.i, p.id, p.i - row_number() OVER (PARTITION BY p.w ORDER BY p.i) AS run FROM pair p JOIN best b ON p.w = b.w AND p.rank = b.rank),
        done AS MATERIALIZED (SELECT w, i, id FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS k FROM hit) WHERE k % 2 = 1)
    SELECT p.w, list(coalesce(a.id, p.t) ORDER BY p.i)
    FROM pos p SEMI JOIN best b ON p.w = b.w LEFT JOIN done a ON p.w = a.w AND p.i = a.i LEFT JOIN done z ON p.w = z.w AND p.i = z.i + 1
    WHERE z.w IS NULL GROUP BY p.w)
)
SELECT w, toks FROM st
"""

#: Symbols of every text of ``lists`` (d, toks), and how many of its tokens are unknown.
JOIN_SYMBOLS = """
SELECT t.d, coalesce(string_agg(v.symbols, '' ORDER BY t.i), '') AS symbols, count(*) FILTER (v.symbols IS NULL) AS unknown
FROM (SELECT d, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM lists) t LEFT JOIN vocabulary v ON t.tok = v.id GROUP BY t.d
"""


def byte_symbols() -> dict[str, int]:
    """Symbol -> byte of the public byte-level format: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + n): b for n, b in enumerate(rest)}}


class Encoder:
    """One vocabulary in a DuckDB of this process."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = byte_symbols()
        self.first = np.zeros(256, np.int32)
        for s, b in symbols.items():
            self.first[b] = vocab[s]
        plain = {i: s for s, i in vocab.items() if all(c in symbols for c in s)}
        self.byte_of = str.maketrans({s: chr(b) for s, b in symbols.items()})
        table = pa.table({"l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "id": pa.array([vocab[a + b] for a, b in pairs], pa.int32())})
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.con.register("given", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.con.register("given", pa.table({"id": pa.array(plain.keys(), pa.int32()), "symbols": pa.array(plain.values(), pa.string())}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        """Ids of words not seen yet."""
        raw = [w.encode() for w in words]
        flat = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum([0, *map(len, raw)])
        table = pa.table({"w": pa.array(range(len(words)), pa.int32()), "toks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))})
        self.con.register("words", table)
        out = self.con.sql(CONTRACT).to_arrow_table()
        self.con.unregister("words")
        for w, toks in zip(out["w"].to_pylist(), out["toks"].to_pylist(), strict=True):
            self.known[words[w]] = toks

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(split))
        if len(self.known) + len(wanted) > CACHE_WORDS:
            self.known = {}
        new = sorted(wanted - self.known.keys())
        if new:
            self.learn(new)
        return [list(chain.from_iterable(map(self.known.__getitem__, words))) for words in split]

    def decode(self, lists: list[list[int] | None]) -> list[str | None]:
        """Text of each id list, null for null; ValueError for an id that is no ordinary token."""
        given = pa.table({"d": pa.array(range(len(lists)), pa.int32()), "toks": pa.array(lists, pa.list_(pa.int32()))})
        self.con.register("lists", given)
        out = self.con.sql(JOIN_SYMBOLS).fetchall()
        self.con.unregister("lists")
        texts: list[str | None] = [None if x is None else "" for x in lists]
        for d, symbols, unknown in out:
            if unknown:
                raise ValueError(f"{unknown} unknown ids in a list")
            texts[d] = symbols.translate(self.byte_of).encode("latin-1").decode(errors="replace")
        return texts


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _slices(texts: list[str | None] | list[list[int] | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for n, t in enumerate(texts):
        chars += len(t or ())
        if chars > SLICE_CHARS:
            yield start, n + 1
            start, chars = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): one row per row of ``df``, the ids of its whole text by the vocabulary, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts have the empty list. Repeated rows stay;
    further columns are not read. Very long texts are one row and are encoded whole.
    """
    with open(f"{folder}/{vocabulary}.json", encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    slim = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoder(shared)
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                ids = enc.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    return slim.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode_corpus(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the texts of id lists; the symbols of the tokens are joined in order. Null lists give null, empty ones the
    empty text; an id that is no ordinary token of the vocabulary is an error."""
    with open(f"{folder}/{vocabulary}.json", encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    slim = df.select(F.col(key).alias("k"), F.col(ids).alias("i"))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoder(shared)
            lists = b.column(1).to_pylist()
            for i, j in _slices(lists):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(enc.decode(lists[i:j]), pa.string())], ["k", "text"])

    return slim.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
