"""Texts read in another encoding than the one they were written in: where they are, and what they said.

A hidden Markov model with one clean state and one state per encoding pair (written in, read in) labels the stretches of
non-ASCII characters. In a pair's state a stretch is what the pair makes of some clean text, so its probability is that of the
text which the inverse transform gives back, under the same character bigram model that scores the clean state. Stretches that
the transform cannot have made are impossible there. Entering a pair's state costs, staying does not, so evidence adds up
across a document; the Viterbi path gives the labels, and each labelled span its state's inverse transform.

The bigram model is counted over all documents, in two rounds: the second takes off the documents in which the first finds a
likely span, so that damage that is common in the corpus does not count as clean. Its tables have a fixed number of buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import spread


#: Buckets of the bigram and of the character counts: they bound the model, whatever the corpus.
PAIR_BUCKETS, CHAR_BUCKETS = 1 << 20, 1 << 17
#: Log-odds that it takes to enter a pair's state and to leave it, that each further stretch costs there, and that make a
#: document doubtful in the first round.
ENTER, LEAVE, STAY, DOUBTFUL = 8.0, 1.0, 0.05, 2.5
#: The same for pairs whose inverse hardly ever fails, as no structure of UTF-8 speaks for them. There the n-th repetition of a
#: stretch counts as its n-th part, being no new evidence.
ENTER_PLAIN = 16.0
#: Log probability that a stretch costs when it is scored as if it were in small letters.
CAPITALS = 3.0
#: Encoding pairs: written in (from the inside out, if decoded wrongly twice), read in. Fixed values.
PAIRS: tuple[tuple[str, ...], ...] = (
    *((("utf-8", r)) for r in ("cp1252", "iso8859-15", "cp1250", "cp1251", "iso8859-2", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "gbk", "cp932", "big5", "euc_kr")),
    ("utf-8", "cp1252", "utf-8", "cp1252"),
    ("utf-8", "mac_roman", "utf-8", "mac_roman"),
    *(((w, "cp1252")) for w in ("koi8-r", "cp1251", "iso8859-5", "cp1250", "iso8859-2", "cp1254", "gbk", "shift_jis", "euc_jp")),
    ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"),
    ("cp1251", "cp866"),
    ("cp866", "cp1251"),
)
#: Encodings of several bytes a character, among those that texts are read in.
MULTIBYTE = ("gbk", "cp932", "big5", "euc_kr")
#: Results that a Python worker keeps, of each kind.
KEPT = 400_000
#: Stretches: non-ASCII characters, single ASCII ones between them included (second bytes of some encodings are ASCII).
STRETCH = regex.compile(r"[^\x00-\x7f]+(?:[!-~][^\x00-\x7f]+)*")
NOT_ASCII = r"[^\x00-\x7f]"
LOST = "�"


def byte_map(codec: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes without a character, and C1 controls, stand for themselves."""
    out: dict[str, int] = {chr(b): b for b in range(256) if b < 128 or 128 <= b < 160}
    out.update({c: b for b in range(128, 256) if (c := bytes([b]).decode(codec, "ignore"))})
    return out


class Undo:
    """Inverse transform of an encoding pair."""

    def __init__(self, pair: tuple[str, ...]) -> None:
        self.steps = []
        for written, read in zip(pair[-2::-2], pair[::-2], strict=True):
            table = None if read in MULTIBYTE else byte_map(read)
            self.steps.append((written, read, table))
        self.letters = None if self.steps[0][2] is None else frozenset(self.steps[0][2])
        self.utf8 = pair[-2] == "utf-8"

    def __call__(self, text: str) -> str | None:
        """What was written, or None if the pair cannot have made ``text``. A character whose bytes were lost is U+FFFD."""
        for written, read, table in self.steps:
            lost = text.count(LOST)
            if table is None:
                try:
                    raw = text.replace(LOST, "").encode(read)
                except UnicodeError:
                    return None
            else:
                try:
                    raw = bytes([0x81 if c == LOST else table[c] for c in text])
                except KeyError:
                    return None
            try:
                text = raw.decode(written)
            except UnicodeError:
                if not lost and table is not None:
                    return None
                text = raw.decode(written, "replace")
                if text.count(LOST) > 1 + 3 * lost:
                    return None
        return text


UNDO = [Undo(p) for p in PAIRS]


def buckets(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bucket of each character pair."""
    h = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(44)).astype(np.int64) % PAIR_BUCKETS


def bucket(before: int, after: int) -> int:
    """As ``buckets``, of one pair."""
    return ((before * 0x9E3779B97F4A7C15 + after * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) >> 44) % PAIR_BUCKETS


def count_text(texts: list[str], pairs: np.ndarray, chars: np.ndarray) -> None:
    """Add the texts' characters, and their pairs with a non-ASCII member, to the counts. A line feed stands between texts."""
    cp = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    chars += np.bincount(cp % CHAR_BUCKETS, minlength=CHAR_BUCKETS)
    a, b = cp[:-1], cp[1:]
    keep = (a > 127) | (b > 127)
    pairs += np.bincount(buckets(a[keep], b[keep]), minlength=PAIR_BUCKETS)


@dataclass
class Model:
    """Character bigram model: P(c | b) from pair counts, backed off to character counts."""

    pairs: np.ndarray
    chars: np.ndarray

    def __post_init__(self) -> None:
        self.total = float(self.chars.sum()) + 1.0
        self.seen: dict[tuple[str, str, str], dict[int, float] | None] = {}
        self.made: dict[str, list[tuple[int, str]]] = {}
        self.logs: dict[str, float] = {}

    def score(self, text: str) -> float:
        """Log probability of the characters after the first, each given the one before; capitals may count as small."""
        low = text.lower()
        return self._score(text) if low == text else max(self._score(text), self._score(low) - CAPITALS)

    def _score(self, text: str) -> float:
        logs, total = self.logs, 0.0
        for pair in map("".join, pairwise(text)):
            v = logs.get(pair)
            total += self._log(pair) if v is None else v
        return total

    def _log(self, pair: str) -> float:
        """Log probability of the second character after the first, kept for the next time."""
        a, b = map(ord, pair)
        single = (float(self.chars[b % CHAR_BUCKETS]) + (1e-3 if 128 <= b < 160 or b == 0xFFFD else 0.05)) / self.total
        base = float(self.chars[a % CHAR_BUCKETS])
        weight = 2.0 + 0.02 * min(base, 500.0)
        seen = float(self.pairs[bucket(a, b)]) if a > 127 or b > 127 else 0.0
        if len(self.logs) > KEPT:
            self.logs.clear()
        v = self.logs[pair] = math.log((seen + weight * single) / (base + weight))
        return v

    def undone(self, before: str, was: str, after: str) -> float:
        """Score of an inverse transform's result; what was lost counts a fixed amount."""
        lost = was.count(LOST)
        return self.score(before + was.replace(LOST, "") + after) - 3.0 * lost

    def odds(self, before: str, stretch: str, after: str) -> dict[int, float] | None:
        """Log-odds against the clean state of each pair that can have made the stretch; None if none is above 0."""
        key = (before, stretch, after)
        if key not in self.seen:
            if len(self.seen) > KEPT:
                self.seen.clear()
            self.seen[key] = self._odds(*key)
        return self.seen[key]

    def _made(self, stretch: str) -> list[tuple[int, str]]:
        """The pairs that can have made the stretch, with what was written."""
        if stretch not in self.made:
            if len(self.made) > KEPT:
                self.made.clear()
            letters, out = set(stretch) - {LOST}, []
            for k, undo in enumerate(UNDO):
                if (undo.letters is not None and not letters <= undo.letters) or (undo.utf8 and len(stretch) < 2):
                    continue
                was = undo(stretch)
                if was is not None and was != stretch and not (undo.utf8 and was.isascii()):
                    out.append((k, was))
            self.made[stretch] = out
        return self.made[stretch]

    def _odds(self, before: str, stretch: str, after: str) -> dict[int, float] | None:
        made = self._made(stretch)
        if not made:
            return None
        clean = self.score(before + stretch + after)
        out = {k: self.undone(before, was, after) - clean for k, was in made}
        return out if any(v > 0 for v in out.values()) else None

    def label(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, pair) of the stretches that the Viterbi path puts into a pair's state."""
        spans, odds = [], []
        for m in STRETCH.finditer(text):
            s, e = m.span()
            spans.append((s, e))
            odds.append(self.odds(text[s - 1] if s else "\n", m.group(), text[e] if e < len(text) else "\n"))
        states = sorted({k for o in odds if o for k, v in o.items() if v > 0})
        if not states:
            return []
        # Stretches that only the clean state can explain cost a cached None; the others are scored in every state.
        best = {-1: 0.0, **{k: -math.inf for k in states}}
        back: list[dict[int, int]] = []
        times: dict[str, int] = {}
        for (s, e), o in zip(spans, odds, strict=True):
            if o is None:
                o = self._weak(text[s - 1] if s else "\n", text[s:e], text[e] if e < len(text) else "\n", states)
            step, came = {}, {}
            n = times[text[s:e]] = times.get(text[s:e], 0) + 1
            out = max(states, key=best.__getitem__)
            came[-1] = -1 if best[-1] >= best[out] - LEAVE else out
            step[-1] = max(best[-1], best[out] - LEAVE)
            for k in states:
                stay, enter = best[k] - STAY, best[-1] - (ENTER if UNDO[k].utf8 else ENTER_PLAIN)
                came[k] = k if stay >= enter else -1
                gain = o.get(k, -math.inf)
                step[k] = max(stay, enter) + (gain if UNDO[k].utf8 or gain < 0 else gain / n)
            back.append(came)
            best = step
        k = max(best, key=lambda s: best[s] - (LEAVE if s >= 0 else 0))
        path = []
        for came in reversed(back):
            path.append(k)
            k = came[k]
        return [(s, e, k) for (s, e), k in zip(spans, reversed(path), strict=True) if k >= 0]

    def _weak(self, before: str, stretch: str, after: str, states: list[int]) -> dict[int, float]:
        clean, out = None, {}
        for k in states:
            was = UNDO[k](stretch)
            if was is not None and was != stretch:
                clean = self.score(before + stretch + after) if clean is None else clean
                out[k] = self.undone(before, was, after) - clean
        return out

    def doubtful(self, text: str) -> bool:
        """Whether some stretch is likelier damaged than clean."""
        for m in STRETCH.finditer(text):
            s, e = m.span()
            o = self.odds(text[s - 1] if s else "\n", m.group(), text[e] if e < len(text) else "\n")
            if o and max(o.values()) > DOUBTFUL:
                return True
        return False

    def repair(self, text: str, labels: list[tuple[int, int, int]]) -> str:
        """``text`` with every labelled span replaced by what was written there."""
        out, at = [], 0
        for s, e, k in labels:
            out += [text[at:s], UNDO[k](text[s:e]) or text[s:e]]
            at = e
        return "".join([*out, text[at:]])


def _counts(df: DataFrame, text: str, shared=None) -> np.ndarray:
    """Pair and character counts of all texts, or of those that the shared model finds doubtful (none is plain ASCII)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(CHAR_BUCKETS, np.int64)
        model = Model(*shared.value) if shared else None
        for b in batches:
            texts = b.column(0).to_pylist()
            count_text(texts if model is None else [t for t in texts if model.doubtful(t)], pairs, chars)
        both = np.concatenate([pairs, chars])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], ["bucket", "n"])

    kept = F.col(text).isNotNull() if shared is None else F.col(text).rlike(NOT_ASCII)
    rows = spread(df.select(text).filter(kept)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most PAIR_BUCKETS + CHAR_BUCKETS rows
    both = np.zeros(PAIR_BUCKETS + CHAR_BUCKETS, np.int64)
    both[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return both


def _tables(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return counts[:PAIR_BUCKETS].astype(np.float32), counts[PAIR_BUCKETS:].astype(np.float32)


def fit(df: DataFrame, text: str) -> Model:
    """The bigram model of the clean texts of ``df``: counts of all of them, less those of the doubtful ones."""
    counts = _counts(df, text)
    shared = df.sparkSession.sparkContext.broadcast(_tables(counts))
    return Model(*_tables(np.maximum(counts - _counts(df, text, shared), 0)))


def repairs(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, spans, restored): each row of ``df`` with a garbled span, the spans (start, end, pair, original) and its text
    with all of them restored; what was lost for good is U+FFFD there.

    Null, empty and plain ASCII texts are never garbled. Repeated rows stay; further columns are not read. An empty table
    gives an empty one. The model is fitted on ``df`` unless given.
    """
    model = model or fit(df, text)
    shared = df.sparkSession.sparkContext.broadcast((model.pairs, model.chars))
    slim = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").rlike(NOT_ASCII)))
    kind = slim.schema["k"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pair", pa.string()), ("original", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            at, spans, fixed = [], [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                if labels := m.label(t):
                    at.append(n)
                    spans.append([{"start": s, "end": e, "pair": " as ".join(PAIRS[k]), "original": UNDO[k](t[s:e])} for s, e, k in labels])
                    fixed.append(m.repair(t, labels))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(spans, pa.list_(span)), pa.array(fixed, pa.string())], ["k", "spans", "restored"])

    return slim.mapInArrow(run, f"k {kind}, spans array<struct<start:int,end:int,pair:string,original:string>>, restored string").withColumnRenamed("k", key)
