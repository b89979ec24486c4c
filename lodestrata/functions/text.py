"""Tokens for sparse retrieval: splitting, stop words, English stemming, hashed dimensions, trigrams, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: English stop words (fixed values).
STOP_WORDS = """
a about above after again against ain all am an and any are aren aren't as at be because been before being below between both
but by can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had
hadn hadn't has hasn hasn't have haven haven't having he her here hers herself him himself his how i if in into is isn isn't
it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on
once only or other our ours ourselves out over own re s same shan shan't she she's should should've shouldn shouldn't so some
such t than that that'll the their theirs them themselves then there these they this those through to too under until up ve
very was wasn wasn't we were weren weren't what when where which while who whom why will with won won't wouldn wouldn't y you
you'd you'll you're you've your yours yourself yourselves
""".split()
#: Longest token.
MOST_CHARS = 40

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words with a stem of their own, and words that are not changed after the first suffix step (fixed values of the algorithm).
_OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT_AFTER_S = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffix replacements of steps 2 and 3 (fixed values of the algorithm).
_STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Starts of R1 and R2."""
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    after = lambda s: next((i + 1 for i in range(s + 1, len(w)) if w[i] not in _VOWELS and w[i - 1] in _VOWELS), len(w))
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    """Whether ``w`` ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """English stem of a lower-case word, by the public Porter2 rules."""
    if len(word) <= 2:
        return word
    if word in _OWN_STEMS:
        return _OWN_STEMS[word]
    w = word[1:] if word[0] == "'" else word
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    # 0 and 1a: possessives and plurals
    w = w[: len(w) - len(_longest(w, ("'", "'s", "'s'")))]
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_S:
        return w.lower()
    # 1b: participles
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    s = _longest(w, (*_STEP_2, "ogi", "li"))
    if s and len(w) - len(s) >= r1:
        if s in _STEP_2:
            w = w[: -len(s)] + _STEP_2[s]
        elif s == "ogi" and w[-4:-3] == "l":
            w = w[:-1]
        elif s == "li" and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    # 3
    s = _longest(w, (*_STEP_3, "ative"))
    if s and len(w) - len(s) >= r1:
        if s in _STEP_3:
            w = w[: -len(s)] + _STEP_3[s]
        elif len(w) - len(s) >= r2:
            w = w[:-5]
    # 4
    s = _longest(w, (*_STEP_4, "ion"))
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def murmur3(token: str, seed: int = 0) -> int:
    """Absolute value of the signed 32-bit MurmurHash3 (x86) of a token's UTF-8 bytes."""
    data, h, m = token.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFF, 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m
        h = (rot(h ^ (rot(k, 15) * 0x1B873593 & m), 13) * 5 + 0xE6546B64) & m
    if tail := data[whole:]:
        h ^= rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def raw_tokens(text: Column, stop_words: bool = True) -> Column:
    """Lower-case tokens of a text without punctuation, stop words and tokens above 40 characters; JVM-side, no stemming."""
    words = F.transform(F.split(text, r"[^\p{L}\p{N}_]+"), F.lower)
    keep = lambda w: (w != "") & (F.length(w) <= MOST_CHARS) & (~w.isin(*STOP_WORDS) if stop_words else F.lit(True))
    return F.filter(words, keep)


@F.pandas_udf(ArrayType(StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Stems of each list of tokens."""
    return tokens.map(lambda ts: None if ts is None else [s for t in ts if (s := stem(t))])


@F.pandas_udf(ArrayType(LongType()))
def hashed(tokens: pd.Series) -> pd.Series:
    """Hashed dimensions of each list of tokens."""
    known = lru_cache(maxsize=100_000)(murmur3)
    return tokens.map(lambda ts: None if ts is None else [known(t) for t in ts])


def tokens(text: Column, stem: bool = True) -> Column:
    """BM25 tokens of a text; with ``stem=False`` they stay JVM-side."""
    return stemmed(raw_tokens(text)) if stem else raw_tokens(text)


def grams(text: Column) -> Column:
    """The character trigrams of a text in order, in time linear in its length; none below three characters."""
    chars = F.split(text, "")
    n = F.size(chars)
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))
    triples = F.zip_with(pairs, F.slice(chars, F.lit(3), n), lambda a, b: F.concat(a, b))
    return F.when(F.length(text) >= 3, F.slice(triples, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """All distinct character trigrams of a text; none below three characters."""
    return F.array_distinct(grams(text))


def words(text: Column) -> Column:
    """Words of a text in lower case with 3 to 128 characters."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: (F.length(w) >= 3) & (F.length(w) <= 128))


_FENCE = re.compile(r"^ {0,3}(```|~~~)")
_BLANK = re.compile(r"^(?:[^\S\n]*\n)+")


#: What stands for the title of a page without any text (fixed value).
NO_TITLE = " "


def chunk_markdown(text: str, most_bytes: int = 2000) -> list[str]:
    """Chunks of a markdown page: its first line that is not blank, then its blocks, packed up to ``most_bytes``; a larger block
    stands alone and is cut at lines, then at characters. A blank page is one chunk, ``NO_TITLE``.

    Lines end at line feeds only. Blank lines around a chunk are left out, indentation is kept.
    """
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    title = next((n for n, line in enumerate(lines) if line.strip()), None)
    if title is None:
        return [NO_TITLE]
    blocks, block, fence = [], "", ""
    for line in lines[title + 1 :]:
        if (m := _FENCE.match(line)) and fence in ("", m[1]):
            fence = "" if fence else m[1]
        block += line
        if not line.strip() and not fence:
            blocks.append(block)
            block = ""
    size = lambda s: len(s.encode())
    pieces: list[str] = []
    for b in [*blocks, block]:
        if size(b) <= most_bytes:
            pieces.append(b)
            continue
        for line in re.findall(r"[^\n]*\n|[^\n]+", b):
            while size(line) > most_bytes:
                head = line.encode()[:most_bytes].decode(errors="ignore")
                pieces.append(head)
                line = line[len(head) :]
            pieces.append(line)
    out, packed = [lines[title].rstrip("\n")], ""
    for p in [*pieces, None]:
        if packed and (p is None or size(packed) + size(p) > most_bytes):
            out.append(_BLANK.sub("", packed).rstrip())
            packed = ""
        packed += p or ""
    return [out[0], *filter(None, out[1:])]


def chunks(df: DataFrame, key: str, text: str, most_bytes: int = 2000) -> DataFrame:
    """(key, chunk, body): ``chunk_markdown`` of every text, chunk 0 being the title; null texts have none."""
    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [chunk_markdown(t, most_bytes) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([n for p in parts for n in range(len(p))], pa.int32()), pa.array([c for p in parts for c in p], pa.string())], ["k", "chunk", "body"])

    return slim.mapInArrow(run, f"k {slim.schema['k'].dataType.simpleString()}, chunk int, body string").withColumnRenamed("k", key)
