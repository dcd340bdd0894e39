"""Semantic chunks: sentences, and the ordered fold that groups them by similarity.

A document is one row, so folding needs no shuffle; vectors come with the rows or from an embedder that each
Python worker makes once.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

HARD, INITIAL, FACTOR, RECENT, LONGEST = 0.6, 1.5, 0.9, 5, 15
SHORTEST = 50
BLOCK = 512
DIMENSIONS = 384
_CODE = regex.compile(r"```.*?```|`[^`\n]+`", regex.S)
_BREAK = regex.compile(r"\n{2,}|\n(?=\S)|(?<=\x00)\n")
_END = regex.compile(r"""(?:[.!?…]+["'”’)\]]*(?=\s+(?!\p{Ll}))|[。？！]["'”’」』)]*)\s*""")
_HEADING = regex.compile(r"#{1,6}\s")
_HIDDEN = regex.compile(r"\x00(\d+)\x00")
_LATIN = regex.compile("[A-Za-z0-9]")
_DECORATION = regex.compile(r"[-=_.*#|~`@!%^&*()\[\]{}\\/<>:+\s]+")


def sentences(text: str) -> list[str]:
    """Sentences in order; code stays whole, a heading is one sentence."""
    codes: list[str] = []

    def hide(m) -> str:
        codes.append(m[0])
        return f"\x00{len(codes) - 1}\x00"

    out: list[str] = []
    for part in _BREAK.split(_CODE.sub(hide, text.replace("\x00", ""))):
        part = part.strip()
        if _HEADING.match(part):
            out.append(part)
            continue
        at = 0
        for m in _END.finditer(part):
            out.append(part[at : m.end()])
            at = m.end()
        out.append(part[at:])
    shown = (_HIDDEN.sub(lambda m: codes[int(m[1])], s).strip() if codes else s.strip() for s in out)
    return [s for s in shown if s]


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def sentence_units(text: str, ranges: Sequence[tuple[int, int]] = ()) -> list[tuple[str, bool]]:
    """(sentence, whole) in order; what ``ranges`` (begin, end in characters) mark is one unit each and never split."""
    out: list[tuple[str, bool]] = []
    at = 0
    for begin, end in ranges:
        if not (isinstance(begin, int) and isinstance(end, int) and at <= begin < end <= len(text)) or not text[begin:end].strip():
            raise ValueError(f"the range from {begin} to {end} doesn't fit the text or the one before it")
        out += [(s, False) for s in sentences(text[at:begin])]
        out.append((text[begin:end].strip(), True))
        at = end
    return out + [(s, False) for s in sentences(text[at:])]


def is_garbage(text: str) -> bool:
    t = text.strip()
    if not t:
        return True
    if _LATIN.search(t):
        return False
    return bool(_DECORATION.fullmatch(t)) or max(map(t.count, set(t))) / (len(t.encode("utf-16-le")) / 2) > 0.8


@functools.lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def hashed_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of hashed words and character trigrams: an embedder that needs no model."""
    if not all(t.strip() for t in texts):
        raise ValueError("an empty text has no vector")
    low = [f" {t.lower()} " for t in texts]
    points = np.concatenate([np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in low] or [np.zeros(0, np.uint32)]).astype(np.uint64)
    sizes = np.array([len(t) for t in low], np.int64)
    owner = np.repeat(np.arange(len(low)), sizes)
    inside = owner[2:] == owner[:-2]
    grams = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    grams = (grams ^ grams >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    split = [t.split() for t in low]
    named = np.array([_word_hash(w) for words in split for w in words], np.uint64)
    h = np.concatenate([grams[inside], named])
    owner = np.concatenate([owner[2:][inside], np.repeat(np.arange(len(low)), [len(words) for words in split])])
    place = owner * dimensions + (h >> np.uint64(20)).astype(np.int64) % dimensions
    out = np.bincount(place, np.where(h >> np.uint64(63), 1.0, -1.0), len(low) * dimensions).reshape(len(low), dimensions)
    out[~out.any(axis=1), 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embedded(parts: list[str], embed: Callable[[list[str]], np.ndarray], most: int = 16, waste: float = 1.5) -> np.ndarray:
    """The vectors of all parts in their order, embedded ``most`` at a time.

    A model pads a batch to its longest text and its work grows with the square of that, so the longest texts wait for
    a later batch while the padded work is over ``waste`` times the needed one.
    """
    left, out = list(range(len(parts))), [None] * len(parts)
    while left:
        batch = left[:most]
        while len(batch) > 1 and len(batch) * max(len(parts[k]) for k in batch) ** 2 > waste * sum(max(1, len(parts[k])) ** 2 for k in batch):
            batch.remove(max(batch, key=lambda k: len(parts[k])))
        taken = set(batch)
        left = [k for k in left if k not in taken]
        vectors = np.asarray(embed([parts[k] for k in batch]), np.float32)
        if vectors.ndim != 2 or len(vectors) != len(batch):
            raise ValueError(f"{len(batch)} texts were given {vectors.shape} vectors")
        for k, v in zip(batch, vectors):
            out[k] = v
    return np.stack(out) if out else np.zeros((0, DIMENSIONS), np.float32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros(vectors.shape, np.result_type(vectors, np.float32)), where=norm > 0)


def groups(vectors: np.ndarray, hard: float = HARD) -> list[int]:
    """Group number of each sentence, by the Max-Min rule over what came before it."""
    v = _unit(np.asarray(vectors))
    n = len(v)
    # like[d][i] is the cosine of sentences i and i + d; no group is longer than LONGEST
    like = [[]] + [np.einsum("ij,ij->i", v[d:], v[: n - d]).tolist() if d < n else [] for d in range(1, LONGEST)]
    out, start = [], 0
    for i in range(n):
        held = i - start
        if held == 1:
            joins = INITIAL * like[1][start] > hard
        elif held >= LONGEST:
            joins = False
        elif held:
            low = max(start, i - RECENT)
            least = min(1.0, min(like[y - x][x] for x in range(low, i) for y in range(x + 1, i)))
            joins = max(like[i - x][x] for x in range(start, i)) > max(FACTOR * least / (1 + math.exp(-held)), hard)
        else:
            joins = True
        if not joins:
            start = i
        out.append(out[-1] + (not joins) if out else 0)
    return out


def chunks_of(text: str, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, shortest: int = SHORTEST, hard: float = HARD, ranges: Sequence[tuple[int, int]] = ()) -> list[str]:
    """Chunks of a text in order, without garbage and those that are short, unless they hold a unit of ``ranges``."""
    parts = sentence_units(text, ranges)
    if not parts:
        return []
    merged: dict[int, list[tuple[str, bool]]] = {}
    texts = [s for s, _ in parts]
    vectors = np.concatenate([np.asarray(embed(texts[a : a + BLOCK]), np.float32) for a in range(0, len(texts), BLOCK)])
    for g, part in zip(groups(vectors, hard), parts):
        merged.setdefault(g, []).append(part)
    joined = ((" ".join(s for s, _ in m), any(whole for _, whole in m)) for m in merged.values())
    return [c for c, whole in joined if (whole or units(c) >= shortest) and not is_garbage(c)]


def chunked(docs: DataFrame, key: str, text: str, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, shortest: int = SHORTEST) -> DataFrame:
    """(key, chunkIndex, text) of every document; null and empty texts have no chunks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(k, i, c) for k, t in zip(part.column(0), part.column(1).to_pylist()) for i, c in enumerate(chunks_of(t or "", embed, shortest))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in rows], part.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [key, "chunkIndex", "text"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunkIndex int, text string")


def vector_groups(vectors: DataFrame, document: str, order: str, vector: str) -> DataFrame:
    """(document, order, group) where the rows of each document are its sentences in order."""
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in (document, order))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return pd.DataFrame({document: rows[document], order: rows[order], "group": np.array(groups(np.stack(rows[vector].to_list())), np.int32)})

    return vectors.select(document, order, F.col(vector)).groupBy(document).applyInPandas(fold, f"{kinds}, group int")


def numbered(parts: DataFrame, document: str, order: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """(document, chunkIndex, text) of the parts that are long enough and no garbage, numbered from 0 without gaps."""
    kept = parts.where((tx.units(F.col(text)) >= shortest) & ~tx.is_garbage(F.col(text)))
    return kept.select(document, (F.row_number().over(Window.partitionBy(document).orderBy(order)) - 1).alias("chunkIndex"), F.col(text).alias("text"))
