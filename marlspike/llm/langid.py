"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The vector of the trigram abc binds its letters by position:
the first letter's vector permuted (rotated) twice, times the second's permuted once, times the third's.  A
text's vector bundles (adds) the vectors of all its trigrams, a language's prototype bundles the unit vectors of
labelled texts, and a text belongs to the language whose prototype has the largest cosine with it.

Prototypes are trained on at most about ``PER_LANGUAGE`` labelled rows for each language, chosen by a hash of
the row's id and text (the row of least hash, should that choose none); every row of the table is then scored over
its whole text.  A document is rejected if it has no letter or its best cosine is under ``threshold`` of its number n
of trigrams, ``least`` * (1 - sqrt(``EVEN`` / n)): the cosine of unrelated vectors has a standard deviation of
1/sqrt(``DIMENSIONS``), of which ``LEAST`` is about three, while that of a text of the language rises with its length as its
trigrams average out, by an error that shrinks with sqrt(n).  At ``EVEN`` trigrams a cosine of 0 is the limit, a shorter text
is given more room and a longer one nears ``LEAST``; there is no length at which the rule changes.

Defined results
* letters are lower case; every run of other characters counts as one space, and each text is framed by spaces;
* a null text, or one without a letter, has no language (null) and cosine 0 and is rejected;
* a row that is repeated trains once; rows without a language train nothing; without any labelled row nothing has a language and all is rejected;
* cosines are rounded to six places; of equal ones the first language in alphabetical order wins;
* repeated rows are scored alike; other columns are kept as they are by ``drop_rejected``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean
from .words import U, mix, slices

DIMENSIONS = 1024
PER_LANGUAGE = 1000
LEAST = 0.1
#: Trigrams at which the threshold is 0.
EVEN = 24
SEED = 7
_SLOTS = 128
_CACHED = 1 << 15


class Encoder:
    """Vectors of texts; trigrams met before are kept, as far as ``_CACHED`` goes."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        kind = np.fromiter((ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else c if chr(c).isalpha() else 32 for c in range(0x10000)), np.uint32, 0x10000)
        self.kind = kind
        self.slot = np.full(0x110000, -1, np.int32)
        self.letters = np.zeros((0, dimensions), np.int8)
        self.turned: list[np.ndarray] = []
        self.places = np.full(_SLOTS**3, -1, np.int32)
        self.rows = np.zeros((1024, dimensions), np.int8)
        self.used = 0

    def letter(self, points: np.ndarray) -> np.ndarray:
        """One vector for each code point, by hashing the point and the dimension."""
        at = np.arange(self.dimensions // 64, dtype=U)
        h = mix(points.astype(U)[:, None] * U(0x9E3779B97F4A7C15) + mix(at + U(self.seed * 1_000_003 + 1))[None])
        return np.unpackbits(h.astype(">u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1

    def symbols(self, text: str) -> np.ndarray:
        """The text as slots of letters with single spaces between runs."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        low = points < 0x10000
        points = np.where(low, self.kind[np.where(low, points, 0)], points)
        if not low.all():
            far = np.unique(points[~low])
            keep = np.array([chr(c).isalpha() for c in far.tolist()])
            points = np.where(np.isin(points, far[~keep]), np.uint32(32), points)
        points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]])
        space = points == 32
        points = points[~(space & np.concatenate([[False], space[:-1]]))]
        if len(points) < 3:
            return np.zeros(0, np.int64)
        out = self.slot[points]
        if (out < 0).any():
            new = np.unique(points[out < 0])
            self.slot[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters = np.concatenate([self.letters, self.letter(new)])
            self.turned = [np.roll(self.letters, 2, axis=1), np.roll(self.letters, 1, axis=1), self.letters]
            out = self.slot[points]
        return out.astype(np.int64)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One bundled vector for each text, in float32, and the number of its trigrams."""
        parts = [self.symbols(t) for t in texts]
        lengths = np.array([max(0, len(p) - 2) for p in parts], np.int64)
        owner = np.repeat(np.arange(len(parts)), lengths)
        if not len(owner):
            return np.zeros((len(texts), self.dimensions), np.float32), lengths
        a, b, c = (np.concatenate([p[k : len(p) - 2 + k] for p in parts if len(p) > 2]) for k in range(3))
        if len(self.letters) <= _SLOTS:
            code = (a * _SLOTS + b) * _SLOTS + c
            seen = np.zeros(_SLOTS**3, bool)
            seen[code] = True
            grams = np.flatnonzero(seen)
            place = np.empty(_SLOTS**3, np.int32)
            place[grams] = np.arange(len(grams))
            inverse = place[code]
            bound = self._cached(grams)
        else:
            n = len(self.letters)
            grams, inverse = np.unique((a * n + b) * n + c, return_inverse=True)
            bound = self._bound(grams, n)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for k in range(0, len(grams), 8192):
            here = (inverse >= k) & (inverse < k + 8192) if len(grams) > 8192 else slice(None)
            width = min(8192, len(grams) - k)
            counts = np.bincount(owner[here] * width + inverse[here] - k, minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ bound[k : k + width].astype(np.float32)
        return out, lengths

    def _bound(self, grams: np.ndarray, n: int) -> np.ndarray:
        return self.turned[0][grams // (n * n)] * self.turned[1][grams // n % n] * self.turned[2][grams % n]

    def _cached(self, grams: np.ndarray) -> np.ndarray:
        at = self.places[grams]
        new = grams[at < 0]
        if len(new) and self.used + len(new) <= _CACHED:
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = self._bound(new, _SLOTS)
            self.places[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            at = self.places[grams]
        if (at >= 0).all():
            return self.rows[at]
        return self._bound(grams, _SLOTS)


def threshold(grams: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The least cosine at which a text of so many trigrams is accepted."""
    return least * (1 - np.sqrt(EVEN / np.maximum(grams, 1)))


def encoder(dimensions: int, seed: int) -> Encoder:
    """One encoder for each Python worker."""
    encoders = kept("trigrams")
    if (dimensions, seed) not in encoders:
        encoders[dimensions, seed] = Encoder(dimensions, seed)
    return encoders[dimensions, seed]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Rows to encode at once: at most 32, and few if they are long."""
    for a, b in slices(np.array([len(t or "") for t in texts], np.int64), 1 << 18):
        for k in range(a, b, 32):
            yield k, min(b, k + 32)


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = labelled.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("hash"))
    draw = F.pmod("hash", F.lit(1 << 40)) / float(1 << 40)
    rates = {r[0]: (per_language / max(1, r[1]), r[2]) for r in hashed.groupBy("lang").agg(F.least(F.count("*"), F.approx_count_distinct("hash")), F.min(draw)).collect()}
    if not rates:
        return [], np.zeros((0, dimensions))
    rate, first = (F.element_at(F.create_map(*[x for lang, v in sorted(rates.items()) for x in (F.lit(lang), F.lit(float(v[k])))]), F.col("lang")) for k in range(2))
    sample = hashed.where((draw < rate) | (draw == first)).dropDuplicates(["lang", "hash"]).select("lang", "text").repartition(16, F.xxhash64("text"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = encoder(dimensions, seed), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                v = made.vectors(texts[a:b])[0].astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for lang, row in zip(langs[a:b], np.round(v * 2**32)):
                    sums[lang] = sums.get(lang, 0) + row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype(np.int64).tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "sums": [np.sum(np.stack(part["sums"].to_list()), axis=0)]})

    kind = "lang string, sums array<long>"
    found = sorted(sample.mapInArrow(lean(bundle, "trigrams"), kind).groupBy("lang").applyInPandas(add, kind).collect())
    if not found:
        return [], np.zeros((0, dimensions))
    m = np.array([r[1] for r in found], np.float64)
    return [r[0] for r in found], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def score(texts: list[str | None], names: list[str], profile: np.ndarray, least: float, dimensions: int, seed: int) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """Language, its cosine, by how much it leads the next one, and whether the text is accepted."""
    made = encoder(dimensions, seed)
    best, cosine, lead, keep = [], np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for a, b in _blocks(texts):
        v, grams = made.vectors([t or "" for t in texts[a:b]])
        v = v.astype(np.float64)
        norm = np.linalg.norm(v, axis=1)
        if not names:
            best += [None] * (b - a)
            continue
        like = np.round(v @ profile.T / np.maximum(norm, 1e-9)[:, None], 6)
        top = like.argmax(axis=1)
        best += [names[k] if n > 0 else None for k, n in zip(top, norm)]
        cosine[a:b] = like[np.arange(b - a), top] * (norm > 0)
        rest = np.sort(like, axis=1)
        lead[a:b] = np.round(rest[:, -1] - (rest[:, -2] if len(names) > 1 else 0), 6) * (norm > 0)
        keep[a:b] = (grams > 0) & (cosine[a:b] >= threshold(grams, least))
    return best, cosine + 0.0, lead + 0.0, keep


def identify(docs: DataFrame, least: float = LEAST, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(doc_id, lang, detected, cosine, lead, accepted) of every document."""
    names, profile = prototypes(docs, per_language, dimensions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, cosine, lead, keep = score(batch.column(2).to_pylist(), names, profile, least, dimensions, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(cosine), pa.array(lead), pa.array(keep)], ["doc_id", "lang", "detected", "cosine", "lead", "accepted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return source.mapInArrow(lean(run, "trigrams"), "doc_id long, lang string, detected string, cosine double, lead double, accepted boolean")


def drop_rejected(docs: DataFrame, least: float = LEAST, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``docs`` without the documents that look like no language."""
    names, profile = prototypes(docs, per_language, dimensions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = score(batch.column(batch.schema.get_field_index("text")).to_pylist(), names, profile, least, dimensions, seed)[3]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run, "trigrams"), docs.schema)
