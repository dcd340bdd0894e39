"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact verification.

For an item of n words every n-word window of a document that has a shingle in common with the item gets a
64-bit SimHash of its words (a window without one has similarity 0 and can't be reported).  The items' own
fingerprints stand in ``BLOCKS`` tables, one for each block of 10 or 11 bits: two fingerprints within ``radius`` differ in at
most radius // ``BLOCKS`` bits of some block, so probing every key that close in all tables misses none.  A
candidate within the radius is reported if the Jaccard similarity of the two sets of word shingles, weighted by
the rarity of each shingle among the items, reaches ``least``.

Words are runs of letters and digits in lower case, punctuation aside.

Defined results
* a null or empty document matches nothing, nor does an item without words; either table may be empty;
* an item of fewer than ``SHINGLE`` words is one shingle;
* in a document shorter than the item the window is the whole document;
* of several windows for the same document and item the most similar one is reported, then the first; repeated
  rows are reported each, items of equal text each under its own ``item_id``;
* texts of any length are read whole; other columns are kept as they are by ``drop_contaminated``.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, loaded, shipped
from .words import LETTERS, U, row_slices, shingles, texts, words

SHINGLE = 3
#: At least 0.9 of the edited passages that the verification would keep are this close, up to eight words replaced in a row.
RADIUS = 15
LEAST = 0.5
BLOCKS = 6
SEGMENT = 200_000
#: Bytes of benchmark text that one index may hold; a larger benchmark is searched in several passes.
INDEX_BYTES = 16 << 20
_FLAGS_BITS = 22


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").astype(U).ravel()


def bits(h: np.ndarray) -> np.ndarray:
    """Each hash as 64 values of 1 and -1."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


def weight(items: int, having: int) -> int:
    """The rarity of a shingle, as a whole number so that sums don't depend on their order."""
    return round(math.log(1 + items / having) * (1 << 32))


class Index:
    """The benchmark's items, their shingles, weights and fingerprints."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int = RADIUS, least: float = LEAST, shared: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.radius, self.least = radius, least
        data, offsets = texts(pa.array([t for _, t in items], pa.string()), True)
        h, _, _, first = words(data, offsets, LETTERS)
        self.ids, self.words, self.sets = [], [], []
        for (item, _), a, b in zip(items, first, first[1:]):
            if b > a:
                self.ids.append(item)
                self.words.append(h[a:b])
                self.sets.append(frozenset(shingles(h[a:b], min(SHINGLE, b - a)).tolist()))
        count = Counter(s for own in self.sets for s in own)
        total, self.common, self.often = shared or (len(self.ids), np.zeros(0, U), np.zeros(0, np.int64))
        self.total, self.rare = total, weight(total, 1)  # a shingle of one item weighs as much as an unseen one
        self.weight = {s: weight(total, n) for s, n in count.items()} if shared is None else {s: self._rarity(s) for s in count}
        self.totals = [sum(self.weight[s] for s in own) for own in self.sets]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.prints = np.concatenate([fingerprints(bits(w).sum(axis=0, dtype=np.int32)[None]) for w in self.words]) if self.words else np.zeros(0, U)
        # shingle -> sizes of the items that have it, in the order of the shingles' hashes, for each length of shingle
        self.lookup = {}
        for k in sorted({min(SHINGLE, n) for n in self.size.tolist()}):
            pairs = sorted({(s, int(self.size[i])) for i, own in enumerate(self.sets) if min(SHINGLE, self.size[i]) == k for s in own})
            keys = np.array([s for s, _ in pairs], U)
            flags = np.zeros(1 << _FLAGS_BITS, bool)
            flags[keys >> U(64 - _FLAGS_BITS)] = True
            self.lookup[k] = flags, keys, np.array([n for _, n in pairs], np.int64)
        edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
        self.tables = []
        for low, high in zip(edges, edges[1:]):
            width = high - low
            key = (self.prints >> U(low)) & U((1 << width) - 1)
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange((1 << width) + 1, dtype=U))
            probes = [sum(1 << x for x in c) for n in range(radius // BLOCKS + 1) for c in itertools.combinations(range(width), n)]
            self.tables.append((U(low), U((1 << width) - 1), np.array(probes, U), order, starts))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of prints, item) within the radius."""
        rows, found = [], []
        for a in range(0, len(prints), 4096):
            part = prints[a : a + 4096]
            for low, mask, probes, order, starts in self.tables:
                key = (((part >> low) & mask)[:, None] ^ probes).astype(np.int64)
                first = starts[key]
                n = starts[key + 1] - first
                r, c = np.nonzero(n)
                m = n[r, c]
                at = np.repeat(first[r, c], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                row, item = np.repeat(r, m), order[at]
                near = np.bitwise_count(part[row] ^ self.prints[item]) <= self.radius
                rows.append(row[near] + a)
                found.append(item[near])
        pairs = np.unique(np.concatenate(rows) * max(1, len(self.prints)) + np.concatenate(found)) if rows else np.zeros(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def _rarity(self, shingle: int) -> int:
        """The weight by the counts of the whole benchmark."""
        at = int(np.searchsorted(self.common, U(shingle)))
        return weight(self.total, int(self.often[at])) if at < len(self.common) and int(self.common[at]) == shingle else self.rare

    def similarity(self, window: np.ndarray, item: int) -> float:
        return self.similarities(window, np.zeros(1, np.int64), len(window), item)[0]

    def similarities(self, h: np.ndarray, starts: np.ndarray, size: int, item: int) -> list[float]:
        """The item's similarity with the windows of ``size`` words at ``starts`` (ascending), which slide: what they share is counted once."""
        k = min(SHINGLE, len(self.words[item]), size)
        base, n = int(starts[0]), size - k + 1
        run = shingles(h[base : int(starts[-1]) + size], k).tolist()
        own, weights, known = self.sets[item], self.weight, {}
        count: dict[int, int] = {}
        both = other = low = high = 0
        out = []
        for start in (starts - base).tolist():
            if start >= high:
                count, both, other, low, high = {}, 0, 0, start, start
            for s in run[low:start]:
                count[s] -= 1
                if not count[s]:
                    if s in own:
                        both -= weights[s]
                    else:
                        other -= known[s]
            for s in run[high : start + n]:
                count[s] = count.get(s, 0) + 1
                if count[s] == 1:
                    if s in own:
                        both += weights[s]
                    else:
                        if s not in known:
                            known[s] = weights[s] if s in weights else self._rarity(s)
                        other += known[s]
            low, high = start, start + n
            out.append(both / (self.totals[item] + other))
        return out

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (first word, words, text) of the given texts that share a shingle with an item of their size."""
        begins, ends, sizes, owners = [], [], [], []
        for k, (flags, keys, known) in self.lookup.items():
            s = shingles(h, k)
            at = np.flatnonzero(flags[s >> U(64 - _FLAGS_BITS)])
            low, high = np.searchsorted(keys, s[at]), np.searchsorted(keys, s[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            doc = np.searchsorted(first, at, "right") - 1
            whole = at + k <= first[doc + 1]
            at, low, n, doc = at[whole], low[whole], n[whole], doc[whole]
            place = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, doc, size = np.repeat(at, n), np.repeat(doc, n), known[place]
            begins.append(np.maximum(at + k - size, first[doc]))
            ends.append(np.maximum(np.minimum(at, first[doc + 1] - size), begins[-1]) + 1)
            sizes.append(size)
            owners.append(doc)
        if not begins or not sum(map(len, begins)):
            return (np.zeros(0, np.int64),) * 3
        begin, end, size, doc = map(np.concatenate, (begins, ends, sizes, owners))
        # intervals of windows of one size and text that meet become one, so that each window comes once
        order = np.lexsort((begin, size, doc))
        begin, end, size, doc = begin[order], end[order], size[order], doc[order]
        group = np.cumsum(np.concatenate([[0], (size[1:] != size[:-1]) | (doc[1:] != doc[:-1])])) * (len(h) + 2)
        reach = np.maximum.accumulate(end + group)
        new = np.concatenate([[True], begin[1:] + group[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        begin, size, doc = begin[at], size[at], doc[at]
        n = reach[np.append(at[1:], len(new)) - 1] - group[at] - begin
        return np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(size, n), np.repeat(doc, n)

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window for each text and item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        widest = int(self.size.max(initial=1))
        for a in range(0, max(1, len(h)), SEGMENT):
            b = min(len(h), a + SEGMENT + widest + SHINGLE)
            lo, hi = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b, "left")
            part, cut = h[a:b], np.clip(first[lo : hi + 1], a, b) - a
            start, size, doc = self.hits(part, cut)  # windows that the segment cuts are whole in another one
            end = np.minimum(start + size, cut[doc + 1])
            whole = end - start == np.minimum(size, first[lo + doc + 1] - first[lo + doc])
            start, end, size, doc = start[whole], end[whole], size[whole], doc[whole]
            if not len(start):
                continue
            cover = np.zeros(len(part) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, end, -1)
            used = np.cumsum(cover[:-1]) > 0
            place = np.concatenate([[0], np.cumsum(used)])
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits(part[used]), axis=0, dtype=np.int32)])
            for w in range(0, len(start), 65536):
                s, e = place[start[w : w + 65536]], place[end[w : w + 65536]]
                row, item = self.candidates(fingerprints(sums[e] - sums[s]))
                row = row + w
                fits = self.size[item] == size[row]
                row, item = row[fits], item[fits]
                by = np.lexsort((start[row], doc[row], item))
                row, item = row[by], item[by]
                edges = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[row[1:]] != doc[row[:-1]]), [True]])) if len(row) else []
                for x, y in zip(edges, edges[1:]):
                    own, i, n = row[x:y], int(item[x]), int(end[row[x]] - start[row[x]])
                    text = int(doc[own[0]] + lo)
                    for s, like in zip(start[own].tolist(), self.similarities(part, start[own], n, i)):
                        if like >= self.least:
                            found = (-like, int(s + a - first[text]), n)
                            best[text, i] = min(best.get((text, i), found), found)
        return sorted((t, i, -like, at, n) for (t, i), (like, at, n) in best.items())


def shared_shingles(benchmark: DataFrame, text: str = "text") -> tuple[int, np.ndarray, np.ndarray]:
    """The number of items with words, and in order the shingles that several of them have, with the number of these items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, text):
                h, _, _, first = words(*texts(batch.column(0), True), LETTERS)
                own = [np.unique(shingles(h[a:b], min(SHINGLE, b - a))) for a, b in zip(first, first[1:]) if b > a]
                if own:  # a null for each item
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(np.concatenate(own).view(np.int64))])], ["shingle"])

    counts = benchmark.select(text).mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("shingle IS NULL OR n > 1").toArrow()
    known, n = counts.column("shingle").combine_chunks(), counts.column("n").to_numpy()
    none = known.is_null().to_numpy(zero_copy_only=False)
    common, often = known.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(U), n[~none]
    order = np.argsort(common)
    return int(n[none].sum()), common[order], often[order]


def indexes(benchmark: DataFrame, radius: int, least: float, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """One index, or as many as the benchmark's size asks for, weighted by the whole benchmark each."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    passes = max(1, math.ceil(total / INDEX_BYTES))
    shared = shared_shingles(benchmark, text) if passes > 1 else None
    for k in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64(text), F.lit(passes)) == k) if passes > 1 else benchmark
        yield Index(sorted(((r[0], r[1]) for r in part.select(item_id, text).collect()), key=repr), radius, least, shared)


def index_of(path: str) -> Index:
    """A shipped index, kept in the Python worker until the next one."""
    held = kept("index")
    if path not in held:
        held.clear()
        held[path] = loaded(path)
    return held[path]


def matches(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, word_start, n_words) of every document and item that it contains."""
    out = None
    schema = "doc_id long, item_id long, similarity double, word_start long, n_words long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in indexes(benchmark, radius, least):
        at = shipped(docs.sparkSession, index, "index")

        def run(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            index = index_of(at)
            for whole in batches:
                for batch in row_slices(whole, "text"):
                    h, _, _, first = words(*texts(batch.column(1), True), LETTERS)
                    found = index.search(h, first)
                    ids = batch.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([round(f[2], 9) for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())], ["doc_id", "item_id", "similarity", "word_start", "n_words"])

        part = source.mapInArrow(lean(run, "index"), schema)
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    schema, text = docs.schema, "text"
    for index in indexes(benchmark, radius, least):
        at = shipped(docs.sparkSession, index, "index")

        def run(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            index = index_of(at)
            for whole in batches:
                for batch in row_slices(whole, text):
                    h, _, _, first = words(*texts(batch.column(batch.schema.get_field_index(text)), True), LETTERS)
                    keep = np.ones(batch.num_rows, bool)
                    keep[[f[0] for f in index.search(h, first)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run, "index"), schema)
    return docs
