"""Passages of at least ``WINDOW`` words that stand in more than one document, by suffix arrays.

A window of 50 words belongs to the partition of its minimizer, the least hash of its 8-word runs: equal windows have
equal minimizers, so each partition can be sorted on its own.  Consecutive windows of one minimizer travel as one
segment of text.  Minimizers that only one document has go no further, and equal segments become one.  Each
partition's segments, cut to the windows whose hash occurs twice among the segments of a minimizer (no other window
can recur), form a text whose suffixes are sorted by external induction (``induced``); neighbours that have
50 words in common are one passage, and belong to the document with the smallest ``doc_id``.  The segments of a
minimizer that outgrow ``_BATCH`` bytes are sorted uncut; those of one that has more than ``HOT`` of them are cut in Spark before.

Places don't travel with the text.  A task numbers its different segments and writes (number, document, place) for
each occurrence beside (number, segment); sorting gives ranges of segments, which are joined to the places by number.  A
number belongs to one task's batch, so a segment that a third of all documents have is spread over all tasks there, and reaches
the sorter once a batch.

A word is what stands between white space (space, tab, line ends, form feed); words are compared by 63-bit hashes.

Defined results
* rows that are equal in ``doc_id`` and ``text`` are one document; a passage repeated inside one document only
  isn't reported; null texts and those of fewer words than a window have no passage;
* a row of the result is a maximal span of windows of one document that recur elsewhere and have the same owner; spans
  of different owners may overlap.  The owner's own span is reported too;
* the owner is the smallest ``doc_id`` that has the window, nulls last;
* texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .exact import Scratched
from .induced import ITEMS, Log, Sorter, Text, suffixes
from .words import SPACES, U, mix, row_slices, shingles, texts, words

WINDOW = 50
GRAM = 8
#: Segments of a minimizer beyond which its windows are counted in Spark before they are sorted; the result is the same.
HOT = 10_000
_BATCH = 4 << 20
_NOBODY = (1 << 63) - 1
_FACTOR = U(0xA0761D6478BD642F)
_BACK = U(pow(int(_FACTOR), -1, 1 << 64))


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    step = 1
    while step * 2 <= width:
        g = np.minimum(g[: len(g) - step], g[step:])
        step *= 2
    return np.minimum(g[: len(g) - (width - step)], g[width - step :]) if width > step else g


def segments(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimizer, first word, windows) of each run of windows with one minimizer."""
    none = (np.zeros(0, np.int64),) * 4
    if len(h) < window:
        return none
    minimizer = _least(shingles(h, gram), window - gram + 1)
    begin, end = first[:-1], np.maximum(first[1:] - window + 1, first[:-1])
    n = end - begin
    at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(at):
        return none
    doc, key = np.repeat(np.arange(len(n)), n), minimizer[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    place = np.flatnonzero(new)
    return doc[place], key[place].view(np.int64), at[place], np.diff(np.append(place, len(at)))


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    powers = np.concatenate([[U(1)], np.multiply.accumulate(np.full(max(1, len(h)), _FACTOR))])
    back = np.concatenate([[U(1)], np.multiply.accumulate(np.full(max(1, len(h)), _BACK))])
    sums = np.concatenate([[U(0)], np.cumsum(h * powers[: len(h)])])
    n = max(0, len(h) - window + 1)
    return mix((sums[window : window + n] - sums[:n]) * back[:n])


class Shard:
    """The segments of one partition, in order of minimizer and text.

    ``found`` takes what is known so far: (number, entry, None, None, None) for the segments that make up an entry, and
    (None, entry, first window, windows, owner) for what recurs of an entry.
    """

    def __init__(self, scratch, window: int, most: int, base: int = 0):
        self.scratch, self.window, self.most = scratch, window, most
        self.text = Text(scratch, most * 8)
        self.sorted, self.spans = Log(scratch, most), Log(scratch, most)
        self.batch: list[list] = []
        self.found: list[tuple] = []
        self.entry, self.base = -1, base
        self.bytes, self.group, self.key, self.seg, self.parted = 0, -1, None, None, False

    def add(self, key: int, seg: bytes, number: int, low: int, high: int, owner: int) -> None:
        """A segment of the documents (their hashes) from ``low`` to ``high``, the least id of which is ``owner``."""
        if key != self.key or seg != self.seg:
            if self.bytes > _BATCH:
                self.parted = key == self.key
                self.flush()
            if key != self.key:
                self.group, self.parted = self.group + 1, False
            self.key, self.seg, self.entry = key, seg, self.entry + 1
            self.batch.append([self.group, seg, low, high, owner, self.parted])
            self.bytes += len(seg)
        else:
            last = self.batch[-1]
            last[2:5] = min(last[2], low), max(last[3], high), min(last[4], owner)
        self.found.append((number, self.base + self.entry, None, None, None))

    def flush(self) -> None:
        batch, self.batch, self.bytes = self.batch, [], 0
        if not batch:
            return
        data = np.frombuffer(b"".join(x[1] for x in batch), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x[1]) for x in batch])])
        h, _, _, first = words(data, offsets, SPACES)
        sizes = np.diff(first) - self.window + 1
        at = np.repeat(first[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        group = np.repeat(np.array([x[0] for x in batch]), sizes)
        found = window_hashes(h, self.window)[at]
        order = np.lexsort((found, group))
        f, g = found[order], group[order]
        same = (f[1:] == f[:-1]) & (g[1:] == g[:-1])
        again = np.repeat(np.array([x[5] for x in batch]), sizes)  # other segments of the minimizer were or will be elsewhere
        if self.parted:
            again |= group == self.group
        again[order[1:]] |= same
        again[order[:-1]] |= same
        ends = np.cumsum(sizes)
        hits = np.flatnonzero(again)
        low, high = np.searchsorted(hits, ends - sizes), np.searchsorted(hits, ends)
        symbols = h | U(1 << 63)
        for k, (_, _, least, most, owner, _) in enumerate(batch):
            n, base, entry = int(sizes[k]), int(ends[k] - sizes[k]), self.entry - len(batch) + 1 + k
            begin = end = n
            if low[k] < high[k]:
                begin, end = int(hits[low[k]]) - base, int(hits[high[k] - 1]) - base + 1
                span = entry, self.text.n, begin, end - begin, owner, least, most
                self.sorted.add(span)
                self.spans.add(span)
                self.text.extend(symbols[first[k] + begin : first[k] + end + self.window - 1].tolist() + [entry + 1])
            if least != most:
                self.found += [(None, self.base + entry, x, y - x, owner) for x, y in ((0, begin), (end, n)) if y > x]

    def ranges(self) -> Iterator[tuple[None, int, int, int, int]]:
        """(None, entry, first window, windows, owner) of what recurs by sorting."""
        placed = Sorter(self.scratch, self.most)
        cluster: list[int] = []
        number = 0
        for position, shared in suffixes(self.text, self.window, self.scratch, self.most):
            if shared < self.window:
                if len(cluster) > 1:
                    number += 1
                cluster = cluster[:0]
            if len(cluster) == 1:
                placed.add((cluster[0], number))
            if cluster:
                placed.add((position, number))
            cluster = [position] if not cluster else [position, position]
        # by position to entries, by cluster to owners, by entry to ranges
        clustered = Sorter(self.scratch, self.most)
        coming = iter(placed)
        mark = next(coming, None)
        for entry, start, _, size, owner, low, high in self.sorted.forwards():
            while mark and mark[0] < start + size:
                clustered.add((mark[1], entry, mark[0] - start, owner, low, high))
                mark = next(coming, None)
            while mark and mark[0] < start + size + self.window:  # the end of a segment and its mark
                mark = next(coming, None)
        marked = Sorter(self.scratch, self.most)
        for _, same in groupby(clustered, key=lambda x: x[0]):
            first = next(same)
            owner, low, high = first[3:]
            members = Log(self.scratch, self.most)
            members.add(first[1:3])
            for x in same:
                owner, low, high = min(owner, x[3]), min(low, x[4]), max(high, x[5])
                members.add(x[1:3])
            if low != high:
                for entry, place in members.forwards():
                    marked.add((entry, place, owner))
        coming = iter(marked)
        mark = next(coming, None)
        for entry, _, offset, size, owner, low, high in self.spans.forwards():
            owners = [owner if low != high else None] * size
            while mark and mark[0] == entry:
                owners[mark[1]] = mark[2]
                mark = next(coming, None)
            begin = 0
            for k in range(1, size + 1):
                if k == size or owners[k] != owners[begin]:
                    if owners[begin] is not None:
                        yield None, self.base + entry, offset + begin, k - begin, owners[begin]
                    begin = k


def _with_cuts(source: DataFrame, cuts: DataFrame) -> DataFrame:
    """(row, doc_id, text, cuts) of the documents that have some; rows are told apart by their hash and their id."""
    wanted = cuts.groupBy("row", "doc_id").agg(F.collect_list(F.struct("key", "at", "begin", "end")).alias("cuts"))
    return source.alias("s").join(wanted.alias("w"), (F.col("s.row") == F.col("w.row")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))).select("s.row", "s.doc_id", "text", "cuts")


def _recurring(joined: DataFrame, window: int) -> DataFrame:
    """The cuts of hot minimizers, (row, doc_id, key, at, begin, end), narrowed to the windows that recur in another document.

    Counting windows by their hash is spread over all tasks and combined before the shuffle; what is left of a passage that
    stands in very many documents is the same in each of them, so that it reaches the sorter as one segment.
    """
    kinds = "row long, doc_id long, key long, at int, hash long, begin int, end int"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in kinds.split(", ")]
        for whole in batches:
            for batch in row_slices(whole, "text"):
                for row, doc, text, found in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2).cast(pa.large_binary()).to_pylist(), batch.column(3).to_pylist()):
                    for c in found:
                        data = np.frombuffer(text, np.uint8)[c["begin"] : c["end"]]
                        h, start, end, _ = words(data, np.array([0, len(data)]), SPACES)
                        n = len(h) - window + 1
                        columns = [np.full(n, row), None, np.full(n, c["key"]), c["at"] + np.arange(n), window_hashes(h, window).view(np.int64), c["begin"] + start[:n], c["begin"] + end[window - 1 :]]
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()) if x is None else pa.array(x, t) for x, t in zip(columns, (pa.int64(), None, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], names)

    spots = written(joined.mapInArrow(spread, kinds), "windows")
    again = spots.groupBy("key", "hash").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").select("key", "hash")
    kept = spots.join(again, ["key", "hash"], "left_semi").select("row", "doc_id", "key", "at", "begin", "end").distinct()
    own = Window.partitionBy("row", "doc_id", "key").orderBy("at")
    spans = kept.withColumn("island", F.col("at") - F.row_number().over(own)).groupBy("row", "doc_id", "key", "island")
    return spans.agg(F.min("at").alias("at"), F.min("begin").alias("begin"), F.max("end").alias("end")).select("row", "doc_id", "key", "at", "begin", "end")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = ITEMS, hot: int = HOT) -> DataFrame:
    """(doc_id, word_start, n_words, owner_id) of every passage that recurs in another document."""
    shared = shared_dir(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") >= 2 * window - 1).withColumn("row", F.xxhash64("doc_id", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                data, base = texts(batch.column(0), False)
                h, start, end, first = words(data, base, SPACES)
                doc, key, at, n = segments(h, first, window, gram)
                columns = [batch.column(1).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(key), pa.array((at - first[doc]).astype(np.int32)), pa.array((start[at] - base[doc]).astype(np.int32)), pa.array((end[at + n + window - 2] - base[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "key", "at", "begin", "end"])

    cuts = written(source.select("text", "row", "doc_id").mapInArrow(cut, "row long, doc_id long, key long, at int, begin int, end int"), "cuts")
    keys = written(cuts.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", (F.col("n") > hot).alias("hot")), "keys")
    known = cuts.join(keys, "key")
    wanted = known.where("NOT hot").drop("hot")
    if not keys.where("hot").isEmpty():
        wanted = wanted.unionByName(_recurring(_with_cuts(source, known.where("hot")), window))
    joined = _with_cuts(source, wanted)
    kinds = "number long, row long, doc_id long, at int, key long, seg binary, low long, high long, owner long"
    names = [x.split()[0] for x in kinds.split(", ")]
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def table(columns: list) -> pa.RecordBatch:
        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, arrow)], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(x[0], key, seg, *x[1:]) for (key, seg), x in held.items()]
            n, key, seg, low, high, owner = zip(*rows) if rows else [()] * 6
            return table([n, None, None, None, key, seg, low, high, owner])

        for whole in batches:
            for batch in row_slices(whole, "text"):
                places = []
                for row, doc, text, found in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2).cast(pa.large_binary()).to_pylist(), batch.column(3).to_pylist()):
                    owner = _NOBODY if doc is None else doc
                    for c in found:
                        name = c["key"], text[c["begin"] : c["end"]]
                        if (x := held.get(name)) is None:
                            held[name] = x = [number, row, row, owner]
                            number += 1
                            size += len(name[1]) + 400
                        else:
                            x[1:] = min(x[1], row), max(x[2], row), min(x[3], owner)
                        places.append((x[0], row, doc, c["at"]))
                if places:
                    yield table([*zip(*places), None, None, None, None, None])
                if size > 24 << 20:
                    yield flush()
                    held, size = {}, 0
        yield flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = Scratched(shared)
        try:
            shard = Shard(home, window, most, TaskContext.get().partitionId() << 36)
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    shard.add(*row)
                yield _ranges(shard.found)
            shard.flush()
            yield _ranges(shard.found)
            held: list[tuple] = []
            for x in shard.ranges():
                held.append(x)
                if len(held) == 50_000:
                    yield _ranges(held)
            yield _ranges(held)
        finally:
            home.close()

    gathered = written(joined.mapInArrow(gather, kinds), "segments")
    segs = gathered.where("key IS NOT NULL").select("key", "seg", "number", "low", "high", "owner").repartition("key").sortWithinPartitions("key", "seg")
    found = written(segs.mapInArrow(sort, "number long, entry long, start long, n long, owner_id long"), "ranges")
    ranges = found.where("number IS NOT NULL").select("number", "entry").join(found.where("number IS NULL").select("entry", "start", "n", "owner_id"), "entry").drop("entry")
    places = gathered.where("key IS NULL").select("number", "row", "doc_id", "at").join(ranges, "number").select("row", "doc_id", (F.col("at") + F.col("start")).alias("start"), "n", "owner_id").distinct()
    own = Window.partitionBy("row", "doc_id", "owner_id").orderBy("start")
    before = F.lag(F.col("start") + F.col("n")).over(own)
    islands = places.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
    spans = islands.groupBy("row", "doc_id", "owner_id", "island").agg(F.min("start").alias("word_start"), F.max(F.col("start") + F.col("n")).alias("stop"))
    return spans.select("doc_id", "word_start", (F.col("stop") - F.col("word_start") + window - 1).alias("n_words"), "owner_id")


def _ranges(held: list[tuple]) -> pa.RecordBatch:
    """The rows as a batch; the list is emptied."""
    names = ["number", "entry", "start", "n", "owner_id"]
    rows = [(*x[:4], None if x[4] == _NOBODY else x[4]) for x in held]
    held.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names)


def oracle(window: int = WINDOW) -> str:
    """The same in DuckDB's SQL."""
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
        windows AS (SELECT rn, doc_id, i, array_to_string(list_slice(ws, i + 1, i + {window}), ' ') AS w FROM (SELECT *, unnest(range(0, len(ws) - {window - 1})) AS i FROM docs WHERE len(ws) >= {window})),
        owned AS (SELECT w, min(doc_id) AS owner_id FROM windows GROUP BY w HAVING count(DISTINCT rn) > 1),
        hits AS (SELECT rn, doc_id, i, owner_id, i - row_number() OVER (PARTITION BY rn, owner_id ORDER BY i) AS island FROM windows JOIN owned USING (w))
    SELECT doc_id, min(i) AS word_start, max(i) - min(i) + {window} AS n_words, owner_id FROM hits GROUP BY rn, doc_id, owner_id, island"""
