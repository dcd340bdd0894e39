"""Character n-grams of whole texts: the postings of every text, of all its positions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Postings that are handed on at once, at least.
ROWS = 500_000
#: Characters whose postings are grouped at once, at least.
CHARACTERS = 1 << 20
_BITS = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)


def counted(low: str) -> tuple[pa.Array, np.ndarray]:
    """The distinct runs of two and three characters and how often each occurs."""
    if "\0" in low:  # numpy drops it from the end of a string
        found = Counter(low[k : k + n] for n in (2, 3) for k in range(len(low) - n + 1))
        return pa.array(list(found), pa.string()), np.array(list(found.values()), np.int64)
    points = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams, counts = [], []
    for n in (2, 3):
        if len(points) < n:
            break
        code = points[: len(points) - n + 1]
        for k in range(1, n):
            code = code << _BITS | points[k : len(points) - n + 1 + k]
        own, count = np.unique(code, return_counts=True)
        letters = np.stack([own >> _BITS * np.uint64(k) & _LOW for k in reversed(range(n))], axis=1).astype(np.uint32)
        grams.append(pa.array(letters.view(f"<U{n}").ravel(), pa.string()))
        counts.append(count)
    return (pa.concat_arrays(grams), np.concatenate(counts)) if grams else (pa.array([], pa.string()), np.zeros(0, np.int64))


def postings(t: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n) of every row's lower-case text; repeated rows have postings of their own, null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
            out = [pa.array(ids, pa.int64()).take(pa.array(owner)), pa.concat_arrays(grams), pa.array(np.concatenate(counts))]
            return pa.RecordBatch.from_arrays(out, [key, "gram", "n"])

        ids, grams, counts, held = [], [], [], 0
        for batch in batches:
            for i, low in zip(batch.column(0), batch.column(1)):
                found, n = counted(low.as_py())
                ids.append(i.as_py())
                grams.append(found)
                counts.append(n)
                held += len(n)
                if held >= ROWS:
                    yield made()
                    ids, grams, counts, held = [], [], [], 0
        if ids:
            yield made()

    source = t.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.lower(text).alias("low"))
    return source.mapInArrow(run, f"{key} long, gram string, n long")


def length(low: F.Column) -> F.Column:
    """How many runs of two and three characters a lower-case text has."""
    return (F.greatest(F.length(low) - 1, F.lit(0)) + F.greatest(F.length(low) - 2, F.lit(0))).cast("long")


def _grouped(lows: list[str], groups: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, how many postings each has, the text of each posting, its count) of texts whose ``groups`` are numbers from 0; ordered by group, gram and text.

    A run is one number: its text's group, its characters as places in the alphabet of these texts, and the text.
    """
    sizes = np.array([len(t) for t in lows], np.int64)
    points = np.frombuffer("".join(lows).encode("utf-32-le"), np.uint32)
    there = np.zeros(0x110000, bool)
    there[points] = True
    alphabet = np.flatnonzero(there)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    text_bits, group_bits = int(len(lows) - 1).bit_length(), int(groups.max()).bit_length() if len(groups) else 0
    if group_bits + 3 * bits + text_bits > 64:  # one text alone takes 63 at most
        for part in (slice(0, len(lows) // 2), slice(len(lows) // 2, None)):
            for grams, held, owner, n in _grouped(lows[part], np.unique(groups[part], return_inverse=True)[1]):
                yield grams, held, owner + (part.start or 0), n
        return
    place = np.zeros(0x110000, np.uint64)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    letters = place[points]
    owner = np.repeat(np.arange(len(lows)), sizes)
    shift = lambda x: np.uint64(x)
    names = [chr(x) for x in alphabet]
    for n in (2, 3):
        if len(points) < n:
            return
        last = len(points) - n + 1
        code = letters[:last]
        for k in range(1, n):
            code = code << shift(bits) | letters[k : last + k]
        own = owner[:last]
        inside = own == owner[n - 1 :]
        own = own[inside]
        key = (groups.astype(np.uint64)[own] << shift(n * bits) | code[inside]) << shift(text_bits) | own.astype(np.uint64)
        if not len(key):
            continue
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(first, len(key)))
        key = key[first]
        lists = key >> shift(text_bits)
        begin = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
        different, back = np.unique(lists[begin] & shift((1 << n * bits) - 1), return_inverse=True)
        parts = [(different >> shift(bits * k) & shift((1 << bits) - 1)).tolist() for k in reversed(range(n))]
        grams = pa.array(["".join([names[x] for x in gram]) for gram in zip(*parts)], pa.string()).take(pa.array(back))
        yield grams, np.diff(np.append(begin, len(key))), (key & shift((1 << text_bits) - 1)).astype(np.int64), counts


def posting_lists(chunks: DataFrame, *kept: str) -> DataFrame:
    """(filePath, the ``kept`` columns of type int, gram, chunkIndexes, tfs, dls): the postings of every chunk with a text, grams counted at all positions.

    Postings of one file and gram that are counted together are one row of three lists, which is far less to sort than a row each.
    """
    names = ["filePath", *kept]
    lists = ["chunkIndexes", "tfs", "dls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches([b.slice(k, 1) for b, k in rows]).combine_chunks()
            seen: dict = {}
            groups = np.array([seen.setdefault(x, len(seen)) for x in zip(*(own[c].to_pylist() for c in names))], np.int64)
            columns = {c: own[c].combine_chunks() for c in (*names, "chunkIndex", "dl")}
            for grams, held, owner, n in _grouped(lows, groups):
                ends = np.cumsum(held)
                offsets = pa.array(np.append(0, ends), pa.int32())
                taken = pa.array(owner)
                values = columns["chunkIndex"].take(taken), pa.array(n).cast(pa.int32()), columns["dl"].take(taken)
                leads = pa.array(owner[ends - held])
                yield pa.RecordBatch.from_arrays([*(columns[c].take(leads) for c in names), grams, *(pa.ListArray.from_arrays(offsets, v) for v in values)], [*names, "gram", *lists])

        rows, lows, held = [], [], 0
        for batch in batches:
            rest = batch.select([*names, "chunkIndex", "dl"])
            for k, low in enumerate(batch.column(batch.num_columns - 1)):
                rows.append((rest, k))
                lows.append(low.as_py())
                held += len(lows[-1])
                if held >= CHARACTERS:
                    yield from made()
                    rows, lows, held = [], [], 0
        if rows:
            yield from made()

    low = F.lower("text")
    source = chunks.where("text IS NOT NULL").select(*names, "chunkIndex", length(low).alias("dl"), low.alias("low"))
    return source.mapInArrow(run, "filePath string, " + "".join(f"{c} int, " for c in kept) + "gram string, chunkIndexes array<int>, tfs array<int>, dls array<long>")


def flat(lists: DataFrame) -> DataFrame:
    """(filePath, chunkIndex, gram, tf, dl): a row for each posting of the lists."""
    each = lists.select("filePath", "gram", F.explode(F.arrays_zip("chunkIndexes", "tfs", "dls")).alias("p"))
    return each.select("filePath", F.col("p.chunkIndexes").alias("chunkIndex"), "gram", F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"))
