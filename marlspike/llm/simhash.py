"""Near-duplicates by SimHash: every pair of fingerprints within the radius, by tiled exclusive-or and bit counts.

A document's 128-bit fingerprint adds up a random vector of +1 and -1 for each of its distinct words (letters and
digits in lower case) and keeps the signs.  Equal fingerprints are one point.  Documents connected by pairs of points
within the radius are a group; its smallest ``doc_id`` owns it.

Which tiles are compared follows from the pigeonhole principle: the bits are cut into m blocks with thresholds
that add up to radius - m + 1, and two points within the radius are within the threshold in one block at least.
So for each block the points are sorted into buckets by its bits, and a bucket is compared exactly, in numpy, with
those whose number is within the threshold.  No pair is lost, whatever m is; it grows narrower with the
number of points, from all pairs (m = 1, one bucket) to a few in a thousand.  A pair counts in its first such block only.

Points move as binary rows of 24 bytes each.  The first bits of a block are a cell, which is one task; cells of more
than ``CELL`` points are split, and the points of a neighbouring cell are sent to one of both.  A task holds its own
points and ``CELL`` of its neighbours' at a time, and returns a forest of its matches (one edge a point at most), however many
pairs match.

Defined results
* a null text, and one without a word, has no fingerprint and belongs to no group;
* order and repetition of words don't count; texts of any length are read whole;
* the owner is the smallest ``doc_id``, nulls last; of repeated rows one stays; rows with the owner's own
  ``doc_id`` aren't reported as its copies;
* empty tables give empty results; other columns are kept as they are by ``drop_near_copies``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lean, written
from .components import roots
from .words import LETTERS, U, mix, row_slices, texts, words

RADIUS = 20
#: Points of a cell at most.
CELL = 1 << 18
#: So many points are one bucket; more have buckets of ``_BUCKET`` on average, if their bits are even.
_WHOLE, _BUCKET = 8192, 32
_PAIRS, _COLUMNS = 1 << 16, 1 << 14
_HELD = 1 << 20
_SALTS = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of each text's fingerprint, and whether it has one."""
    h, _, _, first = words(*texts(column, True), LETTERS)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    there = np.unique(owner)
    halves = np.zeros((2, len(column)), U)
    if len(there):
        starts = np.searchsorted(owner, there)
        for k, salt in enumerate(_SALTS):
            b = np.unpackbits(mix(h ^ salt).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(b, starts, axis=0, dtype=np.int32)
            n = np.diff(np.append(starts, len(h)))[:, None]
            # of as many ones as zeros the bit of the smallest hash decides
            sign = 4 * ones - 2 * n + 2 * b[starts].astype(np.int32) - 1 > 0
            halves[k, there] = np.packbits(sign, axis=1).view(">u8").astype(U).ravel()
    has = np.zeros(len(column), bool)
    has[there] = True
    return halves[0], halves[1], has


def _with_prints(docs: DataFrame, text: str, a: str, b: str, row: str) -> DataFrame:
    """``docs`` with both halves (null without a fingerprint) and a number for each row, unique in one run."""
    schema = T.StructType([*docs.schema.fields, T.StructField(a, T.LongType()), T.StructField(b, T.LongType()), T.StructField(row, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in row_slices(whole, text):
                x, y, has = fingerprints(batch.column(batch.schema.get_field_index(text)))
                extra = [pa.array(x.view(np.int64), mask=~has), pa.array(y.view(np.int64), mask=~has), pa.array(np.arange(at, at + len(has)))]
                at += len(has)
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, a, b, row])

    return docs.mapInArrow(lean(run), schema)


class Forest:
    """Union of points by batches of pairs; label[x] is always x's root."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.label[x], self.label[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while not np.array_equal(again := to[to], to):
                to = again
            self.label = to[self.label]


def field(a: np.ndarray, b: np.ndarray, at: int, width: int) -> np.ndarray:
    """``width`` bits (fewer than 64) of the fingerprints from bit ``at`` on, counted from the highest one of ``a``."""
    low = 128 - at - width
    if low >= 64:
        out = a >> U(low - 64)
    elif low + width <= 64:
        out = b >> U(low)
    else:
        out = (a << U(64 - low)) | (b >> U(low))
    return out & U((1 << width) - 1)


class Plan:
    """Blocks (first bit, width, threshold, bits of a cell) for so many points, and the cells' tasks."""

    def __init__(self, points: int, radius: int, cell: int, parallel: int = 1, blocks: int | None = None):
        bits = max(1, math.ceil(math.log2(max(2, points / _BUCKET))))
        m = min(blocks, radius + 1) if blocks else (1 if points <= min(cell, _WHOLE) else min(math.ceil(128 / bits), radius + 1))
        least, more = divmod(radius - m + 1, m)
        cells = max(0, math.ceil(math.log2(max(1, points / cell))), math.ceil(math.log2(4 * parallel / m)) if m > 1 else 0)
        self.cell, self.blocks = cell, []
        cuts = [128 * k // m for k in range(m + 1)]
        wide = sorted(range(m), key=lambda k: cuts[k] - cuts[k + 1])[:more]
        for k in range(m):
            width = 0 if m == 1 else min(cuts[k + 1] - cuts[k], bits + 1)
            self.blocks.append((cuts[k], width, least + (k in wide), min(cells, width)))
        self.base = np.cumsum([0, *(1 << own[3] for own in self.blocks)])

    def cells(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """For each block the cells of the points."""
        for (at, _, _, own), base in zip(self.blocks, self.base):
            yield field(a, b, at, own).astype(np.int64) + base

    def assign(self, counts: dict[int, int]) -> None:
        """Tasks of the cells by their counts: the first one and how many each has, and for each task those that it is sent to as well."""
        self.parts = np.array([-(-counts.get(c, 0) // self.cell) for c in range(self.base[-1])], np.int64)
        self.task = np.cumsum([0, *self.parts])
        self.targets: list[list[int]] = [[] for _ in range(self.task[-1])]
        for (_, _, most, own), base in zip(self.blocks, self.base):
            for mask in masks(own, most).tolist():
                for c in range(base, base + (1 << own)):
                    d = base + (c - base ^ mask)
                    for i in range(self.task[c], self.task[c + 1]):
                        for j in range(max(i + 1, self.task[d]), self.task[d + 1]):
                            # either of both, so that the tasks have alike to do
                            x, y = (i, j) if int(mix(np.array([i * self.task[-1] + j], U))[0]) & 1 else (j, i)
                            self.targets[x].append(y)

    def block(self, task: int) -> int:
        return int(np.searchsorted(self.task[self.base], task, "right")) - 1


def masks(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``most`` are set at most, in order."""
    return np.array(sorted(sum(1 << k for k in c) for n in range(min(width, most) + 1) for c in itertools.combinations(range(width), n)), np.int64)


class Buckets:
    """Points (3, n) of one block, numbers and both halves, sorted by its bits."""

    def __init__(self, points: np.ndarray, at: int, width: int):
        key = field(points[1], points[2], at, width).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.id, self.a, self.b = points[:, order]
        self.key, self.first, self.n = np.unique(key[order], return_index=True, return_counts=True)


def near(one: Buckets, two: Buckets, reach: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (row of one, row of two) within the radius in buckets whose numbers differ by one of ``reach``.

    Inside one and the same each pair comes once.
    """
    same = one is two
    xor, first, second = (np.empty(_PAIRS, kind) for kind in (U, np.uint8, np.uint8))
    step = max(1, (1 << 19) // len(reach))
    for k in range(0, len(one.key), step):
        want = one.key[k : k + step, None] ^ reach
        at = np.minimum(np.searchsorted(two.key, want), len(two.key) - 1)
        there = two.key[at] == want
        if same:
            there &= want >= one.key[k : k + step, None]
        own, hit = np.nonzero(there)[0], at[there]
        ends = np.searchsorted(own, np.arange(len(want) + 1))
        for c in np.flatnonzero(np.diff(ends)).tolist():
            other = hit[ends[c] : ends[c + 1]]
            n = two.n[other]
            stop = np.cumsum(n)
            columns = np.arange(stop[-1]) + np.repeat(two.first[other] - stop + n, n)
            begin = int(one.first[k + c])
            end = begin + int(one.n[k + c])
            for p in range(0, len(columns), _COLUMNS):
                some = columns[p : p + _COLUMNS]
                a, b, width = two.a[some], two.b[some], len(some)
                rows = _PAIRS // width
                for r in range(begin, end, rows):
                    s = min(end, r + rows)
                    size = (s - r) * width
                    x, u, v = (y[:size].reshape(s - r, width) for y in (xor, first, second))
                    np.bitwise_xor(one.a[r:s, None], a, out=x)
                    np.bitwise_count(x, out=u)
                    np.bitwise_xor(one.b[r:s, None], b, out=x)
                    np.bitwise_count(x, out=v)
                    np.add(u, v, out=u)
                    found = np.flatnonzero(first[:size] <= radius)
                    if len(found):
                        i, j = found // width + r, some[found % width]
                        if same:
                            i, j = i[j > i], j[j > i]
                        yield i, j


def _numbered(prints: DataFrame) -> DataFrame:
    """(id, a, b) of the distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + batch.num_rows)), *batch.columns], ["id", "a", "b"])
            at += batch.num_rows

    return written(prints.where("a IS NOT NULL").select("a", "b").distinct().mapInArrow(run, "id long, a long, b long"), "points")


def _halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(x)).to_numpy().view(U) for x in ("a", "b"))


def _spread(points: DataFrame, plan: Plan) -> DataFrame:
    """(task, other, points) of every task: pieces of its own points, then those of its neighbours."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(plan.base[-1], np.int64)
        for batch in batches:
            for cells in plan.cells(*_halves(batch)):
                n += np.bincount(cells, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["cell", "n"])

    plan.assign({r[0]: r[1] for r in points.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.stack([batch.column(0).to_numpy().view(U), *_halves(batch)])
            part = mix(own[0]).astype(np.int64) & (1 << 62) - 1
            for cells in plan.cells(own[1], own[2]):
                tasks = plan.task[cells] + part % plan.parts[cells]
                order = np.argsort(tasks, kind="stable")
                kinds, first = np.unique(tasks[order], return_index=True)
                to, other, data = [], [], []
                for t, rows in zip(kinds.tolist(), np.split(order, first[1:])):
                    piece = own[:, rows].tobytes()
                    to += [t, *plan.targets[t]]
                    other += [False] + [True] * len(plan.targets[t])
                    data += [piece] * (1 + len(plan.targets[t]))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(other, pa.bool_()), pa.array(data, pa.binary())], ["task", "other", "points"])

    tasks = max(1, len(plan.targets))
    return points.mapInArrow(lean(cut), "task int, other boolean, points binary").repartitionById(tasks, "task").sortWithinPartitions("task", "other")


def components(prints: DataFrame, radius: int = RADIUS, cell: int = CELL, blocks: int | None = None) -> DataFrame:
    """(a, b, root) of the fingerprints that have another one within the radius; the number of blocks is by their count."""
    points = _numbered(prints)
    plan = Plan(points.count(), radius, cell, points.sparkSession.sparkContext.defaultParallelism, blocks)
    spread = _spread(points, plan)

    def forest(own: Buckets, other: Buckets, k: int) -> pa.RecordBatch:
        """The matches inside one set of buckets, or between two."""
        shift = 0 if own is other else len(own.id)
        a, b, number = own.a, own.b, own.id
        if shift:
            a, b, number = (np.concatenate(x) for x in ((a, other.a), (b, other.b), (number, other.id)))
        whole = Forest(len(number))
        u, v, held = [], [], 0

        def join() -> None:
            x, y = np.concatenate(u), np.concatenate(v)
            p, q, new = a[x] ^ a[y], b[x] ^ b[y], np.ones(len(x), bool)
            for at, width, most, _ in plan.blocks[:k]:
                new &= np.bitwise_count(field(p, q, at, width)) > most
            whole.join(x[new], y[new])

        _, width, most, _ = plan.blocks[k]
        for x, y in near(own, other, masks(width, most), radius):
            u.append(x)
            v.append(y + shift)
            held += len(x)
            if held > _HELD:
                join()
                u, v, held = [], [], 0
        if u:
            join()
        node = np.flatnonzero(whole.label != np.arange(len(number)))
        root = whole.label[node]
        columns = [x.view(np.int64) for x in (number[node], number[root], a[node], b[node], a[root], b[root])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "ua", "ub", "va", "vb"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, held, n = None, None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal own, held, n
            if held:
                k = plan.block(now[0])
                these = Buckets(np.concatenate(held, axis=1), *plan.blocks[k][:2])
                held, n = [], 0
                if now[1]:
                    if own is not None:
                        yield forest(own, these, k)
                else:
                    own = these
                    yield forest(own, own, k)

        for batch in batches:
            for j in range(batch.num_rows):
                at = batch.column(0)[j].as_py(), batch.column(1)[j].as_py()
                if at != now or at[1] and n > cell:
                    yield from done()
                    if now is None or at[0] != now[0]:
                        own = None
                    now = at
                held.append(np.frombuffer(batch.column(2)[j].as_buffer(), U).reshape(3, -1))
                n += held[-1].shape[1]
        yield from done()

    edges = written(spread.mapInArrow(lean(compare), "u long, v long, ua long, ub long, va long, vb long"), "near")
    names = edges.select(F.col("u").alias("node"), F.col("ua").alias("a"), F.col("ub").alias("b")).union(edges.select("v", "va", "vb")).distinct()
    return names.join(roots(edges.select("u", "v")), "node").select("a", "b", "root")


def _grouped(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """``prints`` with the columns g0, g1, g2 of its group."""
    found = written(components(prints, radius, tile), "groups")
    joined = prints.where("a IS NOT NULL").join(found, ["a", "b"], "left")
    alone = F.col("root").isNull()
    return joined.select(*prints.columns, F.coalesce("root", F.lit(-1)).alias("g0"), F.when(alone, F.col("a")).otherwise(0).alias("g1"), F.when(alone, F.col("b")).otherwise(0).alias("g2"))


def near_copies(docs: DataFrame, radius: int = RADIUS, tile: int = CELL) -> DataFrame:
    """(doc_id, owner_id) of every document in a group that another document owns."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(_with_prints(source, "text", "a", "b", "row").select("doc_id", "a", "b"), "prints")
    grouped = _grouped(prints, radius, tile)
    owners = grouped.groupBy("g0", "g1", "g2").agg(F.min("doc_id").alias("owner_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return grouped.join(owners, ["g0", "g1", "g2"]).where(~F.col("doc_id").eqNullSafe(F.col("owner_id"))).select("doc_id", "owner_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, tile: int = CELL) -> DataFrame:
    """``docs`` with one row of each group, and every row outside one."""
    a, b, row = fresh(docs, "print_a", "print_b", "row_number")
    whole = written(_with_prints(docs, "text", a, b, row), "printed")
    prints = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(row).alias("row"))
    grouped = _grouped(prints, radius, tile)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    owners = grouped.groupBy("g0", "g1", "g2").agg(F.min(key)["row"].alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = grouped.join(owners, ["g0", "g1", "g2"]).where("row <> owner").select(F.col("row").alias(row))
    return whole.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
