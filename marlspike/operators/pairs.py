"""A set of query vectors against all vectors, by tiles: a product of matrices gives the cosines of two tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1024
#: Of medians: rows of a group that one task takes whole, rows of a larger group's blocks, bins of a pass, cosines that the last pass fetches, and large groups at a time.
WHOLE, BLOCK, BINS, MOST, WAVE = 2048, 8192, 8192, 8192, 32
#: Stands for a cosine that is no number: like in Spark and SQL, it is larger than all others.
_NAN = 2.0


def _pack(ids: pa.Array, vectors: pa.Array) -> tuple[bytes, bytes, bytes, bytes]:
    """Ids, sizes (-1: null), which vectors hold a null, and all numbers one after the other."""
    own = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    holes = np.zeros(len(own), bool)
    holes[np.repeat(np.arange(len(own)), np.maximum(sizes, 0))[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    numbers = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    return own.tobytes(), sizes.tobytes(), holes.tobytes(), numbers.tobytes()


def _by_size(sizes: np.ndarray, flat: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their matrix for each size that occurs."""
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    rows = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes[sizes > 0])}
    return {n: (r, flat[starts[r][:, None] + np.arange(n)]) for n, r in rows.items()}


def cosines(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of every row of a with every row of b, as ``vectors.cosine`` has it, and which are null."""
    (sa, ha, fa), (sb, hb, fb) = a, b
    like = np.zeros((len(sa), len(sb)))
    left, right = _by_size(sa, fa), _by_size(sb, fb)
    for n in left.keys() & right.keys():
        (r, x), (c, y) = left[n], right[n]
        norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))
        like[np.ix_(r, c)] = np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm != 0)
    null = (sa < 0)[:, None] | (sb < 0) & (sa != 0)[:, None] | (sa[:, None] == sb) & (ha[:, None] | hb)
    return like, null


def tiles(t: DataFrame, key: str, vector: str, tile: int = TILE) -> DataFrame:
    """(ids, sizes, holes, flat): ``tile`` rows each, a null key left out."""
    names = ["ids", "sizes", "holes", "flat"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, tile):
                part = batch.slice(k, tile)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _pack(part.column(0), part.column(1))], names)

    source = t.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("x")).where("i IS NOT NULL")
    return source.mapInArrow(cut, "ids binary, sizes binary, holes binary, flat binary")


def against(queries: DataFrame, t: DataFrame, key: str, vector: str, tile: int = TILE) -> DataFrame:
    """(i, j, cosine) of every query i with every row j of another key, in blocks; repeated rows pair each, a null key with nothing."""
    names = ["ids", "sizes", "holes", "flat"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, holes, flat, *other = (np.frombuffer(c[k].as_buffer(), kind) for c, kind in zip(batch.columns, (np.int64, np.int64, bool, np.float64) * 2))
                like, null = cosines((sizes, holes, flat), tuple(other[1:]))
                r, c = np.nonzero(ids[:, None] != other[0])
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(other[0][c]), pa.array(like[r, c], mask=null[r, c])], ["i", "j", "cosine"])

    # blocks of a stated query set meet blocks of the table
    met = tiles(queries, key, vector, tile).crossJoin(tiles(t, key, vector, tile).toDF(*(f"other_{n}" for n in names)))
    return met.mapInArrow(meet, "i long, j long, cosine double").select("i", "j", (F.round("cosine", 6) + 0.0).alias("cosine"))


def _blocks(ids: pa.Array, vectors: pa.Array) -> tuple:
    """Sizes, holes and numbers of the vectors, for ``cosines``; and unit vectors in rows where all have one size, no holes and finite numbers."""
    sizes, holes, flat = (np.frombuffer(x, kind) for x, kind in zip(_pack(ids, vectors)[1:], (np.int64, bool, np.float64)))
    if len(sizes) == 0 or sizes[0] <= 0 or (sizes != sizes[0]).any() or holes.any() or not np.isfinite(flat).all():
        return sizes, holes, flat, None
    x = flat.reshape(len(sizes), -1)
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return sizes, holes, flat, np.divide(x, norm, out=np.zeros_like(x), where=norm != 0)


def _pair_cosines(rows: pa.Table, tile: int) -> Iterator[np.ndarray]:
    """Cosines of the pairs of different ids in one cell, some tiles at a time: between its blocks ``row`` and ``column``, or within the one that is both."""
    ids = rows["i"].to_numpy().astype(np.int64)
    own, vectors = rows["own"].to_numpy(), rows["x"].combine_chunks()
    order = np.lexsort((ids, own))  # the same tiles in every pass
    ids, own, vectors = ids[order], own[order], vectors.take(pa.array(order))
    cell = (rows["row"][0].as_py(), rows["column"][0].as_py())
    left = np.flatnonzero(own == cell[0])
    right = left if cell[0] == cell[1] else np.flatnonzero(own == cell[1])
    cut = lambda at: [(ids[part], *_blocks(pa.array(ids[part]), vectors.take(pa.array(part)))) for part in (at[k : k + tile] for k in range(0, len(at), tile))]
    a = cut(left)
    b = a if right is left else cut(right)
    for r, (i, si, hi, fi, ui) in enumerate(a):
        for c, (j, sj, hj, fj, uj) in enumerate(b):
            if right is left and c < r:
                continue
            if ui is not None and uj is not None and ui.shape[1] == uj.shape[1]:
                like, null = ui @ uj.T, None
            else:
                like, null = cosines((si, hi, fi), (sj, hj, fj))
                like = np.nan_to_num(like, nan=_NAN)
            if right is left and (c == r or i[-1] >= j[0]):
                keep = i[:, None] < j
                like = like[keep if null is None else keep & ~null]
            elif null is not None:
                like = like[~null]
            yield like.ravel()


def _counted(rows: pa.Table, spans: dict, fetched: set, bins: int) -> pa.Table:
    """(g, k, v, n) of one cell: for the k-th interval of its group how many cosines are in the v-th bin (0: below, bins + 1: beyond); of a group to be fetched how many have the value v within, None: below."""
    g, tally = rows["g"][0].as_py(), {}
    for like in _pair_cosines(rows, TILE):
        for k, (low, high) in enumerate(spans[g]):
            if g in fetched:
                value, n = np.unique(like[(like > low) & (like < high)], return_counts=True)
                found = [(None, int((like <= low).sum())), *zip(value.tolist(), n.tolist())]
            else:
                place = like - low
                place *= bins / (high - low)
                place += 1
                n = np.bincount(np.clip(place, 0, bins + 1, out=place).astype(np.intp), minlength=bins + 2)
                found = [(float(v), int(n[v])) for v in np.flatnonzero(n)]
            for v, n in found:
                tally[k, v] = tally.get((k, v), 0) + n
    return pa.table({"g": pa.array([g] * len(tally), rows.schema.field("g").type), "k": pa.array([k for k, _ in tally], pa.int32()), "v": pa.array([v for _, v in tally], pa.float64()), "n": pa.array(list(tally.values()), pa.int64())})


def _large_medians(cells: DataFrame, groups: list, bins: int, most: int) -> dict:
    """The median of each group by passes over its cells; nothing for a group without a pair."""
    kind = cells.schema["g"].dataType.simpleString()
    spans = {g: [(-1.001, _NAN + 1)] for g in groups}  # where the ranks are, whose mean is the median
    ranks: dict = {}
    fetched: set = set()
    out: dict = {}
    while spans:

        def now(rows: pa.Table) -> pa.Table:
            return _counted(rows, spans, fetched, bins)  # noqa: B023

        sums = cells.where(F.col("g").isin(list(spans))).groupBy("g", "row", "column").applyInArrow(now, f"g {kind}, k int, v double, n long").groupBy("g", "k", "v").agg(F.sum("n").alias("n"))
        tallies: dict = {}
        for r in sums.orderBy("g", "k", F.col("v").asc_nulls_first()).collect():
            tallies.setdefault(r["g"], {}).setdefault(r["k"], []).append((r["v"], r["n"]))
        left: dict = {}
        for g, own in spans.items():
            if g not in ranks:
                total = sum(n for _, n in tallies.get(g, {}).get(0, []))
                ranks[g] = sorted({(total - 1) // 2, total // 2}) if total else []
            values, inside = [], {}
            for rank in ranks[g]:
                for k, (low, high) in enumerate(own):
                    tally = tallies[g].get(k, [])
                    at = int(np.searchsorted(np.cumsum([n for _, n in tally]), rank, "right"))
                    v, n = tally[at] if at < len(tally) else (None, 0)
                    if v is None or g not in fetched and not 1 <= v <= bins:
                        continue
                    step = (high - low) / bins
                    edge, slack = low + (v - 1) * step, step / 1000 + 4e-16  # a cosine at an edge may be rounded to its other side
                    values.append(v)
                    inside[edge - slack, edge + step + slack] = n
                    break
            if len(values) < len(ranks[g]):
                raise RuntimeError(f"the cosines of {g} changed between passes")
            if ranks[g] and g in fetched:
                out[g] = math.nan if max(values) == _NAN else sum(values) / len(values)
            elif ranks[g]:
                left[g] = list(inside)
                if all(n <= most or high - low < 1e-12 for (low, high), n in inside.items()):
                    fetched.add(g)
        spans = left
    return out


def group_medians(t: DataFrame, group: str, key: str, vector: str, whole: int = WHOLE, block: int = BLOCK, bins: int = BINS, most: int = MOST) -> DataFrame:
    """(group, m): the exact median cosine of all pairs of different keys in each group; groups without a pair are left out.

    A group of up to ``whole`` rows is one task's work.  A larger one is cut into blocks by a checksum of the key, and every two blocks
    are a cell that any task may take.  Cosines are not kept: a pass counts them in equal bins, the next one counts within the bin
    that holds the median, and when that has ``most`` cosines at most, or is too narrow to cut, they are fetched with their counts.
    """
    spark = t.sparkSession
    kind = t.schema[group].dataType.simpleString()
    held = t.select(F.col(group).alias("g"), F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("x")).where("g IS NOT NULL AND i IS NOT NULL")
    large = {r[0]: r[1] for r in held.groupBy("g").count().where(F.col("count") > whole).collect()}  # one for ``whole`` vectors at most

    def median(rows: pa.Table) -> pa.Table:
        for c in ("own", "row", "column"):
            rows = rows.append_column(c, pa.array(np.zeros(rows.num_rows, np.int64)))
        like = np.sort(np.concatenate(list(_pair_cosines(rows, TILE))))
        middle = like[(len(like) - 1) // 2 : len(like) // 2 + 1]
        m = None if not len(like) else math.nan if middle[-1] == _NAN else float(middle.mean())
        return pa.table([rows["g"][:1], pa.array([m], pa.float64())], [group, "m"])

    small = held.where(~F.col("g").isin(list(large))) if large else held
    found = small.groupBy("g").applyInArrow(median, f"`{group}` {kind}, m double").where("m IS NOT NULL")
    names = list(large)
    for part in (names[k : k + WAVE] for k in range(0, len(names), WAVE)):
        sizes = spark.createDataFrame([(g, -(-large[g] // block)) for g in part], f"g {kind}, blocks long")
        own = held.join(F.broadcast(sizes), "g").withColumn("own", F.pmod(F.xxhash64("i"), "blocks"))
        met = own.select("g", "i", "x", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        cells = met.select("g", "i", "x", "own", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"))
        medians = _large_medians(cells, part, bins, most)
        if medians:
            found = found.unionByName(spark.createDataFrame(list(medians.items()), f"`{group}` {kind}, m double"))
    return found
