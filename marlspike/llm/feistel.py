"""Token-id sequences in training order, as fixed-stride binary shards.

Each document becomes sequences of ``LENGTH`` token ids (the last one padded), numbered through in the order of
the table.  A keyed Feistel permutation of [0, n) maps a sequence's number to its global slot: a balanced network
on the least even number of bits that holds n, walked again from any value beyond n - 1 until it falls inside
(cycle-walking), so it is a bijection that needs no memory and can be inverted.  Slots are cut into shards by
range; slot s is record s % per_shard of shard s // per_shard, at byte (s % per_shard) * stride.  A reader that
was stopped at slot s opens that shard, seeks there and goes on.

A first pass encodes and writes the number of sequences of each split of the table's files; a split's first number is the
sum of those before it.  A second one encodes again (which costs less than keeping all tokens twice), permutes and
sends each batch's records to their shards, compressed; a shard's task puts them in their places of one buffer of
``PER_SHARD`` records, so nothing is sorted.  The numbers are in the shared folder, each task reads its own; nothing
is broadcast, and a task that runs again gives the same records.

Defined results
* the table's order is its files' order by path, then the rows' within; a table that isn't read from files as it is
  is written to the shared folder first;
* repeated rows are sequences of their own; a null or empty text has no sequence; a text of any length is encoded whole;
* an empty table has no slots and no shards; other columns are ignored;
* ``pad`` fills a document's last sequence; one that is a token of the vocabulary is an error.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import filesystem, output_path, shipped, work_path, written
from .words import U, mix, row_slices, texts

LENGTH = 1024
PER_SHARD = 65_536
KEY = 0x6D61726C7370696B
ROUNDS = 6
#: Fill of a document's last sequence; free in the vocabulary.
PAD = 50256
#: Splits whose numbers one task reads to find its own.
_SPLITS = 10_000
_BATCH = 32 << 20


class Permutation:
    """A keyed bijection of [0, n)."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = U((1 << self.half) - 1)
        self.keys = [mix(np.array([(key + k * 0x9E3779B97F4A7C15) % (1 << 64)], U))[0] for k in range(rounds)]

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U(self.half), x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & self.mask)
        return left << U(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(x).astype(U), back)
        while len(beyond := np.flatnonzero(out >= U(self.n))):
            out[beyond] = self._pass(out[beyond], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("block"))


def _encoded(batches: Iterator[pa.RecordBatch], at: str, length: int) -> Iterator[tuple[str, int, list, np.ndarray, np.ndarray]]:
    """(file, block, doc_ids, tokens, tokens of each document) of every run of rows from one split."""
    encoder, _ = bpe.coder(at)
    for whole in batches:
        for batch in row_slices(whole, "text"):
            file, block = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ids, counts = encoder.encode(*texts(batch.column(1), False))
            ends = np.concatenate([[0], np.cumsum(counts)])
            cuts = [0, *(k for k in range(1, len(file)) if (file[k], block[k]) != (file[k - 1], block[k - 1])), len(file)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield file[a], block[a], batch.column(0).slice(a, b - a), ids[ends[a] : ends[b]], counts[a:b]


def _splits(docs: DataFrame, at: str, length: int) -> DataFrame:
    """(file, block, size) of every split with sequences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], int] = {}
        for file, block, _, _, counts in _encoded(batches, at, length):
            sums[file, block] = sums.get((file, block), 0) + int((-(-counts // length)).sum())
        rows = [(f, b, n) for (f, b), n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "block", "size"])

    return written(_source(docs).mapInArrow(count, "file string, block long, size long").groupBy("file", "block").agg(F.sum("size").alias("size")), "splits")


def _bucket(file: str, block: int, buckets: int) -> int:
    return zlib.crc32(f"{file}|{block}".encode()) % buckets


def _placed(docs: DataFrame, vocabulary: str, length: int, per_shard: int, key: int, pad: int) -> tuple[DataFrame, int, np.dtype]:
    """(shard, data) with the records of each batch for each shard, the number of sequences and the kind of a token."""
    spark = docs.sparkSession
    merges = bpe.merges_of(vocabulary)
    if pad in merges.tokens or not 0 <= pad <= np.iinfo(merges.code).max:
        raise ValueError(f"the fill {pad} is a token of {vocabulary} or doesn't fit its ids")
    kind, at = np.dtype(merges.code).newbyteorder("<"), shipped(spark, merges, "merges")
    sizes = _splits(docs, at, length)
    if not sizes.where("file = '' OR block < 0").isEmpty():
        docs = written(docs.select("doc_id", "text"), "texts")
        sizes = _splits(docs, at, length)
    before = F.sum("size").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    parts, n = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-parts // _SPLITS))
    path = work_path(spark, "bases")
    bucket = F.pmod(F.crc32(F.concat_ws("|", "file", F.col("block").cast("string")).cast("binary")), F.lit(buckets))
    sizes.select("file", "block", "size", F.coalesce(before, F.lit(0)).alias("base"), bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(path)
    order = Permutation(max(1, n), key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base_at = filesystem(path)
        bases: dict[tuple[str, int], tuple[int, int]] = {}
        done: dict[tuple[str, int], int] = {}
        packer = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            numbers, doc, known, index, used = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(5))
            ids = np.concatenate([h[5] for h in held]) if held else np.zeros(0, kind)
            begin = np.cumsum(used) - used
            slots = order.slots(numbers) if len(numbers) else numbers
            by = np.argsort(slots, kind="stable")
            shard = slots[by] // per_shard
            edges = np.concatenate([np.flatnonzero(np.diff(shard, prepend=-1)), [len(shard)]])
            rows = []
            for a, b in zip(edges, edges[1:]):
                own = by[a:b]
                n_own = used[own]
                where = np.arange(n_own.sum()) + np.repeat(begin[own] - (np.cumsum(n_own) - n_own), n_own)
                head = np.stack([slots[own], doc[own], known[own], index[own], n_own]).astype("<i8")
                rows.append((int(shard[a]), packer.compress(np.int64(b - a).tobytes() + head.tobytes() + ids[where].tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

        for file, block, docs_, ids, counts in _encoded(batches, at, length):
            split = file, block
            if split not in bases:
                found = pq.read_table(posixpath.join(base_at, f"bucket={_bucket(file, block, buckets)}"), filesystem=files, columns=["file", "block", "base", "size"], partitioning=None).to_pylist()
                bases = {(r["file"], r["block"]): (r["base"], r["size"]) for r in found}
            n_own = -(-counts // length)
            first = bases[split][0] + done.get(split, 0)
            done[split] = done.get(split, 0) + int(n_own.sum())
            if done[split] > bases[split][1]:
                raise RuntimeError(f"{file} at {block} has more sequences than were counted")
            row = np.repeat(np.arange(len(counts)), n_own)
            index = np.arange(len(row)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
            used = np.minimum(counts[row] - index * length, length)
            doc = docs_.fill_null(0).to_numpy()
            known = docs_.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((first + np.arange(len(row)), doc[row], known[row], index, used, ids.astype(kind, copy=False)))
            size += ids.nbytes + 40 * len(row)
            if size > _BATCH:
                yield flush()
                held, size = [], 0
        yield flush()

    shards = max(1, -(-n // per_shard))
    return _source(docs).mapInArrow(cut, "shard int, data binary").repartitionById(shards, "shard"), n, kind


class Buffer:
    """The records of one shard in their places."""

    def __init__(self, shard: int, per_shard: int, n: int, length: int, kind: np.dtype, pad: int):
        self.base, self.length, self.kind = shard * per_shard, length, kind
        self.shard, self.size = shard, min(per_shard, n - shard * per_shard)
        self.records = np.full((self.size, length), pad, kind)
        self.head = np.zeros((4, self.size), np.int64)
        self.there = np.zeros(self.size, bool)

    def add(self, data: bytes) -> None:
        rows = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", 5 * rows, 8).reshape(5, rows)
        ids = np.frombuffer(data, self.kind, offset=8 + 40 * rows)
        at, used = head[0] - self.base, head[4]
        if self.there[at].any():
            raise RuntimeError(f"two records for a slot of shard {self.shard}")
        self.there[at], self.head[:, at] = True, head[1:]
        where = np.arange(len(ids)) + np.repeat(at * self.length - (np.cumsum(used) - used), used)
        self.records.reshape(-1)[where] = ids

    def columns(self, a: int, b: int) -> list[pa.Array]:
        """slot, shard, byte_offset, doc_id, sequence and n_tokens of the records from a to b - 1."""
        place = np.arange(a, b)
        doc, known, index, used = self.head[:, a:b]
        return [pa.array(self.base + place), pa.array(np.full(b - a, self.shard, np.int32)), pa.array(place * self.length * self.kind.itemsize), pa.array(doc, mask=known == 0), pa.array(index.astype(np.int32)), pa.array(used.astype(np.int32))]


_INDEX = "slot long, shard int, byte_offset long, doc_id long, sequence int, n_tokens int"
_NAMES = ["slot", "shard", "byte_offset", "doc_id", "sequence", "n_tokens"]


def _buffers(batches: Iterator[pa.RecordBatch], per_shard: int, n: int, length: int, kind: np.dtype, pad: int) -> Iterator[Buffer]:
    """The shards of one task, which has one as a rule."""
    made: dict[int, Buffer] = {}
    reader = zstandard.ZstdDecompressor()
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if shard not in made:
                made[shard] = Buffer(shard, per_shard, n, length, kind, pad)
            made[shard].add(reader.decompress(data.as_buffer()))
    for shard in sorted(made):
        if not made[shard].there.all():
            raise RuntimeError(f"shard {shard} lacks records")
        yield made.pop(shard)


def ordered(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, pad: int = PAD) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, sequence, n_tokens, record) in slot order; a record is length little-endian ids."""
    placed, n, kind = _placed(docs, vocabulary, length, per_shard, key, pad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _buffers(batches, per_shard, n, length, kind, pad):
            for a in range(0, x.size, 4096):
                b = min(x.size, a + 4096)
                records = pa.array([r.tobytes() for r in x.records[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([*x.columns(a, b), records], [*_NAMES, "record"])

    return placed.mapInArrow(run, _INDEX + ", record binary")


class Shards:
    """Shard files of one task, each written under another name and moved when it is whole."""

    def __init__(self, path: str):
        self.files, self.base = filesystem(path)
        self.files.create_dir(self.base, recursive=True)
        self.now, self.out, self.hidden, self.rows = None, None, "", []
        self.count = self.size = 0

    def put(self, shard: int, data: bytes) -> None:
        if shard != self.now:
            self.close()
            self.now, self.count, self.size = shard, 0, 0
            self.hidden = posixpath.join(self.base, f".{shard}-{uuid.uuid4().hex}")
            self.out = self.files.open_output_stream(self.hidden)
        self.out.write(data)
        self.count, self.size = self.count + 1, self.size + len(data)

    def close(self) -> None:
        if self.now is not None:
            self.out.close()
            self.files.move(self.hidden, posixpath.join(self.base, shard_name(self.now)))
            self.rows.append((self.now, shard_name(self.now), self.count, self.size))
            self.now = None


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def write_shards(sequenced: DataFrame, path: str) -> DataFrame:
    """Write what ``ordered`` gives as files shard-NNNNNN.bin when the result is computed: (shard, file, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path)
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shards.put(shard, data)
        shards.close()
        rows = shards.rows
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["shard", "file", "records", "bytes"])

    return sequenced.select("shard", "record").mapInArrow(run, "shard int, file string, records long, bytes long")


def write_indexed(docs: DataFrame, path: str, vocabulary: str = bpe.VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, pad: int = PAD) -> DataFrame:
    """Write the shards of ``ordered`` as ``write_shards`` does; the result has each record's place: (slot, shard, byte_offset, doc_id, sequence, n_tokens, file)."""
    placed, n, kind = _placed(docs, vocabulary, length, per_shard, key, pad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path)
        for x in _buffers(batches, per_shard, n, length, kind, pad):
            for a in range(0, x.size, 1024):
                shards.put(x.shard, x.records[a : a + 1024].tobytes())
            shards.close()
            yield pa.RecordBatch.from_arrays([*x.columns(0, x.size), pa.array([shard_name(x.shard)] * x.size, pa.string())], [*_NAMES, "file"])

    return placed.mapInArrow(run, _INDEX + ", file string")


def materialised(docs: DataFrame) -> DataFrame:
    """The index of the shards; their files stay in the cluster's shared folder (``common.OUTPUTS`` has the path)."""
    return write_indexed(docs, output_path(docs.sparkSession, "shards"))


def read_slots(path: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences of slots start to stop - 1, read one after the other from where ``start`` is."""
    files, base = filesystem(path)
    stride, slot = length * np.dtype(kind).itemsize, start
    while slot < stop:
        shard, at = divmod(slot, per_shard)
        with files.open_input_file(posixpath.join(base, shard_name(shard))) as data:
            data.seek(at * stride)
            for _ in range(min(stop - slot, per_shard - at)):
                yield np.frombuffer(data.read(stride), kind)
                slot += 1
