"""What the training-data operators share: tables, the cluster's shared folder, work tables and scratch streams.

Work that outlives one job (a written table, an archive, spilled runs) goes to the folder that the session
names in ``spark.checkpoint.dir``; every executor can read it, so a lost executor loses nothing.  Where the
setting is missing a local session (tests) gets a folder of its own and a cluster gets an error.
"""

from __future__ import annotations

import atexit
import ctypes
import pickle
import posixpath
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_LIVE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors share."""
    at = spark.conf.get(SETTING, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="marlspike-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set(SETTING, at)
    return at.rstrip("/") if "://" in at or at.startswith("file:") else "file://" + at.rstrip("/")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path inside it."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; the end of the process removes it."""
    path = f"{shared_dir(spark)}/marlspike/{name}-{uuid.uuid4().hex[:12]}"
    if not _LIVE:
        atexit.register(release)
    _LIVE.append(path)
    return path


#: Outputs that queries have written in this process.
OUTPUTS: list[str] = []


def output_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for files that are a query's output: they stay until their user removes them."""
    path = f"{shared_dir(spark)}/marlspike/{name}-{uuid.uuid4().hex[:12]}"
    OUTPUTS.append(path)
    return path


def release() -> None:
    """Remove the work tables made so far."""
    gone, _LIVE[:] = _LIVE[:], []
    for uri in gone:
        try:
            files, path = filesystem(uri)
            if files.get_file_info(path).type != pafs.FileType.NotFound:
                files.delete_dir(path)
        except OSError:
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a work table and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, what: object, name: str) -> str:
    """Put an object in the shared folder, for ``loaded`` in the workers; nothing is broadcast, whatever its size."""
    path = work_path(spark, name)
    files, at = filesystem(path)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(posixpath.join(at, "object")) as out:
        out.write(pickle.dumps(what, protocol=5))
    return path


def loaded(path: str) -> object:
    files, at = filesystem(path)
    with files.open_input_stream(posixpath.join(at, "object")) as data:
        return pickle.loads(data.read())


_KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What a Python worker keeps of this kind from one task to the next."""
    return _KEPT.setdefault(kind, {})


def forget(kind: str | None) -> None:
    """Drop what is kept of other kinds, and give free memory back to the system: Arrow and the C library hold on to it."""
    for other, own in _KEPT.items():
        if other != kind:
            own.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that serves several operators: it keeps ``kind`` alone, and no free memory after the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(kind)
        try:
            yield from run(batches)
        finally:
            forget(kind)

    return task


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have in any spelling, one for each wanted name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Sequential files of one task in the shared folder, removed when the task is over."""

    def __init__(self, uri: str):
        self.files, base = filesystem(uri)
        self.base = posixpath.join(base, f"scratch-{uuid.uuid4().hex}")
        self.made = False
        self.n = 0

    def new(self) -> str:
        if not self.made:
            self.files.create_dir(self.base, recursive=True)
            self.made = True
        self.n += 1
        return posixpath.join(self.base, str(self.n))

    def writer(self, path: str):
        return self.files.open_output_stream(path)

    def reader(self, path: str):
        return self.files.open_input_stream(path)

    def drop(self, path: str) -> None:
        self.files.delete_file(path)

    def close(self) -> None:
        if self.made:
            self.files.delete_dir(self.base)


def put_record(stream, record: object) -> int:
    data = pickle.dumps(record, protocol=5)
    stream.write(struct.pack("<I", len(data)) + data)
    return len(data)


def records(stream) -> Iterator[object]:
    while head := stream.read(4):
        yield pickle.loads(stream.read(struct.unpack("<I", head)[0]))
