"""The chunk table and its n-gram index as immutable Parquet folders under a manifest with an atomic pointer.

Rows are in ``BUCKETS`` buckets by a checksum of their path.  A commit writes the buckets that it touches into new folders
(an insertion only adds a folder to them), then a manifest that lists every bucket's folders, and then moves
the pointer; readers see one state or the next and a failed commit leaves the old one.  Beside each bucket's rows are
their postings, by a checksum of the gram, so that a query reads the lists of its own grams and no text; the manifest
has the number of indexed rows and the sum of their lengths.

The folder may be on any file system that Spark and pyarrow both know; a path without a scheme is a local one.
"""

from __future__ import annotations

import json
import os
import posixpath
import time
import uuid
import zlib
from collections.abc import Iterable

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ngrams
from ..operators.search import in_scope

_META = T.StructType([T.StructField("fileName", T.StringType()), T.StructField("fileSize", T.LongType()), T.StructField("fileType", T.StringType())])
_KINDS = [("id", T.StringType()), ("filePath", T.StringType()), ("chunkIndex", T.IntegerType()), ("text", T.StringType()), ("vector", T.ArrayType(T.FloatType())), ("metadata", _META), ("fileTitle", T.StringType()), ("contentHash", T.StringType()), ("timestamp", T.StringType())]
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _KINDS])
POSTINGS = T.StructType([T.StructField("filePath", T.StringType()), T.StructField("chunkIndex", T.IntegerType()), T.StructField("gram", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])
LISTS = T.StructType([T.StructField("filePath", T.StringType()), T.StructField("gram", T.StringType()), *(T.StructField(c, T.ArrayType(k)) for c, k in (("chunkIndexes", T.IntegerType()), ("tfs", T.IntegerType()), ("dls", T.LongType())))])
#: Seconds that a replaced folder stays for readers that are under way.
GRACE = 60.0
#: Buckets of a new store; a large one takes more, as a deletion rewrites whole buckets.
BUCKETS = 16
#: Bytes of a row group: what a read of a few neighbours takes at least.
GROUP_BYTES = 16 << 20
#: Folders of one bucket's postings.
PARTS = 16


def bucket_of(path: str, buckets: int) -> int:
    return zlib.crc32(path.encode()) % buckets


def _checksum(column: str, n: int) -> F.Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(column, F.lit("")), "UTF-8")), F.lit(n)).cast("int")


def _may_hold(group: pq.RowGroupMetaData, wanted: dict[str, tuple]) -> bool:
    """Whether a row group's statistics leave room for values in the wanted ranges."""
    for k in range(group.num_columns):
        column = group.column(k)
        if (limits := wanted.get(column.path_in_schema)) and (s := column.statistics) and s.has_min_max and (s.max < limits[0] or s.min > limits[1]):
            return False
    return True


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path.rstrip("/") if "://" in path else "file://" + os.path.abspath(path)
        self.files_, self.base = pafs.FileSystem.from_uri(self.path)

    def _bytes(self, name: str) -> bytes | None:
        try:
            with self.files_.open_input_stream(posixpath.join(self.base, name)) as data:
                return data.read()
        except FileNotFoundError:
            return None

    def _put(self, name: str, data: bytes) -> None:
        """Write under another name and move, so that no reader sees half of it."""
        self.files_.create_dir(self.base, recursive=True)
        hidden = posixpath.join(self.base, f".{uuid.uuid4().hex}")
        with self.files_.open_output_stream(hidden) as out:
            out.write(data)
        self.files_.move(hidden, posixpath.join(self.base, name))

    def version(self) -> str | None:
        now = self._bytes("_CURRENT")
        return now.decode().strip() if now else None

    def manifest(self) -> dict:
        now = self.version()
        return json.loads(self._bytes(now)) if now else {"buckets": self.buckets, "rows": {}, "grams": {}, "totals": {}}

    def _rows(self, folders: list[str]) -> DataFrame:
        """Rows of some folders; columns that an older folder lacks are null, empty titles and hashes too."""
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("fileTitle", "contentHash")})

    def read(self) -> DataFrame:
        return self._rows([f for own in self.manifest()["rows"].values() for f in own])

    def of_file(self, path: str) -> DataFrame:
        """The rows of exactly this path, from its bucket alone."""
        m = self.manifest()
        return self._rows(m["rows"].get(str(bucket_of(path, m["buckets"])), [])).where(F.col("filePath") == path)

    def postings(self, grams: list[str]) -> tuple[DataFrame, int, float]:
        """(filePath, chunkIndex, gram, tf, dl) of the rows that have the grams, how many rows are indexed and their mean length."""
        m = self.manifest()
        n, total = (sum(x[k] for x in m["totals"].values()) for k in range(2))
        parts = {f"part={zlib.crc32(g.encode()) % PARTS}" for g in grams}
        folders = [f"{self.path}/{f}" for own in m["grams"].values() for f in own if f.rsplit("/", 1)[1] in parts]
        of_kind = lambda kind, schema: self.spark.read.schema(schema).parquet(*own) if (own := [f for f in folders if f.rsplit("/", 3)[1] == kind]) else self.spark.createDataFrame([], schema)
        wanted = F.col("gram").isin(grams)
        # older folders have a row for each posting
        found = ngrams.flat(of_kind("lists", LISTS).where(wanted)).unionByName(of_kind("grams", POSTINGS).where(wanted))
        return found, n, total / max(1, n)

    def _write(self, rows: DataFrame, touched: set[int] | None, add: bool) -> None:
        """``rows`` instead of (or, to ``add``, beside) what the touched buckets have, in one commit; None: all buckets."""
        m = self.manifest()
        touched = set(range(m["buckets"])) if touched is None else touched
        name = f"c-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        fields = rows.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])
        spread = fields.withColumn("bucket", _checksum("filePath", m["buckets"])).hint("rebalance", "bucket").sortWithinPartitions("bucket", "filePath", "chunkIndex")
        spread.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(f"{self.path}/{name}/rows")
        folder = lambda kind, b: f"{name}/{kind}/bucket={b}"
        there = lambda kind: {b for b in touched if self.files_.get_file_info(posixpath.join(self.base, folder(kind, b))).type != pafs.FileType.NotFound}
        made = there("rows")
        if made:
            new = self.spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{name}/rows").where("text IS NOT NULL")
            listed = ngrams.posting_lists(new, "bucket").withColumn("part", _checksum("gram", PARTS))
            listed.hint("rebalance", "bucket", "part").sortWithinPartitions("bucket", "part", "gram").write.option("compression", "zstd").partitionBy("bucket", "part").parquet(f"{self.path}/{name}/lists")
            totals = {r[0]: (r[1], r[2]) for r in new.groupBy("bucket").agg(F.count("*"), F.sum(ngrams.length(F.lower("text")))).collect()}
        parts = {b: sorted(x.base_name for x in self.files_.get_file_info(pafs.FileSelector(posixpath.join(self.base, folder("lists", b)))) if x.type == pafs.FileType.Directory) for b in (there("lists") if made else ())}
        for b in touched:
            key = str(b)
            old = {k: m[k].get(key, [] if k != "totals" else [0, 0]) if add else ([] if k != "totals" else [0, 0]) for k in ("rows", "grams", "totals")}
            n, dl = totals.get(b, (0, 0)) if made else (0, 0)
            new_ = {"rows": old["rows"] + [folder("rows", b)] * (b in made), "grams": old["grams"] + [f"{folder('lists', b)}/{x}" for x in parts.get(b, ())], "totals": [old["totals"][0] + n, old["totals"][1] + int(dl or 0)]}
            for k, v in new_.items():
                if new_["rows"]:
                    m[k][key] = v
                else:
                    m[k].pop(key, None)
        manifest = f"m-{name[2:]}.json"
        self._put(manifest, json.dumps(m).encode())
        self._put("_CURRENT", manifest.encode())

    def insert(self, rows: DataFrame) -> None:
        n = self.manifest()["buckets"]
        touched = {r[0] for r in rows.select(_checksum("filePath", n)).distinct().collect()}
        if touched:
            self._write(rows, touched, True)

    def replace_files(self, rows: DataFrame, paths: Iterable[str]) -> None:
        """Rows of ``paths`` go and ``rows`` come, in one commit that rewrites the buckets of what goes."""
        m = self.manifest()
        paths = list(paths)
        gone = self.spark.createDataFrame([(p,) for p in paths], "filePath string")
        old = {bucket_of(p, m["buckets"]) for p in paths}
        stored = self._rows([f for b in sorted(old) for f in m["rows"].get(str(b), [])])
        touched = old | {r[0] for r in rows.select(_checksum("filePath", m["buckets"])).distinct().collect()}
        if stored.join(gone, "filePath", "left_semi").isEmpty():
            if touched:
                self._write(rows, touched, True)
            return
        kept = self._rows([f for b in sorted(touched) for f in m["rows"].get(str(b), [])]).join(gone, "filePath", "left_anti")
        self._write(kept.unionByName(rows), touched, False)

    def delete(self, path: str) -> int:
        """Removes the rows of exactly this path; how many they were."""
        n = self.of_file(path).count()
        if n:
            m = self.manifest()
            b = bucket_of(path, m["buckets"])
            self._write(self._rows(m["rows"][str(b)]).where(~F.col("filePath").eqNullSafe(F.lit(path))), {b}, False)
        return n

    def optimize(self, grace: float = GRACE) -> None:
        """Buckets of several folders become one each, with their postings; folders that are in no manifest and older than ``grace`` seconds go."""
        m = self.manifest()
        many = {int(b) for b, own in m["rows"].items() if len(own) > 1}
        if many:
            self._write(self._rows([f for b in sorted(many) for f in m["rows"][str(b)]]), many, False)
        now = self.version()
        if now is None:
            return
        m = self.manifest()
        used = {f.split("/")[0] for kind in ("rows", "grams") for own in m[kind].values() for f in own}
        for info in self.files_.get_file_info(pafs.FileSelector(self.base)):
            stem = info.base_name.removesuffix(".json")
            if stem[:2] in ("c-", "m-") and info.base_name != now and stem not in used and time.time_ns() - int(stem.split("-")[1]) > grace * 1e9:
                (self.files_.delete_dir if info.type == pafs.FileType.Directory else self.files_.delete_file)(info.path)

    def drop_hidden(self, prefix: str) -> None:
        """Remove the folders beside the rows whose names begin so."""
        for info in self.files_.get_file_info(pafs.FileSelector(self.base, allow_not_found=True)):
            if info.base_name.startswith(prefix):
                self.files_.delete_dir(info.path)

    def files(self, scope: str | list[str] | None = None) -> DataFrame:
        rows = self.read().where("filePath IS NOT NULL")
        if scope:
            rows = rows.where(in_scope(F.col("filePath"), scope))
        return rows.groupBy("filePath").agg(F.count("*").alias("chunkCount"), F.max("timestamp").alias("timestamp"))

    def chunk_range(self, path: str, low: int, high: int) -> DataFrame:
        if low < 0 or high < low:
            raise ValueError("a range goes from 0 at least to its end")
        return self.of_file(path).where(F.col("chunkIndex").between(low, high)).select("filePath", "chunkIndex", "text", "fileTitle").orderBy("chunkIndex")

    def range_rows(self, path: str, low: int, high: int) -> list[dict]:
        """The rows of ``chunk_range``, read here and now without a Spark job: a range is a few row groups of one bucket."""
        if low < 0 or high < low:
            raise ValueError("a range goes from 0 at least to its end")
        m = self.manifest()
        names = ["filePath", "chunkIndex", "text", "fileTitle"]
        rows: list[dict] = []
        for folder in m["rows"].get(str(bucket_of(path, m["buckets"])), []):
            files = [x.path for x in self.files_.get_file_info(pafs.FileSelector(posixpath.join(self.base, folder))) if x.base_name.endswith(".parquet")]
            for file in files:
                with self.files_.open_input_file(file) as data:
                    held = pq.ParquetFile(data)
                    there = [c for c in names if c in held.schema_arrow.names]
                    for group in range(held.num_row_groups):
                        if _may_hold(held.metadata.row_group(group), {"filePath": (path, path), "chunkIndex": (low, high)}):
                            found = held.read_row_group(group, there)
                            keep = pc.and_(pc.equal(found["filePath"], path), pc.and_(pc.greater_equal(found["chunkIndex"], low), pc.less_equal(found["chunkIndex"], high)))
                            rows += found.filter(keep).to_pylist()
        return sorted(({c: r.get(c) or None if c == "fileTitle" else r.get(c) for c in names} for r in rows), key=lambda r: r["chunkIndex"])

    def status(self) -> dict[str, int]:
        n, files = self.read().agg(F.count("*"), F.count_distinct("filePath")).first()
        return {"documentCount": files, "chunkCount": n}
