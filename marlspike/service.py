"""The engine's tools over one store: query, ingest, neighbours, list, delete, status, sync."""

from __future__ import annotations

import datetime
import json
import os
import re
import resource
import threading
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import chunker, search, sync
from .sources import readers, scan
from .sources.store import SCHEMA, Store


@dataclass
class Settings:
    """As in the environment: a value that makes no sense is left out with a warning."""

    roots: list[str] = field(default_factory=lambda: [os.getcwd()])
    grouping: str | None = None
    max_distance: float | None = None
    max_files: int | None = None
    hybrid_weight: float = search.WEIGHT
    shortest: int = chunker.SHORTEST
    most_bytes: int = readers.MOST_BYTES
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def from_env(cls, env: dict[str, str]) -> Settings:
        made = cls()

        def take(name: str, attribute: str, kind: Callable, fits: Callable) -> None:
            if raw := env.get(name, "").strip():
                try:
                    value = kind(raw)
                except ValueError:
                    value = None
                if value is not None and fits(value):
                    setattr(made, attribute, value)
                else:
                    made.warnings.append(f"{name}={raw} is ignored")

        take("RAG_GROUPING", "grouping", str, lambda v: v in ("similar", "related"))
        take("RAG_MAX_DISTANCE", "max_distance", float, lambda v: 0 < v < float("inf"))
        take("RAG_MAX_FILES", "max_files", int, lambda v: v >= 1)
        take("RAG_HYBRID_WEIGHT", "hybrid_weight", float, lambda v: 0 <= v <= 1)
        take("CHUNK_MIN_LENGTH", "shortest", int, lambda v: 1 <= v <= 10_000)
        take("MAX_FILE_SIZE", "most_bytes", int, lambda v: 1 << 20 <= v <= 500 << 20)
        if raw := env.get("BASE_DIRS", "").strip():
            roots = json.loads(raw)
            if not isinstance(roots, list) or not roots or not all(isinstance(r, str) and r.strip() for r in roots):
                raise ValueError("BASE_DIRS must be a JSON list of folders")
            nested = scan.nested_roots(r.strip() for r in roots)
            made.roots = [r for r, ancestor in nested.items() if ancestor is None]
            made.warnings += [f"{scan.shown(r)} is inside {scan.shown(a)}" for r, a in nested.items() if a]
        elif raw := env.get("BASE_DIR", "").strip():
            made.roots = [raw]
        return made

    def checked(self) -> Settings:
        """Itself, if no root is a folder of the system or of keys."""
        for root in self.roots:
            if scan.sensitive(root):
                raise ValueError(f"{root} can't be a document folder")
        return self


_JOB = re.compile(r"[0-9a-fA-F-]{1,128}")


class Engine:
    """embed gives unit vectors of a list of texts; pdf gives the pages of a PDF file's bytes (``operators.pdf.Document``);
    caption gives a text for a page number and a PDF file's bytes.  They are sent to the workers."""

    def __init__(self, spark: SparkSession, db: str, settings: Settings | None = None, embed: Callable[[list[str]], np.ndarray] = chunker.hashed_vectors, pdf: Callable | None = None, caption: Callable | None = None):
        self.spark, self.db, self.settings, self.embed, self.pdf = spark, os.path.abspath(db), (settings or Settings()).checked(), embed, pdf
        self.caption = caption
        self._began = time.monotonic()
        self.store = Store(spark, os.path.join(self.db, "chunks"))
        self._writing = threading.Lock()
        self._job: dict | None = None

    def _rows(self, files: DataFrame) -> DataFrame:
        """Rows of the store from (filePath, contentHash, text, title, ranges, captions); one pass, nothing is shuffled."""
        embed, shortest = self.embed, self.settings.shortest

        def run(batches):
            for batch in batches:
                for path, digest, text, title, ranges, captions in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    parts = chunker.chunks_of(text or "", embed, shortest, ranges=[(r["start"], r["end"]) for r in ranges or []]) + (captions or [])
                    vectors = chunker.embedded(parts, embed).tolist()
                    columns = [[str(uuid.uuid4()) for _ in parts], [path] * len(parts), range(len(parts)), parts, vectors, [chunker.units(text or "")] * len(parts), [title] * len(parts), [digest] * len(parts)]
                    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.float32()), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "filePath", "chunkIndex", "text", "vector", "size", "fileTitle", "contentHash"])

        name = F.regexp_extract("filePath", "([^/]+)$", 1)
        own = F.when(F.col("title") != "", F.col("title"))
        title = F.coalesce(own, F.when(F.lower("filePath").endswith(".md"), tx.markdown_title(F.col("text"), name)).when(F.lower("filePath").endswith(".txt"), tx.txt_title(F.col("text"), name)).otherwise(tx.name_title(name)))
        made = files.select("filePath", "contentHash", "text", title.alias("title"), "ranges", "captions").mapInArrow(run, "id string, filePath string, chunkIndex int, text string, vector array<float>, size long, fileTitle string, contentHash string")
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        kind = F.regexp_extract(name, r"\.([^.]+)$", 1)
        return made.select("id", "filePath", "chunkIndex", "text", "vector", F.struct(name.alias("fileName"), F.col("size").alias("fileSize"), kind.alias("fileType")).alias("metadata"), "fileTitle", "contentHash", F.lit(now).alias("timestamp")).select(*SCHEMA.names)

    def _write(self, wait: bool = False):
        if not self._writing.acquire(blocking=wait):
            raise RuntimeError("another change is under way")
        return self._writing

    def query_documents(self, query: str, limit: int = 10, scope: str | list[str] | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("the query is empty")
        if not isinstance(limit, int) or isinstance(limit, bool):
            raise ValueError("the limit is a whole number")
        scope = self._scopes(scope)
        s = self.settings
        self._warn(scope)
        found = search.search(self.store.read(), self.embed([query])[0].tolist(), query, limit, scope, s.max_distance, s.grouping, s.hybrid_weight, s.max_files, self.store.postings)
        return found.select("filePath", "chunkIndex", "text", "score", "fileTitle", tx.raw_source(F.col("filePath"), self.db).alias("source"))

    @staticmethod
    def _scopes(scope: str | list[str] | None) -> list[str] | None:
        """The scopes without space around them; none may be blank."""
        if scope is None:
            return None
        found = [s.strip() if isinstance(s, str) else "" for s in ([scope] if isinstance(scope, str) else scope)]
        if not all(found):
            raise ValueError("a scope is a path or a list of paths")
        return found or None

    @staticmethod
    def _warn(scope: str | list[str] | None) -> None:
        for s in search.not_absolute(scope):
            warnings.warn(f"the scope {s} isn't an absolute path and matches nothing", stacklevel=3)

    def managed(self, path: str) -> bool:
        """The path lies among the raw data, by its spelling and by where it really is."""
        home = os.path.join(self.db, "raw-data")
        try:
            return scan.below(os.path.normpath(path), home) and scan.below(os.path.realpath(path), os.path.realpath(home))
        except OSError:
            return False

    def ingest_file(self, path: str, visual: bool = False) -> dict:
        return self.ingest_files([path], visual)[0]

    def ingest_files(self, paths: list[str], visual: bool = False) -> list[dict]:
        """Replace the files' chunks in one commit.  A file that can't be read or leaves no chunk is an error; the store is untouched then."""
        for path in paths:
            scan.validate(path, [self.db] if self.managed(path) else self.settings.roots)
        if visual and self.caption is None:
            raise ValueError("captions take a provider")
        found = self._parsed(paths, visual)
        with self._write_lock():
            staged = self._stage(found)
            made = {r[0]: tuple(r[1:]) for r in staged.groupBy("filePath").agg(F.count("*"), F.max("timestamp"), F.max("fileTitle")).collect()}
            for path in paths:
                if path not in made:
                    error = found.where(F.col("filePath") == path).select("error").first()
                    raise ValueError(f"{path}: {error[0] if error and error[0] else 'no chunk is left of it'}")
            self.store.replace_files(staged, paths)
            self.store.optimize()
        return [{"filePath": p, "chunkCount": made[p][0], "timestamp": made[p][1], "fileTitle": made[p][2]} for p in paths]

    def _parsed(self, paths: list[str], visual: bool = False) -> DataFrame:
        """The files' texts; the title of raw data is that of its sidecar."""
        files = readers.read_files(self.spark, paths, self.settings.most_bytes, self.pdf, self.caption if visual else None, self.embed)
        own = [(p, m["title"]) for p in paths if self.managed(p) and (m := self.load_meta(p)) and m.get("title")]
        if not own:
            return files
        titles = self.spark.createDataFrame(own, "filePath string, known string")
        return files.join(F.broadcast(titles), "filePath", "left").withColumn("title", F.coalesce("known", "title")).drop("known")

    @staticmethod
    def load_meta(path: str) -> dict | None:
        """The sidecar of a raw-data file: title, source and format; None if there is none."""
        try:
            with open(path[:-3] + ".meta.json") as f:
                found = json.load(f)
        except FileNotFoundError:
            return None
        if not isinstance(found, dict):
            raise ValueError(f"{path} has a sidecar that isn't an object")
        return found

    def _stage(self, files: DataFrame) -> DataFrame:
        """The rows, written once in the store's folder so that they are parsed and embedded once."""
        at = f"{self.store.path}/.staged-{uuid.uuid4().hex}"
        self._rows(files.where("error IS NULL")).write.parquet(at)
        return self.spark.read.schema(SCHEMA).parquet(at)

    def _write_lock(self, wait: bool = False):
        engine = self

        class Held:
            def __enter__(self):
                engine._write(wait)

            def __exit__(self, *_):
                engine.store.drop_hidden(".staged-")
                engine._writing.release()

        return Held()

    def raw_path(self, source: str) -> str:
        return self.spark.range(1).select(tx.raw_path(F.lit(source), self.db)).first()[0]

    def ingest_data(self, content: str, source: str, form: str = "text") -> dict:
        if not content or not source.strip() or form not in ("text", "html", "markdown"):
            raise ValueError("content, source and a format of text, html or markdown are needed")
        text, title = readers.html_markdown(content) if form == "html" else (content, "")
        path = self.raw_path(source)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        new = ((path, text), (path[:-3] + ".meta.json", json.dumps({"title": title or None, "source": source, "format": form})))
        old = {name: open(name, "rb").read() if os.path.exists(name) else None for name, _ in new}
        try:
            for name, data in new:
                self._save(name, data.encode())
            return self.ingest_file(path)
        except BaseException:
            for name, data in old.items():  # as it was before
                if data is not None:
                    self._save(name, data)
                elif os.path.exists(name):
                    os.unlink(name)
            raise

    @staticmethod
    def _save(name: str, data: bytes) -> None:
        hidden = name + f".{uuid.uuid4().hex}.new"
        with open(hidden, "wb") as f:
            f.write(data)
        os.replace(hidden, name)

    def read_chunk_neighbors(self, chunk: int, path: str | None = None, source: str | None = None, before: int = 2, after: int = 2) -> list[dict]:
        """The chunks around one in order, the target flagged; none if there are none."""
        if (path is None) == (source is None) or chunk < 0 or not (0 <= before <= 50 and 0 <= after <= 50):
            raise ValueError("either path or source, an index from 0, and 0 to 50 neighbours on either side")
        target = path or self.raw_path(source)
        known = {"source": source} if source is not None else {}
        return [r | {"isTarget": r["chunkIndex"] == chunk} | known for r in self.store.range_rows(target, max(0, chunk - before), chunk + after)]

    def _disk(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], "filePath string, contentHash string")
        found = self.spark.read.format("binaryFile").load([f"file://{p}" for p in files]).where(F.col("length") <= self.settings.most_bytes)
        return found.select(F.regexp_replace("path", "^file:/+", "/").alias("filePath"), F.sha2("content", 256).alias("contentHash"))

    def _scan(self, within: str | None = None) -> tuple[list[str], scan.Coverage]:
        files, seen = [], scan.Coverage()
        for root in scan.surviving_roots(self.settings.roots):
            own, more = scan.collect(root, [self.db], scope=[within] if within else ())
            files += own
            for f in ("unreadable", "too_deep", "symlinks"):
                getattr(seen, f).extend(getattr(more, f))
        for path in list(files):
            if os.path.getsize(path) > self.settings.most_bytes:
                seen.oversized.append(path)
                files.remove(path)
        return sorted(set(files)), seen

    def list_files(self, scope: str | list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(files on disk with what is stored of them, stored files that aren't there)."""
        scope = self._scopes(scope)
        disk = self.spark.createDataFrame([(p,) for p in self._scan()[0]], "filePath string")
        self._warn(scope)
        files, rest = sync.listed(disk, self.store.read()), sync.sources(disk, self.store.read(), scope, self.db)
        if scope:
            files = files.where(search.in_scope(F.col("filePath"), scope))
        return files.orderBy("filePath"), rest.withColumn("source", tx.raw_source(F.col("filePath"), self.db)).orderBy("filePath")

    def delete_file(self, path: str | None = None, source: str | None = None) -> dict:
        if (path is None) == (source is None):
            raise ValueError("either path or source")
        target = path or self.raw_path(source)
        with self._write_lock():
            n = self.store.delete(target)
            if n:
                self.store.optimize()
        gone = False
        if self.managed(target):
            for name in (target, target[:-3] + ".meta.json"):
                if os.path.exists(name):
                    os.unlink(name)
                    gone = True
        return {"filePath": target, "deleted": True, "removedChunks": n, "existed": n > 0 or gone, "timestamp": datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")}

    def base_dirs(self) -> dict:
        return {"baseDir": self.settings.roots[0], "baseDirs": list(self.settings.roots)}

    def status(self) -> dict:
        """Counts of the store, the driver's memory in MB and the seconds since the engine began."""
        memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        return self.store.status() | {"memoryUsage": round(memory, 1), "uptime": round(time.monotonic() - self._began, 3), "ftsIndexEnabled": True, "searchMode": "hybrid" if self.settings.hybrid_weight > 0 else "vector"}

    def sync(self, path: str | None = None, progress: Callable[[int, int], None] = lambda total, completed: None) -> dict:
        """Stored chunks brought in line with the folders (or one of them, or one file) in a single commit.

        Files are taken in order up to the first that can't be read, whose error is in the result; then nothing is
        pruned.  A file of which no chunk is left is counted as empty and keeps what is stored of it.
        """
        kind = None
        if path is not None:
            path = os.path.normpath(path.strip())
            kind = scan.requested(path, self.settings.roots, [self.db])
        if kind == "file":
            files, seen = [path], scan.Coverage()
            if os.path.getsize(path) > self.settings.most_bytes:
                files, seen.oversized = [], [path]
        else:
            files, seen = self._scan(path)
        with self._write_lock():
            plan = sync.plan_sync(self._disk(files), self.store.read(), [path] if path else self.settings.roots, [self.db, *seen.unobserved()], path if kind == "file" else None, self.db)
            todo = {a: [] for a in ("upsert", "prune", "skip")}
            for p, action, others in plan.where("action <> 'keep'").orderBy("filePath").collect():
                todo[action].append((p, others))
            total = len(todo["upsert"]) + len(todo["skip"])
            progress(total, len(todo["skip"]))
            out = {"upserted": 0, "skipped": len(todo["skip"]), "empty": 0, "pruned": 0, "error": None, "coverage": vars(seen)}
            changed, gone, staged = [p for p, _ in todo["upsert"]], [], self.spark.createDataFrame([], SCHEMA)
            if changed:
                found = self._parsed(changed)
                staged = self._stage(found)
                failed = found.where("error IS NOT NULL").orderBy("filePath").select("filePath", "error").first()
                if failed:
                    out["error"] = f"{failed[0]}: {failed[1]}"
                    changed = [p for p in changed if p < failed[0]]
                    staged = staged.where(F.col("filePath") < failed[0])
                made = {r[0] for r in staged.select("filePath").distinct().collect()}
                out |= {"upserted": len(made), "empty": len(changed) - len(made)}
                gone = [q for p, others in todo["upsert"] if p in made for q in (p, *others)]
            if not out["error"]:
                out["pruned"] = len(todo["prune"])
                gone += [q for p, others in todo["prune"] for q in (p, *others)]
            if gone:
                self.store.replace_files(staged, gone)
                self.store.optimize()
            progress(total, out["upserted"] + out["skipped"] + out["empty"])
        return out

    def sync_start(self, path: str | None = None) -> dict:
        """Sync in the background; only the latest job is remembered, and none is started while one runs."""
        if self._job and self._job["state"] == "running" or self._writing.locked():
            raise RuntimeError("another change is under way")
        job = self._job = {"jobId": str(uuid.uuid4()), "state": "running", "total": None, "completed": 0, "summary": None, "error": None}

        def step(total: int, completed: int) -> None:
            job["total"], job["completed"] = total, completed

        def run() -> None:
            try:
                job["summary"] = self.sync(path, step)
                job["error"] = job["summary"]["error"]
                job["state"] = "failed" if job["error"] else "done"
            except Exception as e:  # the job's record is where it is reported
                job["error"], job["state"] = str(e), "failed"

        threading.Thread(target=run, daemon=True).start()
        return {"jobId": job["jobId"]}

    def sync_status(self, job: str) -> dict:
        if not _JOB.fullmatch(job):
            raise ValueError("a job's id is made of hexadecimal digits and hyphens")
        if not self._job or self._job["jobId"] != job:
            raise ValueError("no such job")
        return dict(self._job)
