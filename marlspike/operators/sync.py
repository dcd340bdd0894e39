"""Planning of a sync: what is on disk against what is stored, and listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .search import in_scope


def stored_files(chunks: DataFrame, windows: bool = False) -> DataFrame:
    """(key, paths, low, high, whole) of each stored file, however its path was spelled; whole: every chunk has a hash."""
    return chunks.groupBy(tx.path_key(F.col("filePath"), windows).alias("key")).agg(F.sort_array(F.collect_set("filePath")).alias("paths"), F.min("contentHash").alias("low"), F.max("contentHash").alias("high"), (F.count("contentHash") == F.count("*")).alias("whole"))


def _under(key: Column, paths: Iterable[str], windows: bool) -> Column:
    """The key is that of one of the paths or below it."""
    found = F.lit(False)
    mark = "\\" if windows else "/"
    for path in paths:
        own = tx.path_key(F.lit(path), windows)
        found = found | (key == own) | key.startswith(F.when(own == mark, own).otherwise(F.concat(own, F.lit(mark))))
    return found


def plan_sync(disk: DataFrame, chunks: DataFrame, roots: Iterable[str] = ("/",), protected: Iterable[str] = (), file: str | None = None, db: str | None = None, windows: bool = False) -> DataFrame:
    """(filePath, action, paths): skip what is equal, upsert what differs or is new, prune what is gone, keep the rest.

    paths are the stored spellings that an upsert or a prune takes away beside the file's own one.  Only what is under
    ``roots`` is pruned (with ``file``, that file alone), and nothing under ``protected`` (unread folders, exclusions) or
    among the raw data of ``db``.  Spellings of one path are one file; with several stored, it is upserted.
    """
    keyed = disk.withColumn("key", tx.path_key(F.col("filePath"), windows))
    own = Window.partitionBy("key").orderBy("filePath")
    seen = keyed.withColumn("n", F.row_number().over(own)).where("n = 1").select("key", F.col("filePath").alias("found"), F.col("contentHash").alias("now"))
    both = seen.join(stored_files(chunks, windows), "key", "full_outer")
    same = F.coalesce((F.size("paths") == 1) & F.col("whole") & (F.col("low") == F.col("now")) & (F.col("high") == F.col("now")), F.lit(False))
    asked = F.col("key") == tx.path_key(F.lit(file), windows) if file else _under(F.col("key"), roots, windows)
    raw = F.exists("paths", lambda p: tx.is_raw_path(p, db)) if db else F.lit(False)
    gone = asked & ~_under(F.col("key"), protected, windows) & ~F.coalesce(raw, F.lit(False))
    action = F.when(F.col("found").isNotNull(), F.when(same, "skip").otherwise("upsert")).when(gone, "prune").otherwise("keep")
    path = F.coalesce("found", F.get("paths", F.lit(0)))
    return both.select(path.alias("filePath"), action.alias("action"), F.filter(F.coalesce("paths", F.array().cast("array<string>")), lambda p: p != path).alias("paths"))


def listed(disk: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files on disk with how many chunks are stored of each and the latest time."""
    stored = chunks.groupBy("filePath").agg(F.count("*").alias("chunkCount"), F.max("timestamp").alias("timestamp"))
    return disk.select("filePath").distinct().join(stored, "filePath", "left").select("filePath", F.col("chunkCount").isNotNull().alias("ingested"), F.coalesce("chunkCount", F.lit(0)).cast("long").alias("chunkCount"), "timestamp")


def sources(disk: DataFrame, chunks: DataFrame, scope: str | Iterable[str] | None = None, db: str | None = None) -> DataFrame:
    """Stored files that aren't on disk: raw data (of ``db``, in any scope) or orphans (in the scope)."""
    found = chunks.select("filePath").distinct().join(disk.select("filePath"), "filePath", "left_anti")
    if not scope:
        return found
    raw = tx.is_raw_path(F.col("filePath"), db) if db else F.lit(False)
    return found.where(raw | in_scope(F.col("filePath"), scope))


def nested_roots(roots: DataFrame) -> DataFrame:
    """(root, ancestor) of each different root: the nearest root it lies in that lies in none itself, null for such a one.

    Every folder above a root is looked up by its name, so no root meets every other.
    """
    named = roots.select("root").distinct()
    parts = F.split("root", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    folders = named.select("root", F.explode(above).alias("folder")).where("folder <> '' AND folder <> root")
    inside = folders.join(named.select(F.col("root").alias("folder")), "folder")
    lost = inside.select("root").distinct()
    whole = inside.join(lost.select(F.col("root").alias("folder")), "folder", "left_anti")
    nearest = whole.groupBy("root").agg(F.max_by("folder", F.length("folder")).alias("ancestor"))
    return named.join(nearest, "root", "left")
