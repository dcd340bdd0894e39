"""New and changed files of a folder as a stream into the store; deletions are found by the engine's sync alone."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..service import Engine
from ..sources.readers import FORMATS


def follow(engine: Engine, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its files' chunks in one commit; a repeated batch changes nothing.

    A batch waits for a change that is under way.  Files that can't be read are warned about and left as they are stored.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = engine.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    known = files.where(F.lower("path").rlike("(" + "|".join(f.replace(".", "\\.") for f in FORMATS) + ")$"))

    def take(batch: DataFrame, _: int) -> None:
        paths = [r[0] for r in batch.distinct().collect()]
        if paths:
            with engine._write_lock(wait=True):
                found = engine._parsed(paths)
                staged = engine._stage(found)
                for path, error in found.where("error IS NOT NULL").select("filePath", "error").collect():
                    warnings.warn(f"{path}: {error}", stacklevel=2)
                made = [r[0] for r in staged.select("filePath").distinct().collect()]
                if made:
                    engine.store.replace_files(staged, made)

    return known.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
