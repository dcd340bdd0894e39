"""Hybrid search: exact vector top-k, gap grouping, n-gram BM25 boost, file filter, limit.

``chunks`` needs filePath, chunkIndex, text and vector.  The vector scan is one pass that keeps 2 * limit rows a
task; from there on at most 40 rows are moved, so the windows over them are no bottleneck.  BM25 reads the postings
of the query's grams; without an index its statistics are one aggregation over all texts (nothing is exploded or
shuffled but one row a task), and the scores are one more scan of the candidates' files.  Ties go by filePath and chunkIndex everywhere.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_grams
from ..functions.vectors import distance_to

KEY = ["filePath", "chunkIndex"]
HITS = "filePath string, chunkIndex int, bm25 double"
K1, B = 1.2, 0.75
WEIGHT = 0.6
MOST = 20


def in_scope(path: Column, scopes: str | Iterable[str]) -> Column:
    """Path equal to a scope or below it; prefixes reach the Parquet scan."""
    found = F.lit(False)
    for scope in [scopes] if isinstance(scopes, str) else scopes:
        mark = "\\" if "\\" in scope and "/" not in scope else "/"
        exact = scope.rstrip("/\\")
        found = found | path.startswith(exact + mark) | (path == (exact or mark))
    return found


def nearest(chunks: DataFrame, vector: Sequence[float], limit: int = 10, scope: str | Iterable[str] | None = None, max_distance: float | None = None) -> DataFrame:
    """The 2 * limit nearest chunks with their distance as score; scope and distance are filtered before."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be from 1 to {MOST}, not {limit}")
    if scope:
        chunks = chunks.where(in_scope(F.col("filePath"), scope))
    scored = chunks.where("vector IS NOT NULL").withColumn("score", distance_to(vector)(F.col("vector"))).drop("vector").where("score IS NOT NULL")
    if max_distance is not None:
        scored = scored.where(F.col("score") < max_distance)
    return scored.orderBy("score", *KEY).limit(2 * limit)


def grouped(ranked: DataFrame, mode: str | None) -> DataFrame:
    """Rows before the first gap beyond mean + 1.5 deviations (similar), or before the second (related)."""
    if mode is None:
        return ranked
    order = Window.orderBy("score", *KEY)
    whole = Window.partitionBy()
    gaps = ranked.withColumn("gap", F.col("score") - F.lag("score").over(order))
    limit = F.avg("gap").over(whole) + 1.5 * F.stddev_pop("gap").over(whole)
    marked = gaps.withColumn("edge", F.coalesce((F.col("gap") > limit).cast("int"), F.lit(0)))
    cut = marked.withColumn("group", F.sum("edge").over(order))
    return cut.where(F.col("group") < (1 if mode == "similar" else 2)).drop("gap", "edge", "group")


def _occurrences(low: str, gram: str, overlaps: bool) -> int:
    if not overlaps:
        return low.count(gram)
    n, at = 0, low.find(gram)
    while at >= 0:
        n, at = n + 1, low.find(gram, at + 1)
    return n


def _counted(chunks: DataFrame, grams: list[str]) -> DataFrame:
    """(filePath, chunkIndex, dl, tf) of every chunk with a text; tf: how often each gram occurs, at every position."""
    kinds = [(g, any(g.startswith(g[k:]) for k in range(1, len(g)))) for g in grams]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([[_occurrences(t, g, o) for g, o in kinds] for t in batch.column(3).to_pylist()], np.int32).reshape(-1)
            tf = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(kinds)), pa.array(counts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], tf], [*KEY, "dl", "tf"])

    low = F.lower("text")
    length = F.greatest(F.length(low) - 1, F.lit(0)) + F.greatest(F.length(low) - 2, F.lit(0))
    # str.count over Arrow batches takes a quarter of the time of a replace for each gram in the JVM
    return chunks.where("text IS NOT NULL").select(*KEY, length.alias("dl"), low.alias("low")).mapInArrow(run, "filePath string, chunkIndex int, dl int, tf array<int>")


def bm25(chunks: DataFrame, text: str, files: list[str] | None = None) -> DataFrame:
    """(filePath, chunkIndex, bm25) of every chunk (of ``files``) that has a gram of the query."""
    wanted = query_grams(text)
    df = F.array(*[F.sum((F.get("tf", F.lit(k)) > 0).cast("long")) for k in range(len(wanted))])
    stats = _counted(chunks, wanted).agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), df.alias("df"))
    held = _counted(chunks if files is None else chunks.where(F.col("filePath").isin(files)), wanted)
    idf = lambda d: F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
    gain = lambda t: t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    score = F.aggregate(F.zip_with("tf", "df", lambda t, d: F.when(t > 0, idf(d) * gain(t)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return held.where(F.exists("tf", lambda t: t > 0)).crossJoin(F.broadcast(stats)).select(*KEY, score.alias("bm25"))


def bm25_of_postings(postings: DataFrame, rows: int, mean: float, files: list[str] | None = None) -> DataFrame:
    """As ``bm25``, from the index: ``postings`` (filePath, chunkIndex, gram, tf, dl) of the query's grams, ``rows`` indexed rows of ``mean`` length."""
    df = postings.groupBy("gram").agg(F.count("*").alias("df"))  # a row for each gram of the query
    held = postings if files is None else postings.where(F.col("filePath").isin(files))
    idf = F.log(1 + (rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / max(mean, 1e-9)))
    return held.join(F.broadcast(df), "gram").groupBy(*KEY).agg(F.sum(idf * gain).alias("bm25"))


def boosted(ranked: DataFrame, hits: DataFrame, weight: float) -> DataFrame:
    """Score over 1 + weight times the hit's share of the best hit; the best counts even if it isn't ranked."""
    share = hits.withColumn("share", F.coalesce(F.col("bm25") / F.nullif(F.max("bm25").over(Window.partitionBy()), F.lit(0.0)), F.lit(0.0))).drop("bm25")
    joined = ranked.join(F.broadcast(share), KEY, "left")
    return joined.withColumn("score", F.col("score") / (1 + F.coalesce("share", F.lit(0.0)) * weight)).drop("share")


def best_files(ranked: DataFrame, most: int | None) -> DataFrame:
    """Rows of the files with the ``most`` best rows."""
    if most is None:
        return ranked
    own = Window.partitionBy("filePath").orderBy("score", *KEY)
    first = ranked.withColumns({"best": F.first("score").over(own), "lead": F.first("chunkIndex").over(own)})
    return first.withColumn("place", F.dense_rank().over(Window.orderBy("best", "filePath"))).where(F.col("place") <= most).drop("best", "lead", "place")


def search(chunks: DataFrame, vector: Sequence[float], text: str = "", limit: int = 10, scope: str | Iterable[str] | None = None, max_distance: float | None = None, grouping: str | None = None, weight: float = WEIGHT, max_files: int | None = None, index: Callable[[list[str]], tuple[DataFrame, int, float]] | None = None) -> DataFrame:
    """The ``limit`` best rows, ascending by score.

    ``index`` gives the postings of a query's grams (``Store.postings``); without it the texts are scanned.  If the
    keyword part fails, the vectors' order stands and a warning says so.
    """
    ranked = grouped(nearest(chunks, vector, limit, scope, max_distance), grouping)
    if text.strip() and weight > 0:
        # at most 40 rows: taken to the driver, the vectors are scanned once and the files' names reach the text's scan
        rows = ranked.collect()
        ranked = chunks.sparkSession.createDataFrame(rows, ranked.schema)
        files = sorted({r["filePath"] for r in rows if r["filePath"] is not None})
        if rows:
            try:
                grams = query_grams(text)
                found = bm25_of_postings(*index(grams), files) if index and grams else bm25(chunks, text, files)
                hits = found.orderBy(F.desc("bm25"), *KEY).limit(2 * len(rows)).collect()
            except (PySparkException, OSError) as e:
                warnings.warn(f"keywords are left out of this query: {str(e).splitlines()[0]}", stacklevel=2)
            else:
                ranked = boosted(ranked, chunks.sparkSession.createDataFrame(hits, HITS), weight)
    return best_files(ranked, max_files).orderBy("score", *KEY).limit(limit)


def not_absolute(scopes: str | Iterable[str] | None) -> list[str]:
    """Scopes that match nothing because they aren't absolute paths."""
    return [s for s in ([scopes] if isinstance(scopes, str) else scopes or []) if not re.match(r"[/\\]|[A-Za-z]:[/\\]", s)]
