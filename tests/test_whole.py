"""Queries that do the whole job, against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from marlspike.functions.vectors import cosine
from marlspike.operators import ngrams, pairs
from marlspike.plans import catalog
from pyspark.sql import functions as F


def test_pairs_of_odd_vectors(spark):
    rows = [(5, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [0.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (8, [-3.0, 4.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a = t.select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    want = a.where("i % 2 = 1").join(a.toDF("j", "y"), F.col("i") != F.col("j")).select("i", "j", (F.round(cosine(F.col("x"), F.col("y")), 6) + 0.0).alias("cosine"))
    for tile in (2, 1024):
        assert sorted(map(repr, pairs.against(t.where("vec_id % 2 = 1"), t, "vec_id", "embedding", tile).collect())) == sorted(map(repr, want.collect()))


def test_ngrams_of_whole_documents(spark, sf):
    def brute(rows):
        return Counter((i, g, n) for i, t in rows for g, n in Counter(t[k : k + m] for m in (2, 3) for k in range(len(t) - m + 1)).items())

    rows = [(r[0], r[1].lower()) for r in catalog.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = catalog.QUERIES["ngram_tokenize_documents"](spark, sf).toArrow()
    assert Counter(zip(*(got.column(c).to_pylist() for c in ("doc_id", "gram", "n")))) == brute(rows)
    odd = [(1, None), (2, ""), (3, "a"), (4, "Ab"), (4, "Ab"), (None, "\U0001f600é\U0001f600é"), (5, "a\0b\0\0")]
    found = ngrams.postings(spark.createDataFrame(odd, "doc_id long, text string"), "doc_id", "text").collect()
    assert Counter(tuple(r) for r in found) == brute([(i, t.lower()) for i, t in odd if t is not None])


def test_neighbours_are_whole(spark, sf):
    rows = [tuple(r) for r in catalog.table(spark, sf, "conversations").select("conv_id", "turn", "text").collect()]
    key = lambda x: (x[0], x[1] is not None, x[1] or "")
    want = sorted((c, n, tuple((m, t, m == n) for m, t in sorted(((m, t) for d, m, t in rows if d == c and abs(m - n) <= 2), key=key))) for c, n, _ in rows)
    got = sorted((r["conv_id"], r["turn"], tuple(tuple(x) for x in r["around"])) for r in catalog.QUERIES["chunk_neighbor_texts"](spark, sf).collect())
    assert got == want


def test_medians_of_large_groups(spark):
    """Groups in blocks and passes have the median of all pairs, as a join of them has it."""
    rng = np.random.default_rng(7)
    rows = [(0, k, [float(x) for x in rng.normal(size=4)]) for k in range(61)]  # an odd number of pairs
    rows += [(1, k, [1.0 + 1e-7 * float(x) for x in rng.normal(size=3)]) for k in range(40)]  # all in one bin
    rows += [(2, k, [1.0, 0.0] if k < 7 else [0.0, 1.0]) for k in range(10)]  # the ranks far apart
    rows += [(2, 9, [1.0, 0.0]), (2, None, [1.0, 1.0]), (3, 1, [1.0]), (3, 1, [2.0]), (None, 1, [1.0]), (None, 2, [1.0])]
    rows += [(4, 1, [1.0, 2.0]), (4, 2, [2.0, 1.0]), (4, 3, None), (4, 4, [1.0]), (4, 5, []), (4, 6, [0.0, 0.0]), (4, 7, [1.0, None]), (4, 8, [3.0, 1.0]), (5, 1, [1.0])]
    rows += [(6, k, [math.nan if k < 5 else 1.0, 1.0]) for k in range(6)]
    t = spark.createDataFrame(rows, "label long, vec_id long, embedding array<double>")
    a = t.select("label", F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    joined = a.join(a.toDF("label", "j", "y"), "label").where("i < j").groupBy("label").agg(F.percentile(cosine(F.col("x"), F.col("y")), 0.5).alias("m"))
    want = {r["label"]: r["m"] for r in joined.where("m IS NOT NULL").collect()}
    for options in ({}, {"whole": 8, "block": 7, "bins": 16, "most": 4}, {"whole": 1, "block": 1000, "bins": 64, "most": 1}):
        got = {r["label"]: r["m"] for r in pairs.group_medians(t, "label", "vec_id", "embedding", **options).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[g], want[g], rtol=0, atol=1e-12, equal_nan=True) for g in want), (options, got, want)


def test_median_of_a_group_in_passes(spark):
    t = spark.range(3000).select((F.col("id") % 1).alias("label"), F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    assert catalog.median_similarity(t).first()["median"] == round(float(np.median([math.cos(d) for d in range(1, 3000) for _ in range(3000 - d)])), 6) + 0.0


def test_posting_lists_are_whole_and_few(spark):
    odd = [("/a", None, "Ab ab"), ("/a", 1, "x"), (None, 2, "ab\0b\0\0"), ("/b", 3, None), ("/b", 4, "\U0001f600é\U0001f600é"), ("/b", 4, ""), *(("/c", k, f"the same words in text {k}") for k in range(50))]
    t = spark.createDataFrame(odd, "filePath string, chunkIndex int, text string").coalesce(1)
    want = Counter((p, i, g, n, max(0, len(x) - 1) + max(0, len(x) - 2)) for p, i, x in odd if x is not None for g, n in Counter(x.lower()[k : k + m] for m in (2, 3) for k in range(len(x) - m + 1)).items())
    lists = ngrams.posting_lists(t)
    assert Counter(tuple(r) for r in ngrams.flat(lists).select("filePath", "chunkIndex", "gram", "tf", "dl").collect()) == want
    assert lists.count() * 5 < want.total()  # a row for each posting was what made the store's writes slow
    letters = "".join(chr(k) for k in (*range(0x20, 0xD800), *range(0xE000, 0x60000)))  # so many that the texts don't fit one number
    lows = [letters[k::7] for k in range(7)] * 9
    got = Counter((i, g) for grams, held, owner, n in ngrams._grouped(lows, np.arange(len(lows)) % 4) for i, g in zip(owner.tolist(), np.repeat(np.array(grams.to_pylist(), object), held)))
    assert got.total() == len(got) == sum(2 * len(x) - 3 for x in lows)
