"""The pipeline against the same five stages by brute force."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
import tiktoken
from marlspike.llm import bpe, common, decontaminate, langid, simhash
from marlspike.llm.common import table
from test_operators import DOCS, brute_groups


def expected(spark, sf):
    source = table(spark, sf, "documents")
    accepted = {r["doc_id"] for r in langid.identify(source).where("accepted").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in source.collect() if r["doc_id"] in accepted)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    rows = [(i, t) for i, t in rows if first[t] == i]
    rows = [r for k, (r, g) in enumerate(zip(rows, brute_groups(rows))) if g == k]
    index = decontaminate.Index([tuple(r) for r in table(spark, sf, "benchmark").collect()])
    hit = set()
    for i, t in rows:
        h, _, _, at = decontaminate.words(*decontaminate.texts(decontaminate.pa.array([t]), True), decontaminate.LETTERS)
        if index.search(h, at):
            hit.add(i)
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    return [(i, len(e := reference.encode_ordinary(t)), e, True) for i, t in rows if i not in hit]


def test_run_is_the_brute_force_pipeline(spark, sf):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    want = expected(spark, sf)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert got == want
    assert 0.5 * table(spark, sf, "documents").count() < len(got)


def test_stages_keep_the_columns_and_bear_odd_rows(spark, tmp_path):
    text = " ".join(f"plain{k} words" for k in range(60))
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "another plain words text", "en", None, None), (4, "word " * 100_000, "en", "b", 1)]
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for content in (rows, []):
        docs = spark.createDataFrame(content, DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(out) <= len(content) and all(r["intact"] for r in out)
        if content:
            assert 1 in [r["doc_id"] for r in out]


def test_workers_keep_nothing_of_earlier_stages(spark):
    docs = spark.createDataFrame([(1, "the same text", "en"), (2, "the same text", "en")], "doc_id long, text string, lang string").coalesce(1)

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, common._KEPT.values()))])], ["n"])

    def now():
        return spark.range(64, numPartitions=64).mapInArrow(held, "n long").agg({"n": "sum"}).first()[0]

    for stage in (lambda: langid.drop_rejected(docs), lambda: decontaminate.drop_contaminated(docs, docs.withColumnRenamed("doc_id", "item_id")), lambda: bpe.encoded(docs)):
        stage().collect()
        assert now() > 0
    # more tasks than workers, so that all of them have one
    simhash.drop_near_copies(spark.range(256, numPartitions=64).selectExpr("id doc_id", "'the same text' text")).collect()
    assert now() == 0
