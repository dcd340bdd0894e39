"""That the operators do the whole job: cases that a part of it would miss."""

from __future__ import annotations

import numpy as np
from marlspike.llm import common, decontaminate, feistel, langid, queries


def test_training_order_query_writes_its_shards(spark, sf):
    before = set(common.OUTPUTS)
    index = queries.QUERIES["op2_training_order"](spark, sf).collect()
    (path,) = [p for p in common.OUTPUTS if p not in before and "/shards-" in p]
    want = feistel.ordered(common.table(spark, sf, "documents")).orderBy("slot").collect()
    assert [r["slot"] for r in sorted(index, key=lambda r: r["slot"])] == list(range(len(want)))
    read = list(feistel.read_slots(path, 0, len(want)))
    assert len(read) == len(want)
    for got, w in zip(read, want):
        assert got.tobytes() == w["record"]
    files, base = common.filesystem(path)
    common.release()  # the end of the process doesn't take the output away
    for r in index:
        w = want[r["slot"]]
        assert (r["shard"], r["byte_offset"], r["doc_id"], r["sequence"], r["n_tokens"]) == tuple(w[1:6])
        with files.open_input_file(f"{base}/{r['file']}") as data:
            data.seek(r["byte_offset"])
            assert np.array_equal(np.frombuffer(data.read(2048), "<u2"), read[r["slot"]])


def test_decontamination_in_passes_is_that_in_one(spark, monkeypatch):
    stock = [" ".join(f"stock{k}x{j}" for j in range(6)) for k in range(8)]
    items = [(k, f"{stock[k % 8]} " + " ".join(f"own{k}x{j}" for j in range(9)) + f" {stock[(3 * k + 1) % 8]}") for k in range(40)] + [(40, None), (41, "..."), (42, "two words"), (43, items_text := "said twice over"), (44, items_text)]
    rows = []
    for k in range(40):
        w = items[k][1].split()
        rows += [(100 * cut + k, "before " + " ".join([*w[:cut], *stock[(k + cut) % 8].split()][: len(w)]) + " after") for cut in (9, 11, 13, 15, 17)]
    rows += [(9000, "two words said twice over"), (9001, None)]
    text, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(map(tuple, decontaminate.matches(text, benchmark).collect()))
    kept = lambda: sorted(r[0] for r in decontaminate.drop_contaminated(text, benchmark).collect())
    want, left = found(), kept()
    assert len(want) > 40 and any(r[2] < 0.7 for r in want)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1500)
    assert len(list(decontaminate.indexes(benchmark, decontaminate.RADIUS, decontaminate.LEAST))) > 2
    assert found() == want and kept() == left


def test_language_of_rows_with_one_id(spark):
    words = {"en": "the house and river with that have this", "de": "das haus und der fluss mit nicht werden", "xx": "zolu mipa krevo tandu"}
    for doc in (None, 4):
        rows = [(doc, f"{own} {own.split()[k % 4]} {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]}", lang) for lang, own in words.items() for k in range(2500)]
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert langid.prototypes(table)[0] == sorted(words)
        assert langid.prototypes(table, per_language=0)[0] == sorted(words)
        assert langid.drop_rejected(table).count() == len(rows)
    once = spark.createDataFrame([(1, f"{own} {k}", lang) for lang, own in words.items() for k in range(3)], "doc_id long, text string, lang string")
    again = once.unionAll(spark.createDataFrame([(1, f"{words['en']} 0", "en")] * 3000, once.schema))
    assert np.array_equal(langid.prototypes(once)[1], langid.prototypes(again)[1])
