"""The engine's rules one by one: store and index, sync, roll-back, pages of PDF files, whole units, command line."""

from __future__ import annotations

import json
import math
import os
import sys
import time
import warnings

import numpy as np
import pytest
from marlspike import __main__ as cli
from marlspike.functions import text as tx
from marlspike.functions import vectors
from marlspike.operators import chunker, pdf, search, sync
from marlspike.plans import catalog
from marlspike.service import Engine, Settings
from marlspike.sources import readers, scan
from marlspike.sources.store import SCHEMA, Store, bucket_of
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_engine import docx

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # providers go to workers that don't have the tests
LINE = "This sentence says something about subject number {} at a fair length."


def rows(spark, made):
    return spark.createDataFrame([(f"id{k}", p, i, t, [1.0, float(k)], ("n", 1, "txt"), "", "h", f"2024-01-{k + 1:02d}") for k, (p, i, t) in enumerate(made)], SCHEMA)


# store


def test_commits_touch_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.version() is None and store.delete("/x") == 0
    store.insert(rows(spark, [(f"/d/{k}", i, LINE.format(k)) for k in range(12) for i in range(2)]))
    first = store.manifest()
    assert store.status() == {"documentCount": 12, "chunkCount": 24} and store.read().first()["fileTitle"] is None
    assert store.delete("/d/3") == 2 and store.delete("/d/3") == 0
    second = store.manifest()
    own = str(bucket_of("/d/3", second["buckets"]))
    assert {b for b in first["rows"] if first["rows"][b] != second["rows"].get(b)} == {own}
    store.replace_files(rows(spark, [("/d/5", 0, "new text"), ("/e", 0, "another")]), ["/d/5", "/e"])
    assert sorted((r["filePath"], r["text"]) for r in store.read().where("filePath IN ('/d/5', '/e')").collect()) == [("/d/5", "new text"), ("/e", "another")]
    assert [r["chunkIndex"] for r in store.chunk_range("/d/7", 0, 5).collect()] == [0, 1] and store.of_file("/d/7").count() == 2
    store.insert(rows(spark, [("/d/7", 2, "third")]))
    assert len(store.manifest()["rows"][str(bucket_of("/d/7", 16))]) > 1
    store.optimize(grace=0)
    m = store.manifest()
    assert all(len(f) == 1 for f in m["rows"].values()) and store.status() == {"documentCount": 12, "chunkCount": 23}
    kept = {f.split("/")[0] for kind in ("rows", "grams") for own in m[kind].values() for f in own}
    assert {n for n in os.listdir(tmp_path / "s") if n.startswith("c-")} == kept
    assert sum(n for n, _ in m["totals"].values()) == 23
    assert Store(spark, f"file://{tmp_path}/s").status() == store.status()


def test_index_scores_as_the_scan(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.insert(rows(spark, [(f"/d/{k}", 0, t) for k, t in enumerate(["aaaa b the", "zz", "", "the and THE", "依存性注入 AAA", "x" * 500 + " and the"])]))
    store.insert(rows(spark, [("/more", 0, "and and the"), ("/gone", 0, "the the the")]))
    store.delete("/gone")
    for query in ("the and", "aa", "依存性", "q9", "z"):
        want = {r["filePath"]: round(r["bm25"], 9) for r in search.bm25(store.read(), query).collect()}
        got = {r["filePath"]: round(r["bm25"], 9) for r in search.bm25_of_postings(*store.postings(tx.query_grams(query))).collect()}
        assert got == want
    some = search.bm25_of_postings(*store.postings(tx.query_grams("the")), files=["/more"]).collect()
    assert [r["filePath"] for r in some] == ["/more"]


def test_neighbours_are_read_in_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.insert(spark.range(10_000).select(F.lit("i").alias("id"), F.lit("/f").alias("filePath"), F.col("id").cast("int").alias("chunkIndex"), F.concat(F.lit("text "), "id").alias("text"), F.array(F.lit(0.5).cast("float")).alias("vector"), F.lit(None).cast(SCHEMA["metadata"].dataType).alias("metadata"), F.lit(None).cast("string").alias("fileTitle"), F.lit("h").alias("contentHash"), F.lit("t").alias("timestamp")))
    assert store.range_rows("/f", 1, 2) == [r.asDict() for r in store.chunk_range("/f", 1, 2).collect()] and store.range_rows("/none", 0, 9) == []
    took = []
    for k in range(50, 9_950, 990):
        began = time.perf_counter()
        assert [r["chunkIndex"] for r in store.range_rows("/f", k - 2, k + 2)] == list(range(k - 2, k + 3))
        took.append(time.perf_counter() - began)
    assert sorted(took)[len(took) // 2] < 1  # bench.py times it


def test_keywords_that_fail_leave_the_vectors_order(spark):
    chunks = spark.createDataFrame([("/a", 0, "one", [1.0, 0.0]), ("/b", 0, "two", [0.0, 1.0]), ("/c", 0, "three", None)], "filePath string, chunkIndex int, text string, vector array<double>")

    def broken(grams):
        raise OSError("no index")

    with pytest.warns(UserWarning, match="no index"):
        got = search.search(chunks, [1.0, 0.0], "two", index=broken).collect()
    assert [r["filePath"] for r in got] == ["/a", "/b"]
    assert search.not_absolute(["a/b", "/c", "C:\\x", "~/d"]) == ["a/b", "~/d"] and search.not_absolute(None) == []


def test_distances_are_those_of_the_column_function(spark):
    rng = np.random.default_rng(2)
    made = [(k, rng.normal(size=5).astype(np.float32).tolist()) for k in range(200)]
    df = spark.createDataFrame(made, "k int, v array<float>")
    want = rng.normal(size=5).tolist()
    got = df.select(vectors.distance_to(want)(F.col("v")).alias("a"), vectors.distance(F.col("v"), vectors.literal(want)).alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 2e-9 for r in got)
    odd = spark.createDataFrame([(None,), ([],), ([1.0, None],), ([1.0, 2.0, 3.0],), ([1.0, 0.0],)], "v array<double>")
    assert [r[0] for r in odd.select(vectors.distance_to([1.0, 0.0])(F.col("v"))).collect()] == [None, None, None, None, 0.0]


# sync


def test_keys_of_paths(spark):
    key = lambda p, w=False: spark.range(1).select(tx.path_key(F.lit(p), w)).first()[0]
    for path in ("/a//b/./c/", "/a/x/../b/c", "/../a/b/c", "/a/b/c"):
        assert key(path) == "/a/b/c"
    assert key("/") == "/" and key("/A/b") == "/A/b"
    assert key("C:\\Docs\\A.md", True) == key("c:/docs/./a.MD", True) == "c:\\docs\\a.md"


def test_plan_of_spellings_files_and_raw_data(spark):
    disk = spark.createDataFrame([("/d/a", "A"), ("/d/b", "B"), ("/d//c", "C")], "filePath string, contentHash string")
    stored = spark.createDataFrame([("/d/a", "A"), ("/d/./a", "A"), ("/d/b", "B"), ("/d/c", "C"), ("/d/x", "X"), ("/d/x/child.md", "Y"), ("/d/y/../z", "Z"), ("/db/raw-data/abc.md", "R"), ("/d/big/f", "F")], "filePath string, contentHash string")
    plan = lambda **k: {r[0]: (r[1], r[2]) for r in sync.plan_sync(disk, stored, ["/d", "/db"], ["/d/big"], db="/db", **k).collect()}
    got = plan()
    assert got["/d/a"] == ("upsert", ["/d/./a"]) and got["/d/b"] == ("skip", []) and got["/d//c"] == ("skip", ["/d/c"])
    assert got["/d/y/../z"] == ("prune", []) and got["/d/x"][0] == got["/d/x/child.md"][0] == "prune"
    assert got["/db/raw-data/abc.md"][0] == got["/d/big/f"][0] == "keep"
    one = plan(file="/d/x")
    assert one["/d/x"][0] == "prune" and one["/d/x/child.md"][0] == "keep" and one["/d/y/../z"][0] == "keep"
    folded = sync.plan_sync(spark.createDataFrame([("C:\\D\\A.md", "A")], disk.schema), spark.createDataFrame([("c:\\d\\a.md", "A"), ("c:\\d\\gone", "G"), ("c:\\dx", "G")], stored.schema), ["C:\\D"], windows=True).collect()
    assert {r[0]: r[1] for r in folded} == {"C:\\D\\A.md": "skip", "c:\\d\\gone": "prune", "c:\\dx": "keep"}


def engine_of(spark, tmp_path, files, **options):
    root = tmp_path / "docs"
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Engine(spark, str(tmp_path / "db"), Settings(roots=[str(root)]), **options), root


def test_sync_refuses_and_prunes_nothing(spark, tmp_path):
    engine, root = engine_of(spark, tmp_path, {"sub/a.txt": LINE.format(1), "b.txt": LINE.format(2), "c.bin": "x"})
    engine.sync()
    os.symlink(root / "sub", root / "link")
    os.rename(root / "sub", tmp_path / "elsewhere")
    os.mkfifo(root / "pipe.txt")
    for path in (root / "sub", root / "sub" / "a.txt" / "x", root / "link", root / "pipe.txt", root / "c.bin"):
        with pytest.raises(ValueError):
            engine.sync(str(path))
    messages = set()
    for path in (tmp_path / "elsewhere", tmp_path / "nowhere", "/root", root / ".." / "elsewhere"):
        with pytest.raises(ValueError) as e:
            engine.sync(str(path))
        messages.add(str(e.value).replace(os.path.normpath(path), ""))
    assert len(messages) == 1  # nothing tells what is there outside the roots
    assert engine.status()["documentCount"] == 2
    out = engine.sync(str(root / "b.txt"))
    assert (out["skipped"], out["pruned"]) == (1, 0)
    assert engine.sync()["pruned"] == 1


def test_sync_stops_at_the_first_error(spark, tmp_path):
    engine, root = engine_of(spark, tmp_path, {"a.txt": LINE.format(1), "c.txt": LINE.format(3), "z.txt": "short"})
    engine.sync()
    (root / "a.txt").write_text(LINE.format(11))
    (root / "b.pdf").write_bytes(b"%PDF")
    (root / "d.txt").write_text(LINE.format(4))
    (root / "c.txt").unlink()
    out = engine.sync()
    assert out["error"].startswith(str(root / "b.pdf")) and (out["upserted"], out["pruned"]) == (1, 0)
    (root / "b.pdf").unlink()
    out = engine.sync()
    assert (out["error"], out["upserted"], out["empty"], out["pruned"]) == (None, 1, 1, 1)


def test_jobs(spark, tmp_path):
    engine, _ = engine_of(spark, tmp_path, {"a.txt": LINE.format(1)})
    with engine._write_lock():
        with pytest.raises(RuntimeError):
            engine.sync_start()
    job = engine.sync_start()["jobId"]
    with pytest.raises(RuntimeError):
        engine.sync_start()
    for _ in range(600):
        state = engine.sync_status(job)
        if state["state"] != "running":
            break
        time.sleep(0.1)
    assert (state["state"], state["total"], state["completed"], state["summary"]["upserted"]) == ("done", 1, 1, 1)
    for bad in ("x y", "", "0" * 129):
        with pytest.raises(ValueError):
            engine.sync_status(bad)


def test_data_that_fails_leaves_no_trace(spark, tmp_path):
    engine, _ = engine_of(spark, tmp_path, {"a.txt": "x"})
    with pytest.raises(ValueError):
        engine.ingest_data("short", "note://1", "text")
    path = engine.raw_path("note://1")
    assert not os.path.exists(path) and not os.path.exists(path[:-3] + ".meta.json") and engine.load_meta(path) is None
    made = engine.ingest_data(f"<title>Own title</title><p>{LINE.format(1)}</p>", "https://ex.org/1", "html")
    assert made["fileTitle"] == "Own title"
    path = engine.raw_path("https://ex.org/1")
    assert engine.load_meta(path) == {"title": "Own title", "source": "https://ex.org/1", "format": "html"}
    with pytest.raises(ValueError):
        engine.ingest_data("no", "https://ex.org/1", "text")
    assert LINE.format(1) in open(path).read() and engine.load_meta(path)["format"] == "html"
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        _, rest = engine.list_files(["docs/x", "/nowhere"])
    assert any("docs/x" in str(w.message) for w in seen) and [r["source"] for r in rest.collect()] == ["https://ex.org/1"]
    os.symlink("/etc", os.path.join(engine.db, "raw-data", "link"))
    assert not engine.managed(os.path.join(engine.db, "raw-data", "link", "passwd")) and engine.managed(path)


def test_roots(spark, tmp_path):
    for bad in ("/etc", "/var/x", os.path.expanduser("~/.ssh")):
        with pytest.raises(ValueError):
            Engine(spark, str(tmp_path / "db"), Settings(roots=[bad]))
    for name in ("a/b/c", "ab"):
        (tmp_path / name).mkdir(parents=True)
    os.symlink(tmp_path / "a", tmp_path / "same")
    names = {k: str(tmp_path / v) for k, v in {"a": "a", "c": "a/b/c", "ab": "ab", "same": "same"}.items()}
    assert scan.nested_roots(names.values()) == {names["a"]: None, names["c"]: names["a"], names["ab"]: None, names["same"]: names["a"]}
    made = Settings.from_env({"BASE_DIRS": json.dumps([names["c"], names["a"]])})
    assert made.roots == [names["a"]] and names["c"] in made.warnings[0]
    assert scan.shown(os.path.expanduser("~/x")) == "~/x" and scan.shown("/xyz") == "/xyz"
    assert scan.classify_path(str(tmp_path / "none")) == "missing" and scan.classify_path(names["a"]) == "directory" and scan.classify_path(names["same"]) == "symlink"


def test_command_line_takes_folders(spark, tmp_path, capsys):
    _, root = engine_of(spark, tmp_path, {"a.txt": LINE.format(1), "sub/b.md": LINE.format(2), "c.bin": "x"})
    call = lambda *a: cli.main(["--db", str(tmp_path / "db"), "--root", str(root), *a])
    assert call("ingest", str(root), str(root / "a.txt")) == 0
    assert [os.path.basename(r["filePath"]) for r in json.loads(capsys.readouterr().out)] == ["a.txt", "b.md"]
    versions = [n for n in os.listdir(tmp_path / "db" / "chunks") if n.startswith("m-")]
    assert len(versions) == 1  # one commit for all of them
    assert call("ingest", str(root / "c.bin")) == 1 == call("ingest", str(tmp_path))
    assert call("query", "subject number 2") == 0 and json.loads(capsys.readouterr().out)[0]["filePath"].endswith("b.md")


# chunks


def test_whole_units():
    text = "First one here. Code: 42 and then. Last one there."
    assert chunker.sentence_units(text, [(16, 24)]) == [("First one here.", False), ("Code: 42", True), ("and then.", False), ("Last one there.", False)]
    for bad in ([(-1, 3)], [(3, 3)], [(0, 99)], [(5, 9), (8, 12)], [(9, 12), (1, 3)], [(0, 1.5)], [(15, 16)]):
        with pytest.raises(ValueError):
            chunker.sentence_units(text, bad)
    alone = lambda texts: np.eye(8)[: len(texts)]
    assert chunker.chunks_of("Code: 42", alone) == [] and chunker.chunks_of("Code: 42", alone, ranges=[(0, 8)]) == ["Code: 42"]
    assert chunker.chunks_of("--------", alone, ranges=[(0, 8)]) == []
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body, _, ranges, _ = readers.parse("/x.docx", docx(p("Intro.") + "<w:tbl>" + row("A", "B") + row("1. x", "2") + "</w:tbl>"))
    assert ("A: 1. x\nB: 2", True) in chunker.sentence_units(body, ranges)
    item = lambda t, k: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{k}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = readers.docx_text(docx(item("one", 0) + item("two", 1) + "<w:tbl>" + row("", "B") + row("1", "") + "</w:tbl>"))[0]
    assert body == "- one\n\n  - two\n\nColumn 1: 1"


def test_batches_keep_order_and_defer_long_texts():
    seen = []

    def embed(texts):
        seen.append([len(t) for t in texts])
        return np.array([[len(t), 1.0] for t in texts])

    parts = ["x" * n for n in (10, 500, 12, 11, 480, 9)]
    assert chunker.embedded(parts, embed)[:, 0].tolist() == [10, 500, 12, 11, 480, 9]
    assert seen == [[10, 12, 11, 9], [500, 480]]
    assert chunker.embedded([], embed).shape[0] == 0
    with pytest.raises(ValueError):
        chunker.embedded(["a", "b"], lambda t: np.zeros((1, 2)))


def brute_groups(vectors):
    """The Max-Min rule said again, sentence by sentence."""
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) and np.linalg.norm(b) else 0.0
    held, out, g = [], [], 0
    for v in vectors:
        if not held:
            joins = True
        elif len(held) == 1:
            joins = 1.5 * cos(held[0], v) > 0.6
        elif len(held) >= 15:
            joins = False
        else:
            last = held[-5:]
            least = min([1.0, *(cos(a, b) for k, a in enumerate(last) for b in last[k + 1 :])])
            joins = max(cos(a, v) for a in held) > max(0.9 * least / (1 + math.exp(-len(held))), 0.6)
        if not joins:
            held, g = [], g + 1
        held.append(v)
        out.append(g)
    return out


def test_groups_are_those_of_the_rule(spark, sf):
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 80):
        base = rng.normal(size=(6, 12))
        v = (base[np.sort(rng.integers(0, 6, n))] + 0.4 * rng.normal(size=(n, 12))).astype(np.float32)
        assert chunker.groups(v) == brute_groups(v.astype(np.float64))
    t = catalog.table(spark, sf, "embeddings")
    held = {}
    for r in t.orderBy("label", "vec_id").collect():
        held.setdefault(r["label"], []).append((r["vec_id"], np.array(r["embedding"], np.float64)))
    want = {i: (label, g) for label, own in held.items() for (i, _), g in zip(own, brute_groups([v for _, v in own]))}
    assert {r["vec_id"]: (r["label"], r["group"]) for r in catalog.QUERIES["minmax_chunker"](spark, sf).collect()} == want


def test_document_chunks_are_those_of_the_rule(spark, sf):
    want = []
    for r in catalog.table(spark, sf, "documents").select("doc_id", "text").limit(60).collect():
        parts = chunker.sentences(r["text"])
        merged = {}
        for s, g in zip(parts, brute_groups(chunker.hashed_vectors(parts).astype(np.float32)) if parts else []):
            merged.setdefault(g, []).append(s)
        kept = [c for c in (" ".join(m) for m in merged.values()) if chunker.units(c) >= 50 and not chunker.is_garbage(c)]
        want += [(r["doc_id"], k, c) for k, c in enumerate(kept)]
    ids = {w[0] for w in want}
    got = sorted((r["doc_id"], r["chunkIndex"], r["text"]) for r in catalog.QUERIES["semantic_chunk_documents"](spark, sf).collect() if r["doc_id"] in ids)
    assert got == sorted(want)


# pages of PDF files


def page(number, lines, **options):
    return pdf.Page(number, [pdf.Item(t, x, y, s) for t, x, y, s in lines], **options)


def numbered(k, head="Annual report of the company", foot=True):
    lines = [(f"{head} {k}.", 0, 760, 6), (f"Body text of page {k} about {'abcdefgh'[k] * 9}.", 0, 500, 12), (f"It goes on with {'qrstuvwx'[k] * 7}.", 0, 480, 12)]
    return page(k + 1, lines + ([(f"Page {k} of 8 of this document.", 0, 20, 6)] if foot else []))


def test_lines_and_pages():
    p = page(1, [("right", 50, 400.4, 10), ("left", 0, 400, 10), ("below", 0, 380, 10)])
    assert pdf.page_text(p) == "left right\nbelow" and pdf.half_up(-0.5) == 0
    assert pdf.text_of(pdf.Document([p, page(2, []), page(3, [("end", 0, 9, 9)])]), chunker.hashed_vectors) == "left right\nbelow\n\nend"
    found = pdf.placed_sentences(page(1, [("One here. Two", 0, 700, 9), ("there.", 90, 700, 9), ("Three now.", 0, 650, 9)]))
    assert found == [("One here. Two there.", 700), ("Three now.", 650)]
    assert list(pdf.centre(3)) == [0, 1, 2] and list(pdf.centre(10)) == [3, 4, 5, 6, 7] and list(pdf.centre(4)) == [0, 1, 2, 3]


def test_boundaries_that_repeat_go():
    pages = [numbered(k) for k in range(8)]
    texts = pdf.without_boundaries(pages, chunker.hashed_vectors)
    assert all(t.startswith("Body text of page") and "report" not in t and "Page" not in t for t in texts)
    odd = [numbered(k, head="".join("zyxwvuts"[(k + j) % 8] * (j + 2) for j in range(6)), foot=False) for k in range(8)]
    assert [t.split("\n")[0] for t in pdf.without_boundaries(odd, chunker.hashed_vectors)] == [p.items[0].text for p in odd]
    assert pdf.without_boundaries(pages[:2], chunker.hashed_vectors) == [pdf.page_text(p) for p in pages[:2]]
    upper, lower = pdf.margin_heights(pages[:5])
    assert (upper, lower) == ({760}, {20})


def test_boundaries_of_tables_are_those_of_documents(spark):
    rows = [(d, p.number, n, i.text, float(i.x), float(i.y), float(i.size)) for d in (1, 2) for p in (numbered(k) if d == 1 else numbered(k, foot=False) for k in range(8)) for n, i in enumerate(p.items)]
    items = spark.createDataFrame(rows + [(3, 1, 0, "alone.", 0.0, 1.0, 9.0)], "document int, page int, n int, text string, x double, y double, size double")
    got = {(r["document"], r["page"]): r["text"] for r in pdf.filtered_pages(items).collect()}
    for d in (1, 2):
        pages = [pdf.Page(p.number, p.items, height=None) for p in (numbered(k) if d == 1 else numbered(k, foot=False) for k in range(8))]
        assert [got[d, k] for k in range(1, 9)] == pdf.without_boundaries(pages, chunker.hashed_vectors)
    assert got[3, 1] == "alone."


def test_titles_of_pdf_files():
    first = page(1, [("small", 0, 700, 9), ("Big", 0, 650, 20), ("title", 0, 620, 20), ("text", 0, 500, 9), ("Big", 0, 100, 20)])
    assert pdf.title_hint(first) == ("Big title", 20)
    assert pdf.title_of(pdf.Document([first], " Own ")) == "Own" and pdf.title_of(pdf.Document([first], "/a/b.doc")) == "Big title"
    assert pdf.title_of(pdf.Document([page(1, [("t", 0, 1, 14)])]), "chunk") == "chunk" and pdf.title_of(pdf.Document([])) == ""


def test_pictures():
    one = lambda **k: pdf.candidate(page(1, [], **k))
    assert one() == (False, None) and one(pictures=[(0, 0, 612, 792)]) == (False, None)  # a scan of the whole page
    assert one(pictures=[(100, 100, 400, 500)]) == (True, (76.0, 68.0, 424.0, 532.0))
    assert one(pictures=[(-50, 300, 150, 700)])[0] and not one(pictures=[(0, 0, 90, 90)])[0] and not one(pictures=[(100, 100, 179, 700)])[0]
    lines = [(100 + 20 * k, 100, 115 + 20 * k, 130) for k in range(5)]
    assert one(strokes=lines[:4]) == (False, None) and one(strokes=lines) == (True, (pytest.approx(88 - 0), 88.0, 207.0, 142.0))
    assert one(pictures=[(20, 20, 590, 600)])[1] is not None and one(pictures=[(40, 40, 580, 650)]) == (True, None)


def test_captions_join_the_chunks(spark, tmp_path):
    def read(content):
        pages = [page(k, [(f"{'abcdef'[k] * 30} {'ghijkl'[k] * 25} {'mnopqr'[k] * 20}.", 0, 500, 12)], pictures=[(100, 100, 400, 500)] if k < 4 else []) for k in range(1, 6)]
        return pdf.Document(pages, "A title")

    def caption(content, number, crop):
        if number == 2:
            raise RuntimeError("model")
        return "\x07 a chart of sales " if number == 1 else "x" * 2000

    engine, root = engine_of(spark, tmp_path, {"f.pdf": "%PDF"}, pdf=read, caption=caption)
    made = engine.ingest_file(str(root / "f.pdf"), visual=True)
    found = [r["text"] for r in engine.store.read().orderBy("chunkIndex").collect()]
    assert made["fileTitle"] == "A title" and made["chunkCount"] == len(found)
    assert found[-2] == "[Visual content on page 1: a chart of sales]" and found[-1] == f"[Visual content on page 3: {'x' * 1000}…]"
    assert not any("page 2" in t for t in found)
    plain = engine.ingest_file(str(root / "f.pdf"))
    assert plain["chunkCount"] == made["chunkCount"] - 2
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "db2"), Settings(roots=[str(root)]), pdf=read).ingest_file(str(root / "f.pdf"), visual=True)


def test_content_of_pages():
    text = "A long sentence about sailing, the sea, and boats, which goes on for a while."
    bar = "".join(f"<li><a href=/{k}>link number {k} of the site</a></li>" for k in range(6))
    page_ = f"<html><body><div id=side><ul>{bar}</ul></div><div id=top>short</div><div id=text><p>{text}</p><p>{text}</p><p>{text}</p></div></body></html>"
    made, _ = readers.html_markdown(page_)
    assert made.count("sailing") == 3 and "link number" not in made and "short" not in made
    even = f"<body><div><p>{text}</p></div><section><p>{text.replace('sailing', 'rowing')}</p></section><div><p>{text.replace('sailing', 'diving')}</p></div></body>"
    assert all(w in readers.html_markdown(even)[0] for w in ("sailing", "rowing", "diving"))
    assert readers.html_markdown("<p>one<p>two</div></b>")[0] == "one\n\ntwo"
    assert readers.html_markdown("<div>" * 2000 + text)[0] == text


def test_arguments_of_tools(spark, tmp_path):
    engine, root = engine_of(spark, tmp_path, {"a.txt": LINE.format(1)})
    for scope in ("", " ", ["/a", ""], [3]):
        with pytest.raises(ValueError):
            engine.query_documents("q", scope=scope)
        with pytest.raises(ValueError):
            engine.list_files(scope)
    for limit in (0, 21, 1.5, True):
        with pytest.raises(ValueError):
            engine.query_documents("q", limit)
    engine.ingest_file(str(root / "a.txt"))
    assert engine.query_documents("subject", scope=f"  {root} ").count() == 1
    found = engine.status()
    assert found["chunkCount"] == 1 and found["memoryUsage"] > 0 and found["uptime"] > 0 and engine.base_dirs() == {"baseDir": str(root), "baseDirs": [str(root)]}
    with pytest.raises(ValueError):
        engine.delete_file(path="/a", source="b")
    with pytest.raises(ValueError):
        engine.read_chunk_neighbors(0, path="/a", before=51)


def test_postings_of_older_folders_are_read(spark, tmp_path):
    """A folder of an older store has a row for each posting; a query reads it beside the lists of newer ones."""
    from marlspike.operators import ngrams

    store = Store(spark, str(tmp_path / "s"))
    store.insert(rows(spark, [("/a", 0, "the first"), ("/a", 1, "the second")]))
    m = store.manifest()
    old = f"{store.path}/c-{1:020d}-old"
    (b,) = m["rows"]
    flat = ngrams.flat(spark.read.parquet(*[f"{store.path}/{f}" for f in m["grams"][b]])).withColumn("part", F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(16)).cast("int"))
    flat.write.partitionBy("part").parquet(f"{old}/grams/bucket={b}")
    before = sorted(map(tuple, store.postings(["th", "he", "sec"])[0].collect()))
    m["grams"][b] = [f.replace(f.split("/lists/")[0] + "/lists/", f"c-{1:020d}-old/grams/") for f in m["grams"][b]]
    store._put("m-old.json", json.dumps(m).encode())
    store._put("_CURRENT", b"m-old.json")
    assert sorted(map(tuple, store.postings(["th", "he", "sec"])[0].collect())) == before and len(before) == 5
    store.insert(rows(spark, [("/a", 2, "the third")]))
    assert store.postings(["th"])[0].count() == 3
