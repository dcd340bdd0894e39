"""Search rules, chunker, readers, store, sync and the tools on small inputs."""

from __future__ import annotations

import io
import os
import zipfile

import numpy as np
import pytest
from marlspike.functions import text as tx
from marlspike.operators import chunker, search, sync
from marlspike.service import Engine, Settings
from marlspike.sources import readers, scan
from marlspike.streaming.ingest import follow
from pyspark.sql import functions as F


def ranked(spark, scores):
    return spark.createDataFrame([(f"/f{k}", k, float(s)) for k, s in enumerate(scores)], "filePath string, chunkIndex int, score double")


@pytest.mark.parametrize(
    ("scores", "similar", "related"),
    [([0.1, 0.15, 0.2, 0.8, 0.85], 3, 5), ([0.1, 0.2, 0.3, 0.4], 4, 4), ([0.1, 0.11, 0.5, 0.51, 0.52], 2, 5), ([0.1, 0.11, 0.12, 0.13, 0.14, 1.0, 1.01, 1.02, 2.0, 2.01], 5, 8), ([0.3], 1, 1), ([], 0, 0)],
)
def test_gaps(spark, scores, similar, related):
    assert search.grouped(ranked(spark, scores), "similar").count() == similar
    assert search.grouped(ranked(spark, scores), "related").count() == related


def test_boost_and_file_filter(spark):
    rows = spark.createDataFrame([("/a", 0, 0.1), ("/b", 0, 0.5), ("/a", 1, 0.6), ("/c", 0, 0.2), ("/c", 1, 0.7)], "filePath string, chunkIndex int, score double")
    assert [tuple(r)[:2] for r in search.best_files(rows, 2).orderBy("score").collect()] == [("/a", 0), ("/c", 0), ("/a", 1), ("/c", 1)]
    hits = spark.createDataFrame([("/b", 0, 10.0), ("/x", 0, 5.0)], "filePath string, chunkIndex int, bm25 double")
    got = {r["filePath"]: r["score"] for r in search.boosted(rows.where("chunkIndex = 0"), hits, 0.6).collect()}
    assert got == {"/a": 0.1, "/b": pytest.approx(0.3125), "/c": 0.2}


def test_scopes_and_limits(spark):
    df = spark.createDataFrame([(p,) for p in ("/a/b/x.md", "/a/b/sub/y.md", "/a/bc.md", "/a/b", "/foo/bar.md", "/a%b/x")], "p string")
    paths = lambda s: sorted(r[0] for r in df.where(search.in_scope(F.col("p"), s)).collect())
    assert paths("/a/b") == paths("/a/b//") == ["/a/b", "/a/b/sub/y.md", "/a/b/x.md"]
    assert len(paths("/")) == 6 and paths(["/foo", "/a%b"]) == ["/a%b/x", "/foo/bar.md"]
    with pytest.raises(ValueError):
        search.nearest(df, [1.0], 21)


def test_bm25_counts_overlaps_and_odd_texts(spark):
    df = spark.createDataFrame([("/a", 0, "aaaa b"), ("/b", 0, "zz"), ("/c", 0, ""), ("/d", 0, None), ("/e", 0, "依存性注入 AAA")], "filePath string, chunkIndex int, text string")
    assert df.select(tx.gram_count(F.lower("text"), "aa")).collect()[0][0] == 3
    assert {r["filePath"] for r in search.bm25(df, "aa").collect()} == {"/a", "/e"}
    assert [r["filePath"] for r in search.bm25(df, "依存性").collect()] == ["/e"]
    assert search.bm25(df, "q").count() == 0 == search.bm25(df.limit(0), "aa").count()


def test_sentences_and_groups():
    assert chunker.sentences("Pi is 3.14 today. Next one! 日本語。次の文？\n\n# A heading. here\nlast `a. B` end.") == ["Pi is 3.14 today.", "Next one!", "日本語。", "次の文？", "# A heading. here", "last `a. B` end."]
    a, b = [1, 0.01, 0], [0, 1, 0]
    assert chunker.groups(np.array([a, a, a, b, b])) == [0, 0, 0, 1, 1]
    assert chunker.groups(np.array([a] * 40)) == [0] * 15 + [1] * 15 + [2] * 10
    assert chunker.groups(np.zeros((2, 3))) == [0, 1]
    assert chunker.chunks_of("") == [] and chunker.is_garbage("-----  ====") and not chunker.is_garbage("日本語の文")


def test_garbage_column_is_the_function(spark):
    texts = ["", "  ", "---", "a", "ああああああ", "日本語の文", " ===\n***"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", tx.is_garbage(F.col("t")).alias("g"))
    assert [r["g"] for r in df.orderBy("k").collect()] == [chunker.is_garbage(t) for t in texts]


def test_titles_and_sources(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(tx.name_title(lit("2024-annual_report.v2.pdf"))) == "2024 annual report.v2"
    assert one(tx.markdown_title(lit("---\nx: 1\ntitle: 'A b'\n---\n# C"), lit("f.md"))) == "A b"
    assert one(tx.markdown_title(lit("text\n# C d \n"), lit("f.md"))) == "C d"
    assert one(tx.txt_title(lit("Title \n\nrest"), lit("f.txt"))) == "Title" and one(tx.txt_title(lit("a\nb"), lit("f-g.txt"))) == "f g"
    assert one(tx.normal_source(lit("HTTPS://u:p@Ex.org:443/a?b#c"))) == "https://ex.org/a" and one(tx.normal_source(lit("clipboard://x"))) == "clipboard://x"
    long = "é" * 200
    assert one(tx.raw_source(tx.raw_path(lit(long), "/db"), "/db")) == long and one(tx.raw_source(lit("/db/x.md"), "/db")) is None
    assert one(tx.caption(lit("\x07 "))) is None and len(one(tx.caption(lit("x" * 2000)))) == 1001


def docx(body, title=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></c>')
    return out.getvalue()


def test_readers():
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    text, title, ranges = readers.docx_text(docx(p("Head", "Heading1") + p("Body") + "<w:tbl>" + row("A", "B") + row("1", "2") + "</w:tbl>"))
    assert (text, title) == ("# Head\n\nBody\n\nA: 1\nB: 2", "Head") and [text[a:b] for a, b in ranges] == ["A: 1\nB: 2"]
    assert readers.docx_text(docx(p("x"), " Core  title "))[1] == "Core title"
    md, title = readers.html_markdown("<html><head><title> T  t</title></head><body><nav>n</nav><article><h2>H</h2><p>a <b>b</b> <em>c</em></p><ul><li>x<li>y</ul><pre><code>q  r</code></pre></article><footer>f</footer></body></html>")
    assert title == "T t" and md.startswith("## H\n\na **b** _c_\n\n- x\n- y") and "```\nq  r\n```" in md and "n" not in md.split()
    assert readers.html_markdown(None) == ("", "") == readers.html_markdown("")
    with pytest.raises(ValueError):
        readers.parse("/a.pdf", b"")


def test_plan(spark):
    disk = spark.createDataFrame([("/d/a", "A"), ("/d/b", "B"), ("/d/n", "N"), ("/d/h", "H")], "filePath string, contentHash string")
    stored = spark.createDataFrame([("/d/a", "A"), ("/d/a", "A"), ("/d/b", "A"), ("/d/h", None), ("/d/gone", "G"), ("/d/raw/x", "X"), ("/other/y", "Y")], "filePath string, contentHash string")
    got = {r[0]: r[1] for r in sync.plan_sync(disk, stored, ["/d"], ["/d/raw"]).collect()}
    assert got == {"/d/a": "skip", "/d/b": "upsert", "/d/n": "upsert", "/d/h": "upsert", "/d/gone": "prune", "/d/raw/x": "keep", "/other/y": "keep"}


TEXT = "TypeScript adds static types to a language that had none of them before. Bread is baked from flour, water and salt in a really hot oven."


def test_engine_end_to_end(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text(TEXT)
    (root / "sub" / "b.md").write_text("# Gardening\n\nTomatoes need sun and a lot of water every single day of summer.")
    (root / "c.bin").write_text("x")
    os.symlink(root / "a.txt", root / "link.txt")
    engine = Engine(spark, str(tmp_path / "db"), Settings(roots=[str(root)]))
    assert engine.status()["chunkCount"] == 0 and engine.query_documents("anything").count() == 0
    counts = lambda out: {k: out[k] for k in ("upserted", "skipped", "empty", "pruned")}
    first = engine.sync()
    assert counts(first) == {"upserted": 2, "skipped": 0, "empty": 0, "pruned": 0} and first["coverage"]["symlinks"] == [str(root / "link.txt")]
    assert counts(engine.sync()) == {"upserted": 0, "skipped": 2, "empty": 0, "pruned": 0}
    top = engine.query_documents("tomatoes water", 5).collect()
    assert top[0]["filePath"].endswith("b.md") and top[0]["fileTitle"] == "Gardening" and [r["score"] for r in top] == sorted(r["score"] for r in top)
    assert {r["filePath"] for r in engine.query_documents("tomatoes", 5, str(root / "sub")).collect()} == {str(root / "sub" / "b.md")}
    made = engine.ingest_data("<title>Page</title><p>Some web page about sailing boats and the wind on wide seas.</p>", "https://Ex.org/p?q=1", "html")
    assert made["chunkCount"] == 1
    files, rest = engine.list_files()
    assert [(os.path.basename(r["filePath"]), r["ingested"]) for r in files.collect()] == [("a.txt", True), ("b.md", True)]
    assert [r["source"] for r in rest.collect()] == ["https://ex.org/p"]
    around = engine.read_chunk_neighbors(0, source="https://ex.org/p")
    assert len(around) == 1 and around[0]["isTarget"]
    (root / "a.txt").write_text(TEXT.upper())
    (root / "sub" / "b.md").unlink()
    assert counts(engine.sync()) == {"upserted": 1, "skipped": 0, "empty": 0, "pruned": 1}
    gone = engine.delete_file(source="https://ex.org/p")
    assert gone["removedChunks"] == 1 and not os.path.exists(gone["filePath"]) and not engine.delete_file(source="https://ex.org/p")["existed"]
    for bad in ("relative.txt", "/etc/passwd", str(root / "missing" / ".." / ".." / "x.txt")):
        with pytest.raises(ValueError):
            engine.ingest_file(bad)
    (root / "new.txt").write_text("A new file that the stream should find and store as one more chunk.")
    follow(engine, str(root), str(tmp_path / "check")).awaitTermination(120)
    assert engine.store.files().where(F.col("filePath").endswith("new.txt")).count() == 1


def test_scan_and_settings(tmp_path):
    deep = tmp_path
    for k in range(4):
        deep = deep / f"d{k}"
    deep.mkdir(parents=True)
    (deep / "x.txt").write_text("x")
    assert scan.collect(str(tmp_path))[0] == [str(deep / "x.txt")]
    files, seen = scan.collect(str(tmp_path), depth=2)
    assert files == [] and len(seen.too_deep) == 1
    assert scan.collect(str(tmp_path), scope=[str(tmp_path / "other")])[0] == []
    assert scan.surviving_roots(["/a/b", "/a", "/ab", "/a"]) == ["/a", "/ab"] and scan.sensitive("/etc/x") and not scan.sensitive("/etcx")
    made = Settings.from_env({"RAG_GROUPING": "odd", "RAG_MAX_FILES": "3", "RAG_HYBRID_WEIGHT": "2"})
    assert made.grouping is None and made.max_files == 3 and made.hybrid_weight == search.WEIGHT and len(made.warnings) == 2
    with pytest.raises(ValueError):
        Settings.from_env({"BASE_DIRS": '{"a": 1}'})
