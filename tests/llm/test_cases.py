"""Cases that every operator must bear: clashing columns, long texts, ties, nulls, small memories; and independent recounts."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from marlspike.llm import bpe, decontaminate, exact, feistel, langid, passages, simhash, template, warc
from marlspike.llm.common import shared_dir
from marlspike.llm.words import LETTERS, SPACES, texts, words

LONG = "lorem ipsum dolor " * 60_000


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_ranks(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference(merges):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


# the splitter and the encoder

PARTS = [" ", "  ", "\n", "\r\n", "\t", "'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "a", "s", "re", "é", "word", "12", "²", "Ⅻ", "!", "?!", "''", "\x1c", "\u0085", " ", "　", "漢字", "😀", "𝟙", "_", "ll", " the"]


@pytest.mark.parametrize("block", [16, 90, 1 << 18])
def test_encoder_in_blocks_is_the_vocabularys(merges, reference, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        rows = ["".join(rng.choices(PARTS, k=rng.randint(0, 150))) for _ in range(6)]
        rows.append(rng.choice(["a", " ", "\n", "é", "!", "漢", "'s", "1"]) * rng.randint(1, 1500) + rng.choice(["", " x", "'s", "\n\n "]) + rng.choice(["b", "'", " ", "　"]) * rng.randint(0, 500))
        ids, n = bpe.Encoder(merges, rng.choice([0, 3, 1000])).encode(*texts(pa.array(rows, pa.string()), False))
        ends = np.cumsum(n)
        assert [ids[b - k : b].tolist() for b, k in zip(ends, n)] == [reference.encode_ordinary(t) for t in rows]


def test_batched_merges_are_those_of_each_piece(merges):
    rng = random.Random(1)
    pieces = [bytes(rng.choices(b"ethranis on", k=rng.randint(1, 48))) for _ in range(3000)] + [bytes([k]) for k in range(256)]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array(list(map(len, pieces)))
    ids, n = merges.batch(data, np.cumsum(sizes) - sizes, sizes)
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n)] == [merges.apply(p) for p in pieces]


def test_encoder_takes_bytes_that_are_no_text(merges):
    data = np.array([0x80, 0xC3, 0x41, 0xF5, 0xFF, 0xE2, 0x82, 0x20, 0xED, 0xA0, 0x80, 0xC3], np.uint8)
    ids, n = bpe.Encoder(merges).encode(data, np.array([0, 7, len(data)]))
    assert b"".join(merges.tokens[i] for i in ids.tolist()) == data.tobytes() and n.sum() == len(ids)


def test_training_order_over_many_files_and_clashing_columns(spark, reference, tmp_path):
    rng = random.Random(3)
    rows = [(k if k % 7 else None, None if k % 11 == 0 else " ".join(rng.choices(["alpha", "beta's", "12", "é\n"], k=rng.randint(0, 90))), k, "x") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, slot int, file string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [(r["doc_id"], k, ids[a : a + 16]) for r in source.selectExpr("*", "input_file_name() f").coalesce(1).orderBy("f").collect() for ids in [reference.encode_ordinary(r["text"] or "")] for k, a in enumerate(range(0, len(ids), 16))]
    index = feistel.write_indexed(source, f"file://{tmp_path}/shards", length=16, per_shard=100).collect()
    assert sorted(r["slot"] for r in index) == list(range(len(want)))
    slots = feistel.Permutation(len(want)).slots(np.arange(len(want)))
    read = list(feistel.read_slots(f"file://{tmp_path}/shards", 0, len(want), 16, 100))
    by = {r["slot"]: r for r in index}
    got = sorted(((by[s]["doc_id"], by[s]["sequence"], read[s][: by[s]["n_tokens"]].tolist()) for s in slots.tolist()), key=repr)
    assert got == sorted(want, key=repr) and all((read[s][by[s]["n_tokens"] :] == feistel.PAD).all() for s in by)
    with pytest.raises(ValueError):
        feistel.ordered(source, pad=5)


# extra columns that clash, long texts, ties


def test_clashing_columns_change_nothing(spark):
    rows = [(1, "the same text of some words", 9, "a"), (2, "the same text of some words", 8, "b"), (3, None, 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner_id int, row string")
    assert [tuple(r) for r in exact.duplicate_owners(docs).collect()] == [(2, 1)] == [tuple(r) for r in simhash.near_copies(docs).collect()]
    assert bpe.encoded(docs.withColumnsRenamed({"owner_id": "tokens", "row": "intact"})).count() == 3
    items = spark.createDataFrame([(5, "the same text", 1)], "item_id long, text string, doc_id int")
    assert {r[0] for r in decontaminate.matches(docs.withColumnRenamed("row", "item_id"), items).collect()} == {1, 2}
    whole = " ".join(f"w{k}" for k in range(60))
    repeated = spark.createDataFrame([(1, whole, 1, 2), (2, whole, 1, 2)], "doc_id long, text string, key int, number int")
    assert sorted(tuple(r) for r in passages.repeated(repeated).collect()) == [(1, 0, 60, 1), (2, 0, 60, 1)]
    found = langid.identify(spark.createDataFrame([(1, whole, "en", "x")], "doc_id long, text string, lang string, detected string")).collect()
    assert found[0]["detected"] == "en"
    pages = spark.createDataFrame([(None, "http://a.example/", "<p>x</p>", "h", 1), (None, None, "<p>x</p>", "h", 1)], "page_id long, url string, html string, host string, share int")
    assert sorted(r["text"] for r in template.extracted(pages).collect()) == ["x", "x"]


def test_archive_of_null_ids_and_few_records(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, "<p>x</p>", 3, "f"), (4, "http://a.example/", "", 3, "f")], "page_id long, url string, html string, length int, file string")
    index = warc.write_warc(pages.coalesce(1), f"file://{tmp_path}/few").collect()
    data = (tmp_path / "few" / index[0]["file"]).read_bytes()
    reader, first = warc.open_dictionary(data)
    assert first > 8  # a file of two records has a dictionary too
    assert [warc.parse(reader.decompress(data[r["file_offset"] : r["file_offset"] + r["length"]]))[1] for r in index] == [b"<p>x</p>", b""]
    assert [f.get("WARC-Target-URI") for f, _ in warc.unpack(data)] == [None, "urn:page:None", "http://a.example/"]


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG + "more"), (3, "short words here")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.near_copies(docs).collect()] in ([(2, 1)], [])
    assert langid.identify(docs.selectExpr("*", "'la' lang")).where("accepted").count() == 3
    items = spark.createDataFrame([(1, " ".join(f"it{k}" for k in range(10_000)))], "item_id long, text string")
    around = spark.createDataFrame([(7, LONG + items.first()["text"] + " " + LONG)], "doc_id long, text string")
    began = time.time()
    assert [tuple(r) for r in decontaminate.matches(around, items).collect()] == [(7, 1, 1.0, 180_000, 10_000)]
    assert time.time() - began < 60
    page = spark.createDataFrame([(1, "http://a.example/", f"<div>{LONG}</div>")], "page_id long, url string, html string")
    assert len(template.extracted(page).first()["text"]) == len(LONG.strip())


def test_bits_of_as_many_ones_as_zeros_are_decided_alike():
    a, b, has = simhash.fingerprints(pa.array(["one two", "two one", "one two two", "one"]))
    assert has.all() and a[0] == a[1] == a[2] and b[0] == b[1] == b[2]


def test_equal_cosines_go_to_the_first_language():
    text = "some words"
    made = langid.Encoder()
    v = made.vectors([text])[0][0].astype(float)
    profile = np.stack([v, v]) / np.linalg.norm(v)
    best, cosine, lead, keep = langid.score([text], ["aa", "bb"], profile, langid.LEAST, langid.DIMENSIONS, langid.SEED)
    assert best == ["aa"] and cosine[0] == 1 and lead[0] == 0 and keep[0]


def test_language_scores_are_those_of_plain_hypervectors(spark):
    """All of operator 9 again with plain sums over letters."""
    rows = [(k, f"{own} {own.split()[k % 5]} {'abcdefgh'[k % 8]}", lang) for lang, own in {"en": "the house and that river is with this", "de": "das haus und der fluss mit nicht werden"}.items() for k in range(6)]
    rows += [(50, "the river house", None), (51, "zzz qqq", None), (52, "ok", None), (53, "жжж щщщ " * 40, None), (54, "12", None)]
    letter = lambda c: langid.Encoder().letter(np.array([ord(c)]))[0].astype(np.int64)
    known = {}

    def bundle(text):
        line = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        grams = [line[k : k + 3] for k in range(len(line) - 2)] if line.strip() else []
        for c in line:
            known.setdefault(c, letter(c))
        return sum((np.roll(known[x], 2) * np.roll(known[y], 1) * known[z] for x, y, z in grams), np.zeros(langid.DIMENSIONS, np.int64)), len(grams)

    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for _, text, lang in rows:
        v, n = bundle(text)
        if lang and n:
            sums[lang] += v / np.linalg.norm(v)
    want = {}
    for i, text, _ in rows:
        v, n = bundle(text)
        like = {lang: round(float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)), 5) if n else 0 for lang, s in sorted(sums.items())}
        top = max(like, key=like.get)
        want[i] = (top if n else None, like[top], n > 0 and like[top] >= 0.1 * (1 - (24 / n) ** 0.5))
    seen = {}
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        seen.setdefault(r["doc_id"], []).append((r["detected"], round(r["cosine"], 5), r["accepted"]))
    for i in (50, 51, 52, 53, 54):
        (got,) = seen[i]
        assert got[0] == want[i][0] and abs(got[1] - want[i][1]) < 2e-5 and got[2] == want[i][2]
    assert not want[53][2] and want[52][2]


def test_threshold_rises_without_a_step():
    at = langid.threshold(np.arange(1, 5000))
    assert (np.diff(at) > 0).all() and np.diff(at)[3:].max() < 0.03 and abs(at[23]) < 1e-12 and at[-1] < langid.LEAST


# exact copies with little memory


def test_owners_with_small_tries(spark):
    rng = random.Random(4)
    home = exact.Scratched(shared_dir(spark))
    links = []

    def join(a, b):
        if a.group < 0:
            a.group = a.number
            links.append((a.number, a.group))
        links.append((b.number, a.group))
        a.take(b.least)
        return a

    trie, want = exact.Trie(join, 8_000, home), defaultdict(list)
    for k in range(2000):
        key = bytes(rng.choices(b"abc", k=rng.randint(0, 5)))
        doc = rng.choice([None, rng.randrange(10_000)])
        want[key].append((k, doc))
        trie.insert(key, exact.Text(doc, k, 1))
    owner = {v.group: v.least for _, v in trie.drain() if v.group >= 0}
    assert home.made is not None
    home.close()
    got = {number: owner[group] for number, group in links}
    for own in want.values():
        if len(own) > 1:
            least = min((d for _, d in own if d is not None), default=None)
            assert all(got[k] == least for k, _ in own)
    assert len(got) == sum(len(x) for x in want.values() if len(x) > 1)


def test_a_tries_size_follows_its_values():
    trie = exact.Trie(lambda a, b: a + b, 1 << 30, None, len)
    for _ in range(100):
        trie.insert(b"key", "x" * 50)
    assert trie.size >= 5000


# passages: a minimizer whose segments outgrow the batch


def test_segments_beyond_a_batch_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(40)}" for _ in range(400)]
    segs = sorted({" ".join(base[a : a + rng.randint(12, 30)]).encode() for a in (rng.randrange(300) for _ in range(120))})
    got = []
    for limit in (1 << 20, 300):
        monkeypatch.setattr(passages, "_BATCH", limit)
        home = exact.Scratched(shared_dir(spark))
        shard, parted = passages.Shard(home, 10, 50), False
        for k, seg in enumerate(segs):
            shard.add(7, seg, k, k, k, k)
            parted |= shard.parted
        assert parted == (limit == 300)
        shard.flush()
        rows = [x for x in shard.found if x[0] is None] + list(shard.ranges())
        home.close()
        got.append({(e, a + k, owner) for _, e, a, n, owner in rows for k in range(n)})
    windows = defaultdict(list)
    for e, seg in enumerate(segs):
        w = seg.split()
        for k in range(len(w) - 9):
            windows[tuple(w[k : k + 10])].append((e, k))
    want = {(e, k, min(x for x, _ in own)) for own in windows.values() if len({e for e, _ in own}) > 1 for e, k in own}
    assert got[0] == got[1] == want


# templates with production parameters, counted by another parser


class Tree(HTMLParser):
    """Subtrees of a well-formed page, as strings."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.found = [["", "", False]], set()
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.stack.append([f"<{tag} {attrs}>", "", False])

    def handle_endtag(self, tag):
        head, body, seen = self.stack.pop()
        whole = f"{head}{body}</{tag}>"
        if seen:
            self.found.add(whole)
        self.stack[-1][1] += whole
        self.stack[-1][2] |= seen

    def handle_data(self, data):
        if data.split():
            self.stack[-1][1] += f"[{' '.join(data.split())}]"
            self.stack[-1][2] = True


def test_template_by_another_parser(spark):
    rng = random.Random(6)
    blocks = [f"<div class=b{k}><span>Block {k}</span><b>common {k}</b></div>" for k in range(30)]
    pages = []
    for k in range(300):
        own = rng.choices(blocks, weights=[1 / (j + 1) ** 2 for j in range(30)], k=3)
        pages.append((k, f"http://{'big' if k % 3 else 'small'}.example/{k}", f"<section><h1>Title {k}</h1>{''.join(own)}<div>text {k}<i>tail {rng.randrange(40)}</i></div></section>"))
    pages += [(1000 + k, url, html) for k, (_, url, html) in enumerate(pages[:40])]  # copies count once
    count, kinds = defaultdict(lambda: defaultdict(int)), defaultdict(set)
    for _, url, html in pages:
        host = url.split("/")[2]
        if html not in kinds[host]:
            kinds[host].add(html)
            for x in Tree(html).found:
                count[host][x] += 1
    got = {r["page_id"]: r["text"] for r in template.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}

    class Rest(Tree):
        def __init__(self, html, gone):
            self.gone = gone
            super().__init__(html)

        def handle_endtag(self, tag):
            head, body, seen = self.stack.pop()
            whole = f"{head}{body}</{tag}>"
            self.stack[-1][1] += whole
            self.stack[-1][2] |= seen
            text = getattr(self, "texts", {}).pop(len(self.stack), "")
            self.texts = getattr(self, "texts", {})
            if whole not in self.gone:
                sep = "\n" if tag in ("div", "section", "h1") else ""
                at = len(self.stack) - 1
                self.texts[at] = self.texts.get(at, "") + sep + text + sep
            else:
                at = len(self.stack) - 1
                self.texts[at] = self.texts.get(at, "") + "\n"

        def handle_data(self, data):
            super().handle_data(data)
            self.texts = getattr(self, "texts", {})
            at = len(self.stack) - 1
            self.texts[at] = self.texts.get(at, "") + data

    removed = 0
    for i, url, html in pages:
        host = url.split("/")[2]
        gone = {x for x, n in count[host].items() if n >= template.FEWEST and n >= template.SHARE * len(kinds[host])}
        rest = Rest(html, gone)
        want = "\n".join(line for line in (" ".join(x.split()) for x in rest.texts[0].split("\n")) if line)
        assert got[i] == want
        removed += any(x in gone for x in Tree(html).found)
    assert removed > 100


def test_deep_pages_are_read_in_time():
    for html in ("<p><section>" + "<span>" * 20_000 + "<ul>" * 20_000 + "x", "<div>" * 30_000 + "x" + "</b>" * 30_000, "<div>" * 30_000 + "a" + "</div>" * 30_000):
        began = time.time()
        assert template.elements(html)[0] and template.plain(html) in ("x", "a")
        assert time.time() - began < 20


def test_words_of_one_kind_only():
    h, _, _, first = words(*texts(pa.array(["a " * 3000], pa.string()), False), SPACES)
    assert len(set(h.tolist())) == 1 and first.tolist() == [0, 3000]
    doc, key, at, n = passages.segments(h, first, 50, 8)
    assert n.tolist() == [2951]
    assert len(words(*texts(pa.array([None, ""], pa.string()), True), LETTERS)[0]) == 0


def test_radius_finds_nine_in_ten_edited_passages(spark):
    """Fingerprints against the verification alone, passages with a block of words replaced."""
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index, rng = decontaminate.Index(items), np.random.default_rng(1)
    for block in (1, 3, 5, 8):
        near = []
        for i, own in enumerate(index.words):
            n = min(block, len(own))
            at = rng.integers(0, len(own) - n + 1)
            edited = own.copy()
            edited[at : at + n] = rng.integers(0, 2**63, n, dtype=np.uint64)
            if index.similarity(edited, i) >= decontaminate.LEAST:
                print_ = decontaminate.fingerprints(decontaminate.bits(edited).sum(axis=0, dtype=np.int32)[None])
                near.append(i in index.candidates(print_)[1])
        assert len(near) > 100 and np.mean(near) >= (0.85 if block == 8 else 0.9)
