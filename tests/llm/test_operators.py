"""The training-data operators against brute force, round trips, SQL and small cases of every defined result."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from marlspike.llm import bpe, components, decontaminate, exact, feistel, induced, langid, passages, queries, simhash, template, urlfilter, warc
from marlspike.llm.common import Scratch, shared_dir, table
from marlspike.llm.words import LETTERS, texts, words
from oracle import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def groups(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# 7: exact dedup

ODD = [(5, "x"), (3, "x"), (9, None), (9, None), (1, ""), (2, ""), (4, "long " * 50_000), (6, "long " * 50_000), (7, "xy"), (None, "xy"), (3, "x"), (8, "only")]


def test_exact_owners(spark, sf):
    assert tuples(exact.duplicate_owners(docs(spark, ODD))) == sorted([(5, 3), (2, 1), (6, 4), (None, 7)], key=repr)
    assert exact.duplicate_owners(docs(spark, [])).count() == 0
    same(queries.QUERIES["op7_exact_dedup"](spark, sf), queries.ORACLES["op7_exact_dedup"], sf)


def test_exact_drop_keeps_one_and_clashing_columns(spark):
    rows = [(*r, k, f"d{k}") for k, r in enumerate(ODD)]
    out = exact.drop_exact_copies(docs(spark, rows, "doc_id long, text string, LENGTH int, digest string"))
    assert out.columns == ["doc_id", "text", "LENGTH", "digest"]
    assert sorted((r[0], r[2]) for r in out.collect()) == [(1, 4), (3, 1), (4, 6), (7, 8), (8, 11), (9, 2), (9, 3)]
    assert exact.drop_exact_copies(docs(spark, [])).count() == 0


def test_trie_spills_and_forgets_nothing(spark):
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(3000)]
    want = defaultdict(int)
    for k in keys:
        want[k] += 1
    home = exact.Scratched(shared_dir(spark))
    trie = exact.Trie(lambda a, b: a + b, 20_000, home)
    for k in keys:
        trie.insert(k, 1)
    got = list(trie.drain())
    assert home.made is not None and len(got) == len(want) and dict(got) == want
    home.close()


# 8: near copies


def brute_groups(rows, radius=simhash.RADIUS):
    """The owner of every row by comparing all pairs."""
    a, b, has = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    edges = [(i, j) for i, j in itertools.combinations(np.flatnonzero(has).tolist(), 2) if int(a[i] ^ a[j]).bit_count() + int(b[i] ^ b[j]).bit_count() <= radius]
    return groups(len(rows), edges)


@pytest.mark.parametrize("tile", [16, 8192])
def test_near_copies_are_those_of_all_pairs(spark, sf, tile):
    rows = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + [(1000, None), (1001, ""), (1002, "...")]
    found = defaultdict(list)
    for (i, _), g in zip(rows, brute_groups(rows)):
        found[g].append(i)
    want = sorted(((i, min(own)) for own in found.values() for i in own if i != min(own)), key=repr)
    assert want and tuples(simhash.near_copies(docs(spark, rows), tile=tile)) == want


def test_near_drop(spark):
    base = [f"word{k}" for k in range(300)]
    rows = [(7, " ".join(base), "a"), (2, " ".join(base[:299] + ["other"]), "b"), (None, " ".join(base), "c"), (4, None, "d"), (4, None, "d"), (5, "something else here", "e"), (6, "", "f"), (8, "something else here", "g"), (8, "something else here", "g")]
    out = simhash.drop_near_copies(docs(spark, rows, "doc_id long, text string, print_a string"))
    assert out.columns == ["doc_id", "text", "print_a"]
    assert sorted(r[2] for r in out.collect()) == ["b", "d", "d", "e", "f"]
    assert simhash.drop_near_copies(docs(spark, [])).count() == 0 == simhash.near_copies(docs(spark, [])).count()


@pytest.mark.parametrize(("blocks", "cell"), [(1, 300), (3, 100), (8, 64), (21, 10_000), (None, 50)])
def test_near_prints_in_any_blocks_are_those_of_all_pairs(spark, blocks, cell):
    rng = random.Random(5)
    flipped = lambda x, n: x ^ sum(1 << k for k in rng.sample(range(128), n))
    prints = {flipped(middle, rng.randrange(14)) for middle in [rng.getrandbits(128) for _ in range(30)] for _ in range(12)}
    prints |= {flipped(rng.getrandbits(9), rng.randrange(4)) for _ in range(200)} | {rng.getrandbits(128) for _ in range(100)}
    # of exactly the radius, spread over all blocks, and one bit more
    middle = rng.getrandbits(128)
    prints |= {middle, middle ^ sum(1 << 6 * k for k in range(20)), middle ^ sum(1 << 6 * k + 3 for k in range(21))}
    prints = sorted(prints)
    want = groups(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in prints]
    found = {(r[0], r[1]): r[2] for r in simhash.components(spark.createDataFrame([*rows, rows[0], (None, None)], "a long, b long"), cell=cell, blocks=blocks).collect()}
    sizes = Counter(want)
    assert found.keys() == {r for r, g in zip(rows, want) if sizes[g] > 1}
    both = {(g, found[r]) for r, g in zip(rows, want) if r in found}
    assert len(both) == len({g for g, _ in both}) == len({g for _, g in both}) > 10


@pytest.mark.parametrize(("n", "share"), [(100_000, 0.15), (1_000_000, 0.03)])
def test_few_pairs_of_prints_are_compared(n, share):
    a, b = np.random.default_rng(1).integers(0, 1 << 64, (2, n), np.uint64)
    compared = 0
    for at, width, most, _ in simhash.Plan(n, simhash.RADIUS, simhash.CELL).blocks:
        each = np.bincount(simhash.field(a, b, at, width).astype(np.int64), minlength=1 << width)
        compared += sum(int((each * each[np.arange(1 << width) ^ m]).sum()) for m in simhash.masks(width, most).tolist())
    assert compared < share * n * n


def test_components_on_driver_and_in_spark(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    want = groups(341, edges)
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    df = spark.createDataFrame(edges, "u long, v long")
    for most in (0, 10_000):
        assert tuples(components.roots(df, most)) == sorted([(x, want[x]) for x in nodes], key=repr)


# 1: decontamination


def brute_matches(rows, items, radius=decontaminate.RADIUS, least=decontaminate.LEAST):
    """Every window of every text against every item."""
    index = decontaminate.Index(items, radius, least)
    out = []
    for doc, text in rows:
        h, _, _, _ = words(*texts(pa.array([text], pa.string()), True), LETTERS)
        for i, own in enumerate(index.words):
            n, best = len(own), None
            for s in range(max(1, len(h) - n + 1)):
                w = h[s : s + n]
                if not len(w):
                    continue
                p = decontaminate.fingerprints(decontaminate.bits(w).sum(axis=0, dtype=np.int32)[None])[0]
                if int(p ^ index.prints[i]).bit_count() <= radius and (like := index.similarity(w, i)) >= least:
                    best = min(best or (0, 0), (-like, s))
            if best:
                out.append((doc, index.ids[i], round(-best[0], 9), best[1], min(n, len(h))))
    return sorted(out, key=repr)


def test_decontamination_is_that_of_all_windows(spark, sf):
    items = [tuple(r) for r in table(spark, sf, "benchmark").orderBy("item_id").collect()][:12] + [(100, "two words"), (101, None), (102, "")]
    rng = random.Random(5)
    pool = [tuple(r) for r in table(spark, sf, "documents").where("n_chars < 2500").select("doc_id", "text").orderBy("doc_id").limit(25).collect()]
    rows = pool + [(900, None), (901, ""), (903, "say two words, again: Two words")]
    for k, (_, text) in enumerate(items[:12]):
        w = text.split()
        rows.append((1000 + k, " ".join(pool[k][1].split()[:40] + w + pool[k][1].split()[40:80])))
        w[rng.randrange(len(w))] = "changed"
        rows.append((2000 + k, "before " + " ".join(w).upper() + " after"))
    got = tuples(decontaminate.matches(docs(spark, rows), docs(spark, items, "item_id long, text string")))
    assert got == brute_matches(rows, items)
    assert {r[0] for r in got} >= {1000 + k for k in range(12)} | {2000 + k for k in range(12)}
    kept = decontaminate.drop_contaminated(docs(spark, [(*r, "s") for r in rows], "doc_id long, text string, similarity string"), docs(spark, items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "similarity"]
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in {g[0] for g in got})


def test_decontamination_segments_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 50)
    item = " ".join(f"item{k}" for k in range(30))
    text = " ".join([f"w{k}" for k in range(35)] + [item] + [f"v{k}" for k in range(90)] + [item])
    index = decontaminate.Index([(1, item)])
    h, _, _, first = words(*texts(pa.array([text]), True), LETTERS)
    assert index.search(h, first) == [(0, 0, 1.0, 35, 30)]
    none = docs(spark, [], "item_id long, text string")
    assert decontaminate.matches(docs(spark, [(1, "a b c")]), none).count() == 0
    assert decontaminate.matches(docs(spark, []), none).count() == 0
    assert decontaminate.drop_contaminated(docs(spark, [(1, "a b c")]), none).count() == 1


# 4: BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_vocabularys(spark, sf, reference):
    rows = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, "²Ⅻ x\x1cy\u0085 <|endoftext|> \U0001f600퟿ it's  'll\n\n _a_1"), (1003, "ab" * 100_000), (1003, "ab" * 100_000)]
    got = tuples(bpe.encoded(docs(spark, rows)))
    want = sorted(((i, None, None, None) if t is None else (i, len(e := reference.encode_ordinary(t)), e, True) for i, t in rows), key=repr)
    assert got == want
    assert bpe.encoded(docs(spark, [])).count() == 0


def test_transducer_in_parts_is_the_whole(ranks, reference):
    merges, rng = bpe.Merges(ranks), random.Random(2)
    for data in (b"a" * 40_000, bytes(rng.choices(b"ethraninson ", k=30_000)), " the".encode() * 5000, bytes(rng.randrange(256) for _ in range(9000))):
        machine, out, at = bpe.Transducer(merges), [], 0
        while at < len(data):
            n = rng.randint(1, 5000)
            out += machine.push(data[at : at + n])
            assert len(machine.held) <= 2 * machine.full
            at += n
        assert out + machine.finish() == merges.apply(data)


def test_decoder_in_parts_is_the_whole():
    rng = random.Random(4)
    single = [bytes([b]) for b in range(256)]
    for _ in range(300):
        data = b"".join(rng.choice(["é".encode(), "€".encode(), "😀".encode(), b"a", bytes([rng.randrange(256)])]) for _ in range(20))
        machine, text, at = bpe.Decoder(single), "", 0
        while at < len(data):
            n = rng.randint(1, 3)
            text += machine.push(data[at : at + n])
            assert len(machine.tail) <= 3
            at += n
        assert text + machine.finish() == data.decode("utf-8", "replace")


# 9: language ID


def test_language_on_held_out_rows(spark):
    whole = table(spark, "/root/testdata/sf0.01", "documents")
    names, profile = langid.prototypes(whole.where("doc_id % 2 = 0"))
    rows = whole.where("doc_id % 2 = 1 AND n_chars > 200").select("text", "lang").collect()
    best, _, _, _ = langid.score([r[0] for r in rows], names, profile, langid.LEAST, langid.DIMENSIONS, langid.SEED)
    assert np.mean([b == r[1] for b, r in zip(best, rows)]) > 0.95


def test_language_rejects_what_it_must(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang").collect()]
    rng = random.Random(6)
    odd = [(1000, None, None), (1001, "", "xx"), (1002, "12 34 !!", None), (1003, "ok", None), (1004, " ".join("".join(rng.choices("զթժիլխծկհձ", k=6)) for _ in range(200)), None)]
    found = {r["doc_id"]: r for r in langid.identify(docs(spark, rows + odd, "doc_id long, text string, lang string")).collect()}
    assert len(found) == len(rows) + 5
    assert [found[k]["accepted"] for k in range(1000, 1005)] == [False, False, False, True, False]
    assert found[1000]["detected"] is None and found[1000]["cosine"] == 0
    normal = [i for i, t, _ in rows if sum(c.isalpha() for c in t) > 200]
    assert np.mean([found[i]["accepted"] for i in normal]) > 0.99
    kept = langid.drop_rejected(docs(spark, [(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, cosine double"))
    assert sorted(r[0] for r in kept.collect()) == sorted(i for i, r in found.items() if r["accepted"])
    assert langid.identify(docs(spark, [], "doc_id long, text string, lang string")).count() == 0
    none = langid.identify(docs(spark, [(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert none["detected"] is None and not none["accepted"]


def test_vector_is_the_bundle_of_bound_letters():
    made = langid.Encoder()
    letter = lambda c: made.letter(np.array([ord(c)]))[0].astype(int)
    padded = " abça "
    want = sum(np.roll(letter(x), 2) * np.roll(letter(y), 1) * letter(z) for x, y, z in zip(padded, padded[1:], padded[2:]))
    assert np.array_equal(made.vectors(["AbÇa"])[0][0], want.astype(np.float32))


# 2: training order


def test_permutation_is_a_bijection_and_inverts():
    for n in [*range(1, 70), 1000, 4097]:
        p = feistel.Permutation(n)
        slots = p.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and np.array_equal(p.numbers(slots), np.arange(n))
    assert not np.array_equal(feistel.Permutation(1000, 1).slots(np.arange(1000)), feistel.Permutation(1000, 2).slots(np.arange(1000)))


def test_training_order_and_shards(spark, sf, reference, tmp_path):
    source = table(spark, sf, "documents").coalesce(1)
    rows = [(r[0], r[1]) for r in source.select("doc_id", "text").collect()]
    want = []
    for doc, text in rows:
        ids = reference.encode_ordinary(text)
        want += [(doc, k, ids[a : a + 64]) for k, a in enumerate(range(0, len(ids), 64))]
    slots = feistel.Permutation(len(want)).slots(np.arange(len(want))).tolist()
    out = feistel.ordered(table(spark, sf, "documents"), length=64, per_shard=500)
    got = {r["slot"]: r for r in out.collect()}
    assert sorted(got) == list(range(len(want)))
    for slot, (doc, k, ids) in zip(slots, want):
        r = got[slot]
        record = np.frombuffer(r["record"], "<u2").tolist()
        assert (r["doc_id"], r["sequence"], r["n_tokens"], r["shard"], r["byte_offset"]) == (doc, k, len(ids), slot // 500, slot % 500 * 128)
        assert record == ids + [feistel.PAD] * (64 - len(ids))
    written = feistel.write_shards(out, f"file://{tmp_path}/shards").collect()
    assert sum(r["records"] for r in written) == len(want) and all(r["bytes"] == 128 * r["records"] for r in written)
    read = [x.tolist() for x in feistel.read_slots(f"file://{tmp_path}/shards", 490, 515, 64, 500)]
    assert read == [np.frombuffer(got[s]["record"], "<u2").tolist() for s in range(490, 515)]


def test_training_order_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x " * 3000)]
    out = feistel.ordered(docs(spark, rows), length=1024).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    assert sorted(r["doc_id"] for r in out if r["doc_id"]) == [3, 3] and sum(r["n_tokens"] for r in out if r["doc_id"] is None) == 3001
    assert feistel.ordered(docs(spark, [])).count() == 0


# 3: HTML


def test_templates_go_and_content_stays(spark):
    page = "<html><head><title>T</title></head><body><div class=nav><p>Home<p>About us</div><div>Unique {k} &amp; text<p>more {k}</div><script>x('<p>')</script><footer>All rights</footer></body></html>"
    rows = [(k, f"https://www.Site.example/{k}?q", page.format(k=k)) for k in range(10)]
    rows += [(20 + k, f"http://other.example/{k}", f"<p>Home</p><p>Page {k}</p>") for k in range(2)]
    rows += [(30, None, page.format(k="x")), (31, "http://site.example/", None), (32, "http://site.example/e", ""), (33, "http://site.example/c", page.format(k=3))]
    got = {r["page_id"]: r for r in template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(10):
        assert got[k]["text"] == f"Unique {k} & text\nmore {k}" and got[k]["n_removed"] == 2
    assert got[20]["text"] == "Home\nPage 0" and got[20]["n_removed"] == 0
    assert got[30]["text"].startswith("Home\nAbout us\nUnique x & text") and got[30]["n_removed"] == 0
    assert got[31]["text"] is None and got[32]["text"] == "" and got[33]["text"] == "Unique 3 & text\nmore 3"
    assert template.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_counts_are_those_of_all_pages(spark, sf):
    pages = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html", template.host().alias("host")).collect()]
    kinds = defaultdict(dict)
    for _, _, html, host in pages:
        found, root = template.elements(html)
        kinds[host][root] = {h for h, _, _ in found}
    count = {host: defaultdict(int) for host in kinds}
    for host, own in kinds.items():
        for hashes in own.values():
            for h in hashes:
                count[host][h] += 1
    want = {}
    for i, _, html, host in pages:
        gone = {h for h, n in count[host].items() if n >= 2 and n >= 0.3 * len(kinds[host])}
        spans = template.outermost(template.elements(html)[0], gone)
        want[i] = (template.plain(html, spans), len(spans))
    got = {r["page_id"]: (r["text"], r["n_removed"]) for r in template.extracted(table(spark, sf, "pages"), 2, 0.3).collect()}
    assert got == want and any(n for _, n in want.values())


# 5: passages


@pytest.mark.parametrize("most", [100, 200_000])
def test_suffixes_are_sorted(spark, most):
    rng = random.Random(most)
    for kinds, n in ((2, 300), (5, 400), (300, 300), (1, 120)):
        symbols = [rng.randint(1, kinds) for _ in range(n)]
        scratch = exact.Scratched(shared_dir(spark))
        text = induced.Text(scratch, most)
        text.extend(symbols)
        got = list(induced.suffixes(text, 10, scratch, most))
        scratch.close()
        order = sorted(range(n), key=lambda i: symbols[i:])
        prefix = lambda a, b: next((k for k in range(10) if symbols[a + k : a + k + 1] != symbols[b + k : b + k + 1]), 10)
        assert [p for p, _ in got] == order
        assert [min(10, s) for _, s in got[1:]] == [prefix(a, b) for a, b in zip(order, order[1:])]


def test_passages_are_the_sqls(spark, sf):
    same(queries.QUERIES["op5_repeated_passages"](spark, sf), queries.ORACLES["op5_repeated_passages"], sf)
    same(passages.repeated(table(spark, sf, "documents"), hot=1), queries.ORACLES["op5_repeated_passages"], sf)


@pytest.mark.parametrize("most", [64, 200_000])
def test_passages_of_odd_rows(spark, tmp_path, most):
    rng = random.Random(8)
    shared, other = (" ".join(f"{c}{k % 37}" for k in range(n)) for c, n in (("s", 120), ("t", 60)))
    filler = lambda: " ".join(f"f{rng.randrange(10**6)}" for _ in range(70))
    rows = [(4, f"{filler()} {shared} {filler()}"), (2, f"{shared}\n{filler()}"), (3, f"{other} {filler()} {other}"), (5, f"x {' '.join(shared.split()[10:70])} {other}")]
    rows += [(6, f"{other} own {other}"), (7, None), (8, ""), (9, filler()), (None, shared), (2, rows[1][1]), (10, "a " * 500), (11, "a " * 300)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for hot in (1, 10_000):  # with all shared minimizers counted in Spark, and with none
        same(passages.repeated(docs(spark, rows), most=most, hot=hot), passages.oracle(), str(tmp_path))
    assert passages.repeated(docs(spark, [])).count() == 0


# 6: URL filter


def test_url_scores_are_the_sqls(spark, sf):
    same(queries.QUERIES["op6_url_filter"](spark, sf), queries.ORACLES["op6_url_filter"], sf)


def test_url_filter_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "https://casino.example/1"), (3, "https://casino.example/1"), (4, "https://good.example/7"), (None, "https://good.example/8")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = urlfilter.scored(pages, labels, urlfilter.SEEDS).collect()
    assert len(got) == 6
    by = {r["page_id"]: r for r in got}
    assert by[1]["score"] is None and by[1]["kept"] and not by[3]["kept"] and by[4]["kept"] and by[None]["kept"]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urlfilter.scored(pages, none, urlfilter.SEEDS).first()["threshold"] == 0
    assert urlfilter.scored(pages.limit(0), none, urlfilter.SEEDS).count() == 0
    hosts = {"downloads-x.example": False, "alphabets.example": False, "free-bets.example": True, "ads-x.example": True, "www.casino-win.example": True}
    rows = spark.createDataFrame([(k, f"http://{h}/") for k, h in enumerate(hosts)], "page_id long, url string")
    marked = {r["page_id"]: r["rejected"] for r in urlfilter.labelled(rows, labels, urlfilter.SEEDS).collect()}
    assert [marked[k] for k in range(5)] == list(hosts.values())


def test_url_filter_on_hosts_of_a_seed_left_out_and_clashing_columns(spark):
    rng = random.Random(9)
    word = lambda kinds: "".join(rng.choices(kinds, k=6))
    good = [(k, f"https://news.{word('abcdel')}.example/{k}/{word('aeilnrst')}") for k in range(400)]
    bad = [(1000 + k, f"http://{seed}-{word('xqzjvk')}.example/?{word('xqzjvk')}={k}") for k, seed in enumerate(["casino", "pills", "spam", "bets"] * 60)]
    pages = spark.createDataFrame([(*r, 0.5, True) for r in good + bad], "page_id long, url string, score double, kept boolean")
    labels = spark.createDataFrame([(k, 1, 0, "u") for k in range(400)], "doc_id long, quality int, toxic int, url string")
    out = {r["page_id"]: r for r in urlfilter.scored(pages, labels, ("casino", "pills", "spam")).collect()}
    assert np.mean([out[i]["kept"] for i, _ in good]) > 0.97
    left_out = [i for i, u in bad if "//bets" in u]
    assert len(left_out) == 60 and np.mean([out[i]["kept"] for i in left_out]) < 0.1


# 10: WARC


def test_warc_round_trip(spark, sf, tmp_path):
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    rows += [(1000, None, "<p>no url"), (1001, "http://x.example/a b\n", ""), (1002, "http://x.example/", None), (1003, "http://x.example/l", "long é " * 200_000), (0, rows[0][1], rows[0][2])]
    at = f"file://{tmp_path}/warc"
    index = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), at, file_bytes=40_000).collect()
    assert len(index) == len(rows)
    want = sorted((warc.target(u, i), h) for i, u, h in rows if h is not None)
    assert sorted((r["uri"], r["block"].decode()) for r in warc.read_warc(spark, at).where("kind = 'resource'").collect()) == want
    html = {(i, u): h for i, u, h in rows}
    for r in index:
        if r["file"] is None:
            assert html[r["page_id"], r["url"]] is None and r["file_offset"] is None
            continue
        data = (tmp_path / "warc" / r["file"]).read_bytes()
        reader, _ = warc.open_dictionary(data)
        fields, block = warc.parse(reader.decompress(data[r["file_offset"] : r["file_offset"] + r["length"]]))
        assert block.decode() == html[r["page_id"], r["url"]] and fields["WARC-Block-Digest"] == r["digest"]
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), at + "0").count() == 0


def test_shared_folder_is_the_sessions(spark):
    home = Scratch(shared_dir(spark))
    path = home.new()
    with home.writer(path) as out:
        out.write(b"x")
    with home.reader(path) as data:
        assert data.read() == b"x"
    home.close()
