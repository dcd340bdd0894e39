"""HTML extraction that leaves out what a site repeats on its pages.

Each page is read once into elements; an element's hash covers its tag, its attributes and, in order, the text and
the hashes of what it contains, white space aside.  Spark counts on how many different pages of a host each
subtree occurs.  Subtrees on at least ``FEWEST`` pages and ``SHARE`` of the host's pages are the site's template:
they are deleted from every page of that host, and the rest becomes text, one line for each block.

Pages are never shuffled.  What moves are hashes: for each task's share of the pages its different (host, hash)
pairs, of which those that recur are written beside the pages and read again by the task that strips that share.

Defined results
* attributes count as they are written, so elements whose ids differ from page to page don't match (what is inside them may);
* the host is the URL's authority in lower case without user, port and a leading www.; a page without one keeps all;
* equal pages of a host (the same subtree as a whole) count as one page, so copies make no template;
* only elements with visible text are counted; script, style, head and the like are never text;
* null html gives null text, empty html an empty one; repeated rows are extracted each;
* unclosed and misnested elements end where a browser would roughly end them; pages of any size are read whole;
* empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import posixpath
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, work_path, written

FEWEST = 5
SHARE = 0.02
#: Shares of the pages whose recurring hashes stand in one folder.
_SHARES = 16
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|<([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object svg math textarea select".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Element:
    __slots__ = ("tag", "attributes", "start", "parts", "seen")

    def __init__(self, tag: str, attributes: str, start: int):
        self.tag, self.attributes, self.start, self.parts, self.seen = tag, attributes, start, [], False


def elements(html: str) -> tuple[list[tuple[int, int, int]], int]:
    """(hash, start, end) of each element with visible text, inner ones first, and the hash of the page."""
    root = Element("", "", 0)
    stack, found = [root], []
    open_: dict[str, list[int]] = {}  # where in the stack the elements of a tag are

    def close(end: int) -> None:
        x = stack.pop()
        open_[x.tag].pop()
        body = "\x00".join(x.parts)
        h = xxhash.xxh64_intdigest(f"{x.tag}\x01{x.attributes}\x01{body}")
        if x.seen and x.tag not in _HIDDEN:
            found.append((h, x.start, end))
        up = stack[-1]
        up.parts.append(f"\x02{h:x}")
        up.seen |= x.seen and x.tag not in _HIDDEN

    def text(a: int, b: int) -> None:
        if a < b and (words := " ".join(html[a:b].split())):
            stack[-1].parts.append(words)
            stack[-1].seen = True

    def innermost(tags: Iterable[str]) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def leave(tags: set[str], fence: set[str], at: int) -> None:
        k = innermost(tags)
        if k > innermost(fence):
            while len(stack) > k:
                close(at)

    at = 0
    while m := _TOKEN.search(html, at):
        text(at, m.start())
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in _ENDS_P:
                leave({"p"}, {"table", "button", "article", "section", "div", "aside", "blockquote", "td", "th"}, m.start())
            if tag in _SIBLING:
                leave(_SIBLING[tag], _FENCE[tag], m.start())
            attributes = " ".join(m[3].strip("/ \t\r\n").split())
            if tag in _VOID:
                stack[-1].parts.append(f"\x03{tag} {attributes}")
                continue
            open_.setdefault(tag, []).append(len(stack))
            stack.append(Element(tag, attributes, m.start()))
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                stop, at = (end.start(), end.end()) if end else (len(html), len(html))
                text(m.end(), stop)
                close(at)
        elif m[1]:
            if k := innermost([m[1].lower()]):
                while len(stack) > k + 1:
                    close(m.start())
                close(at)
    text(at, len(html))
    while len(stack) > 1:
        close(len(html))
    return found, xxhash.xxh64_intdigest("\x00".join(root.parts))


def plain(html: str, gone: list[tuple[int, int]] | None = None) -> str:
    """Visible text outside the given spans (apart from each other, in order), a line for each block."""
    out: list[str] = []
    hidden: list[str] = []
    at, spans = 0, iter(gone or [])
    span = next(spans, None)
    while True:
        if span and at >= span[0]:
            out.append("\n")
            at, span = max(at, span[1]), next(spans, None)
            continue
        m = _TOKEN.search(html, at)
        stop = m.start() if m else len(html)
        if span and span[0] <= stop:
            stop = span[0]
            m = None
        if not hidden:
            out.append(html[at:stop].replace("\n", " "))
        if not m:
            if span and stop == span[0]:
                at = stop
                continue
            break
        at = m.end()
        tag = (m[2] or m[1] or "").lower()
        if m[2] and tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag in _HIDDEN:
            if m[2]:
                hidden.append(tag)
            elif tag in hidden:
                del hidden[hidden.index(tag) :]
        elif tag in _BLOCK or tag == "br":
            if tag == "body":
                hidden.clear()
            if not hidden:
                out.append("\n")
    lines = (" ".join(entities.unescape(line).split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def outermost(nodes: list[tuple[int, int, int]], recurring: set[int]) -> list[tuple[int, int]]:
    """Spans of the recurring subtrees that aren't inside another one."""
    spans: list[tuple[int, int]] = []
    for start, end in sorted(((a, b) for h, a, b in nodes if h in recurring), key=lambda x: (x[0], -x[1])):
        if not spans or start >= spans[-1][1]:
            spans.append((start, end))
    return spans


def host(url: str = "url") -> F.Column:
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, html with the page's hash, the hashes and spans of its elements and the number of the task."""
    share = TaskContext.get().partitionId()
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            hashes, starts, ends, roots = [], [], [], []
            for html in part.column(3).to_pylist():
                found, root = elements(html or "")
                roots.append(_signed(root))
                hashes.append([_signed(x) for x, _, _ in found])
                starts.append([x for _, x, _ in found])
                ends.append([x for _, _, x in found])
            extra = [pa.array(roots, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array([share] * len(roots), pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "root", "hashes", "starts", "ends", "share"])


def _recurring(read: DataFrame, fewest: int, share: float) -> str:
    """Write the recurring (share, host, hash) of every task's share of the pages; the folder's path."""
    sited = read.where("host IS NOT NULL")
    kinds = written(sited.groupBy("host", "root").agg(F.first("hashes").alias("hashes")), "kinds")
    sizes = kinds.groupBy("host").agg(F.count("*").alias("pages"))
    counts = kinds.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
    site = counts.join(sizes, "host").where(F.col("n") >= F.col("pages") * F.lit(share)).select("host", "hash")
    own = sited.select("share", "host", F.explode(F.array_distinct("hashes")).alias("hash")).distinct()
    path = work_path(read.sparkSession, "recurring")
    found = own.join(site, ["host", "hash"], "left_semi").withColumn("folder", F.floor(F.col("share") / _SHARES).cast("int"))
    found.repartition("folder").sortWithinPartitions("folder", "share", "host").write.partitionBy("folder").parquet(path)
    return path


def _template(path: str, share: int) -> dict[str, set[int]]:
    """The recurring hashes of each host in one share of the pages."""
    files, base = filesystem(path)
    at = posixpath.join(base, f"folder={share // _SHARES}")
    out: dict[str, set[int]] = {}
    if files.get_file_info(at).type != pafs.FileType.NotFound:
        found = pq.read_table(at, filesystem=files, columns=["host", "hash"], filters=[("share", "=", share)], partitioning=None)
        for host, hash_ in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
            out.setdefault(host, set()).add(hash_)
    return out


def extracted(pages: DataFrame, fewest: int = FEWEST, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_removed, removed_chars) of every page."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), "html")
    read = written(source.mapInArrow(_read, "page_id long, url string, host string, html string, root long, hashes array<long>, starts array<int>, ends array<int>, share int"), "read")
    path = _recurring(read, fewest, share)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, template = None, {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts, removed, chars = [], [], []
                for html, h, s, e, own, site in zip(*(part.column(k).to_pylist() for k in range(2, 8))):
                    if own != now:
                        now, template = own, _template(path, own)
                    if html is None:
                        texts.append(None)
                        removed.append(None)
                        chars.append(None)
                        continue
                    spans = outermost(list(zip(h, s, e)), template.get(site, set()))
                    texts.append(plain(html, spans))
                    removed.append(len(spans))
                    chars.append(sum(y - x for x, y in spans))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int32()), pa.array(chars, pa.int64())], ["page_id", "url", "text", "n_removed", "removed_chars"])

    columns = read.select("page_id", "url", "html", "hashes", "starts", "ends", "share", "host")
    return columns.mapInArrow(strip, "page_id long, url string, text string, n_removed int, removed_chars long")
