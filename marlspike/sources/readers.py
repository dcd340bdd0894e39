"""Text of TXT, Markdown, DOCX and HTML content; PDF through a provider that the caller gives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunker, pdf

FORMATS = (".pdf", ".docx", ".txt", ".md")
MOST_BYTES = 100 << 20
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DROP = frozenset("script style nav header footer aside noscript template iframe form svg head".split())
_PARAGRAPH = frozenset("p div section article main ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6 body".split())
_MARKS = {"em": "_", "i": "_", "strong": "**", "b": "**", "code": "`"}
_VOID = frozenset("br hr img input link meta area base col embed source track wbr".split())


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.hidden: list[str] = []
        self.lists: list[list] = []
        self.links: list[str] = []
        self.marks: list[str] = []
        self.code = False
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in _DROP:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag in _PARAGRAPH and not (tag in ("ul", "ol") and len(self.lists) > 1):
            self.out.append("\n\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "pre":
            language = re.search(r"language-([\w+-]+)", dict(attrs).get("class") or "")
            self.out.append(f"```{language[1] if language else ''}\n")
            self.code = True
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag in _MARKS and not (tag == "code" and self.code):
            self.marks.append(tag)
            self.out.append(_MARKS[tag])
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in _DROP and tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if self.hidden or tag in _VOID:
            return
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag == "pre":
            self.out.append("\n```")
            self.code = False
        elif tag in self.marks:  # one that wasn't opened closes nothing
            self.marks.remove(tag)
            self.out.append(_MARKS[tag])
        elif tag == "a" and self.links:
            to = self.links.pop()
            self.out.append(f"]({to})" if to else "]")
        if tag in _PARAGRAPH:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.hidden:
            self.out.append(data if self.code else re.sub(r"\s+", " ", data))


_HOLDS = frozenset("body div section article main td blockquote".split())
_COUNTS = frozenset("p pre td li blockquote div".split())


class _Scores(HTMLParser):
    """Where the containers of a page begin and end, with a score for the running text right inside them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.stack: list[dict] = []
        self.found: list[dict] = []
        self.hidden = self.links = 0
        self.feed(html)
        self.close()
        while self.stack:
            self._end(len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _DROP
        self.links += tag == "a"
        if tag not in _VOID:
            if tag in ("p", "li", "td") and self.stack and self.stack[-1]["tag"] == tag:
                self._end(self._at())
            self.stack.append({"tag": tag, "start": self._at(), "text": 0, "linked": 0, "commas": 0, "score": 0.0})

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.stack):
            while self.stack[-1]["tag"] != tag:
                self._end(self._at())
            self._end(self._at())

    def _end(self, at: int) -> None:
        x = self.stack.pop()
        self.hidden -= x["tag"] in _DROP
        self.links -= x["tag"] == "a"
        x["end"] = at
        above = self.stack[-1] if self.stack else None
        if x["tag"] in _COUNTS and x.get("own", 0) >= 25:
            gain = 1 + x["commas"] + min(3, x["own"] / 100)
            for share, holder in zip((1.0, 0.5), reversed([y for y in self.stack if y["tag"] in _HOLDS])):
                holder["score"] += gain * share
        if above:
            above["text"] += x["text"]
            above["linked"] += x["linked"]
        if x["tag"] in _HOLDS:
            self.found.append(x)

    def handle_data(self, data):
        n = len(data.strip())
        if n and self.stack and not self.hidden:
            x = self.stack[-1]
            x["text"] += n
            x["linked"] += n if self.links else 0
            near = next((y for y in reversed(self.stack) if y["tag"] in _COUNTS), x)
            near["own"] = near.get("own", 0) + n
            near["commas"] += len(re.findall("[,，、]", data))


def _main(html: str) -> str:
    """The part of a page that holds its content.

    That is its article or main part, if it has just one.  Otherwise each paragraph of 25 characters or more scores for
    the containers around it, by its length and commas, and links count against a container; the best one is the
    content if it holds half of the visible text, else all of the page is.
    """
    for tag in ("article", "main"):
        found = re.findall(rf"<{tag}\b.*?</{tag}\s*>", html, re.S | re.I)
        if len(found) == 1:
            return found[0]
    found = _Scores(html).found
    whole = max((x["text"] for x in found), default=0)
    scored = [(x["score"] * (1 - x["linked"] / x["text"]), -x["start"], x) for x in found if x["text"] and x["score"] > 0]
    if scored:
        best = max(scored, key=lambda y: y[:2])[2]
        if best["tag"] != "body" and 2 * best["text"] >= whole:
            return html[best["start"] : best["end"]]
    return html


def html_markdown(html: str | None) -> tuple[str, str]:
    """(Markdown of the main content, title); empty strings for what has none."""
    if not html:
        return "", ""
    whole, part = _Markdown(), _Markdown()
    whole.feed(html)
    whole.close()
    part.feed(_main(html))
    part.close()
    out = "".join(part.out)
    blocks = re.split(r"(```.*?```)", out, flags=re.S)
    tidy = "".join(b if k % 2 else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*(?=\n|\S)|[ \t]+\n", lambda m: "\n" if "\n" in m[0] else m[0], b)) for k, b in enumerate(blocks))
    return tidy.strip(), " ".join("".join(whole.title).split())


def _cell(node) -> str:
    return "".join(t.text or "" if t.tag == _WORD + "t" else "\t" if t.tag == _WORD + "tab" else "\n" for t in node.iter() if t.tag in (_WORD + "t", _WORD + "tab", _WORD + "br")).strip()


def _table(node) -> list[str]:
    """A line block for each row, header: value; flat text if the rows don't fit a header."""
    rows = [[_cell(c) for c in r.findall(_WORD + "tc")] for r in node.findall(_WORD + "tr")]
    spans = next(node.iter(_WORD + "gridSpan"), None) is not None or next(node.iter(_WORD + "vMerge"), None) is not None
    nested = any(True for c in node.iter(_WORD + "tc") for _ in c.iter(_WORD + "tbl"))
    if len(rows) < 2 or spans or nested or len({len(r) for r in rows}) != 1:
        return [" ".join(x for r in rows for x in r if x)]
    names = [h or f"Column {k}" for k, h in enumerate(rows[0], 1)]
    return ["\n".join(f"{h}: {v}" for h, v in zip(names, row) if v) for row in rows[1:]]


def docx_text(content: bytes) -> tuple[str, str, list[tuple[int, int]]]:
    """(text, title, ranges of table rows) of a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_WORD + "body")
        title = ""
        try:
            core = ElementTree.fromstring(archive.read("docProps/core.xml"))
            title = " ".join((core.findtext("{http://purl.org/dc/elements/1.1/}title") or "").split())
        except (KeyError, ElementTree.ParseError):
            pass
    blocks: list[tuple[str, bool]] = []
    for node in body if body is not None else []:
        if node.tag == _WORD + "tbl":
            blocks += [(b, True) for b in _table(node) if b]
        elif node.tag == _WORD + "p" and (text := _cell(node)):
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            name = style.get(_WORD + "val", "") if style is not None else ""
            level = int(name[-1]) if re.fullmatch(r"[Hh]eading ?[1-6]", name) else 0
            title = title or (text if level == 1 else "")
            item = node.find(f"{_WORD}pPr/{_WORD}numPr")
            depth = item.find(_WORD + "ilvl") if item is not None else None
            indent = "  " * int(depth.get(_WORD + "val", "0")) if depth is not None else ""
            blocks.append(("#" * level + " " + text if level else indent + "- " + text if item is not None else text, False))
    out, ranges, at = [], [], 0
    for text, atomic in blocks:
        if atomic:
            ranges.append((at, at + len(text)))
        out.append(text)
        at += len(text) + 2
    return "\n\n".join(out), title, ranges


def parse(path: str, content: bytes, read_pdf: Callable[[bytes], pdf.Document] | None = None, caption: Callable | None = None, embed: Callable = chunker.hashed_vectors) -> tuple[str, str, list[tuple[int, int]], list[str]]:
    """(text, own title, ranges that stay whole, captions) of a file by its extension."""
    kind = path[path.rfind(".") :].lower()
    if kind in (".txt", ".md"):
        return content.decode("utf-8", "replace"), "", [], []
    if kind == ".docx":
        return *docx_text(content), []
    if kind == ".pdf":
        if read_pdf is None:
            raise ValueError("reading PDF takes a provider")
        document = read_pdf(content)
        texts = pdf.without_boundaries(document.pages, embed)
        first = chunker.chunks_of(texts[0], embed)[:1] if texts else []
        captions = pdf.captions_of(document, content, caption) if caption else []
        return "\n\n".join(t for t in texts if t), pdf.title_of(document, "".join(first)), [], captions
    raise ValueError(f"{path}: only {', '.join(FORMATS)} can be read")


def read_files(spark: SparkSession, paths: list[str], most_bytes: int = MOST_BYTES, read_pdf: Callable[[bytes], pdf.Document] | None = None, caption: Callable | None = None, embed: Callable = chunker.hashed_vectors) -> DataFrame:
    """(filePath, contentHash, text, title, error, ranges, captions) of each file, read and parsed by the executors.

    A file over ``most_bytes`` or one that can't be parsed has an error and no text.
    """
    found = spark.read.format("binaryFile").load([f"file://{p}" for p in paths])
    small = found.where(F.col("length") <= most_bytes)
    hashed = small.select(F.regexp_replace("path", "^file:/+", "/").alias("filePath"), "content", F.sha2("content", 256).alias("contentHash"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kinds = [pa.string()] * 5 + [pa.list_(span), pa.list_(pa.string())]
    schema = "filePath string, contentHash string, text string, title string, error string, ranges array<struct<start: int, end: int>>, captions array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content, digest = (batch.column(j)[k].as_py() for j in range(3))
                try:
                    text, title, ranges, captions = parse(path, content, read_pdf, caption, embed)
                    row = path, digest, text, title, None, [{"start": x, "end": y} for x, y in ranges], captions
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    row = path, digest, None, None, str(e), None, None
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["filePath", "contentHash", "text", "title", "error", "ranges", "captions"])

    read = hashed.mapInArrow(run, schema)
    none = (F.lit(None).cast(f.dataType).alias(f.name) for f in read.schema if f.name not in ("filePath", "error"))
    large = found.where(F.col("length") > most_bytes).select(F.regexp_replace("path", "^file:/+", "/").alias("filePath"), F.lit(f"larger than {most_bytes} bytes").alias("error"), *none)
    return read.unionByName(large)


def html_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the Markdown and title of a column of HTML; null html gives empty strings."""
    names = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [html_markdown(t) for t in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([m for m, _ in made], pa.string()), pa.array([t for _, t in made], pa.string())], names=[*names, "markdown", "title"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)
    return pages.mapInArrow(run, f"{kinds}, markdown string, title string")
