"""Pages of PDF files: lines, repeated page boundaries, titles, pictures and captions.

What a PDF library gives is taken as items (text, x, y from the page's foot, font size) and rectangles; the library itself is
a provider of the caller.  A document is one row for the per-document functions, which the readers use; the same steps
stand below as operators over tables of items, for documents that are tables already.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .chunker import hashed_vectors, is_garbage, sentences, units

FEWEST_PAGES, SAMPLE = 3, 5
ALIKE, ALIKE_HINTED = 0.85, 0.75
SMALL_FONT, MARGIN = 0.7, 0.1
TITLE_SIZE = 14.0
#: Least width, height and share of a page of a picture, and of a drawn line; the largest share of either.
PICTURE, STROKE, LARGEST = (80.0, 80.0, 0.01), (10.0, 10.0, 0.0001), 0.85
ONE_PICTURE, ALL_PICTURES, STROKES = 0.10, 0.15, 5
LOGO, EDGE = 0.03, 0.15
PAD, PAD_SHARE = 12.0, 0.08


@dataclass
class Item:
    text: str
    x: float
    y: float
    size: float = 0.0


@dataclass
class Page:
    number: int
    items: list[Item] = field(default_factory=list)
    width: float = 612.0
    height: float | None = 792.0
    pictures: list[tuple[float, float, float, float]] = field(default_factory=list)
    strokes: list[tuple[float, float, float, float]] = field(default_factory=list)


@dataclass
class Document:
    pages: list[Page]
    title: str = ""


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def page_text(page: Page) -> str:
    """Items of one rounded height by x, lines from the top."""
    lines: dict[int, list[Item]] = {}
    for item in page.items:
        lines.setdefault(half_up(item.y), []).append(item)
    return "\n".join(" ".join(i.text for i in sorted(lines[y], key=lambda i: i.x)) for y in sorted(lines, reverse=True)).strip()


def placed_sentences(page: Page) -> list[tuple[str, int]]:
    """(text, height) of the page's sentences in reading order; neighbours of one height are one."""
    order: list[list[Item]] = []
    for item in sorted(page.items, key=lambda i: (-i.y, i.x)):  # heights that differ by one at most are a line
        if order and order[-1][-1].y - item.y <= 1:
            order[-1].append(item)
        else:
            order.append([item])
    text, starts = "", []
    for line in order:
        text = text.rstrip() + "\n" if text else ""
        for item in sorted(line, key=lambda i: i.x):
            starts.append((len(text), half_up(item.y)))
            text += item.text + " "
    out: list[tuple[str, int]] = []
    at = 0
    for s in sentences(text):
        found = text.find(s, at)
        if found < 0:
            continue
        at = found + len(s)
        y = next(y for begin, y in reversed(starts) if begin <= found)
        if out and out[-1][1] == y:
            out[-1] = f"{out[-1][0]} {s}", y
        else:
            out.append((s, y))
    return out


def centre(n: int, sample: int = SAMPLE) -> range:
    """The pages from the middle of n."""
    begin = max(0, n // 2 - sample // 2)
    return range(begin, min(n, begin + sample))


def margin_heights(middle: list[Page]) -> tuple[set[int], set[int]]:
    """Rounded heights in the upper and the lower tenth of a document's middle pages where the font is small."""
    sizes = [i.size for p in middle for i in p.items if i.size > 0]
    height = next((p.height for p in middle if p.height is not None), None) or max((i.y for p in middle for i in p.items), default=0)
    if not sizes or height <= 0:
        return set(), set()
    small = [i for p in middle for i in p.items if i.size < SMALL_FONT * float(np.median(sizes))]
    return {half_up(i.y) for i in small if i.y > (1 - MARGIN) * height}, {half_up(i.y) for i in small if i.y < MARGIN * height}


def median_cosine(vectors: np.ndarray) -> float:
    """Median over all pairs; 1 for fewer than two."""
    if len(vectors) < 2:
        return 1.0
    v = np.asarray(vectors, np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return float(np.median((v @ v.T)[np.triu_indices(len(v), 1)]))


def boundaries(middle: list[Page], embed: Callable[[list[str]], np.ndarray]) -> tuple[bool, bool]:
    """Whether the first and the last sentences of a document's middle pages are alike."""
    found = [s for s in map(placed_sentences, middle) if s]

    def repeats(own: list[tuple[str, int]], hints: set[int]) -> bool:
        if len(own) < FEWEST_PAGES:
            return False
        return median_cosine(embed([t for t, _ in own])) >= (ALIKE_HINTED if any(y in hints for _, y in own) else ALIKE)

    upper, lower = margin_heights(middle)
    return repeats([s[0] for s in found], upper), repeats([s[-1] for s in found if len(s) > 1], lower)


def cleaned_page(page: Page, head: bool, foot: bool) -> str:
    if not head and not foot:
        return page_text(page)
    own = [t for t, _ in placed_sentences(page)][int(head) :]
    return " ".join(own[:-1] if foot else own)


def without_boundaries(pages: list[Page], embed: Callable[[list[str]], np.ndarray]) -> list[str]:
    """Each page's text, without its first or last sentence where the middle pages' ones are alike."""
    head, foot = boundaries([pages[k] for k in centre(len(pages))], embed) if len(pages) >= FEWEST_PAGES else (False, False)
    return [cleaned_page(p, head, foot) for p in pages]


def title_hint(page: Page | None) -> tuple[str, float]:
    """The first run of items in the page's largest font, and its size."""
    items = page.items if page else []
    most = max((i.size for i in items), default=0.0)
    run: list[str] = []
    for i in items:
        if most > 0 and i.size == most:
            run.append(i.text.strip())
        elif run:
            break
    return " ".join(run), most


def title_of(document: Document, first_chunk: str = "") -> str:
    """Own title unless it is a path, the large print of the first page, its first chunk, or empty for the file's name."""
    own = document.title.strip()
    if own and not re.search(r"[/\\]", own):
        return own
    hint, size = title_hint(document.pages[0] if document.pages else None)
    return hint.strip() if size > TITLE_SIZE and hint.strip() else first_chunk.strip()


def text_of(document: Document, embed: Callable[[list[str]], np.ndarray]) -> str:
    """All pages that have text, an empty line between them."""
    return "\n\n".join(t for t in without_boundaries(document.pages, embed) if t)


def _clamped(rect: tuple, width: float, height: float) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = rect
    return max(0.0, min(width, x0)), max(0.0, min(height, y0)), max(0.0, min(width, x1)), max(0.0, min(height, y1))


def _share(rect: tuple, width: float, height: float) -> float:
    return max(0.0, rect[2] - rect[0]) * max(0.0, rect[3] - rect[1]) / (width * height) if width > 0 and height > 0 else 0.0


def candidate(page: Page) -> tuple[bool, tuple[float, float, float, float] | None]:
    """Whether the page is worth a caption for its pictures or drawings, and the part to show (None: all of it)."""
    width, height = page.width, page.height or 0.0
    if width <= 0 or height <= 0:
        return False, None

    def fits(r: tuple, least: tuple[float, float, float]) -> bool:
        return r[2] - r[0] >= least[0] and r[3] - r[1] >= least[1] and least[2] <= _share(r, width, height) <= LARGEST

    def logo(r: tuple) -> bool:
        return _share(r, width, height) <= LOGO and (r[0] <= EDGE * width or r[2] >= (1 - EDGE) * width) and (r[1] <= EDGE * height or r[3] >= (1 - EDGE) * height)

    kept = [r for r in (_clamped(x, width, height) for x in page.pictures) if not logo(r) and fits(r, PICTURE)]
    shares = [_share(r, width, height) for r in kept]
    if not (shares and (max(shares) >= ONE_PICTURE or sum(shares) >= ALL_PICTURES)):
        drawn = [r for r in (_clamped(x, width, height) for x in page.strokes) if fits(r, STROKE)]
        if len(drawn) < STROKES:
            return False, None
        kept += drawn
    x0, y0, x1, y1 = (f(r[k] for r in kept) for k, f in enumerate((min, min, max, max)))
    px, py = (max(PAD, PAD_SHARE * d) for d in (x1 - x0, y1 - y0))
    crop = _clamped((x0 - px, y0 - py, x1 + px, y1 + py), width, height)
    return True, None if _share(crop, width, height) > LARGEST else crop


def cleaned(caption: str | None) -> str | None:
    """As ``functions.text.caption``."""
    t = re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "", caption or "").strip()
    return t.encode("utf-16-le")[: 2 * tx.CAPTION].decode("utf-16-le", "ignore") + "…" if units(t) > tx.CAPTION else t or None


def captions_of(document: Document, content: bytes, caption: Callable[[bytes, int, tuple | None], str | None]) -> list[str]:
    """A chunk for each page with pictures; a page whose caption fails has none."""
    out = []
    for page in document.pages:
        wanted, crop = candidate(page)
        if wanted:
            try:
                text = cleaned(caption(content, page.number, crop))
            except Exception:  # a model's failure on one page mustn't lose the document
                text = None
            if text and not is_garbage(text):
                out.append(f"[Visual content on page {page.number}: {text}]")
    return out


# the same over tables of items: (document, page, n, text, x, y, size), n being the order of a page's items


def line_of(y: Column) -> Column:
    return F.floor(y + 0.5)


def _in_order(order: list[Column], text: str, mark: str) -> Column:
    held = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(text).alias("t"))))
    return F.array_join(F.transform(held, lambda i: i["t"]), mark)


def page_texts(items: DataFrame) -> DataFrame:
    """(document, page, text) of every page with items."""
    lines = items.groupBy("document", "page", line_of(F.col("y")).alias("line")).agg(_in_order([F.col("x")], "text", " ").alias("text"))
    return lines.groupBy("document", "page").agg(F.trim(_in_order([-F.col("line")], "text", "\n")).alias("text"))


def document_texts(pages: DataFrame) -> DataFrame:
    """(document, text) of (document, page, text): the pages with text, an empty line between them."""
    return pages.where("text <> ''").groupBy("document").agg(_in_order([F.col("page")], "text", "\n\n").alias("text"))


def middle_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Those of (document, page, ...) with one row a page that stand in the middle of their document."""
    own = Window.partitionBy("document")
    placed = pages.withColumns({"k": F.row_number().over(own.orderBy("page")) - 1, "m": F.count("*").over(own)})
    begin = F.greatest(F.lit(0), F.floor(F.col("m") / 2) - sample // 2)
    return placed.where((F.col("k") >= begin) & (F.col("k") < begin + sample)).drop("k", "m")


def margin_lines(items: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(document, line, upper) of the heights where the middle pages have small print in the upper or lower tenth.

    A document of fewer than ``FEWEST_PAGES`` pages has none; a page is as high as the highest item of these pages.
    """
    pages = items.select("document", "page").distinct()
    enough = pages.groupBy("document").agg(F.count("*").alias("m")).where(F.col("m") >= FEWEST_PAGES).select("document")
    held = items.join(middle_pages(pages.join(enough, "document", "left_semi"), sample), ["document", "page"], "left_semi")
    facts = held.groupBy("document").agg(F.percentile(F.when(F.col("size") > 0, F.col("size")), 0.5).alias("median"), F.max("y").alias("height"))
    small = held.join(facts, "document").where(F.col("size") < SMALL_FONT * F.col("median"))
    upper, lower = F.col("y") > (1 - MARGIN) * F.col("height"), F.col("y") < MARGIN * F.col("height")
    return small.where(upper | lower).select("document", line_of(F.col("y")).alias("line"), upper.alias("upper")).distinct()


def merged_lines(rows: DataFrame) -> DataFrame:
    """(document, n, y, text): neighbours in the order of n with one y become one, under the first one's n."""
    own = Window.partitionBy("document").orderBy("n")
    marked = rows.withColumn("new", F.coalesce((F.col("y") != F.lag("y").over(own)).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("new").over(own)).groupBy("document", "island").agg(F.min("n").alias("n"), F.first("y").alias("y"), _in_order([F.col("n")], "text", " ").alias("text")).drop("island")


def title_hints(items: DataFrame) -> DataFrame:
    """(document, title, size): the first run of items in the largest font of each document's first page."""
    page = Window.partitionBy("document")
    first = items.withColumn("first", F.min("page").over(page)).where("page = first").withColumn("most", F.max("size").over(page)).where("most > 0")
    run = first.withColumn("breaks", F.sum((F.col("size") != F.col("most")).cast("int")).over(page.orderBy("n")))
    large = run.where("size = most").withColumn("least", F.min("breaks").over(page)).where("breaks = least")
    return large.groupBy("document").agg(F.first("most").alias("size"), _in_order([F.col("n")], "text", " ").alias("title")).select("document", F.trim("title").alias("title"), "size")


def picture_pages(rects: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """(page, x0, y0, x1, y1, whole) of the pages worth a caption, of (page, kind, x0, y0, x1, y1) with kind picture or stroke; whole: show all of the page."""
    at = {c: F.greatest(F.lit(0.0), F.least(F.lit(top), F.col(c))) for c, top in (("x0", width), ("y0", height), ("x1", width), ("y1", height))}
    wide, high = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    clamped = rects.withColumns(at).withColumns({"wide": wide, "high": high}).withColumn("share", F.col("wide") * F.col("high") / (width * height))
    side = (F.col("x0") <= EDGE * width) | (F.col("x1") >= (1 - EDGE) * width)
    edge = (F.col("y0") <= EDGE * height) | (F.col("y1") >= (1 - EDGE) * height)
    picture = F.col("kind") == "picture"
    fits = lambda least: (F.col("wide") >= least[0]) & (F.col("high") >= least[1]) & F.col("share").between(least[2], LARGEST)
    kept = clamped.where(F.when(picture, ~((F.col("share") <= LOGO) & side & edge) & fits(PICTURE)).otherwise(fits(STROKE)))
    rect = lambda only: [f(F.when(only, F.col(c))) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    names = ["x0", "y0", "x1", "y1"]
    sums = kept.groupBy("page").agg(F.max(F.when(picture, F.col("share"))).alias("most"), F.sum(F.when(picture, F.col("share"))).alias("total"), F.count(F.when(~picture, 1)).alias("strokes"), *(c.alias(f"p{n}") for n, c in zip(names, rect(picture))), *(c.alias(f"a{n}") for n, c in zip(names, rect(F.lit(True)))))
    pictured = F.coalesce((F.col("most") >= ONE_PICTURE) | (F.col("total") >= ALL_PICTURES), F.lit(False))
    found = sums.where(pictured | (F.col("strokes") >= STROKES)).select("page", *(F.when(pictured, F.col(f"p{n}")).otherwise(F.col(f"a{n}")).alias(n) for n in names))
    padx, pady = (F.greatest(F.lit(PAD), (F.col(b) - F.col(a)) * PAD_SHARE) for a, b in (("x0", "x1"), ("y0", "y1")))
    crop = found.select("page", *(F.round(F.greatest(F.lit(0.0), F.least(F.lit(top), c)), 4).alias(n) for n, c, top in (("x0", F.col("x0") - padx, width), ("y0", F.col("y0") - pady, height), ("x1", F.col("x1") + padx, width), ("y1", F.col("y1") + pady, height))))
    return crop.withColumn("whole", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (width * height) > LARGEST)


def with_captions(texts: DataFrame, captions: DataFrame) -> DataFrame:
    """(page, chunkIndex, text): the chunks of (page, n, text) in order, then those of (page, caption) that say something."""
    own = texts.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("n")) - 1).alias("chunkIndex"), "text")
    said = captions.select("page", tx.caption(F.col("caption")).alias("caption")).where("caption IS NOT NULL")
    counts = texts.groupBy("page").agg(F.count("*").cast("int").alias("held"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy("caption")) - 1
    more = said.join(counts, "page", "left").select("page", (F.coalesce("held", F.lit(0)) + rank).alias("chunkIndex"), tx.caption_chunk(F.col("page"), F.col("caption")).alias("text"))
    return own.unionByName(more)


def filtered_pages(items: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_vectors) -> DataFrame:
    """(document, page, text) of every page, without the sentences that begin or end the pages of its document alike.

    A document's middle pages, five at most, decide; then each page is cleaned on its own, so a long document isn't one task.
    """
    pages = items.groupBy("document", "page").agg(F.array_sort(F.collect_list(F.struct("n", "text", "x", "y", "size"))).alias("items"))
    middle = middle_pages(pages)
    names = ["document", "head", "foot"]
    kind = pages.schema["document"].dataType.simpleString()
    enough = pages.groupBy("document").agg(F.count("*").alias("m")).where(F.col("m") >= FEWEST_PAGES).select("document")
    held = middle.join(enough, "document", "left_semi").groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "items"))).alias("pages"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [boundaries([_page(p["items"]) for p in own], embed) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.bool_()) for k in range(2))], names)

    cuts = held.mapInArrow(decide, f"document {kind}, head boolean, foot boolean")
    marked = pages.join(cuts, "document", "left").select("document", "page", "items", F.coalesce("head", F.lit(False)).alias("head"), F.coalesce("foot", F.lit(False)).alias("foot"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cleaned_page(_page(i), head, foot) for i, head, foot in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["document", "page", "text"])

    return marked.mapInArrow(clean, f"document {kind}, page {pages.schema['page'].dataType.simpleString()}, text string")


def _page(items: list[dict]) -> Page:
    return Page(0, [Item(i["text"], i["x"], i["y"], i["size"]) for i in items], height=None)
