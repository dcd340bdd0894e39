"""Text functions as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser's trim sees it.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CAPTION = 1000


def trimmed(text: Column, space: str = SPACE) -> Column:
    return F.regexp_replace(text, rf"^{space}+|{space}+\z", "")


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_garbage(text: Column) -> Column:
    """Blank; or without a Latin letter or digit and either decoration only or more than 80 % one character."""
    t = trimmed(text)
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    most = F.array_max(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c))))
    repeated = most / units(t) > 0.8
    decoration = t.rlike(r"^(?:[-=_.*#|~`@!%^&*()\[\]{}\\/<>:+]|" + SPACE + ")+$")
    return F.when(t == "", True).when(t.rlike("[A-Za-z0-9]"), False).when(decoration, True).otherwise(repeated)


def name_title(name: Column) -> Column:
    """File name without its last extension, hyphens and underscores as spaces."""
    return F.regexp_replace(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"), "[-_]", " ")


def _or_name(found: Column, name: Column) -> Column:
    return F.coalesce(F.when(found != "", found), name_title(name))


def markdown_title(text: Column, name: Column) -> Column:
    """Front matter's title, the first first-level heading, or the file name."""
    front = trimmed(F.regexp_extract(text, r"""(?s)\A---\n.*?title:\s*['"]?([^\n]+?)['"]?\s*\n.*?---""", 1))
    heading = trimmed(F.regexp_extract(text, r"(?m)^# (.+)$", 1))
    return F.coalesce(F.when(front != "", front), F.when(heading != "", heading), name_title(name))


def txt_title(text: Column, name: Column) -> Column:
    """The first line if an empty one follows it, else the file name."""
    lines = F.split(text, "\n", 3)
    first, second = trimmed(lines[0]), trimmed(F.get(lines, F.lit(1)))
    return F.when((first != "") & (second == ""), first).otherwise(name_title(name))


def html_title(html: Column, name: Column) -> Column:
    return _or_name(trimmed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), name)


def pdf_title(own: Column, hint: Column, size: Column, first_chunk: Column, name: Column, least: float = 14.0) -> Column:
    """Own title unless it is a path, print of the first page larger than ``least``, its first chunk, or the file name."""
    filled = lambda c: F.when(trimmed(c) != "", trimmed(c))
    return F.coalesce(F.when(~own.rlike(r"[/\\]"), filled(own)), F.when(size > least, filled(hint)), filled(first_chunk), name_title(name))


def caption(text: Column, space: str = SPACE) -> Column:
    """A model's caption without control characters and without ``space`` around it; null if nothing is left, cut beyond ``CAPTION`` characters."""
    t = trimmed(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", ""), space)
    return F.when(t == "", None).when(F.length(t) > CAPTION, F.concat(F.substring(t, 1, CAPTION), F.lit("…"))).otherwise(t)


def caption_chunk(page: Column, text: Column) -> Column:
    return F.format_string("[Visual content on page %d: %s]", page.cast("int"), text)


def base64url(text: Column) -> Column:
    """RFC 4648 for URLs, unpadded."""
    return F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n=]", ""), "+/", "-_")


def unbase64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("="))), "UTF-8")


def path_key(path: Column, windows: bool = False) -> Column:
    """The path as files are told apart by: absolute, without empty, . and .. parts; on Windows in lower case with backslashes."""
    parts = F.split(F.translate(path, "\\", "/") if windows else path, "/")
    none = F.array().cast("array<string>")
    back = lambda held: F.when(F.size(held) > 0, F.slice(held, 1, F.size(held) - 1)).otherwise(held)
    joined = F.aggregate(parts, none, lambda held, x: F.when(x.isin("", "."), held).when(x == "..", back(held)).otherwise(F.array_append(held, x)))
    return F.lower(F.array_join(joined, "\\")) if windows else F.concat(F.lit("/"), F.array_join(joined, "/"))


_URL = r"^([Hh][Tt][Tt][Pp][Ss]?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?([^?#]*)"


def normal_source(source: Column) -> Column:
    """A web address without credentials, default port, query and fragment; anything else as it is."""
    part = [F.regexp_extract(source, _URL, k) for k in range(1, 5)]
    scheme = F.lower(part[0])
    default = (part[2] == "") | ((scheme == "http") & (part[2] == "80")) | ((scheme == "https") & (part[2] == "443"))
    port = F.when(default, "").otherwise(F.concat(F.lit(":"), part[2]))
    path = F.when(part[3] == "", "/").otherwise(part[3])
    return F.when(source.rlike(_URL), F.concat(scheme, F.lit("://"), F.lower(part[1]), port, path)).otherwise(source)


def raw_path(source: Column, db: str) -> Column:
    return F.concat(F.lit(f"{db}/raw-data/"), base64url(normal_source(source)), F.lit(".md"))


def is_raw_path(path: Column, db: str) -> Column:
    return path.startswith(f"{db}/raw-data/") & F.regexp_extract(path, "([^/]+)$", 1).rlike(r"^[A-Za-z0-9_-]+\.md$")


def raw_source(path: Column, db: str) -> Column:
    """The source that a managed path stands for; null for any other path."""
    return F.when(is_raw_path(path, db), unbase64url(F.regexp_extract(path, r"([^/]+)\.md$", 1)))


def sidecar(text: Column) -> Column:
    """title, source and format of a raw-data file's sidecar; nulls for what isn't one."""
    return F.from_json(text, "title string, source string, format string")


def entry_kind(path: Column, link: Column, folder: Column, regular: Column, excluded: Sequence[str], formats: Sequence[str]) -> Column:
    """What a scan takes an entry for, as ``scan.classify``."""
    out = F.lit(False)
    for x in excluded:
        out = out | (path == x) | path.startswith(x.rstrip("/") + "/")
    known = F.lower(path).rlike("(" + "|".join(f.replace(".", "\\.") for f in formats) + ")$")
    return F.when(link, "symlink").when(out, "excluded").when(folder, "directory").when(~regular, "irregular").when(known, "file").otherwise("unsupported")


def paragraphs(text: Column) -> Column:
    """Non-empty parts between blank lines and line starts."""
    return F.filter(F.transform(F.split(text, r"\n{2,}|\n(?=\S)"), trimmed), lambda p: p != "")


def grams(text: Column) -> Column:
    """All runs of two and three characters of the lower-case text."""
    low = F.lower(text)

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.concat(runs(2), runs(3))


def gram_count(low: Column, gram: str) -> Column:
    """Occurrences of ``gram`` at every position of a lower-case text."""
    if any(gram.startswith(gram[k:]) for k in range(1, len(gram))):  # occurrences may overlap
        return F.regexp_count(low, F.lit("(?=" + "".join(f"\\x{{{ord(c):X}}}" for c in gram) + ")"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(gram), F.lit("")))) / len(gram)).cast("int")


def query_grams(text: str) -> list[str]:
    low = text.lower()
    return sorted({low[i : i + n] for n in (2, 3) for i in range(len(low) - n + 1)})
