"""WARC files compressed record by record with a dictionary of their own.

Each file begins with a skippable frame that holds a Zstandard dictionary, followed by one Zstandard frame for each
record: first a warcinfo record, then one resource record for each page.  The dictionary is built from the
records of the very file, all of them: trained, or raw content from the records' beginnings where they are too few or
too small for training; a file is closed at ``FILE_BYTES`` of records, which bounds what is held in
memory.  Every record can be read on its own, given the dictionary: the index has file, offset and length.

Every task writes its own files under names made of its partition's number, first under another name and then moved,
with the same bytes each time; a task that is run again replaces what a lost executor left.

Defined results
* a page without html is in the index with null file, offset and length and isn't archived; empty html is archived;
* a null URL is written as urn:page:<page_id>; control characters and spaces in a URL are percent-encoded;
* repeated rows are archived each, with the same record id; html of any length is one record;
* an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, output_path

FILE_BYTES = 64 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D


def record(kind: str, uri: str | None, identity: str, block: bytes, mime: str, date: str = DATE) -> tuple[bytes, str]:
    """A WARC record and its block's digest."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identity)}>"), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", uri))
    head += [("WARC-Block-Digest", digest), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n", digest


def target(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def dictionary(blocks: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary of all blocks: a trained one, or where they are too few or too small to train one, what they begin with."""
    size = min(size, max(256, sum(map(len, blocks)) // 8))
    try:
        return zstandard.train_dictionary(size, blocks, k=200, d=8, level=LEVEL)
    except zstandard.ZstdError:
        each = max(64, size // len(blocks))
        return zstandard.ZstdCompressionDict(b"".join(x[:each] for x in reversed(blocks))[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(blocks: list[bytes], size: int = DICTIONARY_BYTES, level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """A file's bytes, and offset and length of each record's frame."""
    made = dictionary(blocks, size)
    held = made.as_bytes()
    out, at, places = [struct.pack("<II", SKIPPABLE, len(held)) + held], 8 + len(held), []
    packer = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True, write_content_size=True)
    for block in blocks:
        frame = packer.compress(block)
        out.append(frame)
        places.append((at, len(frame)))
        at += len(frame)
    return b"".join(out), places


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Archive ``pages`` under ``path`` when the result is computed.

    The result is the index: (page_id, url, file, file_offset, length, raw_length, digest) of every row.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(path)
        files.create_dir(base, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        blocks: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            name, places = None, []
            if blocks:
                name = f"part-{part:06d}-{number:05d}.warc.zst"
                info, _ = record("warcinfo", None, name, b"software: marlspike\r\nformat: WARC File Format 1.1\r\n", "application/warc-fields", date)
                data, places = pack([info, *blocks])
                hidden = posixpath.join(base, f".{name}-{uuid.uuid4().hex}")
                with files.open_output_stream(hidden) as out:
                    out.write(data)
                files.move(hidden, posixpath.join(base, name))
                number += 1
            at = iter(places[1:])
            found = [(i, u, name, *next(at), raw, digest) if raw is not None else (i, u, None, None, None, None, None) for i, u, raw, digest in rows]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["page_id", "url", "file", "file_offset", "length", "raw_length", "digest"]
            rows.clear()
            blocks.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds], names)

        size = 0
        for batch in batches:
            html = batch.column(2).cast(pa.large_binary())
            for page, url, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html):
                block = block.as_py()
                if block is None:
                    rows.append((page, url, None, None))
                    continue
                uri = target(url, page)
                whole, digest = record("resource", uri, f"{page} {uri}", block, "text/html; charset=utf-8", date)
                rows.append((page, url, len(whole), digest))
                blocks.append(whole)
                size += len(whole)
                if size >= file_bytes:
                    yield close()
                    size = 0
        yield close()

    return source.mapInArrow(run, "page_id long, url string, file string, file_offset long, length long, raw_length long, digest string")


def archived(pages: DataFrame) -> DataFrame:
    """The archive's index; its files stay in the cluster's shared folder (``common.OUTPUTS`` has the path)."""
    return write_warc(pages, output_path(pages.sparkSession, "warc"))


def fields_of(head: bytes) -> dict[str, str]:
    """A record's header, from its first line to the empty one."""
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:-2])


def parse(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of one record."""
    end = block.index(b"\r\n\r\n") + 4
    fields = fields_of(block[:end])
    return fields, block[end : end + int(fields["Content-Length"])]


def open_dictionary(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor for a file that begins with ``data``, and where its first record is."""
    magic, n = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE:
        raise ValueError("the file doesn't begin with a dictionary frame")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])), 8 + n


def unpack(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a file."""
    reader, at = open_dictionary(data)
    stream = io.BufferedReader(reader.stream_reader(io.BytesIO(memoryview(data)[at:]), read_across_frames=True), 1 << 20)
    while head := stream.readline():
        while not head.endswith(b"\r\n\r\n"):
            head += stream.readline()
        fields = fields_of(head)
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, uri, kind, digest, block) of every record under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(posixpath.basename(file), f.get("WARC-Target-URI"), f["WARC-Type"], f["WARC-Block-Digest"], b) for f, b in unpack(data)]
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "uri", "kind", "digest", "block"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    return found.mapInArrow(run, "file string, uri string, kind string, digest string, block binary")
