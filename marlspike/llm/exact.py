"""Exact deduplication with compressed radix (Patricia) tries.

Rows are partitioned by length and content hash, and each partition inserts the full byte strings of its
texts into one trie; two texts meet at a terminal node only if every byte agrees, so the hash decides where
a text goes and never whether it is a copy.  A terminal keeps the smallest identifier.  Each map task first
combines its own rows in a trie of bounded size, so that a text repeated a million times reaches the reducer
once a task.  A trie beyond its memory hands its largest subtree to a scratch file, along with every later
key that falls into it, and inserts that file's keys on their own afterwards.

Members never travel with their text.  A map task numbers the texts of its trie and writes (number, doc_id) for each row
beside (number, text, least doc_id) for each text; the reducers' tries turn numbers into owners, and
the members are joined to these by number.  A number belongs to one task, so a text that a third of all rows
have is spread over all tasks in that join.

Defined results
* null texts are compared with nothing; the empty text is a text like any other;
* the owner is the smallest ``doc_id`` with nulls last, then the row whose other columns have the smallest
  representation; of rows equal in every column one stays;
* texts of any length are compared whole; an empty table gives an empty result;
* columns beyond ``doc_id`` and ``text`` are carried along under their own names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, fresh, lean, put_record, records, shared_dir, written

MAP_BYTES = 32 << 20
TRIE_BYTES = 96 << 20
NODE_BYTES = 400


class Node:
    __slots__ = ("label", "kids", "value", "ends")

    def __init__(self, label: bytes):
        self.label, self.kids, self.value, self.ends = label, {}, None, False


class Spilled:
    """Stands for a subtree whose keys are in a scratch file."""

    __slots__ = ("path", "stream")

    def __init__(self, path: str, stream):
        self.path, self.stream = path, stream


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(n, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


class Trie:
    """merge(old, new) joins the values of equal keys; scratch() opens the task's scratch folder; weigh(value) is a value's size."""

    def __init__(self, merge: Callable, most: int, scratch: Callable[[], Scratch] | None = None, weigh: Callable[[object], int] = lambda value: 0):
        self.root, self.merge, self.most, self.scratch, self.weigh = Node(b""), merge, most, scratch, weigh
        self.size = 0
        self.spills: list[Spilled] = []

    def insert(self, key: bytes, value: object) -> object:
        """The key's value from now on; None if it went to a scratch file."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                self._end(node, value)
                break
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.size += len(kid.label) + NODE_BYTES
                self._end(node := kid, value)
                break
            if isinstance(kid, Spilled):
                put_record(kid.stream, (key, value))
                return None
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            n = common(label, key[at : at + len(label)])
            fork = node.kids[key[at]] = Node(label[:n])
            kid.label = label[n:]
            fork.kids[label[n]] = kid
            self.size += NODE_BYTES
            node, at = fork, at + n
        value = node.value
        if self.scratch and self.size > self.most:
            self._spill()
        return value

    def _end(self, node: Node, value: object) -> None:
        if node.ends:
            self.size -= self.weigh(node.value)
            value = self.merge(node.value, value)
        node.value, node.ends = value, True
        self.size += self.weigh(value)

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.ends:
                yield key, node.value
            stack += [(kid, key) for kid in node.kids.values() if isinstance(kid, Node)]

    def _bytes(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + NODE_BYTES + (self.weigh(x.value) if x.ends else 0)
            stack += [kid for kid in x.kids.values() if isinstance(kid, Node)]
        return total

    def _spill(self) -> None:
        """Write the largest subtree below the first fork to a file."""
        node, prefix = self.root, b""
        while len(node.kids) == 1 and not isinstance(kid := next(iter(node.kids.values())), Spilled):
            node, prefix = kid, prefix + kid.label
        sizes = {byte: self._bytes(kid) for byte, kid in node.kids.items() if isinstance(kid, Node)}
        if not sizes:  # one text longer than the memory: it stays
            return
        byte = max(sizes, key=sizes.get)
        if len(node.kids) == 1 and not node.ends:
            return
        home = self.scratch()
        spilled = Spilled(path := home.new(), home.writer(path))
        for key, value in self.items(node.kids[byte], prefix):
            put_record(spilled.stream, (key, value))
        node.kids[byte] = spilled
        self.spills.append(spilled)
        self.size -= sizes[byte]

    def drain(self) -> Iterator[tuple[bytes, object]]:
        """Every key once with its merged value, spilled subtrees last."""
        yield from self.items()
        self.root, self.size = Node(b""), 0
        for spilled in self.spills:
            spilled.stream.close()
            inner = Trie(self.merge, self.most, self.scratch, self.weigh)
            with self.scratch().reader(spilled.path) as stream:
                for key, value in records(stream):
                    inner.insert(key, value)
            yield from inner.drain()
            self.scratch().drop(spilled.path)


class Scratched:
    """Opens the scratch folder of a task when it is first wanted."""

    def __init__(self, uri: str):
        self.uri, self.made = uri, None

    def __call__(self) -> Scratch:
        self.made = self.made or Scratch(self.uri)
        return self.made

    def close(self) -> None:
        if self.made:
            self.made.close()


def _rows(batch: pa.RecordBatch, text: str) -> Iterator[tuple[bytes, dict]]:
    whole = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
    rest = batch.drop_columns([text]).to_pylist()
    yield from zip(whole, rest)


def _chunks(rows: Iterator[dict], schema: pa.Schema, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get(text) or b"") + 64
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _partitioned(df: DataFrame, text: str, length: str, digest: str) -> DataFrame:
    return df.withColumns({length: F.octet_length(text), digest: F.xxhash64(text)})


class Text:
    """A terminal's value: the smallest identifier, the number of the first combined text, its rows, and the class once there are two."""

    __slots__ = ("least", "number", "rows", "group")

    def __init__(self, least: int | None, number: int, rows: int):
        self.least, self.number, self.rows, self.group = least, number, rows, -1

    def __reduce__(self):
        return _text, (self.least, self.number, self.rows, self.group)

    def take(self, doc_id: int | None) -> None:
        if doc_id is not None and (self.least is None or doc_id < self.least):
            self.least = doc_id


def _text(least: int | None, number: int, rows: int, group: int) -> Text:
    made = Text(least, number, rows)
    made.group = group
    return made


def duplicate_owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, owner_id) of every row whose text another row owns."""
    shared = shared_dir(docs.sparkSession)
    keyed = _partitioned(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()), "text", "length", "digest")
    names, kinds = ["number", "doc_id", "rows", "text", "length", "digest"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def table(columns: list) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[3] = arrays[3].cast(pa.string(), safe=False)
        return pa.RecordBatch.from_arrays(arrays, names)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        trie, places = Trie(lambda a, b: a, MAP_BYTES), {}

        def flush() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for key, value in trie.items():
                held.append((value.number, value.least, value.rows, key, *places[value.number]))
                size += len(key) + 64
                if size > 8 << 20:
                    yield table(list(zip(*held)))
                    held, size = [], 0
            if held:
                yield table(list(zip(*held)))

        for batch in batches:
            ids, lengths, digests = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "length", "digest"))
            own = []
            for (key, _), doc, length, digest in zip(_rows(batch.select(["text"]), "text"), ids, lengths, digests):
                value = trie.insert(key, Text(doc, number, 0))
                if value.number == number:
                    places[number] = length, digest
                    number += 1
                value.take(doc)
                value.rows += 1
                own.append(value.number)
                if trie.size > MAP_BYTES:
                    yield from flush()
                    trie, places = Trie(lambda a, b: a, MAP_BYTES), {}
            none = [None] * len(own)
            yield table([own, ids, none, none, none, none])
        yield from flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, links = TaskContext.get().partitionId() << 36, []

        def join(a: Text, b: Text) -> Text:
            nonlocal group
            if a.group < 0:
                a.group = group
                group += 1
                links.append((a.number, a.group))
            links.append((b.number, a.group))
            a.take(b.least)
            return a

        def linked() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64()), pa.nulls(len(links), pa.int64())], ["number", "group", "owner_id"])
            links.clear()
            return made

        home = Scratched(shared)
        trie = Trie(join, TRIE_BYTES, home)
        try:
            for batch in batches:
                numbers, ids, rows = (batch.column(k).to_pylist() for k in range(3))
                for key, number, doc, n in zip(batch.column(3).cast(pa.large_binary()).to_pylist(), numbers, ids, rows):
                    trie.insert(key, Text(doc, number, n))
                yield linked()
            owners = []
            for _, value in trie.drain():
                if value.group < 0 and value.rows > 1:
                    value.group = group
                    group += 1
                    links.append((value.number, value.group))
                if value.group >= 0:
                    owners.append((value.group, value.least))
                if len(owners) > 100_000 or len(links) > 100_000:
                    yield linked()
                    yield _owners(owners)
                    owners = []
            yield linked()
            yield _owners(owners)
        finally:
            home.close()

    combined = written(keyed.mapInArrow(lean(combine), "number long, doc_id long, rows long, text string, length int, digest long"), "texts")
    found = written(combined.where("length IS NOT NULL").repartition("length", "digest").mapInArrow(lean(own), "number long, group long, owner_id long"), "owners")
    owners = found.where("number IS NULL").select("group", "owner_id")
    links = found.where("number IS NOT NULL").select("number", "group").join(owners, "group").select("number", "owner_id")
    return combined.where("length IS NULL").select("number", "doc_id").join(links, "number").where(~F.col("doc_id").eqNullSafe(F.col("owner_id"))).select("doc_id", "owner_id")


def _owners(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], ["number", "group", "owner_id"])


def _binary(rows: Iterator[dict], schema: pa.Schema, text: str) -> Iterator[pa.RecordBatch]:
    """Like _chunks, with the text given as bytes."""
    at = schema.get_field_index(text)
    raw = schema.set(at, pa.field(text, pa.binary()))
    for batch in _chunks(rows, raw, text):
        columns = batch.columns
        columns[at] = columns[at].cast(schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row for each distinct text, and every row without a text."""
    length, digest = fresh(docs, "length", "digest")
    shared = shared_dir(docs.sparkSession)
    none = docs.where(F.col(text).isNull())
    keyed = _partitioned(docs.where(F.col(text).isNotNull()), text, length, digest)
    arrow, final = to_arrow_schema(keyed.schema), to_arrow_schema(docs.schema)

    def weigh(row: dict) -> int:
        return 300 + sum(len(v) for v in row.values() if isinstance(v, (str, bytes, list, dict)))

    def rank(row: dict) -> tuple:
        x = row[doc_id]
        return x is None, 0 if x is None else x, repr(sorted((k, repr(v)) for k, v in row.items()))

    def least(a: dict, b: dict) -> dict:
        if a[doc_id] is not None and b[doc_id] is not None and a[doc_id] != b[doc_id]:
            return a if a[doc_id] < b[doc_id] else b
        return min(a, b, key=rank)

    def sift(schema: pa.Schema, most: int, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home = Scratched(shared) if last else None
            trie = Trie(least, most, home, weigh)
            names = [f.name for f in schema]

            def out(items: Iterator) -> Iterator[pa.RecordBatch]:
                yield from _binary(({k: row[k] for k in names if k != text} | {text: key} for key, row in items), schema, text)

            try:
                for batch in batches:
                    for key, row in _rows(batch, text):
                        trie.insert(key, row)
                        if not last and trie.size > most:
                            yield from out(trie.items())
                            trie = Trie(least, most, None, weigh)
                yield from out(trie.drain() if last else trie.items())
            finally:
                if home:
                    home.close()

        return lean(run)

    combined = keyed.mapInArrow(sift(arrow, MAP_BYTES, False), keyed.schema)
    return combined.repartition(length, digest).mapInArrow(sift(final, TRIE_BYTES, True), docs.schema).unionAll(none)
