"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

Text is split by the vocabulary's pattern; inside a piece the merges of the merge list apply by rank, leftmost
first.  Both steps stream.  The splitter reads ``BLOCK`` bytes at a time, finds the pieces by classes of characters
(letters, digits, white space, others) and leaves what the following bytes could still change to the next block.  A
piece that outgrows the block goes through the transducer, which holds back only what later bytes could still
change: a merge u+v can be undone from the right only if a suffix symbol of v is taken first by a merge of lower
rank, which in turn can be undone only by one of lower rank still.  ``lookahead`` follows the longest such chain
through the merge list; a token that ends that many bytes before the end of what was read is stable and is emitted.
Memory beside the text and its tokens is bounded by the block and a few times the lookahead, however long text or
piece are, and the tokens are those of the whole text.  Most pieces are words; their tokens are remembered, about
``REMEMBERED`` at most, and looked up for a whole block at once (by hash, then compared byte by byte).

The decoder turns tokens into bytes and bytes into text; its state is the incomplete character at the end, of at
most three bytes.  Bytes that are no UTF-8 become U+FFFD.

Defined results
* a null text has null tokens and isn't intact or otherwise (null); the empty text has no tokens and is intact;
* texts of any length are encoded whole; repeated rows are encoded alike; an empty table gives no rows;
* bytes that are no UTF-8 are encoded as they are, as neither letter nor digit; such a text isn't intact;
* special tokens' strings in a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, loaded, shipped
from .words import BYTES, INVERSE, POWERS, U, mix, row_slices, slices, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 1 << 21
#: Bytes that the splitter reads at once.
BLOCK = 1 << 20
_WORD = 48
_READ = 1 << 16
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)
_SPREAD, _ALL, _NONE = 0x9E3779B97F4A7C15, (1 << 64) - 1, (1 << 31) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a token in base64, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_CLASSES: list[np.ndarray] = []


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    if not _CLASSES:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        known = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                known[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
        known[0xD800:0xE000] = _OTHER
        ascii_ = np.full(256, _OTHER, np.uint8)
        ascii_[:128] = known[:128]
        _CLASSES[:] = known, ascii_
    known, ascii_ = _CLASSES
    out = ascii_[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        first, *more = (wide[lead + k].astype(np.int32) for k in range(4))
        n = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = np.where(n == 2, first & 0x1F, np.where(n == 3, first & 0x0F, first & 0x07))
        valid = first < 0xF5
        for k, x in enumerate(more):
            inside = n > k + 1
            point = np.where(inside, point << 6 | x & 0x3F, point)
            valid &= ~inside | (x & 0xC0 == 0x80)
        valid &= point < 0x110000
        lead, n, kind = lead[valid], n[valid], known[point[valid]]
        out[lead] = kind
        for k in range(1, 4):
            inside = n > k
            out[lead[inside] + k] = kind[inside]
    return out


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts that begin at ``begins`` (not at the end of ``data``) begin."""
    kind = classes(data)
    fresh = np.zeros(len(data), bool)
    fresh[begins] = True
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(data))
    # white space before something else: its last character goes with what follows if it is a space, else alone
    spaces = np.flatnonzero((kind[at] == _SPACE) & (end < len(data)))
    spaces = spaces[~fresh[end[spaces]]]
    begin, stop = at[spaces], end[spaces]
    last = stop - 1
    for _ in range(3):
        last -= (data[last] & 0xC0 == 0x80) & (last > begin)
    start[stop[data[last] == 32]] = False
    start[last] = True
    # an apostrophe that begins a piece, and s, t, m, d, re, ve or ll behind it
    for p in at[(data[at] == 39) & (end - at == 1) & (end < len(data))].tolist():
        if fresh[p + 1] or kind[p + 1] != _LETTER or (not fresh[p] and data[p - 1] == 32):
            continue
        n = 2 if data[p + 1] in b"stmd" else 3 if data[p + 1 : p + 3].tobytes() in (b"re", b"ve", b"ll") and not fresh[p + 2] else 0
        if n:
            start[p + 1] = False
            if p + n < len(data):
                start[p + n] = True
    return np.flatnonzero(start)


def settled(data: np.ndarray) -> int:
    """The last begin of a piece in a part of a text that what follows the part can't change; 0 if there is none."""
    kind = classes(data)
    change = np.flatnonzero(kind[1:] != kind[:-1])
    if not len(change):
        return 0
    last = int(change[-1]) + 1
    before = data[last - 1]
    if kind[last] != _SPACE and before == 32:
        return last - 1
    if kind[last] == _LETTER and before == 39 and (last < 2 or kind[last - 2] != _OTHER and data[last - 2] != 32):
        return last - 1
    return last


def same_class_until(data: np.ndarray, at: int) -> int:
    """Where the characters end that have the class of the one at ``at``."""
    kind = None
    while at < len(data):
        stop = character(data, min(len(data), at + BLOCK))
        found = classes(data[at:stop])
        kind = found[0] if kind is None else kind
        other = np.flatnonzero(found != kind)
        if len(other):
            return at + int(other[0])
        at = stop
    return at


def character(data: np.ndarray, at: int) -> int:
    """``at``, or the begin of the character that it would cut."""
    for back in range(min(4, at)):
        if at >= len(data) or data[at - back] & 0xC0 != 0x80:
            return at - back
    return at


class Merges:
    """The merge list that a rank file stands for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
            ids = self._merge([self.single[b] for b in token])
            if len(ids) == 2:  # what the earlier merges leave of it
                self.pairs[ids[0], ids[1]] = ranks[token]
        self.lookahead = self._lookahead()
        self.code = "H" if max(self.tokens) < 1 << 16 else "I"
        self.longest = max(map(len, ranks))
        self.pair_table = None
        self.byte_pairs = np.full(1 << 16, _NONE, np.int32)
        letter = {i: b for b, i in enumerate(self.single)}
        for (u, v), rank in self.pairs.items():
            if u in letter and v in letter:
                self.byte_pairs[letter[u] << 8 | letter[v]] = rank

    def _lookahead(self) -> int:
        """Bytes after a token's end beyond which nothing can change the token."""
        right = {merged: v for (_, v), merged in self.pairs.items()}
        reach: dict[int, int] = {}
        most = 0
        for (u, v), _ in sorted(self.pairs.items(), key=lambda x: x[1]):
            far, s = 0, v
            while True:
                far = max(far, reach.get(s, 0))
                if s not in right:
                    break
                s = right[s]
            far += len(self.tokens[v])
            reach[u] = max(reach.get(u, 0), far)
            most = max(most, far)
        return most

    def _merge(self, ids: list[int]) -> list[int]:
        """All merges on a short list of symbols."""
        get, none = self.pairs.get, 1 << 62
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found and (rank := min(found)) != none:
            i = found.index(rank)
            ids[i] = rank
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get((ids[i - 1], rank), none)
            if i < len(found):
                found[i] = get((rank, ids[i + 1]), none)
        return ids

    def _hashed(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The pairs in an open hash table: its bits, keys (-1 where it is empty) and ranks."""
        if self.pair_table is None:
            bits = (4 * len(self.pairs) + 4).bit_length()
            keys, ranks = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            for (u, v), rank in self.pairs.items():
                key = u << 32 | v
                slot = (key * _SPREAD & _ALL) >> (64 - bits)
                while keys[slot] >= 0:
                    slot = (slot + 1) & ((1 << bits) - 1)
                keys[slot], ranks[slot] = key, rank
            self.pair_table = bits, keys, ranks
        return self.pair_table

    def _ranks(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; ``_NONE`` if they don't merge or one is missing (-1)."""
        bits, keys, ranks = self._hashed()
        key = u.astype(np.int64) << 32 | v
        slot = ((key.view(U) * U(_SPREAD)) >> U(64 - bits)).astype(np.int64)
        found = keys[slot]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << bits) - 1)
            now = found[open_] = keys[slot[open_]]
            open_ = open_[(now != key[open_]) & (now >= 0)]
        return np.where((found == key) & (u >= 0) & (v >= 0), ranks[slot], _NONE)

    def batch(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges on many short pieces at once: their symbols one after the other, and how many each has."""
        single = np.array(self.single, np.int32)
        counts, rows = np.zeros(len(sizes), np.int64), []
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), 4096):
            own = order[a : a + 4096]
            width = int(sizes[own].max())
            at = np.minimum(starts[own, None] + np.arange(width + 1), len(data) - 1)
            raw, inside = data[at], np.arange(width + 1) < sizes[own, None]
            symbols = np.where(inside, single[raw], -1)
            found = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]], _NONE)
            while True:
                place = found.argmin(axis=1) if found.shape[1] else np.zeros(len(own), np.int64)
                line = np.arange(len(own))
                rank = found[line, place] if found.shape[1] else np.full(len(own), _NONE)
                over = rank == _NONE
                if over.any():
                    done = symbols[over]
                    counts[own[over]] = (done >= 0).sum(axis=1)
                    rows.append((own[over], done))
                    own, symbols, found, place, rank = own[~over], symbols[~over], found[~over], place[~over], rank[~over]
                    line = np.arange(len(own))
                if not len(own):
                    break
                symbols[line, place] = rank
                # the symbol after the place goes, and with it the place's pair
                column = np.arange(symbols.shape[1] - 1)
                symbols = np.take_along_axis(symbols, column + (column > place[:, None]), 1)
                column = column[:-1]
                found = np.take_along_axis(found, column + (column >= place[:, None]), 1)
                left = np.flatnonzero(place > 0)
                found[left, place[left] - 1] = self._ranks(symbols[left, place[left] - 1], rank[left])
                right = np.flatnonzero(place < found.shape[1])
                found[right, place[right]] = self._ranks(rank[right], symbols[right, place[right] + 1])
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for own, done in rows:
            n = counts[own]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            line = np.repeat(np.arange(len(own)), n)
            out[first[own][line] + k] = done[line, k]
        return out, counts

    def apply(self, data: bytes) -> list[int]:
        """All merges on the bytes of one piece."""
        ids = [self.single[b] for b in data]
        if len(ids) <= _WORD:
            return self._merge(ids)
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        get = self.pairs.get
        heap = [(rank, i) for i, p in enumerate(zip(ids, ids[1:])) if (rank := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


class Transducer:
    """Tokens of one piece that comes in parts."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.full = 4 * merges.lookahead + merges.longest

    def push(self, part: bytes) -> list[int]:
        out: list[int] = []
        for a in range(0, len(part), self.full):
            self.held += part[a : a + self.full]
            if len(self.held) < self.full:
                break
            stable, at = len(self.held) - self.merges.lookahead, 0
            for token in self.merges.apply(self.held):
                end = at + len(self.merges.tokens[token])
                if end > stable:
                    break
                out.append(token)
                at = end
            self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self.merges.apply(held)


class Encoder:
    """Token ids of texts.  Pieces met before are in arrays: bytes and tokens one after the other, places by hash.

    Beyond ``remembered`` pieces all are forgotten and met anew.
    """

    def __init__(self, merges: Merges, remembered: int | None = None):
        self.merges = merges
        self.kind = np.dtype(merges.code)
        self.most = REMEMBERED if remembered is None else remembered
        self._forget(1 << 12)

    def _forget(self, room: int) -> None:
        self.used, self.bits = 0, (4 * room).bit_length()
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.begin, self.first = np.zeros(room, U), np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
        self.bytes, self.tokens = np.zeros(16 * room, np.uint8), np.zeros(8 * room, self.kind)

    def _piece(self, data: np.ndarray) -> list[int] | np.ndarray:
        if len(data) <= self.merges.lookahead:
            return self.merges.apply(data.tobytes())
        machine, out = Transducer(self.merges), []
        for a in range(0, len(data), _READ):
            out.append(np.array(machine.push(data[a : a + _READ].tobytes()), self.kind))
        return np.concatenate([*out, np.array(machine.finish(), self.kind)])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The remembered piece of each hash, or -1."""
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            found = out[open_] = self.table[slot[open_]]
            open_ = open_[(found >= 0) & (self.hashes[found] != h[open_])]
        return out

    def _place(self, own: np.ndarray) -> None:
        """Enter remembered pieces into the table."""
        slot = (self.hashes[own] >> U(64 - self.bits)).astype(np.int64)
        while len(own):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = own[free]
            lost = self.table[slot] != own
            own, slot = own[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def _remember(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Add pieces whose hashes are new and differ from each other."""
        ids, n = self.merges.batch(data, starts, sizes)
        k, to = self.used, self.used + len(h)
        room = lambda x, n: np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)]) if n >= len(x) else x
        self.hashes, self.begin, self.first = room(self.hashes, to), room(self.begin, to), room(self.first, to)
        self.hashes[k:to] = h
        self.begin[k + 1 : to + 1], self.first[k + 1 : to + 1] = self.begin[k] + np.cumsum(sizes), self.first[k] + np.cumsum(n)
        self.bytes, self.tokens = room(self.bytes, int(self.begin[to])), room(self.tokens, int(self.first[to]))
        whole = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        self.bytes[self.begin[k] : self.begin[to]] = data[whole]
        self.tokens[self.first[k] : self.first[to]] = ids
        self.used = to
        if 2 * to > len(self.table):
            self.bits += 2
            self.table = np.full(1 << self.bits, -1, np.int32)
            k = 0
        self._place(np.arange(k, to, dtype=np.int32))

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, which make up ``data``, and how many each has."""
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        sums = np.concatenate([[U(0)], np.cumsum(BYTES[data] * POWERS[: len(data)])])
        h = mix((sums[ends] - sums[starts]) * INVERSE[starts] ^ size.astype(U))
        if self.used > self.most:
            self._forget(1 << 12)
        found = self._find(h)
        new = np.flatnonzero((found < 0) & (size <= _WORD))
        if len(new):
            kinds, at = np.unique(h[new], return_index=True)
            self._remember(kinds, data, starts[new[at]], size[new[at]])
            found[new] = self._find(h[new])
        # whatever has a remembered hash must have its bytes
        begin = self.begin[found]
        alike = (found >= 0) & (self.begin[found + 1] - begin == size)
        width = np.where(alike, size, 0)
        shift = np.repeat(begin - starts, width)
        here = np.arange(len(data)) if alike.all() else np.flatnonzero(np.repeat(alike, size))
        wrong = here[self.bytes[here + shift] != data[here]]
        if len(wrong):
            alike[np.searchsorted(starts, wrong, "right") - 1] = False
        first = self.first[found]
        count = np.where(alike, self.first[found + 1] - first, 0)
        store = self.tokens
        odd = np.flatnonzero(~alike)
        if len(odd):
            extra, n = [store], len(store)
            for k in odd.tolist():
                extra.append(np.array(self._piece(data[starts[k] : ends[k]]), self.kind))
                first[k], count[k] = n, len(extra[-1])
                n += len(extra[-1])
            store = np.concatenate(extra)
        total = np.cumsum(count)
        where = np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)
        return store[where], count

    def _long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """The tokens of one long text, block by block."""
        at, none = 0, np.zeros(1, np.int64)
        while at < len(data):
            stop = character(data, min(len(data), at + BLOCK))
            part = data[at:stop]
            starts = piece_starts(part, none)
            if stop == len(data):
                yield self._pieces(part, starts)[0]
                return
            end = settled(part)
            if end > 0:
                starts = starts[starts < end]
            elif len(starts) > 1:
                end = int(starts[1])
                starts = starts[:1]
            else:  # one piece that goes on
                joined = int(part[0] == 32 and classes(part[:5])[1] != _SPACE)
                end = joined + same_class_until(data[at + joined :], 0)
                if at + end < len(data) and classes(part[joined : joined + 4])[0] == _SPACE:
                    end = character(data[at:], end - 1)  # the last one goes with what follows
                yield np.array(self._piece(data[at : at + end]), self.kind)
                at += end
                continue
            yield self._pieces(part[:end], starts)[0]
            at += end

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts and how many each has; text k is data[offsets[k] : offsets[k + 1]]."""
        sizes = np.diff(offsets)
        counts, out = np.zeros(len(sizes), np.int64), [np.zeros(0, self.kind)]
        for a, b in slices(sizes, BLOCK):
            part = data[offsets[a] : offsets[b]]
            if len(part) > BLOCK:
                for ids in self._long(part):
                    counts[a] += len(ids)
                    out.append(ids)
            elif len(part):
                begins = offsets[a:b] - offsets[a]
                starts = piece_starts(part, begins[sizes[a:b] > 0])
                ids, n = self._pieces(part, starts)
                out.append(ids)
                upto = np.concatenate([[0], np.cumsum(n)])
                counts[a:b] = np.diff(upto[np.searchsorted(starts, np.append(begins, len(part)))])
        return np.concatenate(out), counts

    def text(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0]


class Decoder:
    """Text of tokens that come in parts."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.tail = tokens, b""

    def push(self, ids: Iterable[int]) -> str:
        data = self.tail + b"".join(map(self.tokens.__getitem__, ids))
        keep = self._incomplete(data[-3:])
        self.tail = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _incomplete(end: bytes) -> int:
        """Bytes at the end that begin a character which isn't over."""
        for n in range(1, len(end) + 1):
            lead = end[-n]
            if lead & 0xC0 != 0x80:
                if lead < 0xC2 or lead > 0xF4 or n >= (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    return 0
                machine = codecs.getincrementaldecoder("utf-8")("replace")
                return 0 if machine.decode(end[-n:]) else n
        return 0

    def finish(self) -> str:
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", "replace")


_BUILT: dict[tuple, Merges] = {}
def merges_of(path: str) -> Merges:
    """The merge list of a rank file, built once in the driver."""
    key = path, os.path.getsize(path), os.path.getmtime(path)
    if key not in _BUILT:
        _BUILT[key] = Merges(read_ranks(path))
    return _BUILT[key]


def coder(path: str) -> tuple[Encoder, list[bytes]]:
    """Encoder and the tokens' bytes by id of a shipped merge list, made once in each Python worker."""
    made = kept("merges")
    if path not in made:
        made.clear()
        merges = loaded(path)
        made[path] = Encoder(merges), [merges.tokens.get(i, b"") for i in range(max(merges.tokens) + 1)]
    return made[path]


def decoded(ids: np.ndarray, tokens: list[bytes], part: int = _READ) -> str:
    machine = Decoder(tokens)
    out = [machine.push(ids[a : a + part].tolist()) for a in range(0, len(ids), part)]
    return "".join(out) + machine.finish()


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, intact) of every document; intact: decoding gives the text again."""
    at = shipped(docs.sparkSession, merges_of(vocabulary), "merges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = coder(at)
        for whole in batches:
            for batch in row_slices(whole, "text"):
                data, offsets = texts(batch.column(1), False)
                ids, sizes = encoder.encode(data, offsets)
                missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                intact = [decoded(ids[b - n : b], tokens).encode() == data[s:e].tobytes() for b, n, s, e in zip(ends, sizes, offsets, offsets[1:])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32), mask=missing), lists, pa.array(intact, mask=missing)], ["doc_id", "n_tokens", "tokens", "intact"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(lean(run, "merges"), "doc_id long, n_tokens int, tokens array<int>, intact boolean")
