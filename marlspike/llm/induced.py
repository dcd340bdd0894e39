"""External suffix sorting by induction, with common prefixes.

The text is a sequence of positive integers.  A suffix is of type S if it is smaller than the one a symbol later,
else of type L; an S after an L is a seed.  The text between seeds is sorted and named, and where names repeat the
string of names is sorted by this same procedure.  The sorted seeds then induce the L suffixes in ascending order
through a minimum queue, and those induce the S suffixes in descending order through a second one.  A queued tuple
carries the suffix's symbol, the time it was queued (which is the order within a symbol), its position and the
symbols to its left as far as induction can go, so no step looks anything up in the text.  The common prefix of two
neighbours with one first symbol is one more than the least common prefix between the suffixes that induced them;
a stack of the last values answers that, as values are capped.

Queues, sorters and lists keep ``ITEMS`` tuples in memory and the rest in sorted runs or blocks in scratch files.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from .common import Scratch, put_record, records

ITEMS = 200_000
_BLOCK = 4096
_TOP = 1 << 64


def _runs(home: Scratch, path: str) -> Iterator:
    with home.reader(path) as stream:
        for block in records(stream):
            yield from block
    home.drop(path)


def _save(home: Scratch, items: Iterable) -> str:
    path = home.new()
    with home.writer(path) as stream:
        block = []
        for x in items:
            block.append(x)
            if len(block) == _BLOCK:
                put_record(stream, block)
                block = []
        if block:
            put_record(stream, block)
    return path


class Sorter:
    """Items in ascending order, once all are added."""

    def __init__(self, scratch: Callable[[], Scratch], most: int):
        self.scratch, self.most, self.items, self.paths = scratch, most, [], []

    def add(self, item) -> None:
        self.items.append(item)
        if len(self.items) >= self.most:
            self.items.sort()
            self.paths.append(_save(self.scratch(), self.items))
            self.items = []

    def __iter__(self) -> Iterator:
        self.items.sort()
        return heapq.merge(self.items, *(_runs(self.scratch(), p) for p in self.paths))


class Queue:
    """The least item first; may be added to at any time."""

    def __init__(self, scratch: Callable[[], Scratch], most: int):
        self.scratch, self.most = scratch, most
        self.heap: list = []
        self.heads: list = []
        self.runs: list[Iterator] = []

    def push(self, item) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            keep = self.most // 2
            run = _runs(self.scratch(), _save(self.scratch(), self.heap[keep:]))
            del self.heap[keep:]
            heapq.heappush(self.heads, (next(run), len(self.runs)))
            self.runs.append(run)

    def top(self):
        """The least item, or None."""
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self):
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, k = self.heads[0]
            following = next(self.runs[k], None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, k))
            return item
        return heapq.heappop(self.heap)


class Log:
    """A list that is written once and read once, forwards or backwards, a block at a time."""

    def __init__(self, scratch: Callable[[], Scratch], most: int):
        self.scratch, self.size = scratch, max(1, most // 4)
        self.blocks: list = []
        self.last: list = []
        self.n = 0

    def add(self, item) -> None:
        self.last.append(item)
        self.n += 1
        if len(self.last) == self.size:
            self.blocks.append(self.last if len(self.blocks) < 2 else _save(self.scratch(), self.last))
            self.last = []

    def _load(self, block) -> list:
        return block if isinstance(block, list) else list(_runs(self.scratch(), block))

    def forwards(self) -> Iterator:
        for k in range(len(self.blocks)):
            yield from self._load(self.blocks[k])
            self.blocks[k] = []
        yield from self.last

    def backwards(self) -> Iterator:
        yield from reversed(self.last)
        for k in reversed(range(len(self.blocks))):
            yield from reversed(self._load(self.blocks[k]))
            self.blocks[k] = []


class Text:
    """Symbols in blocks, in memory or in scratch files; slices go through a small cache."""

    def __init__(self, scratch: Callable[[], Scratch], most: int):
        self.scratch, self.most = scratch, most
        self.blocks: list = []
        self.held: list[int] = []
        self.n = 0
        self.cache: dict[int, np.ndarray] = {}

    def extend(self, symbols: list[int]) -> None:
        self.held += symbols
        self.n += len(symbols)
        while len(self.held) >= _BLOCK:
            block = np.array(self.held[:_BLOCK], np.uint64)
            del self.held[:_BLOCK]
            if len(self.blocks) * _BLOCK >= self.most:
                path = self.scratch().new()
                with self.scratch().writer(path) as stream:
                    stream.write(block.tobytes())
                block = path
            self.blocks.append(block)

    def _block(self, k: int) -> np.ndarray | list[int]:
        if k == len(self.blocks):
            return self.held
        if not isinstance(self.blocks[k], str):
            return self.blocks[k]
        if k not in self.cache:
            if len(self.cache) >= 64:
                del self.cache[next(iter(self.cache))]
            with self.scratch().reader(self.blocks[k]) as stream:
                self.cache[k] = np.frombuffer(stream.read(), np.uint64)
        return self.cache[k]

    def slice(self, at: int, n: int) -> list[int]:
        out: list[int] = []
        n = min(n, self.n - at)
        while n > 0:
            k, j = divmod(at, _BLOCK)
            part = self._block(k)[j : j + n]
            part = part.tolist() if isinstance(part, np.ndarray) else part
            out += part
            at, n = at + len(part), n - len(part)
        return out

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        for k in reversed(range(len(self.blocks))):
            yield from reversed(self._block(k).tolist())

    def common(self, a: int, b: int, most: int, known: int = 0) -> int:
        """Length of the common prefix of two suffixes, up to ``most``, given that it is ``known`` at least."""
        while known < most:
            step = min(16, most - known)
            x, y = self.slice(a + known, step), self.slice(b + known, step)
            n = min(len(x), len(y))
            if n == 0:
                return known
            if x[:n] != y[:n]:
                return known + next(k for k in range(n) if x[k] != y[k])
            known += n
            if n < step:
                return known
        return most


class Least:
    """The least of the last values, back to a given time."""

    def __init__(self):
        self.times: list[int] = []
        self.values: list[int] = []

    def add(self, time: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.times.pop()
        self.times.append(time)
        self.values.append(value)

    def after(self, time: int) -> int:
        return self.values[bisect.bisect_right(self.times, time)]


def suffixes(text: Text, cap: int, scratch: Callable[[], Scratch], most: int = ITEMS) -> Iterator[tuple[int, int]]:
    """(position, common prefix with the suffix before it, at most ``cap``) in ascending order."""
    if not text.n:
        return
    # seeds from the last to the first; run: the symbols left of a seed (or of the end), down to the previous seed
    seeds = Log(scratch, most)
    run: list[int] = []
    small = False  # whether the suffix at the symbol read last is of type S
    symbol, at = 0, text.n
    seed: tuple = (text.n, 0)
    for left in text.backwards():
        smaller = left < symbol if left != symbol else small
        if small and not smaller:
            # the suffix at ``at`` is a seed; what is left of the seed after it ends here
            seeds.add((*seed, tuple(run)))
            seed, run = (at, symbol), []
        run.append(left)
        symbol, small, at = left, smaller, at - 1
    seeds.add((*seed, tuple(run)))
    end, order = None, Sorter(scratch, most)
    forwards = Log(scratch, most)
    for x in seeds.backwards():
        forwards.add(x)
    m = forwards.n - 1  # the last one is the text's end
    named = Log(scratch, most)
    before: tuple | None = None
    for k, (position, first, left) in enumerate(forwards.forwards()):
        named.add((position, first, left))
        # from the previous seed up to this one; where another goes on with an L instead of a seed, that one is smaller
        if before is not None:
            order.add(((*reversed(left), first, _TOP), k - 1))
        before = (position, first)
    names = Sorter(scratch, most)
    last, name = None, 0
    for substring, k in order:
        if substring != last:
            name += 1
            last = substring
        names.add((k, name))
    ranks = Sorter(scratch, most)
    if name == m:
        for k, x in names:
            ranks.add((k, x, 0))
    else:
        reduced = Text(scratch, most)
        for _, x in names:
            reduced.extend([x])
        for r, (k, shared) in enumerate(suffixes(reduced, cap, scratch, most)):
            ranks.add((k, r + 1, shared))
    sorted_seeds = Sorter(scratch, most)
    for (position, first, left), found in zip(named.forwards(), _padded(ranks)):
        if found is None:
            end = (position, first, left)
        else:
            sorted_seeds.add((found[1], position, first, left, found[2]))
    # ascending: the end and the seeds induce the L suffixes
    queue, least, pushed, time = Queue(scratch, most), Least(), {}, 0
    larger = Log(scratch, most)

    def induce(left: tuple, k: int, position: int) -> None:
        c = left[k]
        since = pushed.get(c)
        pushed[c] = time
        queue.push((c, time, position - 1, left, k, 0 if since is None else min(cap, 1 + least.after(since))))

    least.add(0, 0)
    if end[2]:
        induce(end[2], 0, end[0])
    previous: tuple[int, int, bool] | None = None  # symbol, position, is a seed
    waiting = iter(sorted_seeds)
    seed = next(waiting, None)
    while True:
        top = queue.top()
        if top is None and seed is None:
            break
        time += 1
        if top is not None and (seed is None or top[0] <= seed[2]):
            c, _, position, left, k, shared = queue.pop()
            least.add(time, shared)
            previous = (c, position, False)
            more = k + 1 < len(left)
            larger.add((c, position, shared, left if more and left[k + 1] < c else None, k + 1))
            if more and left[k + 1] >= c:
                induce(left, k + 1, position)
        else:
            _, position, first, left, known = seed
            if previous is None or previous[0] != first:
                shared = 0
            else:
                shared = text.common(previous[1], position, cap, min(cap, known) if previous[2] else 1)
            least.add(time, shared)
            previous = (first, position, True)
            if left:
                induce(left, 0, position)
            seed = next(waiting, None)
    # descending: all suffixes induce the S suffixes
    queue, least, pushed, time = Queue(scratch, most), Least(), {}, 0
    least.add(0, 0)
    out = Log(scratch, most)
    falling = larger.backwards()
    big = next(falling, None)
    previous, carried = None, 0
    while True:
        top = queue.top()
        if top is None and big is None:
            break
        time += 1
        if top is not None and (big is None or -top[0] >= big[0]):
            c, _, position, left, k, shared = queue.pop()
            c = -c
            if previous is None or previous[0] != c:
                shared = 0
            more = k + 1 < len(left)
            source = (left, k + 1) if more and left[k + 1] <= c else None
            kind = False
        else:
            c, position, below, left, k = big
            if previous is None or previous[0] != c:
                shared = 0
            elif previous[2]:
                shared = carried
            else:
                shared = text.common(previous[1], position, cap, 1)
            carried = below
            source = (left, k) if left is not None else None
            big = next(falling, None)
            kind = True
        out.add((position, shared))
        least.add(time, shared)
        previous = (c, position, kind)
        if source:
            left, k = source
            symbol = left[k]
            since = pushed.get(symbol)
            pushed[symbol] = time
            queue.push((-symbol, time, position - 1, left, k, 0 if since is None else min(cap, 1 + least.after(since))))
    shared = 0
    for position, above in out.backwards():
        yield position, shared
        shared = above


def _padded(items: Iterable) -> Iterator:
    """The items, then None for ever."""
    yield from items
    while True:
        yield None
