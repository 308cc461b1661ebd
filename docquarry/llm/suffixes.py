"""Suffix order and capped common prefixes by external induced sorting.

sorted_suffixes() follows the induced-sorting scheme: suffixes are of type L (larger than their successor) or S; the
leftmost S ones are sorted first, by naming their substrings in an induction of their own and recursing on the string of
names; two sweeps then induce all others. Between the sweeps' steps, suffix tuples (position, common prefix) wait in
monotone priority queues, one file for each first character, which go to disk beyond a memory limit. Since what is taken
from the queues is already in order, each queue is read in the order in which it was filled. A tuple's common prefix with
its neighbour is one more than the least common prefix between the two places from which they were induced. Tuples of type L,
which the second sweep takes in the opposite order, and the result wait in spools that go to disk beyond the same limit.

The recursion sorts a string of names in the same way (Names): its alphabet is as large as the string, so one disk-backed
priority queue (Heap) of tuples (name, type, number) stands for the queues by character, and is emptied in batches. Each level of
the recursion is at most half as long; a string of names that fits the limit is sorted in memory, which ends the recursion.
Strings, types, leftmost S suffixes and their names are arrays on disk beyond the limit, read and written block by block.
So what a sort holds in memory depends on the limit alone. All files are scratch of the task: they have no names and end with it.

All steps move whole arrays: a queue is emptied in waves, each wave induces the next.

Common prefixes are capped, since removal only asks whether DEPTH bytes agree; beyond the cap the order is arbitrary.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples kept in memory by all queues of a sort together, before they go to disk.
QUEUE_LIMIT = 8_000_000


def array(n: int, kind, limit: int) -> np.ndarray:
    """An array to be filled: in memory up to the limit, else on disk."""
    if n <= limit:
        return np.empty(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


def blocks(n: int, limit: int):
    """Slices of at most `limit` items."""
    return (slice(a, min(n, a + limit)) for a in range(0, n, limit))


class Grown:
    """An array that grows at its end, on disk beyond the limit."""

    def __init__(self, kind, limit: int = QUEUE_LIMIT):
        self.kind, self.limit, self.n = np.dtype(kind), limit, 0
        self.held: list[np.ndarray] = []
        self.inside, self.file = 0, None

    def put(self, x: np.ndarray) -> None:
        self.held.append(np.ascontiguousarray(x, self.kind))
        self.n += len(x)
        self.inside += len(x)
        if self.inside > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self._write()

    def _write(self) -> None:
        self.file.seek(0, 2)
        for x in self.held:
            self.file.write(x.tobytes())
        self.held, self.inside = [], 0

    def get(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self._write()
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.n,))


class Queues:
    """One queue of (position, common prefix) for each character, on disk beyond the limit."""

    def __init__(self, characters: int, limit: int = QUEUE_LIMIT):
        self.held: list[list] = [[] for _ in range(characters)]
        self.limit, self.inside, self.file = limit, 0, None

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.inside + len(pos) > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.held[c].append((at, len(pos)))
        else:
            self.inside += len(pos)
            self.held[c].append((pos, lcp))

    def take(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        """What waits longest for a character, not more tuples at a time than the limit or one entry has."""
        waiting, n, size = self.held[c], 0, 0
        while n < len(waiting):
            a, b = waiting[n]
            more = b if isinstance(a, int) else len(a)
            if n and size + more > self.limit:
                break
            n, size = n + 1, size + more
        got, self.held[c] = waiting[:n], waiting[n:]
        if not got:
            return None
        pos, lcp = [], []
        for a, b in got:
            if isinstance(a, int):
                self.file.seek(a)
                pos.append(np.frombuffer(self.file.read(8 * b), np.int64))
                lcp.append(np.frombuffer(self.file.read(b), np.uint8))
            else:
                self.inside -= len(a)
                pos.append(a)
                lcp.append(b)
        return (pos[0], lcp[0]) if len(pos) == 1 else (np.concatenate(pos), np.concatenate(lcp))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Spool:
    """Tuples (position, common prefix) in one order, on disk beyond the limit; they are taken from the end."""

    def __init__(self, limit: int = QUEUE_LIMIT):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.blocks: list[tuple[int, int]] = []  # places and sizes in the file
        self.limit, self.inside, self.file = limit, 0, None

    def put(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.held and self.inside + len(pos) > self.limit:
            self._write()
        self.held.append((pos, lcp))
        self.inside += len(pos)

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for k, kind in enumerate((np.int64, np.uint8)):
            for held in self.held:
                self.file.write(np.ascontiguousarray(held[k], kind).tobytes())
        self.blocks.append((at, self.inside))
        self.held, self.inside = [], 0

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The last tuples, `most` of them at most, in the order in which they came."""
        if not self.held:
            if not self.blocks:
                return None
            at, n = self.blocks.pop()
            self.file.seek(at)
            self.held, self.inside = [(np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8))], n
        got, size = [], 0
        while self.held and size < most:
            pos, lcp = self.held.pop()
            cut = max(0, len(pos) - (most - size))
            if cut:
                self.held.append((pos[:cut], lcp[:cut]))
            got.append((pos[cut:], lcp[cut:]))
            size += len(pos) - cut
        self.inside -= size
        return got[0] if len(got) == 1 else (np.concatenate([x for x, _ in got[::-1]]), np.concatenate([x for _, x in got[::-1]]))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Minima:
    """Range minima of a byte array by a sparse table."""

    def __init__(self, x: np.ndarray):
        self.rows, w = [x], 1
        while 2 * w <= len(x):
            y = self.rows[-1]
            self.rows.append(np.minimum(y[:-w], y[w:]))
            w *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of x[a..b], both ends included, a <= b."""
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for level in np.unique(k).tolist():
            m = k == level
            row = self.rows[level]
            out[m] = np.minimum(row[a[m]], row[b[m] - (1 << level) + 1])
        return out


def types(s: np.ndarray, limit: int = QUEUE_LIMIT) -> np.ndarray:
    """True where a suffix is of type S; the last character is the smallest and occurs once."""
    n = len(s)
    out = array(n, bool, limit)
    out[n - 1] = after = True
    for part in reversed(list(blocks(n - 1, limit))):
        x = s[part.start : part.stop + 1].astype(np.int64)
        step = np.sign(x[1:] - x[:-1])
        m = len(step)
        at = np.where(step != 0, np.arange(m), m)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[part] = np.where(at < m, step[np.minimum(at, m - 1)] > 0, after)
        after = bool(out[part.start])
    return out


def leftmost(kind: np.ndarray, limit: int) -> np.ndarray:
    """Positions of the leftmost S suffixes: type S after type L."""
    out = Grown(np.int64, limit)
    for part in blocks(len(kind) - 1, limit):
        x = kind[part.start : part.stop + 1]
        out.put(np.flatnonzero(x[1:] & ~x[:-1]) + 1 + part.start)
    return out.get()


def names_of(s: np.ndarray, lms: np.ndarray, ordered, depth: int, limit: int) -> tuple[np.ndarray, int]:
    """The name of each leftmost-S substring, in text order, and the number of names.

    ordered: positions in the order of their substrings, block by block. Equal substrings have equal names, larger ones
    larger names; so have those that agree in `depth` characters, whose order doesn't matter.
    """
    names = array(len(lms), np.int64, limit)
    last, name = None, 0
    for pos in ordered:
        if not len(pos):
            continue
        index = np.searchsorted(lms, pos)
        size = np.minimum(lms[np.minimum(index + 1, len(lms) - 1)] + 1 - pos, depth)
        size[index == len(lms) - 1] = 1
        if last is not None:
            pos, size = np.concatenate([last[0], pos]), np.concatenate([last[1], size])
        same = size[1:] == size[:-1]
        live = np.flatnonzero(same)
        for k in range(depth):
            live = live[size[live] > k]
            if not len(live):
                break
            agree = s[pos[live] + k] == s[pos[live + 1] + k]
            same[live[~agree]] = False
            live = live[agree]
        new = np.cumsum(~same)
        if last is None:
            new = np.concatenate([[0], new])
        names[index] = name + new
        name += int(new[-1])
        last = pos[-1:], size[-1:]
    return names, name + 1


class Sorter:
    """A string of small integers."""

    def __init__(self, s: np.ndarray, depth: int, limit: int = QUEUE_LIMIT):
        """The last integer is 0 and occurs only there."""
        self.s, self.depth, self.limit = s, depth, limit
        self.kind = types(s, limit)
        self.characters = max(int(s[part].max()) for part in blocks(len(s), limit)) + 1

    def prefix(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes p and q, capped."""
        out = np.zeros(len(p), np.uint8)
        live = np.arange(len(p))
        last = len(self.s) - 1
        for k in range(self.depth):
            a, b = p[live] + k, q[live] + k
            live = live[(np.maximum(a, b) <= last) & (self.s[np.minimum(a, last)] == self.s[np.minimum(b, last)])]
            if not len(live):
                break
            out[live] = k + 1
        return out

    def _push(self, queues: Queues, since: np.ndarray, pos: np.ndarray, lcp: np.ndarray, want_s: bool) -> None:
        """Put the predecessors of a wave into their queues. since: least common prefix since a character's last tuple."""
        before = pos - 1
        ok = before >= 0
        ok[ok] = self.kind[before[ok]] == want_s
        at = np.flatnonzero(ok)
        whole = int(lcp.min())
        if not len(at):
            np.minimum(since, whole, out=since, where=since >= 0)
            return
        before = before[at]
        c = self.s[before]
        order = np.argsort(c, kind="stable")
        at, before, c = at[order], before[order], c[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        ends = np.concatenate([head[1:], [len(c)]])
        low = np.zeros(len(c), np.uint8)
        inner = np.ones(len(c), bool)
        inner[head] = False
        inner = np.flatnonzero(inner)
        if len(inner):
            low[inner] = _Minima(lcp).of(at[inner - 1] + 1, at[inner])
        up_to = np.minimum.accumulate(lcp)
        had = since[c[head]]
        low[head] = np.where(had >= 0, np.minimum(up_to[at[head]], np.maximum(had, 0)), 0)
        grown = np.minimum(low + 1, self.depth).astype(np.uint8)
        grown[head[had < 0]] = 0
        after = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [255]])
        np.minimum(since, whole, out=since, where=since >= 0)
        since[c[head]] = after[at[ends - 1] + 1]
        for a, b, x in zip(head.tolist(), ends.tolist(), c[head].tolist(), strict=True):
            queues.put(x, before[a:b].astype(np.int64), grown[a:b])

    def induce(self, lms: Queues):
        """All suffixes in order, piece by piece, and common prefix with the one before, from the leftmost S ones in order."""
        s, k = self.s, self.characters
        queues, since = Queues(k, self.limit), np.full(k, -1, np.int16)
        large, sizes = Spool(self.limit), [0] * k  # the second sweep takes them in the opposite order
        for c in range(k):
            last = None
            while (got := queues.take(c)) is not None:
                pos, lcp = got
                large.put(pos, lcp)
                sizes[c] += len(pos)
                last = pos[-1:]
                self._push(queues, since, pos, lcp, False)
            head = True
            while (got := lms.take(c)) is not None:
                pos, lcp = got
                if head:
                    lcp = lcp.copy()
                    lcp[0] = 0 if last is None else self.prefix(last, pos[:1])[0]
                    head = False
                for part in blocks(len(pos), self.limit):
                    self._push(queues, since, pos[part], lcp[part], False)
        queues.close()
        lms.close()
        queues, since = Queues(k, self.limit), np.full(k, -1, np.int16)
        out = Spool(self.limit)  # in descending order; lcp: with the next larger one

        def extract(pos, lcp):
            out.put(pos, lcp)
            self._push(queues, since, pos, lcp, True)

        for c in range(k - 1, -1, -1):
            last = None
            while (got := queues.take(c)) is not None:
                last = got[0][-1:]
                extract(*got)
            if c == 0:
                extract(np.array([len(s) - 1]), np.zeros(1, np.uint8))
            left, up = sizes[c], None
            while left:
                pos, lcp = large.take(min(left, self.limit))
                left -= len(pos)
                pos, down = pos[::-1], np.concatenate([lcp[1:], lcp[:1]])[::-1]
                if up is None:
                    up = 0 if last is None else self.prefix(last, pos[:1])[0]
                down[0], up = up, lcp[0]
                extract(pos, down)
        queues.close()
        large.close()
        before = np.zeros(1, np.uint8)
        while (got := out.take(self.limit)) is not None:
            pos, lcp = got[0][::-1], got[1][::-1]
            yield pos, np.concatenate([before, lcp[:-1]])
            before = lcp[-1:]
        out.close()

    def _by_character(self, lms) -> Queues:
        """Blocks of leftmost S suffixes and their common prefixes, in queues by first character."""
        out = Queues(self.characters, self.limit)
        for pos, lcp in lms:
            c = self.s[pos]
            order = np.argsort(c, kind="stable")
            pos, lcp, c = pos[order], lcp[order], c[order]
            cut = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]]) if len(c) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out.put(int(c[a]), np.ascontiguousarray(pos[a:b], np.int64), np.ascontiguousarray(lcp[a:b], np.uint8))
        return out

    def run(self):
        kind, limit = self.kind, self.limit
        lms = leftmost(kind, limit)
        none = lambda: ((lms[part], np.zeros(part.stop - part.start, np.uint8)) for part in blocks(len(lms), limit))
        if len(lms) < 2:
            yield from self.induce(self._by_character(none()))
            return
        found = (x[kind[x] & (x > 0) & ~kind[np.maximum(x, 1) - 1]] for x, _ in self.induce(self._by_character(none())))
        names, different = names_of(self.s, lms, found, self.depth, limit)
        order = Names(names, -(-self.depth // 2), limit).order(different)

        def lead():
            last = None
            for part in blocks(len(order), limit):
                pos = lms[order[part]]
                held = pos if last is None else np.concatenate([last, pos])
                lcp = self.prefix(held[:-1], held[1:])
                yield pos, np.concatenate([np.zeros(1, np.uint8), lcp]) if last is None else lcp
                last = pos[-1:]

        yield from self.induce(self._by_character(lead()))


class Heap:
    """A priority queue of tuples (name, type, number, position): sorted runs on disk beyond the limit.

    What is put is never smaller than what was taken, so each run is read once from its beginning.
    """

    def __init__(self, limit: int):
        self.limit, self.inside = limit, 0
        self.held: list[np.ndarray] = []  # rows of four
        self.runs: list[list] = []  # rows on disk, next row

    def put(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        self.held.append(rows)
        self.inside += len(rows)
        if self.inside > self.limit:
            rows = self._sorted()
            run = np.memmap(tempfile.TemporaryFile(), np.int64, "w+", shape=rows.shape)
            run[:] = rows
            self.runs.append([run, 0])
            self.held, self.inside = [], 0

    def _sorted(self) -> np.ndarray:
        rows = self.held[0] if len(self.held) == 1 else np.concatenate(self.held)
        return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]

    def take(self, most: int) -> tuple[np.ndarray, int | None]:
        """The smallest rows, about `most` at most, and the name of the smallest row that is left."""
        if self.held:
            self.held = [self._sorted()]
        ends = [(x, at) for x, at in [*self.runs, *([h, 0] for h in self.held)] if at < len(x)]
        if not ends:
            return np.zeros((0, 4), np.int64), None
        share = max(1, most // len(ends))
        # rows up to the least of the last rows looked at are known to be the smallest
        bound = min(tuple(x[min(len(x), at + share) - 1, :3].tolist()) for x, at in ends)
        got = []
        for k, (x, at) in enumerate([*self.runs, *([h, 0] for h in self.held)]):
            part = x[at : at + share]
            below = (part[:, 0] < bound[0]) | (part[:, 0] == bound[0]) & ((part[:, 1] < bound[1]) | (part[:, 1] == bound[1]) & (part[:, 2] <= bound[2]))
            n = int(below.sum())
            got.append(np.array(part[:n]))
            if k < len(self.runs):
                self.runs[k][1] = at + n
            else:
                self.held, self.inside = [x[n:]] if n < len(x) else [], len(x) - n
        rows = np.concatenate(got)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        self.runs = [r for r in self.runs if r[1] < len(r[0])]
        left = [int(x[at, 0]) for x, at in [*self.runs, *([h, 0] for h in self.held)]]
        return rows, min(left) if left else None


class Names:
    """A string of names, as large an alphabet as can be; the last one is 0 and occurs only there."""

    def __init__(self, t: np.ndarray, depth: int, limit: int):
        self.t, self.depth, self.limit = t, depth, limit

    def order(self, different: int) -> np.ndarray:
        """Positions in suffix order, exact up to depth names; different: how many names there are."""
        t, limit = self.t, self.limit
        if len(t) <= limit or different == len(t):
            if len(t) <= limit:
                return order_names(np.asarray(t), 2 * self.depth)
            out = array(len(t), np.int64, limit)  # all names are different: each is its place
            for part in blocks(len(t), limit):
                out[t[part]] = np.arange(part.start, part.stop)
            return out
        self.kind = types(t, limit)
        lms = leftmost(self.kind, limit)
        whole = lambda pos: pos[self.kind[pos] & (pos > 0) & ~self.kind[np.maximum(pos, 1) - 1]]
        if len(lms) > 1:
            found = (whole(x) for x in self._induce(lms[part] for part in blocks(len(lms), limit)))
            names, n = names_of(t, lms, found, self.depth, limit)
            order = Names(names, -(-self.depth // 2), limit).order(n)
            ordered = (lms[order[part]] for part in blocks(len(order), limit))
        else:
            ordered = iter([lms])
        out = Grown(np.int64, limit)
        for x in self._induce(ordered):
            out.put(x)
        return out.get()

    def _induce(self, lms):
        """All suffixes in order, block by block, from blocks of the leftmost S ones in order."""
        t, heap, n = self.t, Heap(self.limit), 0
        for pos in lms:
            heap.put(np.stack([t[pos], np.ones(len(pos), np.int64), np.arange(n, n + len(pos)), pos], 1))
            n += len(pos)
        large = Grown(np.int64, self.limit)
        for pos in self._sweep(heap, n, 0):
            large.put(pos[~self.kind[pos]])
        large, heap, n, top = large.get(), Heap(self.limit), 0, len(t)
        for part in reversed(list(blocks(len(large), self.limit))):  # in descending order
            pos = np.asarray(large[part])[::-1]
            heap.put(np.stack([top - t[pos], np.ones(len(pos), np.int64), np.arange(n, n + len(pos)), pos], 1))
            n += len(pos)
        down = Grown(np.int64, self.limit)
        for pos in self._sweep(heap, n, top):
            down.put(pos)
        down.put(np.array([len(t) - 1]))  # the end of the string, which nothing induces
        down = down.get()
        for part in reversed(list(blocks(len(down), self.limit))):
            yield np.asarray(down[part])[::-1]

    def _sweep(self, heap: Heap, number: int, top: int):
        """Take all rows in order and induce predecessors: of type L in ascending order, of type S in descending order.

        top: 0 for ascending order, else what names are subtracted from. A row of type 1 was given, one of type 0 is induced.
        """
        t, kind, want = self.t, self.kind, bool(top)
        while True:
            rows, after = heap.take(self.limit)
            if not len(rows):
                return
            given = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == 1)
            if given[-1] and not given.all():  # induced rows of this name may still come before them
                after = int(rows[-1, 0])
                heap.put(rows[given])
                rows = rows[~given]
            # predecessors with names below what is left belong to this batch
            name, sort, key, pos = (list(x) for x in ([rows[:, 0]], [rows[:, 1]], [rows[:, 2]], [rows[:, 3]]))
            lead, begin, front = [np.full(len(rows), -1)], 0, rows[:, 3]
            while True:
                index = np.flatnonzero(front > 0)
                before = front[index] - 1
                ok = kind[before] == want
                index, before = index[ok], before[ok]
                c = t[before]
                c = top - c if top else c
                own = c < after if after is not None else np.ones(len(c), bool)
                index, before, c = index[own], before[own], c[own]
                if not len(before):
                    break
                name.append(c), sort.append(np.zeros(len(c), np.int64)), key.append(np.zeros(len(c), np.int64)), pos.append(before)
                lead.append(index + begin)
                begin += len(front)
                front = before
            name, sort, key, pos, lead = (np.concatenate(x) for x in (name, sort, key, pos, lead))
            inner, rank = lead >= 0, np.zeros(len(pos), np.int64)
            for _ in range(self.depth + 1):  # a predecessor stands by the place of what induced it
                order = np.lexsort((np.where(inner, number + rank[lead], key), sort, name))
                new = np.empty(len(pos), np.int64)
                new[order] = np.arange(len(pos))
                if not inner.any() or (new == rank).all():
                    break
                rank = new
            out = pos[order]
            for part in blocks(len(out), self.limit):
                yield out[part]
            index = np.flatnonzero(out > 0)
            before = out[index] - 1
            ok = kind[before] == want
            index, before = index[ok], before[ok]
            c = t[before]
            c = top - c if top else c
            if after is not None:
                far = c >= after
                heap.put(np.stack([c[far], np.zeros(int(far.sum()), np.int64), number + index[far], before[far]], 1))
            number += len(out)


def order_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by names that cover twice as many each time.

    A name stands for two characters at least, so the recursion ends when names are distinct or cover depth characters.
    """
    covered = 2
    while covered <= depth and names.max() + 1 < len(names):
        top = int(names.max()) + 2
        step = covered // 2
        nxt = np.zeros(len(names), np.int64)
        nxt[: len(names) - step] = names[step:] + 1
        _, names = np.unique(names * top + nxt, return_inverse=True)
        covered *= 2
    return np.argsort(names, kind="stable")


def suffix_pieces(s: np.ndarray, depth: int, limit: int = QUEUE_LIMIT):
    """sorted_suffixes() in pieces of `limit` suffixes at most, one after the other."""
    return Sorter(s, depth, limit).run()


def sorted_suffixes(s: np.ndarray, depth: int, limit: int = QUEUE_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order (exact up to depth characters) and common prefixes with the one before, capped at depth."""
    pos, lcp = zip(*suffix_pieces(s, depth, limit), strict=True)
    return np.concatenate(pos), np.concatenate(lcp)
