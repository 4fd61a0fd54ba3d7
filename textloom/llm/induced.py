"""External suffix sorting by induction.

Types of suffixes (smaller or larger than their successor) and the left-most smaller ones (LMS) are found in one pass. LMS substrings are
sorted by one induction and named; the string of names is sorted by recursion; a second induction from the sorted LMS suffixes
gives all. Induction scans suffixes in order and puts their predecessors into a priority queue of tuples (symbol, order of arrival,
position, common prefix with the tuple before). Symbols are taken range by range: a byte is a range of its own and streams through; names are many, so
a range holds about RANGE of them, and what a range induces within itself is ordered in rounds.

The common prefix of two neighbours is one more than the least common prefix between their successors; it is found while they are put
and travels with them. Only LMS suffixes are compared on the text.

Memory: about `rows` tuples a queue and the ranges' own rows. Queues spill sorted runs, and every array over the whole string that is larger
lies in a file, all in a folder of the task's own; a task that is run again makes its own anew.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples of a queue in memory.
ROWS = 4 << 20
#: Tuples that are looked at together, and those of a range of several symbols.
PIECE, RANGE = 1 << 15, 1 << 14
_FAR = np.uint16(np.iinfo(np.uint16).max)
Piece = tuple[np.ndarray, np.ndarray]


class Scratch:
    """A folder for arrays that don't fit into memory; gone at the end."""

    def __init__(self, rows: int = ROWS):
        self.rows, self.spilled = rows, 0
        self.folder = None

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.folder is not None:
            self.folder.cleanup()

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.rows:
            return np.empty(n, dtype)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory()
        self.spilled += 1
        return np.memmap(f"{self.folder.name}/{self.spilled}", dtype, "w+", shape=(n,))


def pieces(n: int, size: int = 0) -> Iterator[slice]:
    size = size or PIECE
    return (slice(a, min(n, a + size)) for a in range(0, n, size))


class TupleQueue:
    """Tuples (range, position, common prefix), taken by range, equal ranges in order of arrival; beyond `rows` in memory, all go to a sorted run."""

    def __init__(self, ranges: int, scratch: Scratch):
        self.scratch, self.held = scratch, 0
        self.parts: list[list[Piece]] = [[] for _ in range(ranges)]
        self.runs: list[tuple[np.ndarray, ...]] = []  # where each range starts and ends, positions, common prefixes

    def put(self, at: np.ndarray, positions: np.ndarray, common: np.ndarray) -> None:
        """at: the ranges, in order."""
        if not len(at):
            return
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            self.parts[at[a]].append((positions[a:b], common[a:b]))
        self.held += len(at)
        if self.held > self.scratch.rows:
            self._spill()

    def _spill(self) -> None:
        sizes = [sum(len(p) for p, _ in x) for x in self.parts]
        ends = np.cumsum([0, *sizes])
        positions, common = self.scratch.array(self.held, np.int64), self.scratch.array(self.held, np.uint16)
        for r, x in enumerate(self.parts):
            at = ends[r]
            for p, c in x:
                positions[at : at + len(p)], common[at : at + len(p)] = p, c
                at += len(p)
        self.runs.append((ends[:-1].copy(), ends[1:], positions, common))
        self.parts = [[] for _ in self.parts]
        self.held = 0

    def take(self, r: int) -> list[Piece]:
        """All of a range that is here now, in pieces; what lies on disk is read when a piece is used."""
        out: list[Piece] = []
        for starts, ends, positions, common in self.runs:
            out += [(positions[starts[r] :][s], common[starts[r] :][s]) for s in pieces(int(ends[r] - starts[r]))]
            starts[r] = ends[r]
        mine, self.parts[r] = self.parts[r], []
        self.held -= sum(len(p) for p, _ in mine)
        if mine:
            p, c = (np.concatenate(x) for x in zip(*mine))
            out += [(p[s], c[s]) for s in pieces(len(p))]
        return out


class _Least:
    """Common prefixes of what is put into each range, from those of what is scanned."""

    def __init__(self, ranges: int):
        self.since = np.zeros(ranges, np.uint16)  # the least since the range's last tuple
        self.none = np.ones(ranges, bool)  # no tuple yet: nothing is common with what isn't there

    def of(self, common: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        """common: of the scanned piece; k: which of it have predecessors to put; at: their ranges, in order, k rising within each."""
        levels = [common]
        while 2 * (1 << (len(levels) - 1)) <= len(common):
            w = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
        first = np.append(True, at[1:] != at[:-1])
        lo = np.where(first, 0, np.append(0, k[:-1] + 1))
        out = self._range(levels, lo, k)
        heads = np.flatnonzero(first)
        out[heads] = np.minimum(out[heads], self.since[at[heads]])
        np.minimum(self.since, common.min(initial=_FAR), out=self.since)
        last = np.append(heads[1:], len(at)) - 1
        tail = k[last] + 1
        some = tail < len(common)
        self.since[at[last]] = _FAR
        self.since[at[last[some]]] = self._range(levels, tail[some], np.full(int(some.sum()), len(common) - 1))
        out = np.minimum(out, _FAR - 1) + np.uint16(1)
        out[heads[self.none[at[heads]]]] = 0
        self.none[at[heads]] = False
        return out

    @staticmethod
    def _range(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of [lo, hi]."""
        out = np.empty(len(lo), np.uint16)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for v in np.unique(level):
            s = np.flatnonzero(level == v)
            out[s] = np.minimum(levels[v][lo[s]], levels[v][hi[s] + 1 - (1 << v)])
        return out

    def skip(self, common: np.ndarray) -> None:
        np.minimum(self.since, common.min(initial=_FAR), out=self.since)


class Level:
    """A string of symbols and what induction needs of it. The last symbol is the smallest."""

    def __init__(self, t: np.ndarray, symbols: int, scratch: Scratch, each: bool):
        """each: every symbol is a range; otherwise symbols share ranges."""
        self.t, self.scratch, n = t, scratch, len(t)
        self.small = scratch.array(n, bool)
        self.small[n - 1] = True
        for a in reversed(range(0, n - 1, PIECE)):
            b = min(n - 1, a + PIECE)
            u = np.asarray(t[a : b + 1])
            d = u[1:] != u[:-1]
            differs = np.flatnonzero(d)
            nth = np.cumsum(d) - d
            up = np.append(u[differs + 1] > u[differs], self.small[b])
            self.small[a:b] = up[nth]
        if each:
            self.of = np.arange(symbols)
        else:
            count = np.zeros(symbols, np.int64)
            for s in pieces(n):
                u, k = np.unique(np.asarray(t[s]), return_counts=True)
                count[u] += k
            most = min(scratch.rows, RANGE)
            place = (np.cumsum(count) - count) // most
            heavy = count > most
            new = np.append(False, (place[1:] != place[:-1]) | heavy[1:] | heavy[:-1])
            self.of = np.cumsum(new)
        self.alone = np.bincount(self.of) == 1
        if len(self.alone) < 1 << 16:
            self.of = self.of.astype(np.uint16)

    def lms(self) -> np.ndarray:
        found = []
        for s in pieces(len(self.t)):
            u = self.small[max(0, s.start - 1) : s.stop]
            found.append(np.flatnonzero(u[1:] & ~u[:-1]) + max(0, s.start - 1) + 1)
        out = self.scratch.array(sum(map(len, found)), np.int64)
        np.concatenate(found, out=out)
        return out

    def before(self, positions: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """(k, predecessor) of those whose predecessor is of the type."""
        positions = np.asarray(positions)
        k = np.flatnonzero(positions > 0)
        p = positions[k] - 1
        keep = self.small[p] if small else ~self.small[p]
        return k[keep], p[keep]

    def induce(self, seeds: TupleQueue, rounds: int, common_at=None) -> Iterator[Piece]:
        """All suffixes, the largest first, in pieces (positions, common prefix with the one before in that order).

        seeds: the LMS suffixes by range, in order (or, to sort by LMS substrings, in order of symbols). common_at: of two positions;
        without it, common prefixes aren't kept.
        """
        ranges = len(self.alone)
        queue, larger = TupleQueue(ranges, self.scratch), TupleQueue(ranges, self.scratch)
        least = _Least(ranges) if common_at else None
        for r in range(ranges):
            if self.alone[r]:
                end = None
                for got in self._stream(queue, r, False, least):
                    larger.put(np.full(len(got[0]), r), *got)
                    end = int(got[0][-1])
                for k, got in enumerate(seeds.take(r)):
                    if k == 0 and end is not None and common_at:
                        got = self._headed(got, common_at(end, int(got[0][0])))
                    self._put(queue, got, False, least)
            else:
                got = self._batch(queue, [p for p, _ in seeds.take(r)], r, False, rounds)
                larger.put(np.full(len(got), r), got, np.zeros(len(got), np.uint16))
        queue, least = TupleQueue(ranges, self.scratch), _Least(ranges) if common_at else None
        last = len(self.t) - 1
        for r in range(ranges - 1, -1, -1):
            own = larger.take(r)
            if not self.alone[r]:
                yield from self._batch_down(queue, own, r, rounds)
                continue
            end = None
            for got in self._stream(queue, r, True, least):
                yield got
                end = int(got[0][-1])
            if self.of[self.t[last]] == r:  # the end of the string: the smallest of all
                got = np.array([last]), np.array([1 if end is not None else 0], np.uint16)
                self._put(queue, got, True, least)
                yield got
            after = 0  # common prefix of the piece's last with the one that follows it in rising order
            for k, (p, c) in enumerate(reversed(own)):
                if k == 0 and end is not None and common_at:
                    after = common_at(int(p[-1]), end)
                got = np.asarray(p)[::-1], np.append(np.uint16(after), np.asarray(c)[:0:-1])
                after = c[0]
                self._put(queue, got, True, least)
                yield got

    @staticmethod
    def _headed(piece: Piece, common: int) -> Piece:
        c = np.array(piece[1])
        c[0] = common
        return piece[0], c

    def _stream(self, queue: TupleQueue, r: int, small: bool, least) -> Iterator[Piece]:
        """The range's tuples in order of arrival; what they put into the range itself comes after them."""
        while got := queue.take(r):
            for piece in got:
                self._put(queue, piece, small, least)
                yield piece

    def _put(self, queue: TupleQueue, piece: Piece, small: bool, least) -> None:
        k, p = self.before(piece[0], small)
        if not len(k):
            if least:
                least.skip(np.asarray(piece[1]))
            return
        at = self.of[self.t[p]]
        order = np.argsort(at, kind="stable")
        k, p, at = k[order], p[order], at[order]
        queue.put(at, p, least.of(np.asarray(piece[1]), k, at) if least else np.zeros(len(p), np.uint16))

    def _batch(self, queue: TupleQueue, given: list[np.ndarray], r: int, small: bool, rounds: int) -> np.ndarray:
        """A range of several symbols: its induced suffixes in the order of the scan. given: the others of it, in that order."""
        order, members, n = self._ordered([p for p, _ in queue.take(r)], given, r, small, rounds)
        scanned = members[order]
        k, p = self.before(scanned, small)
        at = self.of[self.t[p]]
        out = at != r
        p, at = p[out], at[out]
        by = np.argsort(at, kind="stable")
        queue.put(at[by], p[by], np.zeros(len(by), np.uint16))
        return scanned[order < n] if not small else scanned

    def _batch_down(self, queue: TupleQueue, own: list[Piece], r: int, rounds: int) -> Iterator[Piece]:
        given = [np.asarray(p)[::-1] for p, _ in reversed(own)]
        last = len(self.t) - 1
        if self.of[self.t[last]] == r:
            given.append(np.array([last]))
        got = self._batch(queue, given, r, True, rounds)
        yield got, np.zeros(len(got), np.uint16)

    def _ordered(self, taken: list[np.ndarray], given: list[np.ndarray], r: int, small: bool, rounds: int):
        """(order, members, number of induced ones): induced suffixes first, then the given ones."""
        none = np.zeros(0, np.int64)
        taken, given = np.concatenate([none, *taken]), np.concatenate([none, *given])
        members, link = [taken], []
        # Predecessors within the range, and theirs; a successor among the given ones is counted from -1 down.
        front, name = np.concatenate((taken, given)), np.concatenate((np.arange(len(taken)), -1 - np.arange(len(given))))
        size = len(taken)
        while len(front):
            k, p = self.before(front, small)
            inside = self.of[self.t[p]] == r
            front, succ = p[inside], name[k[inside]]
            name = np.arange(size, size + len(front))
            size += len(front)
            members.append(front)
            link.append(succ)
        n = size
        link = np.concatenate([none, *link])
        link = np.where(link < 0, n - 1 - link, link)
        members = np.concatenate([*members, given])
        # One number a suffix: its symbol, whether it is given, and its key.
        symbol = self.t[members].astype(np.int64)
        symbol = symbol.max(initial=0) - symbol if small else symbol
        lead = symbol * 2 + (np.arange(len(members)) >= n) << 40
        key = np.concatenate((np.arange(len(taken)), np.zeros(n - len(taken), np.int64), np.arange(len(given))))
        key[len(taken) : n] = len(taken)
        order, rank, place = np.argsort(lead | key, kind="stable"), np.empty(len(members), np.int64), np.arange(len(members))
        for _ in range(rounds - 1):
            rank[order] = place
            key[len(taken) : n] = len(taken) + rank[link]
            # A round changes little, so the order before is nearly this one's, or is it.
            value = (lead | key)[order]
            if (value[1:] >= value[:-1]).all():
                break
            order = order[np.argsort(value, kind="stable")]
        return order, members, n


def _seeds(level: Level, positions: np.ndarray, common: np.ndarray | None = None) -> TupleQueue:
    queue = TupleQueue(len(level.alone), level.scratch)
    for s in pieces(len(positions)):
        p = np.asarray(positions[s])
        symbol = level.t[p]
        order = np.argsort(level.of[symbol], kind="stable")
        p = p[order]
        queue.put(level.of[level.t[p]], p, np.ones(len(p), np.uint16) if common is None else np.asarray(common[s])[order])
    return queue


def _names(level: Level, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """The LMS substrings' names in the order of the text, equal ones alike, and how many there are."""
    n, scratch = len(level.t), level.scratch
    r = 0x9E3779B97F4A7C15
    power, total = scratch.array(n + 1, np.uint64), scratch.array(n + 1, np.uint64)
    power[0], total[0] = 1, 0
    step = np.ones(PIECE, np.uint64)
    step[1:] = r
    step = np.cumprod(step)
    for s in pieces(n):
        m = s.stop - s.start
        power[s.start : s.stop] = step[:m] * np.uint64(pow(r, s.start, 1 << 64))
        mixed = (level.t[s].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        total[s.start + 1 : s.stop + 1] = total[s.start] + np.cumsum(mixed * power[s.start : s.stop])
    power[n] = pow(r, n, 1 << 64)
    end, names, place = scratch.array(len(lms), np.int64), scratch.array(len(lms), np.int64), scratch.array(n, np.int64)
    end[:-1], end[-1] = lms[1:], n - 1
    for s in pieces(len(lms)):
        place[lms[s]] = np.arange(s.start, s.stop)
    count, was = 0, None
    for s in pieces(len(ordered)):
        p = np.asarray(ordered[s])
        at = place[p]
        size = end[at] - p + 1
        value = (total[p + size] - total[p]) * power[n - p]
        new = np.append(was is None or was != (size[0], value[0]), (size[1:] != size[:-1]) | (value[1:] != value[:-1]))
        names[at] = count + np.cumsum(new) - 1
        count += int(new.sum())
        was = size[-1], value[-1]
    return names, count


def _sorted_lms(level: Level, depth: int) -> np.ndarray:
    """The LMS positions in the order of their suffixes, exact to `depth` symbols."""
    lms = level.lms()
    if len(lms) <= 1:
        return lms
    ordered = level.scratch.array(len(lms), np.int64)
    at = len(lms)
    by_symbol = lms
    if not level.alone.all():  # the seeds of a range of several symbols are wanted in the symbols' order
        by_symbol = lms[np.argsort(level.t[lms], kind="stable")]
    for p, _ in level.induce(_seeds(level, by_symbol), depth + 2):
        p = np.asarray(p)
        i = p[level.small[p] & (p > 0)]
        i = i[~level.small[i - 1]]
        ordered[at - len(i) : at] = i[::-1]
        at -= len(i)
    names, count = _names(level, lms, ordered)
    if count == len(lms) or depth <= 2:
        return ordered
    # A name spans two symbols at least.
    inner = Level(names, count, level.scratch, each=False)
    order = level.scratch.array(len(names), np.int64)
    at = len(names)
    for p, _ in inner.induce(_seeds(inner, _sorted_lms(inner, (depth + 1) // 2)), (depth + 1) // 2 + 2):
        order[at - len(p) : at] = np.asarray(p)[::-1]
        at -= len(p)
    for s in pieces(len(order)):
        order[s] = lms[order[s]]
    return order


def suffixes_down(t: np.ndarray, depth: int, scratch: Scratch) -> Iterator[Piece]:
    """The suffixes of t (bytes plus one, its last 0 and the others only where strings end, never side by side), the largest first, exact to `depth`
    symbols, in pieces: positions, and each one's common prefix with the one before, at most `depth`."""
    level = Level(t, 257, scratch, each=True)

    def common_at(i: int, j: int) -> int:
        a, b = np.asarray(t[i : i + depth]), np.asarray(t[j : j + depth])
        m = min(len(a), len(b))
        differs = np.flatnonzero(a[:m] != b[:m])
        return int(differs[0]) if len(differs) else m

    order = _sorted_lms(level, depth)
    common = scratch.array(len(order), np.uint16)
    room = len(t) - 1
    for s in pieces(len(order)):
        j = np.asarray(order[s])
        i = np.append(order[s.start - 1] if s.start else j[0], j[:-1])
        here = np.zeros(len(j), np.uint16)
        open_ = np.arange(len(j))
        for at in range(0, depth, 10):
            reach = np.arange(at, min(depth, at + 10))
            same = t[np.minimum(i[open_, None] + reach, room)] == t[np.minimum(j[open_, None] + reach, room)]
            whole = same.all(axis=1)
            here[open_] += np.where(whole, len(reach), same.argmin(axis=1)).astype(np.uint16)
            open_ = open_[whole]
        common[s] = here
    if len(order):
        common[0] = 0
    for p, c in level.induce(_seeds(level, order, common), depth + 2, common_at):
        yield np.asarray(p), np.minimum(np.asarray(c), depth)
