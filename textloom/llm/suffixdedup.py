"""Exact substring dedup across documents by suffix arrays of shards.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Such a string is a
window. Every window has an anchor: the least hash of its substrings of `gram` bytes. Equal windows have equal anchors, so shards are cut by
anchor and need nothing of each other. A run of windows with one anchor, with the bytes they cover, is a context.

Texts are dealt to cells once, by a hash of id and text; that one exchange is read in each of four rounds, in which cells and shards tell each other:

1. The anchors and the hashes of the texts of a cell, each once however often it occurs there. Shards answer which anchors another text has as well, and the
   least id of each text: all other copies of a text go whole, and only the text with the least id is looked at further.
2. The different contexts of shared anchors, as hashes with the least id that has them in the cell. Shards answer whether a smaller id has the
   context elsewhere, so that it goes whole, and whether the anchor has several contexts.
3. The bytes of the contexts of such anchors. A shard's are sorted by external induced sorting (textloom.llm.induced), which also tells the common prefix of
   neighbours; those that share `length` bytes are one window, and its least id decides.
4. The cell cuts the spans out of its texts.

So a text, line or passage that very many documents share costs each cell one entry. What a cell or shard holds is in memory as arrays, but for the
contexts that are sorted, which lie in files where they are many. Cells have about CELL bytes of text, shards a SHARD-th of it all, but there are no fewer than
spark.sql.shuffle.partitions. A task takes its shards one after another, so neither its memory nor what it spills grows with the table.

Defined results: null and empty texts, and texts shorter than `length`, lose nothing; rows with equal ids don't take from
each other; a null id counts as larger than all others; an empty table gives no rows; extra columns are ignored; ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.exchange import PACKED, bucket_count, emit, pack, planes, reduce_streamed, unpack, unplanes
from textloom.llm.hashing import mix64
from textloom.llm.induced import ROWS, Scratch, suffixes_down

LENGTH, GRAM = 50, 20
#: Bytes of text in a cell, a shard's share of all texts, and bytes of those whose anchors are found together.
CELL, SHARD, PART = 8 << 20, 8 << 20, 1 << 20
NO_ID = (1 << 63) - 1
_R = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at every position, by doubling."""
    have = {1: _TABLE[data]}
    w, r = 1, {1: _R}
    with np.errstate(over="ignore"):
        while 2 * w <= k:
            have[2 * w] = have[w][:-w] * r[w] + have[w][w:] if len(have[w]) > w else np.zeros(0, np.uint64)
            r[2 * w] = r[w] * r[w]
            w *= 2
        out, width = have[w], w
        for p in sorted((x for x in have if x < w), reverse=True):
            if width + p <= k:
                n = len(have[p]) - width
                out = out[: max(n, 0)] * r[p] + have[p][width:] if n > 0 else np.zeros(0, np.uint64)
                width += p
        return mix64(out)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        h = np.minimum(h[:-width], h[width:]) if len(h) > width else h[:0]
        width *= 2
    if width < w:
        h = np.minimum(h[: -(w - width)], h[w - width :]) if len(h) > w - width else h[:0]
    return h


def anchor_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, last window, anchor) of every run of windows of a text that share their anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    least = sliding_min(gram_hashes(data, gram), length - gram + 1)
    none = np.zeros(0, np.int64)
    if not len(least):
        return none, none, none, np.zeros(0, np.uint64)
    number = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    inside = np.arange(len(least)) + length <= (starts + sizes)[number]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    v, d = least[at], number[at]
    first = np.append(True, (v[1:] != v[:-1]) | (d[1:] != d[:-1]))
    a = np.flatnonzero(first)
    b = np.append(a[1:], len(at)) - 1
    return d[a], at[a] - starts[d[a]], at[b] - starts[d[a]], mix64(v[a])


def merge_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Union of the spans [a, b) as maximal runs; touching spans are one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    if not len(a):
        return []
    new = np.append(True, a[1:] > b[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(a)) - 1
    return list(zip(a[s].tolist(), b[e].tolist()))


def _merge_by(owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of each owner's spans."""
    order = np.lexsort((a, owner))
    owner, a, b = owner[order].astype(np.int64), a[order], b[order]
    if not len(a):
        return owner, a, b
    far = int(b.max()) + 1
    end = np.maximum.accumulate(b + owner * far)
    new = np.append(True, (owner[1:] != owner[:-1]) | (a[1:] + owner[1:] * far > end[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(a)) - 1
    return owner[new], a[new], end[last] - owner[new] * far


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first places) of equal keys, which are given the most important one first."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


class Cell:
    """The different texts of a cell, in an order of their own, with the least id of each. `full` anchors are a shard's number, then 32 bits: anchors
    that collide are treated as one, as windows are compared by bytes."""

    def __init__(self, rows: list[tuple[int, bytes]], shards: int, length: int, gram: int):
        held: dict[bytes, int] = {}
        for i, t in rows:
            if len(t) >= length and held.get(t, NO_ID + 1) > i:
                held[t] = i
        self.texts = sorted(held)
        self.least = np.array([held[t] for t in self.texts], np.int64)
        self.shards, self.length, self.gram = np.uint64(shards), length, gram

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard of each text, two halves of its hash)."""
        wide = b"".join(map(xxhash.xxh3_128_digest, self.texts))
        a, b = np.frombuffer(wide, np.uint64).reshape(-1, 2).T
        return (a % self.shards).astype(np.int64), a, b

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, last window, full anchor) of the runs of the texts."""
        out, part, size = [], [], 0
        for k in [*which.tolist(), -1]:
            if k >= 0:
                part.append(k)
                size += len(self.texts[k])
            if part and (k < 0 or size >= PART):
                d, a, b, v = anchor_runs([self.texts[j] for j in part], self.length, self.gram)
                out.append((np.array(part)[d], a.astype(np.uint32), b.astype(np.uint32), v % self.shards << np.uint64(32) | (v // self.shards & np.uint64(0xFFFFFFFF))))
                part, size = [], 0
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
        return tuple(map(np.concatenate, zip(*out)))

    def entries(self, d: np.ndarray, a: np.ndarray, b: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of runs: each one's entry; the entries' full anchors, context hashes, least ids, and a run of each."""
        texts, length = self.texts, self.length
        h = np.fromiter((xxhash.xxh64_intdigest(texts[k][x : y + length]) for k, x, y in zip(d.tolist(), a.tolist(), b.tolist())), np.uint64, len(d))
        order, first = _groups(full, h)
        entry = np.empty(len(d), np.int64)
        entry[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(d))))
        ids = np.minimum.reduceat(self.least[d[order]], first) if len(first) else np.zeros(0, np.int64)
        return entry, full[order[first]], h[order[first]], ids, order[first]


def _by_shard(full: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """full is in order."""
    cuts = np.searchsorted(full, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
    return ((k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if a < b)


def _code(full: np.ndarray) -> np.ndarray:
    return (full & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bits(x: np.ndarray) -> tuple[np.ndarray, int]:
    return np.packbits(x), len(x)


def _unbits(x: tuple[np.ndarray, int]) -> np.ndarray:
    return np.unpackbits(x[0], count=x[1]).astype(bool)


def _join(parts: list[np.ndarray], kind=bool) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


# What cells send, and what shards answer. An answer goes back to the cell, in the order of what it sent.


def _send_anchors(cell: Cell, number: int) -> Iterator[tuple[int, bytes]]:
    shards = int(cell.shards)
    d, _, _, full = cell.runs(np.arange(len(cell.texts)))
    order, first = _groups(full)
    last = np.append(first[1:], len(order)) - 1
    twice = d[order[first]] != d[order[last]] if len(first) else np.zeros(0, bool)
    full = full[order[first]]
    to, x, y = cell.names()
    at = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[at], np.arange(shards + 1))
    mine = dict(_by_shard(full, shards))
    for s in range(shards):
        own, texts = mine.get(s, slice(0, 0)), at[cuts[s] : cuts[s + 1]]
        if own.start < own.stop or len(texts):
            yield pack(s, {"cell": number, "anchors": planes(np.diff(_code(full[own]), prepend=np.uint32(0))), "twice": _bits(twice[own]), "text": (x[texts], y[texts]), "least": cell.least[texts]})


def _answer_anchors(shard: int, payloads: Iterator[dict]) -> Iterator[tuple[int, bytes]]:
    held = list(payloads)
    code = [np.cumsum(unplanes(p["anchors"], np.uint32), dtype=np.uint32) for p in held]
    twice = _join([_unbits(p["twice"]) for p in held])
    order, first = _groups(np.concatenate(code))
    size = np.diff(np.append(first, len(order)))
    shared = np.empty(len(order), bool)
    shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], first) if len(first) else size > 1, size)
    ids = np.concatenate([p["least"] for p in held])
    order, first = _groups(*(np.concatenate([p["text"][k] for p in held]) for k in (0, 1)))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], first) if len(first) else ids, np.diff(np.append(first, len(order))))
    a = b = 0
    for p, c in zip(held, code):
        yield pack(p["cell"], {"from": shard, "shared": _bits(shared[a : a + len(c)]), "open": _bits(least[b : b + len(p["least"])] == p["least"])})
        a, b = a + len(c), b + len(p["least"])


def _state_after_anchors(cell: Cell, answers: list[dict]) -> tuple[dict, tuple]:
    """Which texts are open, which of them have shared anchors, which of those texts' runs are shared; and these runs."""
    answers = sorted(answers, key=lambda p: p["from"])
    shared = _join([_unbits(p["shared"]) for p in answers])
    to, _, _ = cell.names()
    is_open = np.zeros(len(cell.texts), bool)
    is_open[np.argsort(to, kind="stable")] = _join([_unbits(p["open"]) for p in answers])
    d, a, b, full = cell.runs(np.arange(len(cell.texts)))
    order, first = _groups(full)
    mask = np.empty(len(d), bool)
    mask[order] = np.repeat(shared, np.diff(np.append(first, len(order))))
    mask &= is_open[d]
    which = np.unique(d[mask])
    some = np.zeros(len(cell.texts), bool)
    some[which] = True
    state = {"open": _bits(is_open), "some": _bits(some), "runs": _bits(mask[some[d]])}
    return state, (d[mask], a[mask], b[mask], full[mask])


def _runs_of(cell: Cell, state: dict) -> tuple:
    """The shared runs of the open texts again."""
    runs = cell.runs(np.flatnonzero(_unbits(state["some"])))
    mask = _unbits(state["runs"])
    return tuple(x[mask] for x in runs)


def _send_contexts(cell: Cell, number: int, answers: list[dict]) -> Iterator[tuple[int, bytes]]:
    shards = int(cell.shards)
    state, runs = _state_after_anchors(cell, answers)
    _, full, h, ids, _ = cell.entries(*runs)
    yield pack(number % shards, {"cell": number, "state": state})
    for s, own in _by_shard(full, shards):
        yield pack(s, {"cell": number, "anchors": planes(np.diff(_code(full[own]), prepend=np.uint32(0))), "hash": h[own], "ids": planes(ids[own])})


def _answer_contexts(shard: int, payloads: Iterator[dict]) -> Iterator[tuple[int, bytes]]:
    held = []
    for p in payloads:
        if "state" in p:
            yield pack(p["cell"], p)
        else:
            held.append(p)
    if not held:
        return
    code = [np.cumsum(unplanes(p["anchors"], np.uint32), dtype=np.uint32) for p in held]
    sizes = [len(c) for c in code]
    code, h, ids = np.concatenate(code), np.concatenate([p["hash"] for p in held]), np.concatenate([unplanes(p["ids"], np.int64) for p in held])
    order, first = _groups(code, h)
    closed, several = np.empty(len(code), bool), np.empty(len(code), bool)
    closed[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(order))))
    anchor = code[order[first]]
    new = np.append(True, anchor[1:] != anchor[:-1])
    contexts = np.diff(np.append(np.flatnonzero(new), len(anchor)))[np.cumsum(new) - 1]
    several[order] = np.repeat(contexts > 1, np.diff(np.append(first, len(order))))
    at = 0
    for p, n in zip(held, sizes):
        yield pack(p["cell"], {"from": shard, "closed": _bits(closed[at : at + n]), "wanted": _bits((several & ~closed)[at : at + n])})
        at += n


def _state_after_contexts(answers: list[dict]) -> dict:
    state = next(p["state"] for p in answers if "state" in p)
    answers = sorted((p for p in answers if "from" in p), key=lambda p: p["from"])
    return state | {k: _bits(_join([_unbits(p[k]) for p in answers])) for k in ("closed", "wanted")}


def _send_bytes(cell: Cell, number: int, answers: list[dict]) -> Iterator[tuple[int, bytes]]:
    shards = int(cell.shards)
    state = _state_after_contexts(answers)
    yield pack(number % shards, {"cell": number, "state": state})
    d, a, b, full = _runs_of(cell, state)
    _, full, h, ids, run = cell.entries(d, a, b, full)
    wanted = np.flatnonzero(_unbits(state["wanted"]))
    full, h, ids, run = full[wanted], h[wanted], ids[wanted], run[wanted]
    for s, own in _by_shard(full, shards):
        cut = [cell.texts[k][x : y + cell.length] for k, x, y in zip(d[run[own]].tolist(), a[run[own]].tolist(), b[run[own]].tolist())]
        yield pack(s, {"cell": number, "anchors": _code(full[own]), "hash": h[own], "ids": planes(ids[own]), "size": np.array([len(x) for x in cut], np.uint32), "bytes": b"".join(cut)}, 3)


def repeated_windows(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, length: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end), merged, of the windows that a context of a smaller id has as well. t: contexts as bytes plus one, each with a 0 at its end."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rest = np.zeros(0, np.int64)  # the windows of the class that may go on in the next piece

    def settle(windows: np.ndarray, new: np.ndarray) -> None:
        if len(windows):
            of = np.searchsorted(starts, windows, side="right") - 1
            own, first = ids[of], np.flatnonzero(new)
            gone = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own)))) < own
            found.append((of[gone], windows[gone] - starts[of[gone]], windows[gone] - starts[of[gone]] + length))

    for p, common in suffixes_down(t, length, scratch):
        # A suffix that is no window shares fewer than `length` bytes with any that is.
        window = p + length <= ends[np.searchsorted(starts, p, side="right") - 1]
        p, new = p[window], common[window] < length
        if not len(p):
            continue
        if new[0]:
            settle(rest, np.arange(len(rest)) == 0)
            rest = rest[:0]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last or new[0]:
            done, flags = np.append(rest, p[:last]), np.append(np.zeros(len(rest), bool), new[:last])
            flags[:1] = True
            settle(done, flags)
            rest = p[last:]
        else:
            rest = np.append(rest, p)
    settle(rest, np.arange(len(rest)) == 0)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return _merge_by(*map(np.concatenate, zip(*found)))


def _answer_bytes(rows: int, length: int):
    def answer(shard: int, payloads: Iterator[dict]) -> Iterator[tuple[int, bytes]]:
        with Scratch(rows) as scratch:
            senders, entry, sizes, ids = [], [], [], []
            known: dict[tuple[int, int], int] = {}
            parts, size, n = [], 0, 0

            def spill() -> None:
                nonlocal parts, size
                if size:
                    t = scratch.array(size, np.uint16)
                    t[:] = np.frombuffer(b"".join(parts), np.uint8)
                    t += np.uint16(1)
                    texts.append(t)
                    parts, size = [], 0

            texts: list[np.ndarray] = []
            for p in payloads:
                if "state" in p:
                    yield pack(p["cell"], p)
                    continue
                at = np.cumsum(p["size"].astype(np.int64))
                own = []
                for k, (key, i, a, b) in enumerate(zip(zip(p["anchors"].tolist(), p["hash"].tolist()), unplanes(p["ids"], np.int64).tolist(), (at - p["size"]).tolist(), at.tolist())):
                    j = known.setdefault(key, n)
                    own.append(j)
                    if j == n:
                        n += 1
                        parts.append(p["bytes"][a:b] + b"\0")
                        sizes.append(b - a)
                        ids.append(i)
                        size += b - a + 1
                entry.append(np.array(own))
                senders.append(p["cell"])
                if size > scratch.rows:
                    spill()
            if not n:
                return
            spill()
            t = scratch.array(sum(map(len, texts)), np.uint16) if len(texts) > 1 else texts[0]
            if len(texts) > 1:
                np.concatenate(texts, out=t)
            del known
            sizes, ids = np.array(sizes), np.array(ids)
            ends = np.cumsum(sizes + 1) - 1
            starts = ends - sizes
            t[ends] = 0
            of, a, b = repeated_windows(t, starts, ends, ids, length, scratch)
            for cell, own in zip(senders, entry):
                lo, hi = np.searchsorted(of, own), np.searchsorted(of, own, side="right")
                m = hi - lo
                pick = np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield pack(cell, {"from": shard, "n": len(own), "at": np.repeat(np.arange(len(own)), m), "a": a[pick], "b": b[pick]})

    return answer


def _spans(cell: Cell, answers: list[dict]) -> dict[int, list[tuple[int, int]]]:
    """Of each text, what its least id loses."""
    state = next(p["state"] for p in answers if "state" in p)
    d, a, b, full = _runs_of(cell, state)
    entry, _, _, ids, _ = cell.entries(d, a, b, full)
    closed, wanted = _unbits(state["closed"]), np.flatnonzero(_unbits(state["wanted"]))
    whole = np.flatnonzero(closed[entry] | (cell.least[d] > ids[entry])) if len(d) else np.zeros(0, np.int64)
    of, x, y = [d[whole]], [a[whole].astype(np.int64)], [b[whole].astype(np.int64) + cell.length]
    base = 0
    by_entry = np.argsort(entry, kind="stable")
    for p in sorted((p for p in answers if "from" in p), key=lambda p: p["from"]):
        e = wanted[base + p["at"]]
        base += p["n"]
        lo, hi = np.searchsorted(entry[by_entry], e), np.searchsorted(entry[by_entry], e, side="right")
        m = hi - lo
        run = by_entry[np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        of.append(d[run])
        x.append(a[run] + np.repeat(p["a"], m))
        y.append(a[run] + np.repeat(p["b"], m))
    of, x, y = _merge_by(np.concatenate(of), np.concatenate(x), np.concatenate(y))
    out: dict[int, list[tuple[int, int]]] = {k: [(0, len(cell.texts[k]))] for k in np.flatnonzero(~_unbits(state["open"])).tolist()}
    for k, i, j in zip(of.tolist(), x.tolist(), y.tolist()):
        out.setdefault(k, []).append((i, j))
    return out


def shard_count(total: int, partitions: int, shard_bytes: int = SHARD) -> int:
    """Shards of `total` bytes of text: a shard's sort spills many times its bytes, so it mustn't grow with the table."""
    return max(partitions, -(-total // shard_bytes))


def remove_duplicate_spans(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, cell_bytes: int = CELL, rows: int = ROWS, shard_bytes: int = SHARD
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, starts, ends, kept_sha256, kept): kept is the text that is left, as bytes. rows: tuples a queue holds in memory."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    shards = shard_count(total, bucket_count(docs), shard_bytes)
    cells = max(shards, -(-total // cell_bytes))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    texts = texts.select(F.pmod(F.xxhash64("id", "text"), F.lit(cells)).cast("int").alias("bucket"), "id", "text").groupBy("bucket")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]
        + [T.StructField("starts", longs), T.StructField("ends", longs), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    )

    def rows_of(table: pa.Table) -> tuple[int, list[tuple[int, bytes]]]:
        ids, values = table.column("id").to_pylist(), table.column("text").to_pylist()
        return table.column("bucket")[0].as_py(), [(NO_ID if i is None else i, t or b"") for i, t in zip(ids, values)]

    def first(table: pa.Table) -> pa.Table:
        number, here = rows_of(table)
        return emit(list(_send_anchors(Cell(here, shards, length, gram), number)))

    def answered(send):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return emit([])
            number, here = rows_of(table)
            return emit(list(send(Cell(here, shards, length, gram), number, [unpack(x.as_py()) for x in answers.column("payload")])))

        return run

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, here = rows_of(table) if table.num_rows else (0, [])
        cell = Cell(here, shards, length, gram)
        place = {t: k for k, t in enumerate(cell.texts)}
        spans = _spans(cell, [unpack(x.as_py()) for x in answers.column("payload")]) if here else {}
        made = []
        for (i, t), own in zip(here, table.column("id").to_pylist()):
            k = place.get(t)
            gone = [] if k is None else [(0, len(t))] if i > cell.least[k] else spans.get(k, [])
            kept, end = [], 0
            for x, y in gone:
                kept.append(t[end:x])
                end = y
            kept = b"".join([*kept, t[end:]])
            made.append((own, len(t), len(t) - len(kept), len(gone), [x for x, _ in gone], [y for _, y in gone], hashlib.sha256(kept).hexdigest(), kept))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * len(arrow), arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    met = reduce_streamed(texts.applyInArrow(first, PACKED), _answer_anchors)
    met = reduce_streamed(texts.cogroup(met.groupBy("bucket")).applyInArrow(answered(_send_contexts), PACKED), _answer_contexts)
    met = reduce_streamed(texts.cogroup(met.groupBy("bucket")).applyInArrow(answered(_send_bytes), PACKED), _answer_bytes(rows, length))
    return texts.cogroup(met.groupBy("bucket")).applyInArrow(cut, schema)
