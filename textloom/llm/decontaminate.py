"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training tokens stream through the automaton, which knows at each of them the longest match with any item that
ends there. A match of at least `window` tokens is an occurrence of an item's window; an item shorter than a window
counts where it occurs whole. Spans beyond that length are removed, and documents of which more than
`max_coverage` is hit can be dropped.

Test items are taken in blocks of `block_tokens`, each with an automaton of its own, and PASS_BLOCKS of them are held against all documents in one pass, so an executor's memory has a bound
however many items there are; the driver holds one block at a time beside the broadcast files.

Defined results: null or empty texts have no words; very long texts are streamed whole; repeated rows are scanned each; ties don't matter, as all items count; items without words never match; equal items are each named;
a null item_id matches as the empty string; with an empty benchmark nothing is hit; extra columns are carried only where asked for,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts, materialize

WINDOW = 10
#: Tokens of one automaton, some hundred bytes each on an executor.
BLOCK_TOKENS = 200_000
#: Automata that a worker holds at once.
PASS_BLOCKS = 4
#: Words are runs of ASCII letters and digits and of everything beyond ASCII, with A-Z lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several token sequences; states know which items their strings of `window` tokens, or whole short items, occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.full: dict[int, set[str]] = {}  # state -> items with the state's string of `window` tokens
        self.short: dict[int, list[tuple[int, str]]] = {}  # state -> whole items shorter than that: (length, item)
        for name, codes in coded:
            state = 0
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.full.setdefault(self._holder(state, window), set()).add(name)
            if len(codes) < window:
                self.short.setdefault(self._holder(state, len(codes)), []).append((len(codes), name))
        self.least = min([window, *(n for x in self.short.values() for n, _ in x)])

    def _holder(self, state: int, n: int) -> int:
        """The state on the suffix path whose strings include the one of n tokens."""
        while self.length[self.link[state]] >= n and self.link[state] > 0:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:  # another item has been here
            return q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        new = self._new(self.length[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans inside occurrences, and the items that occur."""
        get, least = self.vocabulary.get, self.least
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        # A match holds no word that no item has: only runs of known words of the least length matter.
        gaps = np.concatenate(([-1], np.flatnonzero(codes < 0), [len(codes)]))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for k in np.flatnonzero(np.diff(gaps) > least):
            self._stream(codes[gaps[k] + 1 : gaps[k + 1]].tolist(), int(gaps[k]) + 1, spans, items)
        return merged(spans), items

    def _stream(self, codes: list[int], base: int, spans: list, items: set) -> None:
        nxt, link, length, window, full, short = self.next, self.link, self.length, self.window, self.full, self.short
        state = matched = 0
        for i, c in enumerate(codes, base + 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(c)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            if matched >= window:
                spans.append((i - matched, i))
                items |= full.get(self._holder(state, window), set())
            if short:
                u = state
                while u > 0:
                    for n, name in short.get(u, ()):
                        if n <= matched:
                            spans.append((i - n, i))
                            items.add(name)
                    u = link[u]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items; the items come to the driver a partition at a time."""
    block, size = [], 0
    for name, value in items.select(F.col(id_col).cast("string"), F.col(text)).toLocalIterator():
        words = tokens((value or "").encode())
        if words:
            block.append((name or "", words))
            size += len(words)
        if size >= block_tokens:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
    yield SuffixAutomaton(block, window)


def passes(items: DataFrame, text: str, window: int, block_tokens: int) -> list[list]:
    """Broadcast automata, PASS_BLOCKS together: a worker holds those of one pass, and drops them when it turns to the next."""
    held = [items.sparkSession.sparkContext.broadcast(a) for a in automata(items, text=text, window=window, block_tokens=block_tokens)]
    return [held[k : k + PASS_BLOCKS] for k in range(0, len(held), PASS_BLOCKS)]


_LONGS = T.ArrayType(T.LongType())
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", _LONGS), T.StructField("ends", _LONGS), T.StructField("items", T.ArrayType(T.StringType()))])


def _scan(held: list):
    def scan(texts: list[bytes]) -> dict:
        out: dict[str, list] = {"n_words": [], "starts": [], "ends": [], "items": []}
        for t in texts:
            words = tokens(t)
            spans, names = [], set()
            for a in held:
                s, x = a.value.hits(words)
                spans += s
                names |= x
            spans = merged(spans)
            out["n_words"].append(len(words))
            out["starts"].append([a for a, _ in spans])
            out["ends"].append([b for _, b in spans])
            out["items"].append(sorted(names))
        return out

    return scan


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    window: int = WINDOW,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """`row` (a struct of carry's columns), n_words, `starts` and `ends` of the hit word spans, and `items`, the matching item ids in string order.

    Spans of one pass are merged; those of several passes may overlap (`merged_spans`).
    """
    docs = docs.select(F.struct(*(carry or ["doc_id"])).alias("row"), F.col(text).alias("text"))
    first, *more = passes(items, text, window, block_tokens)
    found = map_texts(docs, ["row"], "text", _scan(first), _FOUND)
    if not more:
        return found
    # Each further pass reads the documents once and gives the few that it hits; rows that are alike are hit alike.
    key = F.xxhash64("row", "text").alias("key")
    keyed = docs.select(F.struct("row", key).alias("row"), "text")
    hits = [map_texts(keyed, ["row"], "text", _scan(held), _FOUND).where(F.size("starts") > 0) for held in more]
    hit = reduce(DataFrame.union, hits).select("row.key", "starts", "ends", "items").distinct()
    hit = hit.groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("starts", "ends", "items")])
    found = map_texts(keyed, ["row"], "text", _scan(first), _FOUND)
    both = found.join(hit, found["row.key"] == hit["key"], "left")
    joined = lambda c: F.concat(c, F.coalesce(f"more_{c}", F.array().cast(_FOUND[c].dataType))).alias(c)
    return both.select("row.row", "n_words", joined("starts"), joined("ends"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>"))))).alias("items"))


def merged_spans(starts: str = "starts", ends: str = "ends"):
    """The spans as array<struct<a, b>>, overlapping and touching ones as one."""
    spans = F.array_sort(F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b")))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (last["b"] >= x["a"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), step)


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words that merged spans name."""
    at = [m.span() for m in _WORD.finditer(text)]
    parts, end = [], 0
    for a, b in spans:
        parts.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*parts, text[end:]])


def strip_spans(text: bytes, automaton_list: list[SuffixAutomaton]) -> tuple[bytes, int, int]:
    """text without the words that are hit, until none is; how many words it had and how many went."""
    n = gone = 0
    first = True
    while True:
        words = tokens(text)
        if first:
            n, first = len(words), False
        spans = merged([s for a in automaton_list for s in a.hits(words)[0]])
        if not spans:
            return text, n, gone
        gone += sum(b - a for a, b in spans)
        text = without(text, spans)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs with the hit spans cut out of their texts, until nothing is hit any more, without the documents of which that takes more than max_coverage.

    All items count together, however many passes they take: the spans of all passes are found before any is cut, and coverage is judged once.
    A document that isn't hit keeps its text, null included. Other columns are carried along, whatever their names.
    """
    first, *more = passes(items, text, window, block_tokens)
    if not more:
        return _cut(docs, first, text, max_coverage)
    return _cut_in_rounds(docs, [first, *more], text, max_coverage)


def _cut_in_rounds(docs: DataFrame, all_passes: list[list], text: str, max_coverage: float) -> DataFrame:
    """What _cut does, where the automata need several passes: each round finds the spans of all passes, cuts them, and goes on with the documents that it cut."""
    row = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("gone"), F.lit(None).cast("long").alias("n"))
    now = materialize(row, "decontaminated")
    done = []
    spans = T.ArrayType(T.LongType())
    after = T.StructType([*[f for f in now.schema if f.name in ("rid", "row")], T.StructField("text", T.StringType()), T.StructField("gone", T.LongType()), T.StructField("n", T.LongType())])

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(after)
        for x in batches:
            rid, row_, texts, gone, n, starts, ends = x.columns
            new, went, had = [], [], []
            for t, g, k, a, b in zip(texts.cast(pa.binary()).to_pylist(), gone.to_pylist(), n.to_pylist(), starts.to_pylist(), ends.to_pylist()):
                own = merged(list(zip(a, b)))
                new.append(without(t, own).decode())
                went.append(g + sum(y - z for z, y in own))
                had.append(len(tokens(t)) if k is None else k)
            yield pa.RecordBatch.from_arrays([rid.cast(schema.field(0).type), row_.cast(schema.field(1).type), pa.array(new, pa.string()), pa.array(went, pa.int64()), pa.array(had, pa.int64())], schema=schema)

    while True:
        found = [map_texts(now, ["rid"], "text", _scan(held), _FOUND).where(F.size("starts") > 0) for held in all_passes]
        hits = reduce(DataFrame.union, found).groupBy("rid").agg(*[F.flatten(F.collect_list(c)).cast(spans).alias(c) for c in ("starts", "ends")])
        hits = materialize(hits, "decontaminated-hits")
        done.append(now.join(hits, "rid", "left_anti").select("row", "text", "gone", "n"))
        now = materialize(now.join(hits, "rid").select("rid", "row", "text", "gone", "n", "starts", "ends").mapInArrow(cut, after), "decontaminated")
        if now.isEmpty():
            break
    kept = reduce(DataFrame.union, done).where((F.col("gone") == 0) | (F.col("gone") / F.col("n") <= max_coverage))
    row = F.col("row")
    return kept.select(*[F.when(F.col("gone") == 0, row[text]).otherwise(F.col("text")).alias(c) if c == text else row[c].alias(c) for c in docs.columns])


def _cut(docs: DataFrame, held: list, text: str, max_coverage: float) -> DataFrame:
    def cut(texts: list[bytes]) -> dict:
        clean, share = [], []
        for t in texts:
            new, n, gone = strip_spans(t, [a.value for a in held])
            clean.append(new.decode() if gone else None)
            share.append(gone / n if n else 0.0)
        return {"clean": clean, "share": share}

    schema = T.StructType([T.StructField("clean", T.StringType()), T.StructField("share", T.DoubleType())])
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    out = map_texts(packed, ["row"], "text", cut, schema).where(F.col("share") <= max_coverage)
    row = F.col("row")
    return out.select(*[F.coalesce("clean", row[text]).alias(c) if c == text else row[c].alias(c) for c in docs.columns])
