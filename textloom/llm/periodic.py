"""Periodic runs of words by a descending-LCP Kruskal: suffix classes are united by decreasing common prefix.

A run is a stretch with smallest period q, of at least max(MIN_LENGTH, 2 q) words, that no neighbouring word extends. If it begins at i, the suffixes at
i and i + q agree for L = length - q words, which is q or more and, as the length is MIN_LENGTH or more, at least MIN_LENGTH / 2. So only positions are sorted whose first
MIN_LENGTH / 2 words occur twice in their text. Neighbours in the suffix array are edges weighted by their common prefix; edges are taken by decreasing weight, and
each unites two classes, ordered sets of positions, the smaller into the larger. When positions i < j become neighbours in a class at level L with j - i <= L,
T[i, j + L) has period j - i, and none smaller, as a position between them would be in the class; it is a run if the word before i doesn't extend it.

Texts of a batch are sorted together: ranks of 1, 2, 3, 6, 12, ... words are numbered by sorting pairs of ranks, until no two positions of a text agree.

Defined results: null and empty texts have no words and no runs; repeated rows are judged each by itself; ties between runs go to the smaller start, then the smaller period;
an empty table gives no rows; carried columns may have any name but `runs`, `n_words` and `collapsed`, others are ignored. Very long texts are taken whole; a text's arrays are in memory together.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts

MIN_LENGTH = 12
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys numbered in their order, and how many there are."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    new = np.append(False, in_order[1:] != in_order[:-1])[: len(keys)]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1 if len(keys) else 0


class Ranks:
    """Ranks of equally long stretches, level by level, of positions that agree with another of their text for `seed` words.

    symbols: words by number, each text ended by a symbol of its own, so that no stretch reaches over an end.
    """

    def __init__(self, symbols: np.ndarray, text_of: np.ndarray, seed: int):
        self.n = len(symbols)
        half = seed // 2
        one, _ = _dense(symbols)
        self.levels, grown = [(1, one)], one
        for k in range(1, half):
            grown, _ = _dense(self._pair(grown, one, k))
        if half > 1:
            self.levels.append((half, grown))
        self.ones = seed - 1 if half == 1 else max(half - 1, seed - 1 - half)
        grown, _ = _dense(self._pair(grown, grown, half))
        if seed % 2:
            grown, _ = _dense(self._pair(grown, one, seed - 1))
        self.levels.append((seed, grown))
        # Ranks of positions that nothing agrees with stay as they are: they are different from all others already.
        length = seed
        order = np.argsort(grown, kind="stable")
        rank = np.empty(self.n, np.int64)
        first = np.append(True, grown[order][1:] != grown[order][:-1])[: self.n]
        starts = np.maximum.accumulate(np.where(first, np.arange(self.n), 0))
        rank[order] = starts
        self.open = self._tied(np.arange(self.n), rank, text_of)
        self.kept = self.open
        while len(self.open):
            at = self.open
            second = np.where(at + length < self.n, rank[np.minimum(at + length, self.n - 1)], -1)
            order = np.lexsort((second, rank[at]))
            at, r, s = at[order], rank[at][order], second[order]
            group = np.append(True, r[1:] != r[:-1])
            new = group | np.append(True, s[1:] != s[:-1])
            place = np.arange(len(at))
            inside = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
            rank = rank.copy()
            rank[at] = r + inside
            length *= 2
            self.levels.append((length, rank))
            self.open = self._tied(at, rank, text_of)
        self.rank = rank

    def _pair(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Ranks a followed, k words on, by ranks b; 0 is past the end."""
        after = np.zeros(self.n, np.int64)
        after[: max(0, self.n - k)] = b[k:] + 1
        return a * (self.n + 2) + after

    def _tied(self, at: np.ndarray, rank: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Of positions, those whose rank another of the same text has."""
        order = np.lexsort((text_of[at], rank[at]))
        at = at[order]
        same = (rank[at][1:] == rank[at][:-1]) & (text_of[at][1:] == text_of[at][:-1])
        tied = np.append(same, False)[: len(at)]
        tied[1:] |= same
        return np.sort(at[tied])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b share."""
        out = np.zeros(len(a), np.int64)
        for length, rank in reversed(self.levels):
            for _ in range(self.ones if length == 1 else 1):
                p, q = np.minimum(a + out, self.n - 1), np.minimum(b + out, self.n - 1)
                out += np.where((rank[p] == rank[q]) & (p != q), length, 0)
        return out


def seeds(positions: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Of a text's suffixes in order and their neighbours' common prefixes: (i, period, L) for every i and i + period <= i + L that become neighbours at L."""
    parent = list(range(len(positions)))
    classes: list[list[int]] = [[p] for p in positions.tolist()]
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.argsort(-lcp, kind="stable")
    for k, level in zip(order.tolist(), lcp[order].tolist()):
        if not level:
            break
        a, b = root(k), root(k + 1)
        large, small = classes[a], classes[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b], classes[b] = a, []
        if small[0] > large[-1]:
            met = [(large[-1], small[0])]
            large += small
        else:
            met = []
            for x in small:
                large.insert(bisect_left(large, x), x)
            # New neighbours are one of either class.
            for before, x, after in zip([None, *small], small, [*small[1:], None]):
                at = bisect_left(large, x)
                if at and large[at - 1] != before:
                    met.append((large[at - 1], x))
                if at + 1 < len(large) and large[at + 1] != after:
                    met.append((x, large[at + 1]))
        out += [(i, j - i, level) for i, j in met if j - i <= level]
    return out


def batch_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Each text's runs (start, length, period), by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    total = int(sizes.sum()) + len(texts)
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(total, np.int64)
    ends = begins + sizes
    body = np.ones(total, bool)
    body[ends] = False
    symbols[body] = flat
    symbols[ends] = len(number) + np.arange(len(texts))
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not total:
        return out
    ranks = Ranks(symbols, text_of, max(2, min_length // 2))
    at = ranks.kept
    if not len(at):
        return out
    at = at[np.lexsort((ranks.rank[at], text_of[at]))]
    lcp = ranks.common(at[:-1], at[1:])
    cuts = np.flatnonzero(text_of[at][1:] != text_of[at][:-1]) + 1
    for part in np.split(np.arange(len(at)), cuts):
        k, a = int(text_of[at[part[0]]]), int(begins[text_of[at[part[0]]]])
        found = {}
        for i, q, level in seeds(at[part], lcp[part[:-1]]):
            if q + level >= min_length and (i == a or symbols[i - 1] != symbols[i - 1 + q]):
                run = (i - a, q + level)
                found[run] = min(q, found.get(run, q))
        out[k] = sorted((s, n, q) for (s, n), q in found.items())
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without the words that a run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    inside = np.cumsum(edge)
    return b" ".join(w for w, k in zip(words, inside.tolist()) if not k)


def periodic_runs(docs: DataFrame, carry: list[str], text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """carry's columns, n_words, `runs` (start, length, period) by start then period, and `collapsed`, the text with each run's repetitions left out."""

    def find(texts: list[bytes]) -> dict:
        words = [t.split() for t in texts]
        runs = batch_runs(words, min_length)
        return {
            "n_words": [len(w) for w in words],
            "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
            "collapsed": pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
        }

    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return map_texts(docs, carry, text, find, schema)


def longest(runs):
    """Column: the run of greatest length, ties to the smallest start, then period; null without runs."""
    key = lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))
    return F.array_min(F.transform(runs, key))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """In a tenth of the documents, by their ids' CRC-32, the words from some place on repeat a period: a test bed with known runs.

    h = crc32(id), g = h // 10. Where h % 10 = 0, word i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id changes nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    staged = docs.withColumn("__words", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__words")).withColumn("__a", F.when(F.col("__n") > 0, g % F.col("__n")).cast("int"))
    p = (F.lit(1) + F.floor((F.col("__n") - F.col("__a")) / (F.lit(3) + g % 8))).cast("int")
    rest = F.col("__n") - F.col("__a")
    block = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("__p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    staged = staged.withColumn("__p", p)
    return staged.withColumn(text, F.when(F.col("__n") > 0, made).otherwise(F.col(text))).drop("__words", "__n", "__a", "__p")
