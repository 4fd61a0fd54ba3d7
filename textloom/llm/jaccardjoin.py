"""N-gram Jaccard self-join by a size-aware heavy-light split: documents link where their sets of k-word shingles are similar enough.

A set is named by 128 bits; equal sets are one node, so exact copies cost one row. Let s and t be the sizes of two sets; they link only
if they share need(s, t) = ceil(J (s + t) / (1 + J)) shingles, J being the similarity.

* **Light** sets, up to a boundary x: every subset of need(s, t) shingles, for each t that a partner may have, is a key. Two sets under a key
  share that many, so all under it whose sizes ask for no more link to its smallest set: a star says what all pairs would.
* **Heavy** sets, and the light ones that may link to them: inverted lists. In order of hash, two linked sets share k shingles among their first
  s - ceil(J s) + k, k = ceil(EXTRA s). Shingles of one set only are dropped, and with them sets with fewer than k left. Of the rest, rare ones first, all but
  the last k - 1 are filed. A list isn't expanded into pairs: its members are held against its most central one first (that whose shingles are the most frequent), those that link become
  components, and only members of different components are held against each other, in blocks of a list, by histograms of the shingles' hashes: they differ
  by no more than the sets do, and so rule out pairs without losing any. A pair that meets in several long lists counts in one.

The boundary is the size, from LIGHT_LEAST to LIGHT_MOST, for which the keys of all smaller sets and the entries in all larger sets' lists are the fewest, as counted over all documents.
Every link is verified on the shingle sets, made from the texts anew for what got this far. Nothing is capped; a long list takes more blocks.

Defined results: null and empty texts, and texts without words, have no shingles and are a component each; fewer words than a shingle are one
shingle; repeated rows share their component; a null id is kept and never names a component unless all ids there are null; an empty table gives no rows; extra columns are ignored.
Very long texts are taken whole, a text at a time.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts, materialize
from textloom.llm.components import connected_components
from textloom.llm.hashing import mix64

SHINGLE, PERCENT = 4, 85
#: The share of a set by which its hash prefix is longer than one common shingle asks for.
EXTRA = 0.05
#: Sets of up to LIGHT_LEAST shingles link only to sets that hold all of theirs, so a subset is nearly the set itself; those of up to LIGHT_MOST carry all their shingles.
LIGHT_LEAST, LIGHT_MOST = 12, 24
#: Cells of a set's histogram.
CELLS = 128
#: Members of a list that are held against each other in one task.
BLOCK = 512
#: Entries of a list beyond which its members carry the names of such lists, so that a pair is only found in one of them.
LONG = 64
#: Ids that are broadcast to pick the documents whose sets are made again (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20

_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class _Words(dict):
    """Word -> 64-bit hash, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, words: dict, k: int = SHINGLE) -> np.ndarray:
    """The different shingles' 64-bit hashes, in order."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    take = min(n, k)
    out = np.full(n - take + 1, take, np.uint64)
    for j in range(take):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - take + 1 + j])
    return np.unique(out)


def need(s: int, t: int, percent: int = PERCENT) -> int:
    """Shingles that sets of these sizes share at least if they link."""
    return -(-percent * (s + t) // (100 + percent))


def least_shared(s: int, percent: int = PERCENT) -> int:
    return -(-percent * s // 100)


def extra(s: int) -> int:
    return max(1, int(np.ceil(EXTRA * s)))


def subset_sizes(s: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a light set of size s is filed under."""
    low, high = least_shared(s, percent), 100 * s // percent
    return sorted({need(s, t, percent) for t in range(low, high + 1)})


def keys_of(s: int, percent: int = PERCENT) -> int:
    return sum(comb(s, o) for o in subset_sizes(s, percent))


def choose_boundary(sets: dict[int, int], scanned: dict[int, int], percent: int = PERCENT) -> int:
    """The boundary of least cost. sets, scanned: how many sets of a size there are, and the entries in their lists together."""
    best, cost, x = 0, 0, LIGHT_LEAST
    for s in range(LIGHT_LEAST + 1, LIGHT_MOST + 1):
        cost += sets.get(s, 0) * keys_of(s, percent) - scanned.get(s, 0)
        if cost < best:
            best, x = cost, s
    return x


def histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(s):
        return 0, 0
    return xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63), xxhash.xxh64_intdigest(s.tobytes(), 2) - (1 << 63)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def marked_documents(docs: DataFrame, id_col: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(id, n, na, nb, cells, front): set size, name, histogram, and the set's first shingles (all of a light one)."""
    words = _Words()

    def mark(texts: list[bytes]) -> dict:
        sets = [shingle_set(t, words, shingle) for t in texts]
        names = [_name(s) for s in sets]
        fronts = [s if len(s) <= LIGHT_MOST else s[: len(s) - least_shared(len(s), percent) + extra(len(s))] for s in sets]
        return {"n": [len(s) for s in sets], "na": [x for x, _ in names], "nb": [x for _, x in names], "cells": [histogram(s) for s in sets], "front": _lists(fronts)}

    long = T.LongType()
    schema = T.StructType([T.StructField("n", long), T.StructField("na", long), T.StructField("nb", long), T.StructField("cells", T.BinaryType()), T.StructField("front", T.ArrayType(long))])
    return map_texts(docs, [id_col], text, mark, schema)


def _pairs(df: DataFrame, fn) -> DataFrame:
    """fn(columns of a batch) -> (a, b) arrays."""

    def run(batches):
        for x in batches:
            a, b = fn(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return df.mapInArrow(run, _LINK)


def _cells(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)


def may_link(s: np.ndarray, t: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """False where sizes or histograms rule a link out."""
    return (100 * np.minimum(s, t) >= percent * np.maximum(s, t)) & ((100 + percent) * apart <= (100 - percent) * (s + t))


def light_links(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Candidate links (a, b) of the nodes of up to that size: stars over equal subsets."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "n", "o", "key")])

    def run(batches):
        for x in batches:
            rows = []
            for node, n, front in zip(*(c.to_pylist() for c in x.columns)):
                mixed = mix64(np.array(front, np.int64).view(np.uint64) + np.uint64(1)).tolist()
                for o in subset_sizes(n, percent):
                    whole = sum(mixed)
                    keys = ((whole - sum(out)) & ((1 << 64) - 1) for out in combinations(mixed, n - o))
                    rows += [(node, n, o, ((k ^ o * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) - (1 << 63)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=schema.fieldNames())

    index = nodes.where(F.col("n").between(1, boundary)).select("node", "n", "front").mapInArrow(run, schema)
    index = index.select("node", "n", "o", "key")
    least = index.groupBy("o", "key").agg(F.min(F.struct("n", "node")).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    s, t = F.col("least.n"), F.col("n")
    fits = (F.lit(percent) * (s + t) <= F.col("o") * (100 + percent)) & (F.col("node") != F.col("least.node"))
    return index.join(least, ["o", "key"]).where(fits).select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b")).distinct()


def filed(nodes: DataFrame, live: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Entries (token, node, n, edge, cells) of the inverted lists of the nodes that may have a partner over the boundary. edge: the lower, the more frequent a node's shingles are."""
    heavy = nodes.where(F.col("n") >= least_shared(boundary + 1, percent))
    # A light set carries all its shingles; its prefix is cut here.
    shared = F.ceil(F.col("n") * percent / 100)
    more = F.greatest(F.lit(1), F.ceil(F.col("n") * EXTRA))
    front = (F.col("n") - shared + more).cast("int")
    index = heavy.select("node", F.explode(F.slice("front", F.lit(1), front)).alias("token"))
    found = index.join(live, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    floor = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * percent / 100) * EXTRA)).cast("int")
    edge = F.floor(F.aggregate("found", F.lit(0).cast("long"), lambda t, f: t + f["df"]) * -1000 / front)
    kept = heavy.select("node", "n", "cells").join(found, "node").withColumn("floor", floor).where(F.size("found") >= F.col("floor"))
    rows = kept.select("node", "n", edge.alias("edge"), "cells", F.explode(F.slice("found", F.lit(1), F.size("found") - F.col("floor") + 1)).alias("f"))
    return rows.select(F.col("f.token").alias("token"), "node", "n", "edge", "cells")


def star_candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Each list's members against its most central one."""
    least = entries.groupBy("token").agg(F.min(F.struct("edge", "n", "node", "cells")).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    met = entries.join(least, "token").where(F.col("node") != F.col("least.node"))
    met = met.select(F.col("node").alias("x"), "n", "cells", F.col("least.node").alias("y"), F.col("least.n").alias("m"), F.col("least.cells").alias("others"))

    def near(x):
        a, n, c, b, m, d = x.columns
        apart = np.abs(_cells(c) - _cells(d)).sum(axis=1, dtype=np.int64)
        keep = may_link(n.to_numpy(), m.to_numpy(), apart, percent)
        a, b = a.to_numpy()[keep], b.to_numpy()[keep]
        return np.minimum(a, b), np.maximum(a, b)

    return _pairs(met, near).distinct()


def cross_candidates(entries: DataFrame, components: DataFrame, percent: int, block: int) -> DataFrame:
    """Members of one list that are in different components so far and that nothing rules out."""
    now = entries.join(components, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed = now.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    mixed = materialize(mixed.select("token", "rows", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "join-mixed")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    now = now.join(mixed, "token")
    long = now.where(F.col("rows") > LONG)
    lists = long.groupBy("node").agg(F.collect_list("token").alias("tokens"))
    long = long.join(lists, "node").select(*now.columns, "tokens")
    now = now.where(F.col("rows") <= LONG).withColumn("tokens", F.array().cast("array<bigint>")).union(long)
    rows = now.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A token's blocks i and j meet under one key; sorted so that a group's rows follow one another.
    rows = rows.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "comp", "cells", "tokens")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").sortWithinPartitions("token", "i", "j", "node")

    def compare(group: list[tuple]):
        token = group[0][0]
        _, i, j, own, node, n, comp, cells, tokens = (np.array(c) if k < 7 else c for k, c in enumerate(zip(*group)))
        have = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, CELLS).astype(np.int16)
        a, b = [], []
        for k in range(len(group) - 1):
            rest = slice(k + 1, None)
            able = (comp[rest] != comp[k]) & ((own[rest] != own[k]) | (i[k] == j[k])) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
            at = np.flatnonzero(able) + k + 1
            if len(at):
                at = at[may_link(n[at], n[k], np.abs(have[at] - have[k]).sum(axis=1, dtype=np.int64), percent)]
                at = at.tolist()
                if len(tokens[k]):  # of the long lists that two nodes share, that of the lowest token counts
                    at = [x for x in at if np.intersect1d(tokens[k], tokens[x], assume_unique=True)[0] == token]
                a += [node[k]] * len(at)
                b += node[at].tolist()
        return a, b

    def run(batches):
        group, out_a, out_b = [], [], []
        for x in batches:
            flat, ends = x.columns[-1].values.to_numpy(), x.columns[-1].offsets.to_numpy()
            tokens = [flat[a:b] for a, b in zip(ends, ends[1:])]
            for row in zip(*(c.to_pylist() for c in x.columns[1:-1]), tokens):
                if group and group[0][:3] != row[:3]:
                    a, b = compare(group)
                    out_a += a
                    out_b += b
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            out_a, out_b = [], []
        if group:
            a, b = compare(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, _LINK).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    of = lambda n: sets.select(F.col("node").alias(n), F.col("tokens").alias(f"of_{n}"))

    def check(x):
        keep, a, b = [], x.column(0).to_numpy(), x.column(1).to_numpy()
        flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (x.column(2), x.column(3))]
        for r in range(x.num_rows):
            s, t = (v[o[r] : o[r + 1]] for v, o in flat)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= percent * (len(s) + len(t) - both))
        keep = np.array(keep, bool)
        return a[keep], b[keep]

    return _pairs(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b"), check)


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(node, tokens): whole sets of the given nodes, made from the texts of the documents that stand for them."""
    words = _Words()
    reps = materialize(nodes.select("rep").distinct(), "join-reps")
    ids = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps.hint("merge")
    some = docs.join(ids, docs[id_col].eqNullSafe(ids["rep"]), "left_semi")

    def make(texts: list[bytes]) -> dict:
        sets = [shingle_set(t, words, shingle) for t in texts]
        names = [_name(s) for s in sets]
        return {"na": [x for x, _ in names], "nb": [x for _, x in names], "tokens": _lists(sets)}

    long = T.LongType()
    made = map_texts(some, [], text, make, T.StructType([T.StructField("na", long), T.StructField("nb", long), T.StructField("tokens", T.ArrayType(long))]))
    return made.join(nodes.select("na", "nb", "node"), ["na", "nb"]).groupBy("node").agg(F.any_value("tokens").alias("tokens"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, boundary: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reached through links. boundary: the largest light size; None chooses it by cost."""
    marked = materialize(marked_documents(docs, id_col, text, shingle, percent), "join-marked")
    nodes = marked.where("n > 0").groupBy("na", "nb").agg(F.any_value("n").alias("n"), F.any_value("cells").alias("cells"), F.any_value("front").alias("front"), F.min(id_col).alias("rep"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    live = materialize(nodes.select(F.explode("front").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join-live")
    entries = materialize(filed(nodes, live, LIGHT_LEAST if boundary is None else boundary, percent), "join-entries")
    if boundary is None:
        some = nodes.where(F.col("n").between(LIGHT_LEAST + 1, LIGHT_MOST)).groupBy("n").agg(F.count(F.lit(1)).alias("v"))
        lengths = entries.groupBy("token").agg(F.count(F.lit(1)).alias("length"), *[F.count_if(F.col("n") == s).alias(f"of_{s}") for s in range(LIGHT_LEAST + 1, LIGHT_MOST + 1)])
        scanned = lengths.agg(*[F.coalesce(F.sum(F.col("length") * F.col(f"of_{s}")), F.lit(0)).alias(str(s)) for s in range(LIGHT_LEAST + 1, LIGHT_MOST + 1)]).first().asDict()
        boundary = choose_boundary({r["n"]: r["v"] for r in some.collect()}, {int(k): v for k, v in scanned.items()}, percent)
        entries = entries.where(F.col("n") >= least_shared(boundary + 1, percent))
    light = materialize(light_links(nodes, boundary, percent), "join-light")
    stars = materialize(star_candidates(entries, percent), "join-stars")

    wanted = entries.select("node").union(light.select("a")).union(light.select("b")).distinct()
    sets = materialize(sets_of(docs, nodes.join(wanted, "node").select("node", "na", "nb", "rep"), id_col, text, shingle), "join-sets")
    first = materialize(verified(stars.union(light).distinct(), sets, percent), "join-first")
    groups = connected_components(first, "join-cc1")
    rest = materialize(cross_candidates(entries, groups, percent, block), "join-cross")
    second = verified(rest, sets, percent)
    groups = connected_components(materialize(first.union(second), "join-links"), "join-cc2")

    named = nodes.join(groups, "node", "left").select("na", "nb", "rep", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "c").select("na", "nb", "component_id")
    out = marked.select(id_col, "n", "na", "nb").join(named, ["na", "nb"], "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))
