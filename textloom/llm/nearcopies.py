"""Near copies of whole documents: five-word shingles, candidates by operator 5's SimHash and by min-hash bands, verified on the texts.

Fingerprints of the shingles are linked as operator 5 links them (one-wildcard variants, equality join, within its two bits); the nodes of linked
fingerprints are candidates. Few pairs at similarity 0.8 come within two bits, so bands propose the rest.

Texts with one shingle set are one node. Each node has BANDS keys of ROWS min-hashes; a pair at similarity s shares a key with probability
1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8. Every pair under a key is a candidate and is verified on the shingle sets made from the texts anew. Keys
of up to `bucket_rows` nodes list their pairs; the nodes under a larger key meet in one task with their sets, which leaves out a pair only
where both are linked already, so the components are those of all verified pairs.

Defined results: texts without words are one group; shorter texts than a shingle are one shingle; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts, materialize
from textloom.llm.components import connected_components
from textloom.llm.simhash import links as print_links
from textloom.llm.simhash import shingle_hashes, simhash_of, signed
from textloom.llm.hashing import mix64 as _mix

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
BUCKET_ROWS = 64
_MANY = np.random.default_rng(6).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The different shingles' hashes, in order."""
    return np.unique(shingle_hashes(text, k))


def node_of(s: np.ndarray) -> int:
    """One signed number for a shingle set; 0 for the empty one."""
    if not len(s):
        return 0
    return int(_mix(_mix(s).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s))).view(np.int64)[0])


def band_keys(s: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(len(_MANY), np.iinfo(np.uint64).max)
    mixed = _mix(s)
    for a in range(0, len(s), 4096):
        np.minimum(least, (mixed[None, a : a + 4096] * _MANY[:, None]).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mix(out ^ column)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets' Jaccard similarity is that or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def group_links(nodes: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links whose components are those of all similar pairs; a set is held against a group until one of it is similar."""
    groups: list[list[int]] = []
    out = []
    for i in range(len(nodes)):
        mine, rest = [i], []
        for g in groups:
            hit = next((j for j in g if similar(sets[i], sets[j], similarity)), None)
            if hit is None:
                rest.append(g)
            else:
                out.append((min(nodes[i], nodes[hit]), max(nodes[i], nodes[hit])))
                mine = g + mine
        groups = [*rest, mine]
    return out


def print_pairs(prints: DataFrame) -> DataFrame:
    """prints(node, fp) -> candidates (a, b) that operator 5 links: nodes of one fingerprint by its smallest, and the smallest of linked fingerprints."""
    least = materialize(prints.groupBy("fp").agg(F.min("node").alias("least")), "near-prints")
    same = prints.join(least.hint("merge"), "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda n: least.select(F.col("fp").alias(n), F.col("least").alias(f"node_{n}")).hint("merge")
    linked = print_links(least.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    both = same.union(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(both.where("a < b").distinct(), "near-print-pairs")


def near_copy_groups(docs: DataFrame, carry: list[str], row: str, text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """carry's columns and `component`, one number for each group. row: a column of carry that says which rows have one text."""

    def mark(texts: list[bytes]) -> dict:
        hashes = [shingle_hashes(t, shingle) for t in texts]
        sets = [np.unique(h) for h in hashes]
        return {"node": [node_of(s) for s in sets], "keys": [band_keys(s) for s in sets], "fp": [signed(simhash_of(h)) for h in hashes]}

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])
    marked = materialize(map_texts(docs, carry, text, mark, schema), "near-marked")
    nodes = materialize(marked.groupBy("node").agg(F.min(row).alias("row"), F.min("keys").alias("keys")), "near-nodes")
    index = nodes.select("node", F.explode("keys").alias("key"))
    keys = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(index.join(materialize(keys, "near-keys").hint("merge"), "key"), "near-met")
    few = met.where(F.col("n") <= bucket_rows)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b")
    pairs = materialize(pairs.select("a", "b").distinct(), "near-pairs")
    crowd = met.where(F.col("n") > bucket_rows).select("key", "node")
    near = print_pairs(marked.select("node", "fp").distinct())

    # Only what is to be verified is made from its text again.
    wanted = nodes.select("node", F.col("row").alias("__row")).join(met.select("node").union(near.select("a")).union(near.select("b")).distinct(), "node")
    again = docs.join(wanted, docs[row] == F.col("__row"))
    made = lambda texts: {"held": pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.binary())}
    sets = map_texts(again, ["node"], text, made, T.StructType([T.StructField("held", T.BinaryType())]))
    sets = materialize(sets.groupBy("node").agg(F.min("held").alias("held")), "near-sets")
    of = lambda n: sets.select(F.col("node").alias(n), F.col("held").alias(f"held_{n}"))

    def verify(batches):
        for x in batches:
            a, b, p, q = (c.to_pylist() for c in x.columns)
            keep = [similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), similarity) for s, t in zip(p, q)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, k in zip(a, keep) if k], pa.int64()), pa.array([y for y, k in zip(b, keep) if k], pa.int64())], names=["a", "b"])

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("node")
        found = group_links(x["node"].tolist(), [np.frombuffer(s, np.uint64) for s in x["held"]], similarity)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    sure = pairs.union(near).distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "held_a", "held_b").mapInArrow(verify, _EDGE)
    hot = crowd.join(sets, "node").groupBy("key").applyInPandas(meet, _EDGE)
    groups = connected_components(materialize(sure.union(hot), "near-links"), "near-cc")
    return marked.join(groups, "node", "left").select(*carry, F.coalesce("component", marked["node"]).alias("component"))
