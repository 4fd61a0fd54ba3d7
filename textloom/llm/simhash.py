"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into s segments, where 2s - 1 is at least the number of bits that linked fingerprints
may differ by, so that one segment differs by one bit at most. Every segment is indexed under its one-wildcard
variants (the segment without one of its bits); equal keys propose pairs, which are verified. Only distinct
fingerprints are indexed, so exact copies cost nothing.

A key under which more than `bucket_rows` distinct fingerprints meet isn't expanded into pairs. Its fingerprints
go to an exact second index instead: each is filed under every value within one bit (65 keys), so those that meet
there differ by two bits at most, and any two that differ by two bits or fewer meet. A star of edges to the
smallest then says all that the pairs would; no key holds more than 65.

Defined results: a null or empty text, or one without words, has fingerprint zero and links to others of that kind
like any other; fewer than `shingle` words make one shingle; repeated rows share their component; an empty table gives
no rows; extra columns are ignored; a null id is kept, and never names a component unless all ids there are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts, materialize
from textloom.llm.components import connected_components

SEED = 42
SEGMENTS, MAX_BITS = 2, 2
#: A key's pairs are listed up to this many distinct fingerprints; beyond, the exact second index takes over.
BUCKET_ROWS = 32


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = len(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    hash_of = xxhash.xxh64_intdigest
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return np.array([hash_of(line[a : b - 1], SEED) for a, b in zip(starts, starts[k:])], np.uint64)


def simhash(text: bytes, k: int = 3) -> int:
    return simhash_of(shingle_hashes(text, k))


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def simhash_of(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """carry's columns and `fp`, the fingerprint as a signed long."""
    made = lambda texts: {"fp": pa.array([signed(simhash(t, shingle)) for t in texts], pa.int64())}
    return map_texts(docs, carry or ["doc_id"], text, made, T.StructType([T.StructField("fp", T.LongType())]))


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(prints: DataFrame, segments: int) -> DataFrame:
    """fp -> (key, fp): each segment without one bit; the key's high bits say which segment and which bit."""
    keys = []
    for s, (low, width) in enumerate(segment_bounds(segments)):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << j))).bitwiseOR(F.lit((s * 64 + j) << 40)) for j in range(width)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _differ(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in prints(fp), whose components are those of all links."""
    if 2 * segments - 1 < max_bits:
        raise ValueError(f"{segments} segments find no more than {2 * segments - 1} bits")
    if segments < 2:
        raise ValueError("a key holds a segment of 32 bits at most")
    # The few rows of a fingerprint table fan out here: a stated number of partitions isn't coalesced by their size.
    index = variants(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"), segments)
    keys = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # The same join at every size: which side would be small enough to broadcast isn't known beforehand.
    met = materialize(index.join(materialize(keys, "simhash-keys").hint("merge"), "key"), "simhash-met")
    few = met.where(F.col("n") <= bucket_rows)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").where(_differ("a", "b") <= max_bits)
    many = met.where(F.col("n") > bucket_rows).select("fp").distinct()
    return pairs.select("a", "b").distinct().union(_ball_links(many, max_bits))


def _ball_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Every value within r = max_bits // 2 bits of a fingerprint is a key; who meets there differs by 2r bits at most.

    For an odd number of bits, keys within r of one and r + 1 of the other meet, so those are verified.
    """
    one = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << j) - (1 << 64) if j == 63 else 1 << j)) for j in range(64)]
    if max_bits > 2:
        raise ValueError("crowded keys are split for two bits or fewer")
    near = prints.select("fp", F.explode(F.array(*(one if max_bits == 2 else one[:1]))).alias("key"))
    if max_bits == 1:
        near = prints.select("fp", F.explode(F.array(*one)).alias("key"))
    least = near.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return near.join(least, "key").where("a < fp").where(_differ("a", "fp") <= max_bits).select("a", F.col("fp").alias("b")).distinct()


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    max_bits: int = MAX_BITS,
    segments: int = SEGMENTS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(id, fp, component_id, group_rows): the smallest id reachable through links, and how many rows that group has."""
    marked = materialize(fingerprints(docs, text, [id_col], shingle), "simhash-fp")
    prints = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-prints")
    edges = links(prints.select("fp"), max_bits, segments, bucket_rows)
    groups = connected_components(edges, "simhash-cc")
    # A component of fingerprints takes the smallest id that any of them carries.
    of = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("c"))
    named = of.groupBy("c").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_rows"))
    by_print = of.select("fp", "c").join(named, "c").select("fp", "component_id", "group_rows")
    return marked.join(by_print, "fp").select(id_col, "fp", "component_id", "group_rows")
