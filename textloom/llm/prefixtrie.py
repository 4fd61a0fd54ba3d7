"""The trie of conversation prefixes in balanced parentheses, a shard at a time, with what sharing prefixes saves.

Turns are named by MD5 digests of role and text, so a conversation is a path of 16-byte steps. Equal paths become one row (their members' ids are hashed in order, in chunks of
an id range each, so that no group is sorted in one place). Paths are dealt to shards by range and sorted; a shard writes its trie, a block of paths at a time,
as balanced parentheses in preorder. Excess is kept in blocks with a tree of their minima: findclose gives a node's closing parenthesis, and with it its subtree; rank of "()" pairs
counts leaves; cumulative arrays give members and savings; a sparse table gives the smallest member.

Only nodes on the first and the last path of a block, its spines, may lie in several blocks. They are emitted as partial sums and merged by name. Between neighbouring blocks, the
nodes on their common spine were counted twice: each takes back one child where the next node on the spine is common, too, a leaf where the earlier block ended there, and a turn's bytes for every common node
below. That is one row for each node of a common spine, whatever the number of shards.

Defined results: rows without a conversation id belong to none; null roles and texts are empty; turns are ordered by number, null first, ties by digest, then size; repeated rows are turns of their own;
an empty table has no root; extra columns are ignored. Very long texts only count by digest and size; a conversation's digests are in memory together, its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import materialize

STEP = 16
#: Ids that one row of a group's members holds.
ID_RANGE = 1 << 16
#: Nodes of a block.
NODES = 1 << 17
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_PATHS = T.StructType([T.StructField("path", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("least", T.LongType()), T.StructField("sha", T.StringType())])
_NUMBERS = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_PARTS = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("id", T.BinaryType()), T.StructField("parent_id", T.BinaryType())]
    + [T.StructField(c, T.LongType()) for c in _NUMBERS]
    + [T.StructField("ends_sha256", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("path", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.LongType()))]
)
#: Rows of _PARTS: a node; a part of a node that other blocks may hold, too; a shard's first and last path.
NODE, PART, FIRST, LAST = range(4)


class Parens:
    """Balanced parentheses with their excess in blocks under a tree of minima."""

    BLOCK = 64
    QUERIES = 1 << 15

    def __init__(self, opens: np.ndarray):
        """opens: True for an opening parenthesis."""
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1), dtype=np.int32)
        n = -(-len(opens) // self.BLOCK)
        padded = np.full(n * self.BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(opens)] = self.excess
        self.blocks = padded.reshape(n, self.BLOCK)
        row = self.blocks.min(axis=1)
        self.tree = [row]
        while len(row) > 1:
            row = np.append(row, np.iinfo(np.int32).max) if len(row) % 2 else row
            self.tree[-1] = row
            row = row.reshape(-1, 2).min(axis=1)
            self.tree.append(row)
        self.pairs = np.append(0, np.cumsum(opens[:-1] & ~opens[1:])) if len(opens) else np.zeros(1, np.int64)

    def _within(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place of the first excess <= target behind `after` in the block; -1 if there is none."""
        out = np.empty(len(block), np.int64)
        places = np.arange(self.BLOCK)
        for a in range(0, len(block), self.QUERIES):
            part = slice(a, a + self.QUERIES)
            hit = (self.blocks[block[part]] <= target[part, None]) & (places > after[part, None])
            first = hit.argmax(axis=1)
            out[part] = np.where(hit[np.arange(len(first)), first], block[part] * self.BLOCK + first, -1)
        return out

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parentheses of the opening ones at these places."""
        target = self.excess[at] - 1
        out = self._within(at // self.BLOCK, at % self.BLOCK, target)
        todo = np.flatnonzero(out < 0)
        node, goal, level = at[todo] // self.BLOCK, target[todo], np.zeros(len(todo), np.int64)
        # Up, until a right sibling holds the place; then down to the first block that does.
        climbing = np.ones(len(todo), bool)
        for k, row in enumerate(self.tree[:-1]):
            sibling = node + 1
            found = climbing & (node % 2 == 0) & (row[np.minimum(sibling, len(row) - 1)] <= goal)
            node = np.where(found, sibling, np.where(climbing, node // 2, node))
            level[found] = k
            climbing &= ~found
        for k in range(len(self.tree) - 1, 0, -1):
            down = level >= k
            left = 2 * node
            row = self.tree[k - 1]
            node = np.where(down, np.where(row[np.minimum(left, len(row) - 1)] <= goal, left, left + 1), node)
        out[todo] = self._within(node, np.full(len(todo), -1), goal)
        return out

    def leaves(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs "()" that begin from place a to before place b."""
        return self.pairs[b] - self.pairs[a]


class RangeMin:
    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (half := 1 << (len(self.rows) - 1)) < len(values):
            last = self.rows[-1]
            self.rows.append(np.append(np.minimum(last[:-half], last[half:]), last[-half:]) if len(last) > half else last)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a:b], which aren't empty."""
        k = np.int64(np.floor(np.log2(b - a)))
        out = np.empty(len(a), self.rows[0].dtype)
        for level in np.unique(k):
            x = k == level
            out[x] = np.minimum(self.rows[level][a[x]], self.rows[level][b[x] - (1 << level)])
        return out


def common_depth(a: bytes, b: bytes) -> int:
    """Steps that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * STEP : mid * STEP] == b[low * STEP : mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


def names(path: bytes, depth: int) -> list[bytes]:
    """Names of the nodes on a path, from the root to that depth."""
    h = hashlib.md5()
    out = [h.digest()]
    for d in range(depth):
        h.update(path[d * STEP : (d + 1) * STEP])
        out.append(h.digest())
    return out


def build(paths: list[bytes], sizes: list[np.ndarray], members: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of sorted, different paths in preorder, the root first: what each has within these paths; `end` is the path that ends there, or -1."""
    depths = np.array([len(p) // STEP for p in paths], np.int64)
    shared = np.array([0] + [common_depth(a, b) for a, b in zip(paths, paths[1:])], np.int64)
    fresh = depths - shared
    fresh[0] += 1
    closes = np.append(depths[:-1] - shared[1:], depths[-1] + 1)
    steps = np.stack([fresh, closes], axis=1).reshape(-1)
    bp = Parens(np.repeat(np.tile([True, False], len(paths)), steps))
    at = np.flatnonzero(bp.opens)
    total = len(at)
    row = np.repeat(np.arange(len(paths)), fresh)
    depth = bp.excess[at].astype(np.int64) - 1
    offsets = np.cumsum([0] + [len(s) for s in sizes])
    flat = np.concatenate([*sizes, np.zeros(1, np.int64)])
    size = np.where(depth > 0, flat[np.minimum(offsets[row] + depth - 1, len(flat) - 1)], 0)
    close = bp.findclose(at)
    first = np.arange(total)
    past = first + (close - at + 1) // 2
    last = np.cumsum(fresh) - 1
    end = np.full(total, -1, np.int64)
    end[last] = np.arange(len(paths))
    ended = np.append(0, np.cumsum(end >= 0))
    count = np.append(0, np.cumsum(np.where(end >= 0, members[end], 0)))
    n = count[past] - count[first]
    saved = np.append(0, np.cumsum((n - 1) * size))
    parent = first - 1
    spine: list[int] = []
    start = 0
    for k, (d, f) in enumerate(zip(shared.tolist(), fresh.tolist())):
        if k:
            parent[start] = spine[d]
            del spine[d + 1 :]
        spine += range(start, start + f)
        start += f
    return {
        "depth": depth, "row": row, "size": size, "end": end, "parent": parent, "n_convs": n, "least": RangeMin(least)(ended[first], ended[past]),
        "n_children": np.bincount(parent[1:], minlength=total), "n_leaves": bp.leaves(at, close), "saved": saved[past] - saved[first],
    }


def overlap(before: bytes, after: bytes, sizes: list[int]) -> list[dict]:
    """What the nodes common to a block's last path and the next one's first have too many of. sizes: of the turns of the path after."""
    depth = common_depth(before, after)
    ended = len(before) == depth * STEP
    out, below = [], 0
    own = names(after, depth)
    for d in range(depth, -1, -1):
        below += int(sizes[d - 1]) if d else 0
        out.append({"kind": PART, "id": own[d], "parent_id": own[d - 1] if d else None, "depth": d, "n_convs": 0, "n_children": -1 if d < depth else 0, "n_leaves": -1 if ended else 0, "saved_tokens": below})
    return out


def _table(rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(_PARTS))


def block_parts(paths: list[bytes], sizes: list[np.ndarray], members: np.ndarray, least: np.ndarray, sha: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its nodes, those on its spines as parts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    got = build(paths, sizes, members, least)
    total = len(got["depth"])
    ids: dict[int, bytes] = {}
    for k in (0, len(paths) - 1):
        v = int(np.flatnonzero(got["end"] == k)[0])
        own = names(paths[k], int(got["depth"][v]))
        while v >= 0:
            ids[v] = own[int(got["depth"][v])]
            v = int(got["parent"][v])
    end, parent = got["end"], got["parent"]
    of_parent = [ids.get(p) for p in parent.tolist()]
    known = np.array([x is None for x in of_parent]) & (parent >= 0)
    is_part = np.zeros(total, bool)
    is_part[list(ids)] = True
    column = {
        "kind": np.where(is_part, PART, NODE).astype(np.int32), "id": [ids.get(v) for v in range(total)], "parent_id": of_parent, "depth": got["depth"], "conv_id": got["least"],
        "parent_conv_id": pa.array(got["least"][np.maximum(parent, 0)], pa.int64(), mask=~known), "n_convs": got["n_convs"], "n_children": got["n_children"], "n_leaves": got["n_leaves"], "saved_tokens": got["saved"],
        "ends_sha256": [sha[e] if e >= 0 else (None if p else EMPTY_SHA) for e, p in zip(end.tolist(), is_part.tolist())],
    }
    schema = to_arrow_schema(_PARTS)
    yield pa.RecordBatch.from_arrays([c if isinstance(c := column.get(f.name), pa.Array) else pa.nulls(total, f.type) if c is None else pa.array(c, f.type) for f in schema], schema=schema)


def shard_parts(most: int):
    """A mapInArrow function over a shard's sorted paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held: list[tuple] = []
        weight, last = 0, None

        def flush():
            paths, sizes, n, least, sha = zip(*held)
            return block_parts(list(paths), [np.array(s, np.int64) for s in sizes], np.array(n, np.int64), np.array(least, np.int64), list(sha))

        for x in batches:
            for row in zip(*(c.to_pylist() for c in x.columns)):
                if last is None:
                    yield _table([{"kind": FIRST, "shard": shard, "path": row[0], "sizes": row[1]}])
                elif not held:
                    yield _table(overlap(last, row[0], row[1]))
                held.append(row)
                last = row[0]
                weight += len(row[0]) // STEP + 1
                if weight >= most:
                    yield from flush()
                    held, weight = [], 0
        if held:
            yield from flush()
        if last is not None:
            yield _table([{"kind": LAST, "shard": shard, "path": last}])

    return run


def turn_paths(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order, as digest and bytes of text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def with_shared_starts(paths: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c begins with the first h = crc32(c) % most turns of conversation c - c % every instead of its own first h turns, where those exist."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    donors = paths.select(F.col("conv").alias("donor"), F.col("turns").alias("given"))
    met = paths.withColumn("donor", F.col("conv") - F.pmod("conv", F.lit(every))).join(donors, "donor", "left").withColumn("h", h)
    none = F.slice("turns", F.lit(1), F.lit(0))
    return met.select("conv", F.concat(F.coalesce(F.slice("given", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def different_paths(paths: DataFrame) -> DataFrame:
    """(path, sizes, n, least, sha): each different path with its members' number, the smallest, and the hash of their ids in order."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = paths.select("conv", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")).withColumn("key", F.md5("path"))
    chunks = rows.groupBy("key", F.floor(F.col("conv") / ID_RANGE).alias("chunk")).agg(F.sort_array(F.collect_list("conv")).alias("ids"), F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"))
    chunks = chunks.select("key", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"), F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"), "path", "sizes")
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, now, sha, done = to_arrow_schema(_PATHS), None, None, []

        def closed():
            key, path_, sizes, n, least = now
            return {"path": path_, "sizes": sizes, "n": n, "least": least, "sha": sha.hexdigest()}

        for x in batches:
            for key, _, text, n, least, path_, sizes in zip(*(c.to_pylist() for c in x.columns)):
                if now and now[0] == key:
                    sha.update(b"," + text.encode())
                    now = (*now[:3], now[3] + n, min(now[4], least))
                    continue
                if now:
                    done.append(closed())
                now, sha = (key, path_, sizes, n, least), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
        if now:
            yield pa.RecordBatch.from_pylist([closed()], schema=schema)

    return chunks.repartition(parts, "key").sortWithinPartitions("key", "chunk").mapInArrow(hashed, _PATHS)


def _boundaries(ends: DataFrame) -> DataFrame:
    """What nodes common to neighbouring shards have too many of. ends: two rows a shard."""
    shards = ends.groupBy("shard").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(a) for k, c, a in ((FIRST, "path", "first"), (FIRST, "sizes", "sizes"), (LAST, "path", "last"))])
    met = shards.select(F.lag("last").over(W.orderBy("shard")).alias("before"), "first", "sizes").where("before IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row in zip(*(c.to_pylist() for c in x.columns)):
                yield _table(overlap(*row))

    return met.mapInArrow(run, _PARTS)


def prefix_trie(paths: DataFrame, most: int = NODES, shards: int | None = None) -> DataFrame:
    """paths(conv, turns) -> a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    most: nodes of a block; shards: partitions that the paths are dealt to.
    """
    spark = paths.sparkSession
    ends = materialize(different_paths(paths), "trie-paths")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(ends.repartitionByRange(n, "path").sortWithinPartitions("path").mapInArrow(shard_parts(most), _PARTS), "trie-parts")
    spine = parts.where(F.col("kind") == PART).union(_boundaries(parts.where(F.col("kind").isin(FIRST, LAST))))
    total = lambda c: F.sum(c).alias(c)
    merged = spine.groupBy("id").agg(F.max("parent_id").alias("parent_id"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[total(c) for c in _NUMBERS[3:]], F.coalesce(F.max("ends_sha256"), F.lit(EMPTY_SHA)).alias("ends_sha256"))
    merged = materialize(merged, "trie-spine")
    above = merged.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("above"))
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    nodes = parts.where(F.col("kind") == NODE)
    inner = nodes.where("parent_id IS NULL").select(*out)
    outer = nodes.where("parent_id IS NOT NULL").drop("parent_conv_id").join(above, "parent_id").withColumnRenamed("above", "parent_conv_id").select(*out)
    return inner.union(outer).union(merged.join(above, "parent_id", "left").withColumnRenamed("above", "parent_conv_id").select(*out))
