"""Exchanges of packed arrays: many small records travel as a few rows of bytes.

A map side fills numpy arrays, deals them to buckets and emits one row (bucket, payload) for each bucket and chunk; a reduce side gets
all payloads of a bucket one after another. Sorting and grouping happen in numpy, a bucket at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])
_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
#: Bytes of text that the map side takes together.
CHUNK = 4 << 20


def bucket_count(df: DataFrame) -> int:
    """Follows spark.sql.shuffle.partitions, which is set by the size of the data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pack(bucket: int, arrays: dict, level: int = 1) -> tuple[int, bytes]:
    return bucket, zstandard.compress(pickle.dumps(arrays, protocol=5), level)


def unpack(payload: bytes) -> dict:
    return pickle.loads(zstandard.decompress(payload))


def owners(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (id, row) pairs in order, and the place of each record's pair among them."""
    order = np.lexsort((rows, ids))
    i, r = ids[order], rows[order]
    new = np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]))[: len(i)]
    at = np.empty(len(i), np.uint32)
    at[order] = np.cumsum(new) - 1
    return i[new], r[new], at


def deal(key: np.ndarray, buckets: int, arrays: dict[str, np.ndarray]) -> Iterator[tuple[int, dict]]:
    """Arrays of one length, split by key modulo buckets."""
    at = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(key[part[0]] % np.uint64(buckets)), {k: v[part] for k, v in arrays.items()}


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes of one place after another, which pack better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def emit(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=_ARROW)


def chunks(batches: Iterator[pa.RecordBatch], n_text: int) -> Iterator[list[tuple]]:
    """Rows, their text column as bytes, in lists of about CHUNK bytes."""
    rows, size = [], 0
    for b in batches:
        cols = [b.column(k).cast(pa.binary()) if k == n_text else b.column(k) for k in range(b.num_columns)]
        for i in range(b.num_rows):
            row = tuple(c[i].as_py() for c in cols)
            row = (*row[:n_text], row[n_text] or b"", *row[n_text + 1 :])
            rows.append(row)
            size += len(row[n_text])
            if size >= CHUNK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def map_packed(df: DataFrame, fn: Callable[[list[tuple]], Iterator[tuple[int, bytes]]], n_text: int) -> DataFrame:
    """fn turns a chunk of df's rows into packed rows."""

    def run(batches):
        for rows in chunks(batches, n_text):
            if out := list(fn(rows)):
                yield from emit(out).to_batches()

    return df.mapInArrow(run, PACKED)


def reduce_packed(packed: DataFrame, fn: Callable[[int, list[dict]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """fn gets each bucket's payloads and yields rows of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        held: list[dict] = []
        now = None

        def out():
            rows = list(fn(now, held))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now and held:
                    yield from out()
                    held = []
                now = bucket
                held.append(unpack(payload.as_py()))
        if held:
            yield from out()

    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def reduce_streamed(packed: DataFrame, fn: Callable[[int, Iterator[dict]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """fn gets a bucket's payloads one after another and yields packed rows."""

    def run(batches):
        stream = ((bucket, payload) for b in batches for bucket, payload in zip(b.column(0).to_pylist(), b.column(1)))
        for bucket, own in groupby(stream, key=lambda x: x[0]):
            for row in fn(bucket, (unpack(p.as_py()) for _, p in own)):
                yield from emit([row]).to_batches()

    n = bucket_count(packed)
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKED)


def meet_texts(docs: DataFrame, packed: DataFrame, bucket, fn: Callable[[list[dict], Iterator[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """docs(id, text) and packed rows meet by bucket; fn gets a bucket's payloads and streams its rows (id, text as bytes).

    bucket: column of docs. Payloads of a bucket are in memory together, texts one after another.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    id_, text = docs.columns
    left = docs.select(bucket.cast("int").alias("bucket"), F.lit(1).alias("side"), F.lit(None).cast("binary").alias("payload"), F.col(id_).alias("id"), F.col(text).cast("binary").alias("text"))
    right = packed.select("bucket", F.lit(0).alias("side"), "payload", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        def stream():
            for b in batches:
                for i in range(b.num_rows):
                    yield tuple(b.column(k)[i].as_py() for k in range(5))

        now, held, rows = None, [], []
        size = 0

        def out():
            made = list(fn(held, iter(rows)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

        for bucket_, side, payload, i, t in stream():
            if bucket_ != now:
                if rows:
                    yield from out()
                now, held, rows, size = bucket_, [], [], 0
            if side == 0:
                held.append(unpack(payload))
            else:
                rows.append((i, t or b""))
                size += len(rows[-1][1])
                if size >= CHUNK:
                    yield from out()
                    rows, size = [], 0
        if rows:
            yield from out()

    return left.union(right).repartition(n, "bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, schema)
