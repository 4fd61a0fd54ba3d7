"""Shared plumbing of the corpus operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters, which is what bytes.split() yields.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = f"/tmp/textloom-shared/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will be read from again."""
    files = df.inputFiles()
    if files:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of what is done deleted, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_texts(
    df: DataFrame,
    columns: list[str],
    text: str,
    fn: Callable[[list[bytes]], dict[str, pa.Array | list]],
    schema: T.StructType,
) -> DataFrame:
    """Carry `columns` along and add what fn makes of each batch's texts: name -> list, in schema's order.

    Texts reach fn in slices of a few MB, so that a worker's memory doesn't follow the batch size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = T.StructType([f for c in columns for f in df.schema if f.name == c])
    out = T.StructType([*kept.fields, *schema.fields])
    arrow = to_arrow_schema(out)
    made = schema.fieldNames()
    most = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = 0, b.num_rows
            texts = b.column(len(columns)).cast(pa.binary())
            while at < n:
                to, size, part = at, 0, []
                while to < n and (size < most or to == at):
                    part.append(texts[to].as_py() or b"")
                    size += len(part[-1])
                    to += 1
                got = fn(part)
                cols = [b.column(k).slice(at, to - at) for k in range(len(columns))]
                cols = [c.cast(arrow.field(k).type) for k, c in enumerate(cols)]
                new = [got[m] if isinstance(got[m], pa.Array) else pa.array(got[m], arrow.field(len(columns) + k).type) for k, m in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*cols, *new], schema=arrow)
                at = to

    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, out)
