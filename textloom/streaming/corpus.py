"""Formatting of a stream of documents: every operator here looks at one document at a time and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.formatting import Format
from textloom.operators.corpus import format_corpus


def format_stream(docs: DataFrame, path: str, checkpoint: str, options: Format = Format(), text: str = "text") -> StreamingQuery:
    """Write the formatted documents of a stream as Parquet files below path, each exactly once; ends when the input is used up."""
    out = format_corpus(docs, options, text)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
