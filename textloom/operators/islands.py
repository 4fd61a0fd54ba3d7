"""Sentences and segments as islands of rows: a document may be rows of words or lines instead of one string, so none has to fit into a task's memory as a whole.

A row that ends an island counts one; the running count before a row names its island. Windows read a document's rows in order and keep the count alone. Rows are dealt to a partition for every
SHARE of them and sorted there once, in the order that all windows read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import native as N
from textloom.operators.corpus import SHARE, shares, together


def numbered(rows: DataFrame, key: str, order: str, ends: Column, name: str) -> DataFrame:
    """rows with the number of their island: of the rows before that end one."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).cast("int"))


def _joined(rows: DataFrame, key: str, order: str, name: str, value: str, separator: str, out: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(key, name).agg(F.array_join(F.transform(parts, lambda p: p[value]), separator).alias(out))


def _in_order(rows: DataFrame, key: str, order: str, share: int) -> DataFrame:
    return together(rows, key, n=shares(rows, share)).sortWithinPartitions(key, order)


def sentences_of_rows(words: DataFrame, key: str = "doc_id", order: str = "pos", word: str = "word", share: int = SHARE) -> DataFrame:
    """words(key, pos, word) -> (key, sid, sentence): a sentence ends at every word that looks like an end. Only a sentence is gathered, never a document."""
    return _joined(numbered(_in_order(words, key, order, share), key, order, N.ends_sentence(F.col(word)), "sid"), key, order, "sid", word, " ", "sentence")


def segments_of_rows(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line", share: int = SHARE) -> DataFrame:
    """lines(key, line_no, line) -> (key, segment_no, segment): lines that are laid out together. Tags and table rows stand apart, and list items do where a document has tags."""
    whole, near = W.partitionBy(key), W.partitionBy(key).orderBy(order)
    x = F.col(line)
    tagged = F.max(N.starts_with_tag(x) | N.ends_with_tag(x)).over(whole)
    rows = _in_order(lines, key, order, share).withColumn("__alone", N.is_table_row(x) | (tagged & N.is_block(x)))
    after = F.lead(F.struct(F.col("__alone").alias("alone"), N.is_tag_at_margin(x).alias("tag"))).over(near)
    rows = rows.withColumn("__next", after)
    ends = F.coalesce(F.col("__alone") | N.ends_with_tag(x) | F.col("__next.alone") | F.col("__next.tag"), F.lit(False))
    return _joined(numbered(rows, key, order, ends, "segment_no"), key, order, "segment_no", line, "\n", "segment")
