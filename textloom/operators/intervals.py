"""Rewrites across inline elements as relations: edits of a scope's whole text are met with the segments that hold them, by an interval join.

A paragraph, heading or cell is a scope; its text is cut into segments by the inline elements in it, at cumulative offsets. A rewrite that keeps lengths sees the scope's whole text; the places where it
changed something are points, segments are intervals, and each point goes to the interval that contains it. Only plain texts take changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import udfs
from textloom.operators.corpus import spread, together

#: Length of a bin; an interval is filed under every bin that it touches, a point under one.
BIN = 1024


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, bin_: int = BIN) -> DataFrame:
    """points with the columns of every interval of the same keys with start <= at < end: an equality join on keys and bins, then the exact test. Empty intervals hold nothing."""
    bins = F.sequence(F.floor(F.col(start) / bin_), F.floor((F.col(end) - 1) / bin_))
    filed = intervals.where(F.col(end) > F.col(start)).withColumn("__bin", F.explode(bins))
    put = points.withColumn("__bin", F.floor(F.col(at) / bin_))
    put, filed = together(put, *by, "__bin"), together(filed, *by, "__bin")
    return put.join(filed.hint("merge"), [*by, "__bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__bin")


def inline_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, scope, ord, text, fixed, start, end): each scope's segments with their offsets in its text. fixed: not plain text, as code and line ends."""
    rows = together(spread(docs).select(key, F.inline(udfs.segments()(F.col(text)))), key)
    before = W.partitionBy(key, "scope").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def changed_segments(segments: DataFrame, rewrite, key: str = "doc_id", bin_: int = BIN) -> DataFrame:
    """(key, scope, ord, text, new) of the plain segments that rewrite changes; rewrite is a column function on a scope's whole text that keeps its length."""
    by = [key, "scope"]
    whole = segments.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    whole = whole.select(*by, F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("old"))
    both = whole.withColumn("new", rewrite(F.col("old"))).where("old <> new")
    pairs = F.arrays_zip(F.split("old", "").alias("a"), F.split("new", "").alias("b"))
    edits = both.select(*by, F.posexplode(pairs).alias("at", "c")).where("c.a <> c.b").select(*by, "at", F.col("c.b").alias("to"))
    met = interval_join(edits, segments.where("NOT fixed"), by, "at", "start", "end", bin_)
    own = together(met, *by).groupBy(*by, "ord").agg(F.any_value("text").alias("text"), F.map_from_entries(F.collect_list(F.struct(F.col("at") - F.col("start"), "to"))).alias("edits"))
    new = F.array_join(F.transform(F.split("text", ""), lambda c, i: F.coalesce(F.col("edits")[i], c)), "")
    return own.select(*by, "ord", "text", new.alias("new"))
