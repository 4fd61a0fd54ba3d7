"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target number of words by its weight; no target is above `max_repeats` times its source's size,
and what is cut off is shared again by weight. The fixed point is found in closed form: ordered by the number of
repeats they can bear for their weight, the capped sources come first.

A document's expected number of copies is its source's target over its source's size, times its own weight over the
source's mean weight where a weight column is given. Whole copies are certain. For the fraction p that is left,
documents are ranked by (u / (1 - u)) / (p / (1 - p)) with a uniform u from a hash of the id: random odds over
inclusion odds, which is Pareto order sampling. The first documents in that order whose words fit the rest of the target are taken,
and then the one document more or less that brings the words nearest to it.

A source may hold a third of all documents: ranks are summed over bins of the order, about `bin_rows` documents each, and
only a bin is ordered by a window. Results depend on ids, sizes and sources alone, so reruns agree.

Defined results: null texts have size 0; null sources form a source of their own, last in order; sources without words
have target 0; repeated rows are each a document, ordered after one another; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import WORD, materialize

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BIN_ROWS = 512


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight_col: str | None = None) -> DataFrame:
    """(id, source, size, w): size is the number of words."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD + "+")), F.lit(0)).cast("long")
    w = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return docs.select(F.col(id_col), F.col(source).alias("source"), words.alias("size"), w.alias("w"))


def targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources(source, source_size, ...) -> with `target`. A row for each source; sources are few beside documents."""
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    share = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth + 1)
    # Capped sources are the first by cap / weight: with k of them capped, the others get level * weight.
    by_cap = W.partitionBy(F.lit(0)).orderBy((max_repeats * F.col("source_size") / F.col("share")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    out = sources.withColumn("share", share)
    out = (
        out.withColumn("cap", max_repeats * F.col("source_size"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("share_before", F.coalesce(F.sum("share").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("shares", F.sum("share").over(everything))
    )
    out = out.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("shares") - F.col("share_before")))
    # The first source whose cap isn't reached sets the level; before it, all are capped.
    out = out.withColumn("at", F.row_number().over(by_cap))
    free = F.min(F.when(F.col("level") * F.col("share") <= F.col("cap"), F.struct("at", "level"))).over(everything)
    out = out.withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("at") < F.col("free.at")), F.col("cap").cast("double")).otherwise(F.col("free.level") * F.col("share"))
    return out.withColumn("target", F.least(target, F.col("cap").cast("double"))).drop("share", "cap", "cap_before", "share_before", "total", "shares", "level", "at", "free")


def uniform(id_col: str, seed: int):
    """A number strictly between 0 and 1 from the id's MD5 (48 bits)."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight_col: str | None = None,
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 7,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every document."""
    base = materialize(sized(docs, id_col, text, source, weight_col), "mix-sizes")
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.try_divide(F.sum(F.col("w") * F.col("size")), F.sum("size")).alias("mean_w"))
    plan = materialize(targets(by_source, weights, max_repeats).withColumn("repeats", F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0))), "mix-plan")
    null_safe = base["source"].eqNullSafe(plan["source"])
    at = base.join(plan, null_safe).drop(plan["source"])

    expected = F.least(F.lit(float(max_repeats)), F.col("repeats") * F.coalesce(F.try_divide("w", "mean_w"), F.lit(1.0)))
    odds = lambda p: F.greatest(p, F.lit(1e-12)) / (1 - F.least(p, F.lit(1 - 1e-12)))
    u = uniform(id_col, seed)
    at = at.withColumn("whole", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    at = at.withColumn("rank_key", u / (1 - u) / odds(F.col("p")))
    centred = F.col("rank_key") * odds(F.col("repeats") - F.floor("repeats"))
    at = at.withColumn("bins", F.ceil(F.col("rows") / bin_rows)).withColumn("bin", F.floor(centred / (1 + centred) * F.col("bins")))
    at = materialize(at.select(id_col, "source", "size", "source_size", "target", "whole", "p", "rank_key", "bin"), "mix-ranked")

    can = F.col("whole") < max_repeats
    bins = at.groupBy("source", "bin").agg(F.sum(F.when(can, F.col("size")).otherwise(0)).alias("bin_size"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.count(F.lit(1)).alias("bin_n"), F.max("target").alias("target"))
    whole_source = W.partitionBy("source")
    earlier = whole_source.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(
        F.col("source").alias("s"),
        F.col("bin").alias("b"),
        F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("bin_n").over(earlier), F.lit(0)).alias("n_before"),
        (F.col("target") - F.sum("certain").over(whole_source)).alias("rest"),
    )
    at = at.join(bins, at["source"].eqNullSafe(bins["s"]) & (at["bin"] == bins["b"]))
    inside = W.partitionBy("source", "bin").orderBy("rank_key", F.col(id_col).asc_nulls_first(), "size")
    upto = F.col("size_before") + F.sum(F.when(can, F.col("size")).otherwise(0)).over(inside.rowsBetween(W.unboundedPreceding, 0))
    at = at.withColumn("upto", upto).withColumn("nth", F.col("n_before") + F.row_number().over(inside))
    at = at.withColumn("first", can & (F.col("upto") <= F.col("rest")))
    at = materialize(at.select(id_col, "source", "size", "source_size", "target", "whole", "p", "rest", "upto", "nth", "first"), "mix-first")

    # What the order leaves of the rest is met by the one document that comes nearest to it, if any comes nearer than nothing.
    left = at.groupBy("source").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("first"), F.col("upto"))), F.lit(0))).alias("left"))
    left = left.select(F.col("source").alias("s"), "left")
    open_ = at.where(~F.col("first") & (F.col("whole") < max_repeats) & (F.col("p") > 0)).join(left, at["source"].eqNullSafe(left["s"]))
    off = F.abs(F.col("left") - F.col("size"))
    last = open_.where(off < F.abs("left")).groupBy("s").agg(F.min(F.struct(off.alias("off"), F.col("nth"))).alias("best")).select(F.col("s").alias("s2"), F.col("best.nth").alias("last"))
    at = at.join(last, at["source"].eqNullSafe(last["s2"]), "left")
    copies = F.col("whole") + F.when(F.col("first") | F.coalesce(F.col("nth") == F.col("last"), F.lit(False)), 1).otherwise(0)
    return at.select(id_col, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
