"""The corpus pipeline: quality rules, verified near-dedup, benchmark decontamination, PII redaction, mixing.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds `copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import materialize, table
from textloom.llm.decontaminate import decontaminate
from textloom.llm.mixing import mix
from textloom.llm.nearcopies import near_copy_groups
from textloom.llm.pii import redact
from textloom.llm.quality import quality_verdicts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_verdicts(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), one row: that with the smallest id, null last."""
    # 128 bits: rows of one name are one row.
    name = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), *COLUMNS)), 16, "0")
    rows = docs.select(*COLUMNS).withColumn("row", F.concat(name(1), name(2)))
    groups = near_copy_groups(rows, ["doc_id", "row"], "row")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("r"))
    once = first.select(F.col("r.row").alias("row")).distinct()
    kept = rows.join(once, "row", "left_semi")
    # Whole texts are only compared where a row repeats.
    repeated = groups.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")
    return kept.join(repeated, "row", "left_anti").select(*COLUMNS).union(kept.join(repeated, "row", "left_semi").select(*COLUMNS).distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly benchmark go."""
    return counted(decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return counted(redact(docs.select(*COLUMNS)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies of each."""
    docs = docs.select(*COLUMNS)
    # Rows with one id, source and size share their copies, the first of them more by one where they don't come out even.
    taken = mix(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("all_copies"))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    rows = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    taken = materialize(taken.join(rows, _alike(taken, rows)).select(*[taken[c] for c in (*ALIKE, "all_copies")], "rows"), "mix-copies")
    out = sized.join(taken, _alike(sized, taken)).select(*[sized[c] for c in COLUMNS], taken["size"], "all_copies", "rows")
    once = out.where("rows = 1").select(*COLUMNS, F.col("all_copies").cast("long").alias("copies"))
    # Only repeated rows are numbered, in the order of their texts.
    again = out.where("rows > 1")
    order = W.partitionBy(*ALIKE).orderBy("text", "lang", "n_chars")
    share = F.col("all_copies") / F.col("rows")
    again = again.withColumn("nth", F.row_number().over(order)).withColumn("copies", (F.floor(share) + (F.col("nth") <= F.col("all_copies") % F.col("rows")).cast("int")).cast("long"))
    return once.union(again.where("copies > 0").select(*COLUMNS, "copies"))


ALIKE = ("doc_id", "source", "size")


def _alike(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: The stages don't fit into SQL: learned verdicts, an automaton and boosted trees.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
