"""Operators over a corpus: a DataFrame with a text column."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import native, scan, udfs
from textloom.functions.formatting import AUTO, FILES, Format


#: Rows of words or lines that a task sorts.
SHARE = 1 << 20


def spread(docs: DataFrame) -> DataFrame:
    """docs over as many partitions as there are cores at least. A file of one row group is one task however large it is and into however many splits it is
    cut, so a scan counts as wide by its files; a wide scan, and anything behind a shuffle, and a stream, stays as it is."""
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    plan = docs._jdf.queryExecution().executedPlan()
    # A plan that is adaptive has an exchange; asking for its partitions would run it.
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return docs
    parts, files = docs.rdd.getNumPartitions(), len(docs.inputFiles())
    if parts >= cores and (not files or files >= cores):
        return docs
    # Dealt by a hash of the rows: dealing in turn would sort the one task's rows first.
    plain = [c for c, t in docs.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    n = max(parts, cores)
    return docs.repartition(n, F.xxhash64(*[f"`{c}`" for c in plain])) if plain else docs.repartition(n)


def together(rows: DataFrame, *keys: str, n: int = 0) -> DataFrame:
    """rows with those of equal keys in one partition, of n at least. A stated number isn't coalesced, so a task's share doesn't follow how well its rows are packed."""
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shares(rows: DataFrame, share: int = SHARE) -> int:
    """Partitions for `share` rows each: as rows grow, tasks become more, not larger. Counts the rows."""
    return 1 if rows.isStreaming else -(-rows.count() // share)


def format_corpus(docs: DataFrame, options: Format = Format(), text: str = "text", out: str = "formatted") -> DataFrame:
    """docs with the formatted text. All passes are one call: a document is parsed once. Plain text stays in the JVM."""
    if options.plaintext:
        return spread(docs).withColumn(out, scan.fill_text(F.col(text), "wrap", options.width))
    return spread(docs).withColumn(out, udfs.reformat(options)(F.col(text)))


def changed(docs: DataFrame, options: Format = FILES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The check: keys of the documents that formatting would change. Line ends alone are no change."""
    plain = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    # A deterministic condition is moved below the exchange that spreads the texts, and takes the formatting with it into the one task of the scan.
    differs = F.when(F.spark_partition_id() >= 0, F.col("formatted") != F.col(text))
    return format_corpus(docs.withColumn(text, plain), options, text).where(differs).select(key)


def auto(options: Format = FILES) -> Format:
    """What --auto sets; width and list spacing stay."""
    return replace(AUTO, width=options.width, list_spacing=options.list_spacing)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 15) -> DataFrame:
    """(key, sid, text, start, end), a row for each sentence."""
    at = spread(docs).select(key, F.posexplode(udfs.sentence_spans(min_length)(F.col(text))).alias("sid", "s"))
    return at.select(key, "sid", "s.text", "s.start", "s.end")


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    at = spread(docs).select(key, F.posexplode(udfs.atomic_words()(F.col(text))).alias("pos", "w"))
    return at.select(key, "pos", "w.text", "w.start", "w.end")


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return spread(docs).select(key, F.inline(udfs.blocks()(F.col(text))))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", include_autolinks: bool = True, include_images: bool = False) -> DataFrame:
    at = spread(docs).select(key, F.posexplode(udfs.links(include_autolinks, include_images)(F.col(text))).alias("ord", "l"))
    return at.select(key, "ord", "l.text", "l.url", "l.title")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(native.lines(F.col(text))).alias("line_no", "line"))


def link_labels(links_: DataFrame, refs: DataFrame) -> DataFrame:
    """Each link with the first label that is defined with its target and title in the same document, if any."""
    first = refs.groupBy("doc_id", "dest", F.coalesce("title", F.lit("")).alias("t")).agg(F.min_by("label", "ord").alias("label"))
    keyed = links_.withColumn("t", F.coalesce("title", F.lit("")))
    return keyed.join(first.withColumnRenamed("dest", "url").hint("merge"), ["doc_id", "url", "t"], "left").drop("t")


def tight_lists(blocks_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, node_id, n_items, can_be_tight) of every list in a block table: it can be tight if no item holds more than one block."""
    held = blocks_.groupBy(key, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    items = blocks_.where("type = 'item'").join(held.hint("merge"), [key, "node_id"], "left").select(key, F.col("parent_id").alias("node_id"), F.coalesce("n", F.lit(0)).alias("n"))
    return items.groupBy(key, "node_id").agg(F.count(F.lit(1)).alias("n_items"), (F.max("n") <= 1).alias("can_be_tight"))


def timing_stats(times: DataFrame, by: str = "run", value: str = "seconds") -> DataFrame:
    v = F.col(value)
    return times.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_samp(v).alias("stdev"))
