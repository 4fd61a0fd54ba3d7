"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table
from textloom.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.licence import scan_licences, train

    docs = table(spark, sf_dir, "documents")
    out = scan_licences(docs, train(docs))
    return out.select("doc_id", F.array_join("families", ",").alias("families"), F.size("paragraphs").cast("long").alias("n_paragraphs"), "probability", "suspected")


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.toxicity import fold, score_documents, train

    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.passages import passage_classes

    return passage_classes(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.simhash import near_duplicate_groups

    out = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_rows")


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.decontaminate import find_contamination, merged_spans

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(merged_spans(), F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "row.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.pii import BASE, KINDS, find_pii, spans_text

    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("row.doc_id", *[count(k) for k, kind in enumerate(KINDS) if kind in BASE], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op9_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.preference import next_reply_pairs, preference_format

    return preference_format(*next_reply_pairs(table(spark, sf_dir, "conversations")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.suffixdedup import remove_duplicate_spans

    return remove_duplicate_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.prefixtrie import prefix_trie, turn_paths, with_shared_starts

    return prefix_trie(with_shared_starts(turn_paths(table(spark, sf_dir, "conversations"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.periodic import longest, periodic_runs, with_planted_runs

    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), ["doc_id"]).withColumn("best", longest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.jaccardjoin import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


# Parts of op3's and op8's results, which SQL can say.


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pii_boosting(spark, sf_dir).drop("spans")


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_toxicity_grammar, op3_quality_rules, op4_compact_windows, op5_simhash_near_dedup, op6_pareto_mixing, op7_benchmark_decontamination, op8_pii_boosting, op9_preference_formatting, op10_suffix_array_dedup, op11_conversation_prefix_trie, op12_periodic_runs, op13_ngram_jaccard_join, quality_base_counts, pii_base_spans)}
