"""What a document refers to, as relations: one parse gives tagged rows, and SQL resolves them.

Definitions are looked up as Markdown has it: the first definition of a label in a document wins, whatever its case and white space. Links and images by reference carry a label and get
their destination from the label's window; those written inline keep their own. A document's rows meet once, in one partition, and all windows and groupings are within it: texts are parsed
once and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import native, udfs
from textloom.operators.corpus import spread, together

KINDS = ("definition", "link", "image", "note", "note_ref")


def reference_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, ord, label, dest, title, text, inside): see KINDS. Parsed once, whatever is asked of it."""
    return spread(docs).select(key, F.inline(udfs.references()(F.col(text))))


def definitions(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, dest, title, times): each label's first definition, and how many there are."""
    own = rows.where(F.col("kind") == "definition")
    first = own.groupBy(key, "label").agg(F.min_by(F.struct("dest", "title"), "ord").alias("first"), F.count(F.lit(1)).alias("times"))
    return first.select(key, "label", "first.dest", "first.title", "times")


def resolved(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, ord, label, dest, title, text, inside) of links and images with their destinations."""
    own = together(rows.where(F.col("kind").isin("definition", "link", "image")), key)
    defines = (F.col("kind") == "definition") & F.col("label").isNotNull()
    first = F.min_by(F.when(defines, F.struct("dest", "title")), F.when(defines, F.col("ord"))).over(W.partitionBy(key, "label"))
    met = own.withColumn("said", first).where(F.col("kind") != "definition")
    return met.select(key, "kind", "ord", "label", F.coalesce("dest", "said.dest").alias("dest"), F.coalesce("title", "said.title").alias("title"), "text", "inside")


def inlined(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, image, link): every image as it is written inline, and the destination of the link around it, if there is one."""
    is_link = F.col("kind") == "link"
    all_ = resolved(rows, key).withColumn("around", F.when(is_link, F.col("ord")).otherwise(F.col("inside")))
    link = F.max(F.when(is_link, F.col("dest"))).over(W.partitionBy(key, "around"))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" "), native.quoted_title(F.col("title")))).otherwise("")
    image = F.concat(F.lit("!["), "text", F.lit("]("), "dest", title, F.lit(")"))
    return all_.withColumn("link", link).where(F.col("kind") == "image").select(key, "ord", image.alias("image"), "link")


def notes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, text, number, marks): each note's first text, its number by the order of first marks, and how often it is marked; notes without marks have no number."""
    own = together(rows.where(F.col("kind").isin("note", "note_ref")), key)
    is_note, is_mark = F.col("kind") == "note", F.col("kind") == "note_ref"
    each = own.groupBy(key, "label").agg(
        F.min_by(F.when(is_note, F.col("text")), F.when(is_note, F.col("ord"))).alias("text"),
        F.count_if(is_note).alias("notes"),
        F.count_if(is_mark).alias("marks"),
        F.min(F.when(is_mark, F.col("ord"))).alias("first"),
    )
    rank = F.rank().over(W.partitionBy(key).orderBy(F.col("first").asc_nulls_last()))
    numbered = each.withColumn("number", F.when(F.col("first").isNotNull(), rank).cast("int"))
    return numbered.where("notes > 0").select(key, "label", "text", "number", "marks")


def unused(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label) of definitions that nothing refers to."""
    defined = F.count_if(F.col("kind") == "definition").alias("defined")
    said = F.count_if(F.col("kind").isin("link", "image")).alias("said")
    return together(rows.where(F.col("label").isNotNull()), key).groupBy(key, "label").agg(defined, said).where("defined > 0 AND said = 0").select(key, "label")
