"""textloom: formatting and analysing corpora of Markdown and plain text with Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from textloom.functions.formatting import AUTO, FILES, Format, fill_markdown, reformat
from textloom.functions.frontmatter import has_frontmatter, split_frontmatter
from textloom.functions.markdown.parse import parse
from textloom.functions.markdown.tree import block_table, extract_links, inline_text, rewrite_across, rewrite_texts, transform_tree, walk
from textloom.functions.typography import ellipses, smart_quotes
from textloom.functions.words import atomic_spans, atomic_words, first_sentence, first_sentences, markup_words, sentence_spans, split_sentences
from textloom.functions.wrap import Wrapper, by_sentence, by_width, fill_text, wrap_lines, wrap_text

__all__ = [
    "AUTO", "FILES", "Format", "Wrapper", "atomic_spans", "atomic_words", "block_table", "by_sentence", "by_width", "ellipses", "extract_links",
    "fill_markdown", "fill_text", "first_sentence", "first_sentences", "has_frontmatter", "inline_text", "markup_words", "parse", "reformat",
    "rewrite_across", "rewrite_texts", "sentence_spans", "ship", "ship_if_missing", "smart_quotes", "split_frontmatter", "split_sentences", "transform_tree", "walk", "wrap_lines", "wrap_text",
]


def formatting_docs() -> str:
    return fill_markdown.__doc__ or ""


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, for sessions whose executors don't have it installed."""
    here = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(), "textloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("textloom", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(at)


_SHIPPED: set[str] = set()


def ship_if_missing(spark: SparkSession) -> None:
    """Ship the package unless the session's Python workers find it; asked once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)

    def found(_):
        import importlib.util

        return importlib.util.find_spec("textloom") is not None

    if not spark.sparkContext.parallelize([0], 1).map(found).first():
        ship(spark)
