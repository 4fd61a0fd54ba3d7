"""Table functions for SQL: blocks, links, references, sentences and words of a text in LATERAL joins.

Their columns depend on constant arguments, which `analyze` reads: SELECT d.id, w.* FROM docs d, LATERAL loom_word_rows(d.text, places => true) w.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from textloom.functions import words
from textloom.functions.formatting import RECURSION
from textloom.functions.markdown import block_table, extract_links, parse, reference_table
from textloom.functions.patterns import MIN_SENTENCE, WRAPPING

_NUMBER, _TEXT = T.IntegerType(), T.StringType()
_PLACES = [T.StructField("start", _NUMBER), T.StructField("end", _NUMBER)]


def _said(argument: AnalyzeArgument | None, name: str, kind: type, default):
    """A constant argument's value."""
    if argument is None:
        return default
    if not argument.isConstantExpression or not isinstance(argument.value, kind):
        raise ValueError(f"{name} has to be a constant of type {kind.__name__}")
    return argument.value


def _checked(text: AnalyzeArgument) -> None:
    if not isinstance(text.dataType, (T.StringType, T.NullType)):
        raise ValueError(f"text has to be a string, not {text.dataType.simpleString()}")


def _deep() -> None:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION))


class WordRows:
    """pos, word and, with places, start and end."""

    @staticmethod
    def analyze(text: AnalyzeArgument, places: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(text)
        return AnalyzeResult(T.StructType([T.StructField("pos", _NUMBER), T.StructField("word", _TEXT), *(_PLACES if _said(places, "places", bool, False) else [])]))

    def eval(self, text, places=False):
        for k, w in enumerate(words.atomic_words(text or "", WRAPPING)):
            yield (k, w.text, w.start, w.end) if places else (k, w.text)


class SentenceRows:
    """sid, sentence and, with places, start and end. min_length: what a sentence has to hold before it may end."""

    @staticmethod
    def analyze(text: AnalyzeArgument, min_length: AnalyzeArgument | None = None, places: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(text)
        _said(min_length, "min_length", int, MIN_SENTENCE)
        return AnalyzeResult(T.StructType([T.StructField("sid", _NUMBER), T.StructField("sentence", _TEXT), *(_PLACES if _said(places, "places", bool, False) else [])]))

    def eval(self, text, min_length=MIN_SENTENCE, places=False):
        for k, s in enumerate(words.sentence_spans(text or "", min_length)):
            yield (k, s.text, s.start, s.end) if places else (k, s.text)


class BlockRows:
    """The block table: node_id, parent_id, ord, depth, type, start, end and, with source, the block's text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, source: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(text)
        own = [T.StructField("source", _TEXT)] if _said(source, "source", bool, False) else []
        return AnalyzeResult(T.StructType([*(T.StructField(c, _NUMBER) for c in ("node_id", "parent_id", "ord", "depth")), T.StructField("type", _TEXT), *_PLACES, *own]))

    def eval(self, text, source=False):
        if text is None:
            return
        _deep()
        plain = text.replace("\r\n", "\n")
        for b in block_table(parse(text, inlines=False)):
            yield (*b.values(), plain[b["start"] : b["end"]]) if source else tuple(b.values())


class LinkRows:
    """ord, text, url, title."""

    @staticmethod
    def analyze(text: AnalyzeArgument, images: AnalyzeArgument | None = None) -> AnalyzeResult:
        _checked(text)
        _said(images, "images", bool, False)
        return AnalyzeResult(T.StructType([T.StructField("ord", _NUMBER), *(T.StructField(c, _TEXT) for c in ("text", "url", "title"))]))

    def eval(self, text, images=False):
        _deep()
        for k, link in enumerate(extract_links(parse(text), include_images=images) if text is not None else []):
            yield (k, *link)


class ReferenceRows:
    """kind, ord, label, dest, title, text, inside: definitions, links, images, notes and their marks."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _checked(text)
        kinds = {"ord": _NUMBER, "inside": _NUMBER}
        return AnalyzeResult(T.StructType([T.StructField(c, kinds.get(c, _TEXT)) for c in ("kind", "ord", "label", "dest", "title", "text", "inside")]))

    def eval(self, text):
        _deep()
        for row in reference_table(parse(text)) if text is not None else []:
            yield tuple(row.values())


TABLES = {"loom_word_rows": WordRows, "loom_sentence_rows": SentenceRows, "loom_block_rows": BlockRows, "loom_link_rows": LinkRows, "loom_reference_rows": ReferenceRows}


def register_tables(spark: SparkSession) -> None:
    for name, cls in TABLES.items():
        spark.udtf.register(name, udtf(cls))
