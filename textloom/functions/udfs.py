"""The text functions that need a parser or one pass over overlapping rules: Arrow-batched columns, and their SQL names."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.functions import formatting, lines, typography, words, wrap
from textloom.functions.markdown import block_table, extract_links, parse, reference_table
from textloom.functions.markdown.tree import segment_table
from textloom.functions.patterns import MIN_SENTENCE, PROSE, WIDTH, WRAPPING
from textloom.functions.tables import register_tables

WORD = "array<struct<text:string,start:int,end:int>>"
SPAN = "array<struct<text:string,start:int,end:int,is_atomic:boolean,name:string>>"
BLOCK = "array<struct<node_id:int,parent_id:int,ord:int,depth:int,type:string,start:int,end:int>>"
REFERENCE = "array<struct<kind:string,ord:int,label:string,dest:string,title:string,text:string,inside:int>>"
LINK = "array<struct<text:string,url:string,title:string>>"


class per_text:  # noqa: N801
    """A column function of one text; null stays null. It becomes a UDF when it is first used, as that takes a session."""

    def __init__(self, fn: Callable, kind: str):
        self.fn, self.kind = fn, kind

    def udf(self):
        fn = self.fn

        @F.pandas_udf(self.kind)
        def run(texts: pd.Series) -> pd.Series:
            # Emphasis and images nest as deep as a text likes.
            sys.setrecursionlimit(max(sys.getrecursionlimit(), formatting.RECURSION))
            return pd.Series([None if t is None else fn(t) for t in texts], dtype=object)

        return run

    def __call__(self, text):
        return self.udf()(text)


def _dicts(rows) -> list[dict]:
    return [r._asdict() for r in rows]


def atomic_spans(constructs=WRAPPING):
    return per_text(lambda t: _dicts(words.atomic_spans(t, constructs)), SPAN)


def atomic_words(constructs=WRAPPING):
    return per_text(lambda t: _dicts(words.atomic_words(t, constructs)), WORD)


def sentence_spans(min_length: int = MIN_SENTENCE, heuristic=words.ends_sentence, constructs=PROSE):
    return per_text(lambda t: _dicts(words.sentence_spans(t, min_length, heuristic, constructs)), WORD)


def markup_words():
    return per_text(words.markup_words, "array<string>")


def wrap_text(width: int = WIDTH, first: str = "", rest: str = "", markdown: bool = False, splitter=words.markup_words, len_fn=len):
    return per_text(lambda t: wrap.wrap_text(t, width, first, rest, splitter=splitter, len_fn=len_fn, markdown=markdown), "string")


def fill_text(style: str = "wrap", width: int = WIDTH, splitter=words.markup_words, len_fn=len):
    return per_text(lambda t: wrap.fill_text(t, style, width, splitter=splitter, len_fn=len_fn), "string")


def wrap_by_sentence(width: int = WIDTH, min_line: int = wrap.MIN_LINE, markdown: bool = False):
    run = wrap.by_sentence(width=width, min_line=min_line, markdown=markdown)
    return per_text(lambda t: run(t, "", ""), "string")


def wrap_by_width(width: int = WIDTH, markdown: bool = True, first: str = "", rest: str = ""):
    run = wrap.by_width(width, markdown=markdown)
    return per_text(lambda t: run(t, first, rest), "string")


def tag_segments():
    return per_text(wrap.tag_segments, "array<string>")


def smart_quotes():
    return per_text(typography.smart_quotes, "string")


def ellipses():
    return per_text(typography.ellipses, "string")



def reformat(options: formatting.Format = formatting.Format()):
    return per_text(lambda t: formatting.reformat(t, options), "string")


def fill_markdown(**options):
    return per_text(lambda t: formatting.fill_markdown(t, **options), "string")


def blocks():
    return per_text(lambda t: block_table(parse(t, inlines=False)), BLOCK)


def links(include_autolinks: bool = True, include_images: bool = False):
    return per_text(lambda t: _dicts(extract_links(parse(t), include_autolinks, include_images)), LINK)


def references():
    return per_text(lambda t: reference_table(parse(t)), REFERENCE)


def segments():
    return per_text(lambda t: segment_table(parse(t)), "array<struct<scope:int,ord:int,text:string,fixed:boolean>>")


def space_tag_blocks():
    return per_text(lines.space_tag_blocks, "string")


def register(spark: SparkSession) -> None:
    """SQL names of the functions, with their default options, and of the table functions."""
    for name, fn in {
        "loom_reformat": reformat(), "loom_reformat_plain": reformat(formatting.Format(plaintext=True)), "loom_fill_markdown": fill_markdown(), "loom_fill_text": fill_text(),
        "loom_smart_quotes": smart_quotes(), "loom_ellipses": ellipses(), "loom_blocks": blocks(), "loom_links": links(), "loom_sentences": sentence_spans(), "loom_words": atomic_words(), "loom_spans": atomic_spans(),
    }.items():
        spark.udf.register(name, fn.udf())
    register_tables(spark)
