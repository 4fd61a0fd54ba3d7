"""Whole documents: Markdown or plain text in, formatted text out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from textwrap import dedent

from textloom.functions.frontmatter import split_frontmatter
from textloom.functions.lines import space_tag_blocks
from textloom.functions.markdown import parse, render
from textloom.functions.markdown.nodes import Node
from textloom.functions.markdown.tree import rewrite_across, rewrite_texts, transform_tree, unbold_headings
from textloom.functions.patterns import WIDTH
from textloom.functions.typography import ellipses, smart_quotes
from textloom.functions.wrap import Wrapper, by_sentence, by_width, fill_text


#: Frames that the deepest emphasis may take; a worker's limit is set to it.
RECURSION = 20_000


@dataclass(frozen=True)
class Format:
    """Options of formatting. The defaults are those of the function on texts: sentences and cleanups."""

    width: int = WIDTH
    plaintext: bool = False
    semantic: bool = True
    cleanups: bool = True
    smartquotes: bool = False
    ellipses: bool = False
    list_spacing: str = "preserve"


#: Files are formatted without sentence breaks unless asked for; `auto` asks for everything.
FILES = Format(semantic=False)
AUTO = replace(FILES, semantic=True, cleanups=True, smartquotes=True, ellipses=True)


def fill_markdown(text: str, width: int = WIDTH, semantic: bool = False, cleanups: bool = False, smartquotes: bool = False, ellipses_: bool = False, wrapper: Wrapper | None = None, list_spacing: str = "preserve", dedent_input: bool = True, transform: Callable[[Node], None] | None = None, rewrite: Callable[[str], str] | None = None) -> str:
    """The passes in order: frontmatter, dedent, tag spacing, parse, cleanups, quotes, ellipses, render. Before it renders come transform, on every container, and rewrite, on every text."""
    wrapper = wrapper or (by_sentence if semantic else by_width)(width=width, markdown=True)
    front, content = split_frontmatter(text)
    body = content if front else text
    body = (dedent(body) if dedent_input else body).strip() + "\n"
    doc = parse(space_tag_blocks(body))
    if cleanups:
        unbold_headings(doc)
    if smartquotes:
        rewrite_across(doc, smart_quotes)
    if ellipses_:
        rewrite_texts(doc, ellipses, coalesce=True)
    if transform:
        transform_tree(doc, transform)
    if rewrite:
        rewrite_texts(doc, rewrite)
    return front + render(doc, wrapper, list_spacing)


def reformat(text: str, options: Format = Format()) -> str:
    if options.plaintext:
        return fill_text(text, "wrap", options.width)
    o = options
    return fill_markdown(text, o.width, o.semantic, o.cleanups, o.smartquotes, o.ellipses, None, o.list_spacing)
