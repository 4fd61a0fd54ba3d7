"""Markdown: block and inline parsing by the CommonMark and GFM rules, normalised rendering, inspection and rewrites."""

from textloom.functions.markdown.nodes import Link, Node
from textloom.functions.markdown.parse import parse
from textloom.functions.markdown.render import render
from textloom.functions.markdown.tree import block_table, extract_links, reference_table, walk

__all__ = ["Link", "Node", "block_table", "extract_links", "parse", "reference_table", "render", "walk"]
