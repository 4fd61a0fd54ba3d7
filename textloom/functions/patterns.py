"""Fixed values of the text engine: constructs that stay whole, tag marks and sentence ends.

Patterns use named groups only, so that they can stand side by side in one alternation.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Construct(NamedTuple):
    """An inline construct that is never broken across lines."""

    name: str
    pattern: str


def paired(name: str, opening: str, closing: str, stop: str) -> Construct:
    """An opening tag with its closing one right behind it, which starts with a slash; neither holds `stop`."""
    o, c, x = re.escape(opening), re.escape(closing), re.escape(stop)
    return Construct(name, rf"{o}(?!\s*/)[^{x}]*{c}\s*{o}\s*/[^{x}]*{c}")


# What counts as a construct. Marks of template tags: opening, closing, and the character that a paired tag may not hold.
TAG_MARKS = {
    "jinja_tag": ("{%", "%}", "%"),
    "jinja_comment": ("{#", "#}", "#"),
    "jinja_var": ("{{", "}}", "}"),
    "html_comment": ("<!--", "-->", "-"),
}
CODE_SPAN = Construct("inline_code_span", r"(?P<ticks>`+)(?:(?!(?P=ticks)).)+(?P=ticks)")
LINK = Construct("markdown_link", r"\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])?")
AUTOLINK = Construct("autolink", r"<[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>]*>|<[^\s<>@]+@[^\s<>]+>")
BARE_URL = Construct("bare_url", r"(?:https?://|www\.)[^\s<>]*[^\s<>?!.,:;*_~'\")\]]")
PAIRED_TAGS = (
    *(paired(f"paired_{kind}", *TAG_MARKS[kind]) for kind in ("jinja_tag", "jinja_comment", "jinja_var")),
    Construct("paired_html_comment", r"<!--(?!\s*/)[^-]*(?:-[^-]+)*-->\s*<!--\s*/[^-]*(?:-[^-]+)*-->"),
)
SINGLE_TAGS = (
    Construct("single_jinja_tag", r"\{%.*?%\}"),
    Construct("single_jinja_comment", r"\{#.*?#\}"),
    Construct("single_jinja_var", r"\{\{.*?\}\}"),
    Construct("single_html_comment", r"<!--.*?-->"),
)
HTML_TAGS = (Construct("html_open_tag", r"<[a-zA-Z][^>]*>"), Construct("html_close_tag", r"</[a-zA-Z][^>]*>"))

#: For wrapping, and for prose. Earlier ones win.
WRAPPING = (CODE_SPAN, LINK, *PAIRED_TAGS, *SINGLE_TAGS, *HTML_TAGS)
PROSE = (CODE_SPAN, LINK, AUTOLINK, BARE_URL)

#: The last word of a sentence: two letters or more, the last one lower case, then a mark, with a closing quote on either side of it.
#: Written without \b, so that Python, Java and RE2 agree.
SENTENCE_END = r"(?:^|[^\p{L}\p{M}\p{N}_])\p{L}+\p{Ll}(?:[.?!]['\"’”)]?|['\"’”)][.?!]) *$"

TABLE_SEPARATOR = r"^\|(\s*:?-+:?\s*\|)+\s*$"
WIDTH, MIN_LINE, MIN_SENTENCE, INDENT = 88, 20, 15, "    "
