"""Parsing, rendering, inspection and whole documents."""

import pytest

from textloom.functions.formatting import AUTO, Format, fill_markdown, reformat
from textloom.functions.markdown import block_table, extract_links, parse

CASES = [
    ("> [!note]\n> hello", "> [!NOTE]\n> hello\n"),
    ("***", "* * *\n"),
    ("- a\n- b\n\n- c", "- a\n\n- b\n\n- c\n"),
    ("3) x\n4) y", "3. x\n4. y\n"),
    ("[x]\n\n[x]: http://a.b 'T'", '[x][]\n\n[x]: http://a.b "T"\n'),
    ("a ~b~ ~~c~~ ~60 s, ~130", "a ~~b~~ ~~c~~ ~60 s, ~130\n"),
    ("Head\n===\npara  \nhard", "# Head\n\npara\\\nhard\n"),
    ("| a | b |\n|:--|--:|\n| 1 | 2\\|3 |", "| a | b |\n| :--- | ---: |\n| 1 | 2\\|3 |\n"),
    ("````\n```\n````", "````\n```\n````\n"),
    ("x\n\n    code", "x\n\n```\ncode\n```\n"),
    ("1\\. no list and 2\\. neither", "1\\. no list and 2. neither\n"),
    ("- [ ] a\n- [x] b", "- [ ] a\n- [x] b\n"),
    ("t[^1]\n\n[^1]: note\n    more", "t[^1]\n\n[^1]: note more\n\n"),
    ("* a\n  * b\n* c", "* a\n  * b\n* c\n"),
    ("<div>\nhi\n</div>", "<div> hi </div>\n"),
    ("*a _b_* __c__", "*a *b** **c**\n"),
    ("> q\nlazy", "> q lazy\n"),
    ("漢字abc", "漢字 abc\n"),
    ("`` `x ``", "`` `x ``\n"),
]


@pytest.mark.parametrize("text,out", CASES)
def test_rendering(text, out):
    assert fill_markdown(text) == out
    assert fill_markdown(out) == out


def test_passes():
    assert fill_markdown("# **A**\n\n## ***b***", cleanups=True) == "# A\n\n## *b*\n\n"
    assert fill_markdown('Say "the `x`" and *it\'s*', smartquotes=True) == "Say “the `x`” and *it’s*\n"
    assert fill_markdown("a...b `c...d`", ellipses_=True) == "a … b `c...d`\n"
    assert fill_markdown("---\nk: v\n---\n\n  x") == "---\nk: v\n---\nx\n"
    assert reformat("It's...so\n\n\nx", Format(plaintext=True)) == "It's...so\n\nx"
    assert reformat('# **T**\n\n"A" b...', AUTO) == "# T\n\n“A” b …\n"


def test_list_spacing():
    assert fill_markdown("- a\n- b", list_spacing="loose") == "- a\n\n- b\n"
    assert fill_markdown("- a\n\n- b", list_spacing="tight") == "- a\n- b\n"


def test_spans_and_links():
    text = "# H\n\n- a\n- b\n\nsee [t](u \"q\"), <http://x.y>, ![i](j) and http://z.w.\n"
    rows = block_table(parse(text))
    assert [r["type"] for r in rows if r["type"] != "blank"] == ["document", "heading", "list", "item", "paragraph", "item", "paragraph", "paragraph"]
    assert rows[0]["end"] == len(text) and text[rows[1]["start"] : rows[1]["end"]] == "# H\n"
    assert extract_links(parse(text)) == [("t", "u", "q"), ("http://x.y", "http://x.y", None), ("http://z.w", "http://z.w", None)]
    assert ("i", "j", None) in extract_links(parse(text), include_images=True)


WORST = {
    "quotes": ">" * 10_000 + " a", "lists": "".join("  " * k + "- a\n" for k in range(150)), "lazy": "> a\n" + "lazy line here\n" * 1300, "lazy in quotes": "> > a\nlazy\n" * 1800, "closing": "a* " * 6500, "opening": "*a " * 6500,
    "ticks": "`" * 20_000, "single ticks": "` " * 10_000, "growing ticks": "".join("`" * k + "a" for k in range(190)), "stars": "*" * 8000 + "a" + "*" * 8000, "images": "![" * 3000 + "](a)" * 3000, "brackets": "[" * 20_000, "tags": "{%" * 10_000, "comments": "<!--" * 5000,
    "open links": "[a](" * 5000, "open destinations": "[a](b " * 3500, "nested parentheses": "[a](" + "(" * 20_000, "pairs": "a*b*" * 5000, "open comments": "<!-- " * 4000, "instructions": "<? " * 6000, "tildes": "~a ~~b " * 3000, "dots": "a." * 10_000,
}


FAST = {"open links", "open destinations", "nested parentheses", "pairs", "open comments"}


@pytest.mark.parametrize("name", WORST)
def test_worst_cases_take_no_time(name):
    """About 20 KB each; nesting beyond the limit is text."""
    import sys
    import time

    from textloom.functions.formatting import RECURSION

    before = sys.getrecursionlimit()
    sys.setrecursionlimit(RECURSION)
    try:
        began = time.process_time()
        assert reformat(WORST[name], AUTO)
        assert time.process_time() - began < (0.75 if name in FAST else 3)
    finally:
        sys.setrecursionlimit(before)


def test_blocks_need_no_inlines(monkeypatch):
    from textloom.functions.markdown import block_table, parse
    import sys

    text = "# a *b*\n\n- c `d`\n  1. [e](f)\n\n| g | h |\n|--|--|\n| *i* | j |\n\n[k]: l\n"
    want = block_table(parse(text))
    monkeypatch.setattr(sys.modules["textloom.functions.markdown.parse"], "parse_inlines", None)
    assert block_table(parse(text, inlines=False)) == want
