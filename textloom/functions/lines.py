"""Tests and repairs of single lines: table rows, list items, template tags."""

from __future__ import annotations

import re

from textloom.functions.patterns import TABLE_SEPARATOR, TAG_MARKS

OPENS = tuple(o for o, _, _ in TAG_MARKS.values())
CLOSES = tuple(c for _, c, _ in TAG_MARKS.values())
_ITEM = re.compile(r"(?:[-*+]|[0-9]{1,9}[.)])[ \t]")
_SEPARATOR = re.compile(TABLE_SEPARATOR)
_AFTER_CLOSE = re.compile("|".join(re.escape(c) + r"\s*(?P<t%d>" % k + re.escape(o) + r"\s*/)" for k, (o, c) in enumerate(zip(OPENS, CLOSES))))


def is_table_row(line: str) -> bool:
    return line.lstrip().startswith("|")


def is_list_item(line: str) -> bool:
    return _ITEM.match(line.lstrip()) is not None


def is_block(line: str) -> bool:
    return is_table_row(line) or is_list_item(line)


def is_table_separator(line: str) -> bool:
    return _SEPARATOR.match(line.strip()) is not None


def alignment_mark(cell: str) -> str:
    return ":" * cell.startswith(":") + "---" + ":" * cell.endswith(":")


def normal_separator(line: str) -> str:
    """A separator row with three dashes in each cell; any other line as it is."""
    if not is_table_separator(line):
        return line
    cells = line.strip()[1:].removesuffix("|").split("|")
    return "| " + " | ".join(alignment_mark(c.strip()) for c in cells) + " |"


def starts_with_tag(line: str) -> bool:
    return line.lstrip().startswith(OPENS)


def ends_with_tag(line: str) -> bool:
    return line.rstrip().endswith(CLOSES)


def is_tag_at_margin(line: str) -> bool:
    return not line[:1].isspace() and starts_with_tag(line)


def is_tag_only(line: str) -> bool:
    return is_tag_at_margin(line) and ends_with_tag(line)


def is_closing_tag(line: str) -> bool:
    return line.lstrip().startswith(tuple(o + " /" for o in OPENS))


def is_long_comment(text: str) -> bool:
    """One HTML comment over several lines and nothing else."""
    t = text.strip()
    return "\n" in t and t.startswith("<!--") and t.endswith("-->") and t.find("-->") == len(t) - 3


def indented(text: str, first: str, rest: str) -> str:
    a, *more = text.split("\n")
    return "\n".join([first + a, *(rest + x for x in more)])


def space_tag_blocks(text: str) -> str:
    """A blank line where a line with nothing but a tag meets a list item or a table row."""
    if not any(o in text for o in OPENS):
        return text
    lines = text.split("\n")
    tags = [is_tag_only(x) for x in lines]
    if not any(tags):
        return text
    blocks = [is_block(x) for x in lines]
    out = lines[:1]
    for k in range(1, len(lines)):
        if (tags[k - 1] and blocks[k]) or (blocks[k - 1] and tags[k]):
            out.append("")
        out.append(lines[k])
    return "\n".join(out)


def settle_closing_tags(text: str) -> str:
    """Closing tags at the margin, a blank line between them and a list or table before."""
    out: list[str] = []
    for line in text.split("\n"):
        if is_closing_tag(line):
            if out and is_block(out[-1]):
                out.append("")
            line = line.lstrip()
        out.append(line)
    return "\n".join(out)


def split_long_tags(text: str) -> str:
    """Where a tag opened on an earlier line ends, its closing tag gets a line of its own."""
    if "\n" not in text:
        return text
    first, *rest = text.split("\n")
    out = [first]
    for line in rest:
        m = None if starts_with_tag(line) else _AFTER_CLOSE.search(line)
        if m:
            at = m.start(m.lastgroup)
            out += [line[:at].rstrip(), line[at:].lstrip()]
        else:
            out.append(line)
    return "\n".join(out)
