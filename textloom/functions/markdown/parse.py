"""Block parsing. Containers take their lines off the source, strip their marks and parse what is left; a line knows its place in the source."""

from __future__ import annotations

import re
from typing import NamedTuple

from textloom.functions.markdown.inline import normal_label, parse_inlines
from textloom.functions.markdown.nodes import Node


class Line(NamedTuple):
    text: str  # without its end
    at: int  # of text in the source
    end: int  # of the whole line in the source, its end included


_THEMATIC = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_QUOTES = re.compile(r"(?: {0,3}> ?)*")
_ITEM = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])(?:( +)(?=\S)|( *)$)")
_NOTE = re.compile(r" {0,3}\[\^([^\s\]]+)\]:[ \t]*")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_REF = re.compile(r" {0,3}\[((?:\\.|[^\[\]\\])*[^\s\[\]\\](?:\\.|[^\[\]\\])*)\]:\s*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]*(?<=[\s])(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t]*(?:\n|$)")
_ALERT = re.compile(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]\s*$", re.IGNORECASE)


#: What all blocks but tables and paragraphs begin with, behind spaces.
_MARKS = "*-_#`~>+[0123456789"

#: Containers inside one another; marks further in are text.
MAX_DEPTH = 100


class Taken(list):
    """A container's lines so far, and how many of them are known to end inside a paragraph or not."""

    known, is_open = 0, False


def _indent(s: str) -> int:
    return len(s) - len(s.lstrip(" "))


def _cut(line: Line, n: int) -> Line:
    return Line(line.text[n:], line.at + n, line.end)


class Parser:
    def __init__(self, depth: int = 0):
        self.depth = depth
        self.refs: dict[str, tuple[str, str | None, str]] = {}
        self.notes: set[str] = set()
        self.inline: list[Node] = []  # blocks whose text is parsed at the end, when all references are known

    def starts_block(self, line: str) -> bool:
        """Whether the line can interrupt a paragraph."""
        if line.lstrip(" ")[:1] not in _MARKS:
            return False
        if _THEMATIC.match(line) or _ATX.match(line) or _QUOTE.match(line) or _NOTE.match(line):
            return True
        m = _FENCE.match(line)
        if m and not (m[2][0] == "`" and "`" in m[3]):
            return True
        m = _ITEM.match(line)
        return bool(m and m[3] and (m[2] in "-+*" or m[2][:-1] == "1"))

    def ends_open(self, lines: Taken) -> bool:
        """Whether lines end inside a paragraph, which a following plain line then continues."""
        if not lines or not lines[-1].text.strip():
            return False
        if not (lines.is_open and all(self.goes_on(x.text) for x in lines[lines.known :])):
            lines.is_open = self.probed_open(lines)
        lines.known = len(lines)
        return lines.is_open

    def goes_on(self, line: str) -> bool:
        """Whether, after an open paragraph, the line leaves one open for sure: it goes on with it, or quotes deeper and begins one there."""
        bare = line[_QUOTES.match(line).end() :]
        if len(bare) < len(line) and (_indent(bare) >= 4 or bare.lstrip()[:1] == "[" or "|" in bare):
            return False
        return bool(bare.strip()) and not _SETEXT.match(bare) and not self.starts_block(bare)

    def probed_open(self, lines: list[Line]) -> bool:
        probe = Parser(self.depth + 1)
        nodes = probe.blocks(lines)
        while nodes and nodes[-1].kind in ("quote", "alert", "list", "item", "footnote"):
            nodes = nodes[-1].children
        return bool(nodes) and nodes[-1].kind == "paragraph"

    def inside(self, lines: list[Line]) -> list[Node]:
        self.depth += 1
        out = self.blocks(lines)
        self.depth -= 1
        return out

    def blocks(self, lines: list[Line]) -> list[Node]:
        out: list[Node] = []
        k = 0
        while k < len(lines):
            start = k
            made, k = self.block(lines, k)
            for n in made:
                if n.start < 0:
                    n.start, n.end = lines[start].at, lines[k - 1].end
            out += made
        return out

    def block(self, lines: list[Line], k: int) -> tuple[list[Node], int]:
        text = lines[k].text
        if not text.strip():
            while k < len(lines) and not lines[k].text.strip():
                k += 1
            return [Node("blank")], k
        if _indent(text) >= 4:
            return self.indented_code(lines, k)
        if text.lstrip(" ")[0] not in _MARKS:
            return self.table_or_paragraph(lines, k)
        if _THEMATIC.match(text):
            return [Node("thematic_break")], k + 1
        if m := _ATX.match(text):
            n = Node("heading", text=(m[2] or "").strip(), attrs={"level": len(m[1]), "setext": False})
            if re.fullmatch("#+", n.text):
                n.text = ""
            self.inline.append(n)
            return [n], k + 1
        m = _FENCE.match(text)
        if m and not (m[2][0] == "`" and "`" in m[3]):
            return self.fenced_code(lines, k, m)
        if self.depth < MAX_DEPTH:
            if _QUOTE.match(text):
                return self.quote(lines, k)
            if _ITEM.match(text):
                return self.list(lines, k)
            if m := _NOTE.match(text):
                return self.footnote(lines, k, m)
        return self.table_or_paragraph(lines, k)

    def table_or_paragraph(self, lines, k):
        text = lines[k].text
        if k + 1 < len(lines) and "|" in text and _DELIMITERS.match(lines[k + 1].text) and len(cells(text)) == len(cells(lines[k + 1].text)):
            return self.table(lines, k)
        return self.paragraph(lines, k)

    def indented_code(self, lines, k):
        own = []
        while k < len(lines) and (not lines[k].text.strip() or _indent(lines[k].text) >= 4):
            own.append(lines[k].text[4:])
            k += 1
        while not own[-1].strip():
            own.pop()
            k -= 1
        return [Node("code_block", text="\n".join(own) + "\n")], k

    def fenced_code(self, lines, k, m):
        depth, fence, info = len(m[1]), m[2], m[3]
        own = []
        k += 1
        while k < len(lines):
            c = re.match(r" {0,3}(~+|`+)[ \t]*$", lines[k].text)
            if c and fence in c[1]:
                k += 1
                break
            s = lines[k].text
            own.append(s[min(depth, _indent(s)) :])
            k += 1
        lang, _, extra = info.partition(" ")
        return [Node("fenced_code", text="".join(x + "\n" for x in own), attrs={"lang": re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", lang), "extra": extra.strip(), "fence": fence})], k

    def lazy(self, own: list[Line], line: Line) -> bool:
        return bool(line.text.strip()) and not self.starts_block(line.text) and self.ends_open(own)

    def quote(self, lines, k):
        own = Taken()
        first = k
        while k < len(lines):
            m = _QUOTE.match(lines[k].text)
            if m:
                own.append(_cut(lines[k], m.end()))
            elif self.lazy(own, lines[k]):
                own.append(_cut(lines[k], _indent(lines[k].text)))
            else:
                break
            k += 1
        alert = _ALERT.match(own[0].text.strip()) if len(own) > 1 else None
        kids = self.inside(own[1:] if alert else own)
        n = Node("alert" if alert else "quote", kids, attrs={"type": alert[1].upper()} if alert else {})
        n.start, n.end = lines[first].at, lines[k - 1].end
        return [n], k

    def list(self, lines, k):
        m = _ITEM.match(lines[k].text)
        mark = m[2][-1]
        ordered = m[2][:-1].isdigit() if len(m[2]) > 1 else False
        items: list[Node] = []
        tight, first, end = True, k, k
        while k < len(lines):
            m = _ITEM.match(lines[k].text)
            if not m or m[2][-1] != mark or (len(m[2]) > 1) != ordered or _THEMATIC.match(lines[k].text):
                break
            item, k = self.item(lines, k, m)
            tight = tight and not item.attrs.pop("loose")
            items.append(item)
            end = k
            while k < len(lines) and not lines[k].text.strip():
                k += 1
            nxt = k < len(lines) and _ITEM.match(lines[k].text)
            if k > end and nxt and nxt[2][-1] == mark and (len(nxt[2]) > 1) == ordered and not _THEMATIC.match(lines[k].text):
                tight = False
        start = int(_ITEM.match(lines[first].text)[2][:-1]) if ordered else 1
        n = Node("list", items, attrs={"ordered": ordered, "number": start, "bullet": mark, "tight": tight})
        n.start, n.end = lines[first].at, lines[end - 1].end
        return [n], end

    def item(self, lines, k, m):
        gap = len(m[3] or "")
        base = len(m[1]) + len(m[2])
        indent = base + (gap if 1 <= gap <= 4 else 1)
        first = k
        own = Taken([_cut(lines[k], min(indent, len(lines[k].text)))])
        k += 1
        while k < len(lines):
            s = lines[k].text
            if not s.strip():
                ahead = k
                while ahead < len(lines) and not lines[ahead].text.strip():
                    ahead += 1
                if ahead == len(lines) or _indent(lines[ahead].text) < indent or (len(own) == 1 and not own[0].text.strip()):
                    break
                own += [_cut(x, min(indent, len(x.text))) for x in lines[k:ahead]]
                k = ahead
                continue
            if _indent(s) >= indent:
                own.append(_cut(lines[k], indent))
            elif not _ITEM.match(s) and self.lazy(own, lines[k]):
                own.append(_cut(lines[k], _indent(s)))
            else:
                break
            k += 1
        kids = self.inside(own)
        if kids and kids[0].kind == "blank":
            kids = kids[1:]
        loose = any(x.kind == "blank" and 0 < j < len(kids) - 1 for j, x in enumerate(kids))
        if kids and kids[0].kind == "paragraph" and (box := re.match(r"\[([ xX])\](?=\s)", kids[0].text)):
            kids[0].attrs["checked"] = box[1] != " "
            kids[0].text = kids[0].text[3:]
        n = Node("item", kids, attrs={"loose": loose})
        n.start, n.end = lines[first].at, lines[k - 1].end
        return n, k

    def footnote(self, lines, k, m):
        label, first = m[1], k
        self.notes.add(normal_label(label))
        own = Taken([_cut(lines[k], m.end())])
        k += 1
        while k < len(lines):
            s = lines[k].text
            if not s.strip():
                ahead = k
                while ahead < len(lines) and not lines[ahead].text.strip():
                    ahead += 1
                if ahead == len(lines) or _indent(lines[ahead].text) < 4:
                    break
                own += [_cut(x, min(4, len(x.text))) for x in lines[k:ahead]]
                k = ahead
            elif _indent(s) >= 4:
                own.append(_cut(lines[k], 4))
                k += 1
            elif self.lazy(own, lines[k]):
                own.append(lines[k])
                k += 1
            else:
                break
        while k < len(lines) and not lines[k].text.strip():  # blank lines after a note belong to it
            k += 1
        n = Node("footnote", self.inside(own), attrs={"label": label})
        n.start, n.end = lines[first].at, lines[k - 1].end
        return [n], k

    def table(self, lines, k):
        head, marks = cells(lines[k].text), cells(lines[k + 1].text)
        rows = [head]
        first = k
        k += 2
        while k < len(lines) and lines[k].text.strip() and not self.starts_block(lines[k].text) and _indent(lines[k].text) < 4:
            rows.append((cells(lines[k].text) + [""] * len(head))[: len(head)])
            k += 1
        kids = []
        for row in rows:
            own = [Node("cell", text=c.replace("\\|", "|")) for c in row]
            self.inline += own
            kids.append(Node("row", own))
        n = Node("table", kids, attrs={"marks": [c.strip() for c in marks]})
        n.start, n.end = lines[first].at, lines[k - 1].end
        return [n], k

    def paragraph(self, lines, k):
        first = k
        own = [lines[k]]
        k += 1
        level = 0
        while k < len(lines) and lines[k].text.strip():
            s = lines[k].text
            if m := _SETEXT.match(s):
                level = 1 if m[1][0] == "=" else 2
                k += 1
                break
            if self.starts_block(s):
                break
            own.append(lines[k])
            k += 1
        out: list[Node] = []
        # Link reference definitions at the start of a paragraph are no part of it.
        while own:
            text = "\n".join(x.text for x in own)
            m = _REF.match(text)
            if not m:
                break
            n = m[0].rstrip("\n").count("\n") + 1
            dest = m[2][1:-1] if m[2].startswith("<") else m[2]
            title = m[3][1:-1] if m[3] is not None else None
            self.refs.setdefault(normal_label(m[1]), (dest, title, m[1]))
            ref = Node("link_ref", attrs={"label": m[1], "dest": dest, "title": title})
            ref.start, ref.end = own[0].at, own[n - 1].end
            out.append(ref)
            own = own[n:]
        if own:
            text = "\n".join(x.text.lstrip(" \t") for x in own).rstrip()
            n = Node("heading", text=text, attrs={"level": level, "setext": True}) if level else Node("paragraph", text=text)
            n.start, n.end = own[0].at, lines[k - 1].end
            self.inline.append(n)
            out.append(n)
        return out, max(k, first + 1)


def cells(line: str) -> list[str]:
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    return [c.strip() for c in re.split(r"(?<!\\)\|", s)]


def _expanded(s: str) -> str:
    """Tabs in the indentation, and after the marks of quotes and items there, as columns."""
    head = re.match(r"[ \t]*(?:(?:>|[-+*]|[0-9]{1,9}[.)])[ \t]+)*", s)[0]
    return head.expandtabs(4) + s[len(head) :] if "\t" in head else s


def parse(text: str, inlines: bool = True) -> Node:
    """The document's tree; spans are offsets in the text with CRLF as LF. Without inlines, blocks keep their texts unparsed."""
    text = text.replace("\r\n", "\n")
    lines, at = [], 0
    for raw in text.splitlines(keepends=True) if "\n" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        body = raw.rstrip("\n")
        lines.append(Line(_expanded(body), at, at + len(raw)))
        at += len(raw)
    p = Parser()
    doc = Node("document", p.blocks(lines), start=0, end=len(text))
    doc.attrs["refs"] = p.refs
    for n in p.inline if inlines else ():
        n.children = parse_inlines(n.text, p.refs, p.notes)
    return doc
