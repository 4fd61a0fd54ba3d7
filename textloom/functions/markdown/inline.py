"""Inline parsing: delimiter runs and brackets by the CommonMark algorithm, with GFM strikethrough, bare URLs and footnotes."""

from __future__ import annotations

import re
import unicodedata

from textloom.functions.markdown.nodes import Node

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_HTML = re.compile(r"<!--.*?-->|<\?.*?\?>|<![A-Z][^>]*>|</[A-Za-z][A-Za-z0-9-]*\s*>|<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>", re.DOTALL)
_URL = re.compile(r"(?:https?://|www\.)[^\s<]+|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOOT = re.compile(r"\[\^([^\s\]]+)\]")
_SPECIAL = re.compile(r"[\\`<\[\]!*_~\n]|(?<![\w/])(?=https?://|www\.|[A-Za-z0-9._+-]+@[A-Za-z0-9])")
_BREAK = re.compile(r"(\\| {2,})?(?: *)\n *")


#: Parentheses nest this deep in a destination.
PARENS = 32


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def is_punctuation(c: str) -> bool:
    return c in _PUNCT or unicodedata.category(c).startswith("P")


def link_tail(text: str, at: int) -> tuple[int, str, str | None] | None:
    """(end, destination, title) of the "(...)" at text[at]."""
    m = re.compile(r"\(\s*").match(text, at)
    if not m:
        return None
    at = m.end()
    if text[at : at + 1] == "<":
        m = re.compile(r"<((?:\\.|[^<>\n\\])*)>").match(text, at)
        if not m:
            return None
        dest, at = m[1], m.end()
    else:
        depth, start = 0, at
        while at < len(text) and not text[at].isspace():
            if text[at] == "\\" and at + 1 < len(text):
                at += 1
            elif text[at] == "(":
                depth += 1
                if depth > PARENS:
                    return None
            elif text[at] == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        dest = text[start:at]
    m = re.compile(r"(?:\s+(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?\s*\)", re.DOTALL).match(text, at)
    if not m:
        return None
    return m.end(), dest, m[1][1:-1] if m[1] is not None else None


class _Inline:
    def __init__(self, text: str, refs: dict, notes: set):
        self.text, self.refs, self.notes = text, refs, notes
        self.out: list[Node] = []
        self.brackets: list[dict] = []
        self.unclosed: set[str] = set()
        self.last: dict[str, int] = {}

    def lacks(self, mark: str, at: int) -> bool:
        """Whether mark doesn't come any more."""
        if mark not in self.last:
            self.last[mark] = self.text.rfind(mark)
        return self.last[mark] < at

    def raw(self, s: str) -> None:
        if self.out and self.out[-1].kind == "raw":
            self.out[-1].text += s
        else:
            self.out.append(Node("raw", text=s))

    def run(self) -> list[Node]:
        text, at = self.text, 0
        while at < len(text):
            m = _SPECIAL.search(text, at)
            to = m.start() if m else len(text)
            if to > at:
                # Spaces before a line's end belong to the break.
                self.raw(text[at:to])
                at = to
                continue
            at = self.special(at, text[at])
        self.emphasis()
        for n in self.out:
            if n.kind in ("run", "bracket"):
                n.kind = "raw"
        return _joined(self.out)

    def special(self, at: int, c: str) -> int:
        text = self.text
        if c == "\\":
            nxt = text[at + 1 : at + 2]
            if nxt == "\n":
                return self.line_break(at + 1, hard=True)
            if nxt and nxt in _PUNCT:
                self.out.append(Node("literal", text=nxt))
                return at + 2
        elif c == "\n":
            return self.line_break(at, hard=False)
        elif c == "`":
            ticks = re.compile(r"`+").match(text, at)[0]
            m = None if ticks in self.unclosed else re.compile(r"(?<!`)" + ticks + r"(?!`)").search(text, at + len(ticks))
            if m:
                code = text[at + len(ticks) : m.start()].replace("\n", " ")
                if code.strip() and code[0] == code[-1] == " ":
                    code = code[1:-1]
                self.out.append(Node("code", text=code))
                return m.end()
            self.unclosed.add(ticks)  # nor do as many close further on
            self.raw(ticks)
            return at + len(ticks)
        elif c == "<":
            if m := _AUTO.match(text, at):
                self.out.append(Node("autolink", [Node("raw", text=m[1])], attrs={"dest": m[1]}))
                return m.end()
            if text.startswith("<!--", at) and self.lacks("-->", at) or text.startswith("<?", at) and self.lacks("?>", at):
                pass
            elif m := _HTML.match(text, at):
                self.out.append(Node("html", text=m[0]))
                return m.end()
        elif c == "[" or (c == "!" and text[at + 1 : at + 2] == "["):
            m = _FOOT.match(text, at)
            if m and normal_label(m[1]) in self.notes:
                self.out.append(Node("footnote_ref", attrs={"label": m[1]}))
                return m.end()
            mark = "[" if c == "[" else "!["
            self.brackets.append({"at": len(self.out), "text": at + len(mark), "image": c == "!", "on": True})
            self.out.append(Node("bracket", text=mark))
            return at + len(mark)
        elif c == "]":
            return self.close(at)
        elif c in "*_":
            return self.delimiters(at, c)
        elif c == "~":
            return self.tildes(at)
        elif m := _URL.match(text, at):
            url = re.sub(r"[?!.,:;*_~'\")\]]+$", lambda t: ")" if t[0].startswith(")") and m[0].count("(") > m[0].count(")") - 1 else "", m[0])
            if url:
                self.out.append(Node("url", [Node("raw", text=url)], attrs={"dest": url}))
                return at + len(url)
        self.raw(c)
        return at + 1

    def tildes(self, at: int) -> int:
        """One or two tildes open what the next run of tildes closes, if it is as long."""
        text, end = self.text, at
        while text.startswith("~", end):
            end += 1
        close = -1 if self.lacks("~", end) else text.find("~", end)
        past = close + end - at
        alike = close > end and end - at <= 2 and text.startswith(text[at:end], close) and not text.startswith("~", past)
        if alike and self.flanking(at, end)[0] and self.flanking(close, past)[1]:
            self.out.append(Node("strike", _Inline(text[end:close], self.refs, self.notes).run()))
            return past
        self.raw(text[at:end])
        return end

    def flanking(self, at: int, end: int) -> tuple[bool, bool]:
        """Whether the run of delimiters there is left-flanking, and right-flanking."""
        before, after = self.text[at - 1 : at] or " ", self.text[end : end + 1] or " "
        edge = lambda c: c.isspace() or is_punctuation(c)
        return not after.isspace() and (not is_punctuation(after) or edge(before)), not before.isspace() and (not is_punctuation(before) or edge(after))

    def line_break(self, at: int, hard: bool) -> int:
        if self.out and self.out[-1].kind == "raw" and not hard:
            bare = self.out[-1].text.rstrip(" ")
            hard = len(self.out[-1].text) - len(bare) >= 2
            self.out[-1].text = bare
        self.out.append(Node("break", attrs={"soft": not hard}))
        return re.compile(r"\n *").match(self.text, at).end()

    def delimiters(self, at: int, c: str) -> int:
        text = self.text
        end = at
        while end < len(text) and text[end] == c:
            end += 1
        before, after = text[at - 1 : at] or " ", text[end : end + 1] or " "
        left, right = self.flanking(at, end)
        opens = left and (c == "*" or not right or is_punctuation(before))
        closes = right and (c == "*" or not left or is_punctuation(after))
        self.out.append(Node("run", text=text[at:end], attrs={"opens": opens, "closes": closes, "size": end - at, "at": at}))
        return end

    def close(self, at: int) -> int:
        if not self.brackets:
            self.raw("]")
            return at + 1
        b = self.brackets.pop()
        if not b["on"]:
            self.raw("]")
            return at + 1
        text, end, found = self.text, at + 1, None
        label = text[b["text"] : at]
        if tail := None if self.lacks(")", at) else link_tail(text, at + 1):
            end, found = tail[0], (tail[1], tail[2], None)
        else:
            m = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]").match(text, at + 1)
            key = normal_label(m[1] if m and m[1].strip() else label)
            if key in self.refs:
                end, found = m.end() if m else at + 1, (*self.refs[key][:2], key)
        if found is None:
            self.raw("]")
            return at + 1
        rest = self.out[b["at"] + 1 :]
        del self.out[b["at"] :]
        keep, self.out = self.out, rest
        self.emphasis()
        for n in self.out:
            if n.kind in ("run", "bracket"):
                n.kind = "raw"
        rest, self.out = _joined(self.out), keep
        self.out.append(Node("image" if b["image"] else "link", rest, attrs={"dest": found[0], "title": found[1], "key": found[2]}))
        if not b["image"]:
            for x in self.brackets:
                x["on"] = x["on"] and x["image"]
        return end

    def emphasis(self) -> None:
        """Pair the delimiter runs. Runs are a linked list from 0, which is no run; gaps[k] is what stands between run k and the next one that is left."""
        runs: list[Node | None] = [None]
        gaps: list[list[Node]] = [[]]
        for n in self.out:
            if n.kind == "run":
                runs.append(n)
                gaps.append([])
            else:
                gaps[-1].append(n)
        before, after = list(range(-1, len(runs))), list(range(1, len(runs) + 1))

        def drop(k: int) -> None:
            after[before[k]], before[after[k]] = after[k], before[k]

        bottom: dict[tuple, int] = {}  # by kind of closing run: up to which place in the text there is no opening one for it
        k = 1
        while k < len(runs):
            closer = runs[k]
            if not closer.closes:
                k = after[k]
                continue
            alike = closer.text[0], closer.opens, closer.size % 3
            j = before[k]
            while j and runs[j].at > bottom.get(alike, -1):
                o = runs[j]
                if o.opens and o.text[0] == closer.text[0] and not ((o.closes or closer.opens) and (o.size + closer.size) % 3 == 0 and (o.size % 3 or closer.size % 3)):
                    break
                j = before[j]
            else:
                j = 0
            if not j:
                bottom[alike] = closer.at - 1
                if not closer.opens:  # no later run will need it
                    gaps[before[k]] += [closer, *gaps[k]]
                    drop(k)
                k = after[k]
                continue
            opener = runs[j]
            n = 2 if len(opener.text) > 1 and len(closer.text) > 1 else 1
            inner, x = gaps[j], after[j]
            while x != k:
                inner += [runs[x], *gaps[x]]
                x = after[x]
            after[j], before[k] = k, j
            for x in inner:
                if x.kind in ("run", "bracket"):
                    x.kind = "raw"
            gaps[j] = [Node("strong" if n == 2 else "emphasis", _joined(inner))]
            opener.text, closer.text = opener.text[n:], closer.text[n:]
            if not opener.text:
                gaps[before[j]] += gaps[j]
                drop(j)
            if not closer.text:
                gaps[before[k]] += gaps[k]
                drop(k)
                k = after[k]
        self.out = gaps[0]
        k = after[0]
        while k < len(runs):
            self.out += [runs[k], *gaps[k]]
            k = after[k]


def _joined(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for n in nodes:
        if n.kind == "raw" and not n.text:
            continue
        if n.kind == "raw" and out and out[-1].kind == "raw":
            out[-1] = Node("raw", text=out[-1].text + n.text)
        else:
            out.append(n)
    return out


def parse_inlines(text: str, refs: dict, notes: set) -> list[Node]:
    if _SPECIAL.search(text) is None:
        return [Node("raw", text=text)] if text else []
    return _Inline(text, refs, notes).run()
