"""Typographic quotes and ellipses, by scanning characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

from textloom.functions.patterns import SINGLE_TAGS
from textloom.functions.words import atomic_spans

_BLANK = re.compile(r"\n\s*\n")

# The curly forms of a straight quote, what may stand around a quoted passage besides white space, what a word before an
# ellipsis may end in besides letters, and the marks that may follow one.
CURLY = {'"': "“”", "'": "‘’"}
BEFORE_QUOTE, AFTER_QUOTE = "—", ".,;:?!—)"
BEFORE_DOTS, AFTER_DOTS = "\"'“‘", ".,:;?!)-—\"'”’"


def has_paragraphs(text: str) -> bool:
    return _BLANK.search(text) is not None


def _wordlike(c: str) -> bool:
    return c.isalnum() or c == "_"


def _starts_line(text: str, i: int) -> bool:
    return i == 0 or text[i - 1] == "\n"


_STRAIGHT = re.compile("[\"']")
_LIKE = {c: re.compile(f"[{c}{CURLY[c]}]") for c in CURLY}


def _first_of(text: str, chars: re.Pattern[str], start: int) -> int:
    """Where one of chars comes first from start on; the end if none does."""
    m = chars.search(text, start)
    return m.start() if m else len(text)


def _quoted(text: str) -> Iterator[tuple[int, int]]:
    """Places of the opening and the closing straight quote of passages that stand free. A passage's surroundings belong to it alone."""
    free, i = 0, _first_of(text, _STRAIGHT, 0)
    while i < len(text):
        opens = _starts_line(text, i) or (i > free and (text[i - 1].isspace() or text[i - 1] in BEFORE_QUOTE))
        if opens:
            j = _first_of(text, _LIKE[text[i]], i + 1)
            after = text[j + 1 : j + 2]
            if j < len(text) and text[j] == text[i] and (not after or after.isspace() or after in AFTER_QUOTE):
                yield i, j
                free = i = j + 1 + len(after)
                i = _first_of(text, _STRAIGHT, i)
                continue
        i = _first_of(text, _STRAIGHT, i + 1)


def _apostrophe(word: str) -> int:
    """Where word has an apostrophe between letters, or at its end after an s; -1 if not, or if it has several."""
    k = word.find("'")
    if k < 0 or word.find("'", k + 1) >= 0:
        return -1
    inside = 0 < k < len(word) - 1 and _wordlike(word[k - 1]) and _wordlike(word[k + 1])
    possessive = k == len(word) - 1 and word[k - 1 : k] in ("s", "S") and all(map(_wordlike, word[:k]))
    return k if inside or possessive else -1


def _quote(text: str) -> str:
    if "'" not in text and '"' not in text:
        return text
    out = list(text)
    for i, j in _quoted(text):
        if not has_paragraphs(text[i + 1 : j]):
            out[i], out[j] = CURLY[text[i]]
    if "'" in text:
        now = "".join(out)
        at = 0
        for word in now.split():
            at = now.index(word, at)
            k = _apostrophe(word)
            if k >= 0:
                out[at + k] = "’"
            at += len(word)
    return "".join(out)


def smart_quotes(text: str) -> str:
    """Straight quotes and apostrophes made typographic where that is safe, outside template tags. Keeps the length."""
    return "".join(s.text if s.is_atomic else _quote(s.text) for s in atomic_spans(text, SINGLE_TAGS))


def _blank_run(text: str, i: int, step: int, stop: int) -> int:
    """How far white space goes from i on (step 1), or before i (step -1)."""
    while i != stop and text[i if step > 0 else i - 1].isspace():
        i += step
    return i


def ellipses(text: str) -> str:
    """Three dots next to a word or at an edge made one character, with spaces between it and words."""
    out: list[str] = []
    done = 0  # what lies before is settled
    k = text.find("...")
    while k >= 0:
        gap = _blank_run(text, k, -1, done)
        before = text[gap - 1] if gap > done else ""
        if not (before and (_wordlike(before) or before in BEFORE_DOTS)):
            before = ""
            gap = next((p for p in range(gap, k + 1) if _starts_line(text, p)), -1)
        if gap >= 0:
            mark = text[k + 3 : k + 4]
            mark = mark if mark and mark in AFTER_DOTS else ""
            here = k + 3 + len(mark)
            end = _blank_run(text, here, 1, len(text))
            then = text[end : end + 1]
            if not then or _wordlike(then):
                left = text[gap:k] or (" " if before and _wordlike(before) else "")
                right = text[here:end] or (" " if then and not mark else "")
                out += [text[done:gap], left, "…", mark, right]
            else:
                out.append(text[done:end])
            done = end
        k = text.find("...", max(k + 1, done))
    return "".join([*out, text[done:]])
