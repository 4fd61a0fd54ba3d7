"""Tokens with offsets: constructs, words and sentences of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import regex

from textloom.functions.patterns import AUTOLINK, CODE_SPAN, HTML_TAGS, LINK, MIN_SENTENCE, PAIRED_TAGS, PROSE, SENTENCE_END, SINGLE_TAGS, TAG_MARKS, WRAPPING, Construct


class Span(NamedTuple):
    text: str
    start: int
    end: int
    is_atomic: bool
    name: str | None


class Word(NamedTuple):
    text: str
    start: int
    end: int


@lru_cache(maxsize=32)
def _alternation(constructs: tuple[Construct, ...]) -> re.Pattern[str] | None:
    """Of all but code spans, which are found without backtracking."""
    rest = [c for c in constructs if c is not CODE_SPAN]
    return re.compile("|".join(f"(?P<{c.name}>{c.pattern})" for c in rest), re.DOTALL) if rest else None


_TICKS = re.compile("`+")


def code_spans(text: str) -> Iterator[tuple[int, int]]:
    """What CODE_SPAN matches, one after the other from any place on: the generator is sent the place to go on from.

    A span starts with as many ticks of a run as close again later, and holds something else. A number of ticks that is missing from one place on is
    missing from all later ones, so text without an end isn't scanned again.
    """
    missing = len(text) + 1
    i, run = text.find("`"), 0
    while i >= 0:
        if run <= i:  # the end of the ticks from i on
            run = _TICKS.match(text, i).end()
        span = None
        for k in range(min(run - i, missing - 1), 0, -1):
            j = text.find("`" * k, i + k)
            if j == i + k:
                break  # fewer ticks are closed at once as well
            if j >= 0:
                span = i, j + k
                break
            missing = k
        if span is None:
            i = text.find("`", i + 1)
            continue
        while (now := (yield span)) is not None and now <= i:
            pass
        i = text.find("`", span[1] if now is None else now)


#: What a text has to hold for a construct: a tag's closing mark, or what the others begin with.
_NEEDS = {c: mark[1] for c in (*PAIRED_TAGS, *SINGLE_TAGS) if (mark := TAG_MARKS.get(c.name.partition("_")[2]))} | {LINK: "["} | dict.fromkeys((AUTOLINK, *HTML_TAGS), "<")


def _found(text: str, constructs: tuple[Construct, ...]) -> Iterator[tuple[int, int, str]]:
    """The constructs' matches from left to right; of those that start at one place, the first listed one's."""
    # Without its closing mark, a tag is sought in vain from each opening one.
    constructs = tuple(c for c in constructs if (mark := _NEEDS.get(c)) is None or mark in text)
    pattern = _alternation(constructs)
    if "`" not in text or CODE_SPAN not in constructs:
        if pattern:
            yield from ((*m.span(), m.lastgroup) for m in pattern.finditer(text))
        return
    spans = code_spans(text)
    code = next(spans, None)
    other = pattern.search(text) if pattern else None
    while code or other:
        if code and (not other or code[0] <= other.start()):
            yield *code, CODE_SPAN.name
            at = code[1]
        else:
            yield *other.span(), other.lastgroup
            at = max(other.end(), other.start() + 1)
        if code and code[0] < at:
            try:
                code = spans.send(at)
            except StopIteration:
                code = None
        if other and other.start() < at:
            other = pattern.search(text, at)


def atomic_spans(text: str, constructs: tuple[Construct, ...] = WRAPPING) -> list[Span]:
    """text cut into constructs and the gaps between them; the spans' texts add up to text."""
    out, at = [], 0
    if constructs:
        for a, b, name in _found(text, constructs):
            if at < a:
                out.append(Span(text[at:a], at, a, False, None))
            out.append(Span(text[a:b], a, b, True, name))
            at = b
    if at < len(text):
        out.append(Span(text[at:], at, len(text), False, None))
    return out


_RUN = re.compile(r"\S+")
#: Every construct that holds white space has one of these characters; a bare URL holds none.
_CONSTRUCT_MARK = re.compile(r"[`\[<{]")


def atomic_words(text: str, constructs: tuple[Construct, ...] = WRAPPING) -> list[Word]:
    """Words between white space; white space inside a construct doesn't count, and a construct sticks to what it touches."""
    if _CONSTRUCT_MARK.search(text) is None:
        return [Word(m[0], *m.span()) for m in _RUN.finditer(text)]
    pieces: list[tuple[int, int]] = []
    for s in atomic_spans(text, constructs):
        pieces += [(s.start, s.end)] if s.is_atomic else [(s.start + m.start(), s.start + m.end()) for m in _RUN.finditer(s.text)]
    out: list[list[int]] = []
    for a, b in pieces:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [Word(text[a:b], a, b) for a, b in out]


_TOUCHING = [(close + open_, close + " " + open_) for open_, close, _ in TAG_MARKS.values()]


def part_tags(text: str) -> str:
    """A space between tags of one kind that touch."""
    for joined, parted in _TOUCHING:
        text = text.replace(joined, parted)
    return text


def join_tags(text: str) -> str:
    """No single space between tags of one kind."""
    for joined, parted in _TOUCHING:
        text = text.replace(parted, joined)
    return text


def plain_words(text: str) -> list[str]:
    return text.split()


def markup_words(text: str) -> list[str]:
    if _CONSTRUCT_MARK.search(text) is None:
        return part_tags(text).split()
    return [w.text for w in atomic_words(part_tags(text))]


_END = regex.compile(SENTENCE_END)


def ends_sentence(word: str) -> bool:
    # Most words end in a letter or digit, which no sentence does.
    return not word[-1:].isalnum() and _END.search(word) is not None


def _sentence_ends(lengths_and_words, min_length: int, heuristic) -> Iterator[int]:
    """Indexes after which a sentence ends."""
    size = -1
    for k, w in enumerate(lengths_and_words):
        size += len(w) + 1
        if size >= min_length and heuristic(w):
            yield k + 1
            size = -1


def split_sentences(text: str, min_length: int = MIN_SENTENCE, heuristic: Callable[[str], bool] = ends_sentence) -> list[str]:
    words = text.split()
    cuts = [0, *_sentence_ends(words, min_length, heuristic)]
    if cuts[-1] < len(words):
        cuts.append(len(words))
    return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]


def first_sentences(text: str, n: int, min_length: int = MIN_SENTENCE) -> list[str]:
    return split_sentences(text, min_length)[:n]


def first_sentence(text: str, min_length: int = MIN_SENTENCE) -> str:
    return next(iter(split_sentences(text, min_length)), text)


def sentence_spans(text: str, min_length: int = MIN_SENTENCE, heuristic: Callable[[str], bool] = ends_sentence, constructs: tuple[Construct, ...] = PROSE) -> list[Word]:
    """Sentences as they stand in text, with offsets; none ends inside a construct."""
    words = atomic_words(text, constructs)
    cuts = [0, *_sentence_ends([w.text for w in words], min_length, heuristic)]
    if cuts[-1] < len(words):
        cuts.append(len(words))
    return [Word(text[words[a].start : words[b - 1].end], words[a].start, words[b - 1].end) for a, b in zip(cuts, cuts[1:])]


def atomic_sentences(text: str, min_length: int = MIN_SENTENCE) -> list[str]:
    # Without constructs and with single spaces, words needn't carry their places.
    if _CONSTRUCT_MARK.search(text) is None and " ".join(text.split()) == text.strip():
        return split_sentences(text, min_length)
    return [s.text for s in sentence_spans(text, min_length)]
