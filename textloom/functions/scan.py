"""The construct scanner in the JVM: constructs, words and lines as columns, for texts with code spans, links and tags.

The kernel's patterns are rewritten for Java: white space as Python has it, and group loops made possessive. A possessive loop is a loop in
Java's matcher, where others recurse, so neither a long word nor a long comment takes stack; and as each of these loops ends only where it must, no match is lost.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import native as N
from textloom.functions.patterns import PROSE, WIDTH, WRAPPING, Construct

_STRINGS = "cast(array() as array<string>)"
#: A space inside a word while lines are cut at spaces; a noncharacter, so texts that hold it take the slower way.
_HELD = "\ufdd0"


def java_pattern(pattern: str) -> str:
    """A kernel pattern for Java's matcher."""
    out, k, in_class = "", 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out += N._S if in_class else f"[{N._S}]"
        elif pattern[k] == "\\":
            out += two
        else:
            in_class = (in_class or pattern[k] == "[") and pattern[k] != "]"
            out, k = out + pattern[k], k - 1
        k += 2
    out = out.replace("(?P<", "(?<")
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return re.sub(r"(?<!\\)\)([*+])", r")\1+", out)


def _either(constructs: tuple[Construct, ...]) -> str:
    return "|".join(java_pattern(c.pattern) for c in constructs)


def _marks(constructs: tuple[Construct, ...]) -> str:
    """The characters that a construct begins with, for a class."""
    return r"`\[<{" + ("hw" if any(c.name == "bare_url" for c in constructs) else "")


def construct_matches(text: Column, constructs: tuple[Construct, ...] = WRAPPING) -> Column:
    """The constructs in text, from left to right; of those that start at one place, the first listed one's."""
    return F.regexp_extract_all(text, F.lit("(?s)" + _either(constructs)), F.lit(0))


def construct_name(piece: Column, constructs: tuple[Construct, ...] = WRAPPING) -> Column:
    """Of something that construct_matches found, the first listed construct that it is."""
    return F.coalesce(*[F.when(piece.rlike("(?s)^(?:" + java_pattern(c.pattern) + r")\z"), F.lit(c.name)) for c in constructs])


def atomic_spans(text: Column, constructs: tuple[Construct, ...] = WRAPPING) -> Column:
    """array<struct<text, is_atomic, name>>: text cut into constructs and the gaps between them."""
    either = _either(constructs)
    ahead = either.replace("<ticks>", "<again>")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){either}|(?:[^{_marks(constructs)}]|(?!{ahead}).)++"), F.lit(0))

    def named(x):
        name = F.when(x.rlike(f"(?s)^[{_marks(constructs)}]"), construct_name(x, constructs))
        return F.struct(x.alias("text"), name.isNotNull().alias("is_atomic"), name.alias("name"))

    return F.transform(pieces, named)


def atomic_words(text: Column, constructs: tuple[Construct, ...] = WRAPPING) -> Column:
    """Words between white space; white space inside a construct doesn't count, and a construct sticks to what it touches."""
    plain = f"[^{N._S}{_marks(constructs)}]++"
    whole = F.regexp_extract_all(text, F.lit(f"(?s)(?:{_either(constructs)}|{plain}|[^{N._S}])++"), F.lit(0))
    return F.when(text.rlike(r"[`\[<{]"), whole).otherwise(N.words(text))


def markup_words(text: Column) -> Column:
    return atomic_words(N.part_tags(text))


def wrap_lines(text: Column, width: int = WIDTH, column: int = 0, offset: int = 0, squeeze: bool = True, markdown: bool = False) -> Column:
    """Greedy lines, as the kernel makes them. Lines are cut by a pattern; those with words to escape by a fold over the words' lengths."""
    if squeeze:
        text = N.spaced(text)
    if width <= 0:
        whole = N.trimmed(text) if squeeze else text
        return F.when(N.trimmed(text) == "", F.expr(_STRINGS)).otherwise(F.array(whole))
    room = width - offset
    if markdown or min(room, width - column) <= 0:
        return N.lines_of_words(atomic_words(N.part_tags(text)), width, column, offset, markdown)

    def cut(flat: Column) -> Column:
        return N.cut_lines(flat, width, column, offset)

    def marked(t: Column) -> Column:
        """Spaces inside words are held back while lines are cut."""
        held = F.array_join(F.transform(atomic_words(t), lambda w: F.replace(w, F.lit(" "), F.lit(_HELD))), " ")
        freed = F.transform(cut(held), lambda x: F.replace(x, F.lit(_HELD), F.lit(" ")))
        return F.when(F.contains(t, F.lit(_HELD)), N.lines_of_words(atomic_words(t), width, column, offset)).otherwise(freed)

    plain = F.trim(text) if squeeze else N.squeezed(text)
    return F.when(text.rlike(r"[`\[<{]"), N._with(N.part_tags(text), marked)).otherwise(cut(plain))


def wrap_text(text: Column, width: int = WIDTH, first: str = "", rest: str = "", squeeze: bool = True, markdown: bool = False) -> Column:
    """wrap_lines with indents; tags that touched in text touch again."""
    done = wrap_lines(text, width, len(first), len(rest), squeeze, markdown)
    if not first and not rest:
        return N.join_tags(F.array_join(done, "\n"))
    return N.join_tags(F.array_join(F.transform(done, lambda x, i: F.concat(F.when(i == 0, first).otherwise(rest), x)), "\n"))


def fill_text(text: Column, style: str = "wrap", width: int = WIDTH) -> Column:
    """Plain text filled paragraph by paragraph, in the styles of the kernel."""
    from textloom.functions.wrap import STYLES

    s = STYLES[style]
    if not s.wraps:
        return N.fill_text(text, style, width)
    fill = lambda first: lambda p: wrap_text(p, width - len(s.rest), first, s.rest, s.squeeze)
    paragraphs = N.split_paragraphs(text)
    if not s.hangs:
        done = F.transform(paragraphs, fill(s.first))
    else:
        done = F.transform(paragraphs, lambda p, i: F.when(i == 0, fill(s.first)(p)).otherwise(fill(s.rest)(p)))
    return F.array_join(done, "\n\n")


def sentences(text: Column, min_length: int = 15, constructs: tuple[Construct, ...] = PROSE) -> Column:
    """Sentences, none of which ends inside a construct, their words joined by spaces. Only texts that may hold constructs take a fold over words."""
    folded = N.sentences_of_words(atomic_words(text, constructs), min_length)
    return F.when(text.rlike(r"[`\[<{]"), folded).otherwise(N.split_sentences(text, min_length))
