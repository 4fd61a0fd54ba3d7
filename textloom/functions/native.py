"""The text functions that Spark's own expressions can say: columns in, columns out, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.patterns import MIN_SENTENCE, SENTENCE_END, TABLE_SEPARATOR, TAG_MARKS, WIDTH

_TOUCHING = [(c + o, c + " " + o) for o, c, _ in TAG_MARKS.values()]
_OPENS = r"(?:\{%|\{#|\{\{|<!--)"
_CLOSES = r"(?:%\}|#\}|\}\}|-->)"
_STRINGS = "cast(array() as array<string>)"
#: White space as Python has it, inside a character class; Java's \s is the ASCII part alone.
_RARE = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_S = r"\s" + _RARE


_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trimmed(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    ascii_ = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(ascii_.rlike(rf"^[{_RARE}]|[{_RARE}]\z"), F.regexp_replace(text, rf"^[{_S}]+|[{_S}]+\z", "")).otherwise(ascii_)


def words(text: Column) -> Column:
    """White space beyond ASCII is rare, and its class slow, so only texts that hold any are split by it."""
    parts = F.when(text.rlike(f"[{_RARE}]"), F.split(text, f"[{_S}]+")).otherwise(F.split(text, r"\s+"))
    return F.array_remove(parts, "")


def spaced(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.when(text.rlike(f"[{_RARE}]"), F.regexp_replace(text, f"[{_S}]+", " ")).otherwise(F.regexp_replace(text, r"\s+", " "))


def squeezed(text: Column) -> Column:
    return F.trim(spaced(text))


def part_tags(text: Column) -> Column:
    for a, b in _TOUCHING:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def join_tags(text: Column) -> Column:
    for a, b in _TOUCHING:
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


# Lines


def is_table_row(line: Column) -> Column:
    return line.rlike(r"^\s*\|")


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^\s*(?:[-*+][ \t]|[0-9]{1,9}[.)][ \t])")


def is_block(line: Column) -> Column:
    return is_table_row(line) | is_list_item(line)


def is_table_separator(line: Column) -> Column:
    return trimmed(line).rlike(TABLE_SEPARATOR)


def alignment_mark(cell: Column) -> Column:
    return F.concat(F.when(F.startswith(cell, F.lit(":")), ":").otherwise(""), F.lit("---"), F.when(F.endswith(cell, F.lit(":")), ":").otherwise(""))


def normal_separator(line: Column) -> Column:
    inner = F.regexp_replace(trimmed(line), r"^\||\|\z", "")
    cells = F.transform(F.split(inner, r"\|"), lambda c: alignment_mark(F.trim(c)))
    return F.when(is_table_separator(line), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(line)


def starts_with_tag(line: Column) -> Column:
    return line.rlike(r"^\s*" + _OPENS)


def ends_with_tag(line: Column) -> Column:
    return line.rlike(_CLOSES + r"\s*\z")


def is_tag_at_margin(line: Column) -> Column:
    return line.rlike("^" + _OPENS)


def is_tag_only(line: Column) -> Column:
    return is_tag_at_margin(line) & ends_with_tag(line)


def is_closing_tag(line: Column) -> Column:
    return line.rlike(r"^\s*" + _OPENS + " /")


def is_long_comment(text: Column) -> Column:
    t = trimmed(text)
    return F.contains(t, F.lit("\n")) & F.startswith(t, F.lit("<!--")) & (F.instr(t, "-->") == F.length(t) - 2)


def space_tag_blocks(text: Column) -> Column:
    rows = lines(text)

    def gap(x, i):
        before = F.get(rows, i - 1)
        meets = (is_tag_only(before) & is_block(x)) | (is_block(before) & is_tag_only(x))
        return F.when((i > 0) & meets, F.concat(F.lit("\n"), x)).otherwise(x)

    return F.array_join(F.transform(rows, gap), "\n")


def settle_closing_tags(text: Column) -> Column:
    """Each line looks at the one put out before it: a fold."""

    def step(acc, x):
        closing = is_closing_tag(x)
        plain = F.regexp_replace(x, r"^\s+", "")
        last = F.try_element_at(acc, F.lit(-1))
        gap = closing & F.coalesce(is_block(last), F.lit(False))
        return F.concat(acc, F.when(gap, F.array(F.lit(""), plain)).when(closing, F.array(plain)).otherwise(F.array(x)))

    return F.array_join(F.aggregate(lines(text), F.expr(_STRINGS), step), "\n")


def split_long_tags(text: Column) -> Column:
    """One line at a time; a line that doesn't open a tag is cut before the first closing tag that follows a tag's end."""
    parts = [rf"{close}\s*{open_}\s*/" for open_, close in ((r"\{%", r"%\}"), (r"\{#", r"#\}"), (r"\{\{", r"\}\}"), ("<!--", "-->"))]
    ends = [close for close in (r"%\}", r"#\}", r"\}\}", "-->")]
    cut = "|".join(rf"(?<={e})\s*(?={p.split(chr(92) + 's*', 1)[1]})" for e, p in zip(ends, parts))

    def fix(x, i):
        at = F.regexp_instr(x, F.lit("|".join(parts)))
        head, tail = F.substring(x, F.lit(1), at - 1), F.substring(x, at, F.length(x))
        pieces = F.split(tail, cut, 2)
        done = F.concat(head, F.regexp_replace(pieces[0], r"\s+\z", ""), F.lit("\n"), F.regexp_replace(F.get(pieces, F.lit(1)), r"^\s+", ""))
        return F.when((i > 0) & ~starts_with_tag(x) & (at > 0), done).otherwise(x)

    return F.array_join(F.transform(lines(text), fix), "\n")


# Sentences


def ends_sentence(word: Column) -> Column:
    return word.rlike(SENTENCE_END)


def _with(value: Column, fn) -> Column:
    """fn(value), with value computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _runs(ws: Column, starts: Column, head=lambda w: w) -> Column:
    """Words joined by spaces, a run from each start to the next; head: of a run's first word, from the second run on."""

    def run(start, i):
        end = F.coalesce(F.get(starts, i + 1), F.size(ws))
        more = F.slice(ws, start + 2, end - start - 1)
        first = F.get(ws, start)
        return F.array_join(F.concat(F.array(F.when(i > 0, head(first)).otherwise(first)), more), " ")

    return F.transform(starts, run)


def sentences_of_words(words_: Column, min_length: int = MIN_SENTENCE) -> Column:
    """A fold over words: a sentence ends at a word that looks like an end, once it is long enough. Only places are folded; words are joined at the end."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("starts"), F.lit(0).alias("at"), F.lit(-1).alias("size"))

    def step(acc, w):
        size = acc["size"] + F.length(w) + 1
        starts = F.when(acc["size"] < 0, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), (acc["at"] + 1).alias("at"), F.when((size >= min_length) & ends_sentence(w), -1).otherwise(size).alias("size"))

    return _with(words_, lambda ws: _with(F.aggregate(ws, start, step, lambda acc: acc["starts"]), lambda starts: _runs(ws, starts)))


#: A sentence's last word as SENTENCE_END has it, in a text with single spaces between its words: what comes before its last space.
_LAST_WORD = r"(?<![\p{L}\p{M}\p{N}_])(\p{L}{2,}+(?<=\p{Ll})(?:[.?!]['\"’”)]?|['\"’”)][.?!])) "


def split_sentences(text: Column, min_length: int = MIN_SENTENCE) -> Column:
    """Patterns alone: the space after every word that looks like an end becomes a line end, and the text is cut at those that are far enough from the one before."""
    marked = F.regexp_replace(squeezed(text), _LAST_WORD, "$1\n")
    if min_length <= 1:
        return F.array_remove(F.split(marked, "\n", -1), "")
    pieces = F.regexp_extract_all(marked, F.lit(rf"(?s)(.{{{min_length},}}?(?=\n|\z)|.++\z)\n?"), F.lit(1))
    return F.transform(pieces, lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))


def first_sentences(text: Column, n: int, min_length: int = MIN_SENTENCE) -> Column:
    return F.slice(split_sentences(text, min_length), 1, n)


def first_sentence(text: Column, min_length: int = MIN_SENTENCE) -> Column:
    return F.coalesce(F.get(split_sentences(text, min_length), F.lit(0)), text)


# Filling


def escape_word(word: Column) -> Column:
    numeral = F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("\\"), F.right(word, F.lit(1)))
    return F.when(word.rlike(r"^[0-9]+[.)]\z"), numeral).when(word.rlike(r"^(?:[-*+>]|#+)\z"), F.concat(F.lit("\\"), word)).otherwise(word)


#: A word that escape_word changes, between single spaces.
_ESCAPED = r"(?:^| )(?:[0-9]+[.)]|[-*+>]|#+)(?: |\z)"


def lines_of_words(words_: Column, width: int = WIDTH, column: int = 0, offset: int = 0, markdown: bool = False) -> Column:
    """Greedy lines of words."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("starts"), F.lit(0).alias("at"), F.lit(column).alias("used"))

    def step(acc, w):
        # The first word may start at `column`; one that is too wide counts as at `offset`.
        need = F.length(w) + F.when(acc["at"] == 0, 0).otherwise(1)
        fits = acc["used"] + need <= width
        new = F.when(acc["at"] == 0, w).otherwise(escape_word(w)) if markdown else w
        starts = F.when(fits & (acc["at"] > 0), acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"])))
        return F.struct(starts.alias("starts"), (acc["at"] + 1).alias("at"), F.when(fits, acc["used"] + need).otherwise(F.lit(offset) + F.length(new)).alias("used"))

    head = escape_word if markdown else lambda w: w
    return _with(words_, lambda ws: _with(F.aggregate(ws, start, step, lambda acc: acc["starts"]), lambda starts: _runs(ws, starts, head)))


def cut_lines(flat: Column, width: int, column: int = 0, offset: int = 0) -> Column:
    """Greedy lines, by a pattern, of a text with single spaces; there has to be room beside both margins. As in lines_of_words, a first word that is too wide counts as at `offset`."""
    first = "" if column == offset else rf"\A.{{1,{width - column}}}(?= |\z)|"
    return F.regexp_extract_all(flat, F.lit(rf"(?s) ?({first}.{{1,{width - offset}}}(?= |\z)|[^ ]++)"), F.lit(1))


def wrap_lines(text: Column, width: int = WIDTH, column: int = 0, offset: int = 0, markdown: bool = False) -> Column:
    """Greedy lines of the words between white space. Constructs aren't heeded; scan.wrap_lines does. Only texts with words to escape take a fold over words."""
    whole = squeezed(text)
    if width <= 0:
        return F.when(whole == "", F.expr(_STRINGS)).otherwise(F.array(whole))
    folded = lines_of_words(words(text), width, column, offset, markdown)
    if width <= max(column, offset):
        return folded
    if not markdown:
        return cut_lines(whole, width, column, offset)
    return _with(whole, lambda flat: F.when(flat.rlike(_ESCAPED), folded).otherwise(cut_lines(flat, width, column, offset)))


def wrap_text(text: Column, width: int = WIDTH, first: str = "", rest: str = "", markdown: bool = False) -> Column:
    done = wrap_lines(text, width, len(first), len(rest), markdown)
    return join_tags(F.array_join(F.transform(done, lambda x, i: F.concat(F.when(i == 0, first).otherwise(rest), x)), "\n"))


def split_paragraphs(text: Column) -> Column:
    return F.transform(F.split(text, "\n{2,}", -1), trimmed)


def fill_text(text: Column, style: str = "wrap", width: int = WIDTH) -> Column:
    from textloom.functions.wrap import STYLES

    s = STYLES[style]
    if not s.wraps:
        rows = F.split(F.regexp_replace(text, rf"(?:{_LINE_END})\z", ""), _LINE_END, -1)
        return F.when(text == "", "").otherwise(F.array_join(F.transform(rows, lambda x: F.concat(F.lit(s.first), x)), "\n"))
    fill = lambda first: lambda p: wrap_text(p, width - len(s.rest), first, s.rest)
    paragraphs = split_paragraphs(text)
    if not s.hangs:
        done = F.transform(paragraphs, fill(s.first))
    else:
        done = F.transform(paragraphs, lambda p, i: F.when(i == 0, fill(s.first)(p)).otherwise(fill(s.rest)(p)))
    return F.array_join(done, "\n\n")


def hard_break_parts(text: Column) -> Column:
    return F.split(text, r"\\\n|  \n", -1)


# Markdown marks


def quoted_title(title: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.regexp_replace(title, r'^"+|"+\z', ""), F.lit('"'), F.lit('\\"')), F.lit('"'))


def least_fence(code: Column, mark: str = "`") -> Column:
    runs = F.transform(F.regexp_extract_all(code, F.lit(f"(?dm)^ {{0,3}}({mark}{{3,}})"), F.lit(1)), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def code_span(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("`")) | F.endswith(text, F.lit("`")), F.concat(F.lit("`` "), text, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), text, F.lit("`")))


def has_paragraphs(text: Column) -> Column:
    return text.rlike(r"\n\s*\n")


def apostrophes(text: Column) -> Column:
    """The apostrophe rule, word by word."""
    one = lambda w: (F.length(w) - F.length(F.replace(w, F.lit("'"), F.lit(""))) == 1) & w.rlike(r"\w'\w|^\w*[sS]'\z")
    return F.array_join(F.transform(F.split(text, "(?<=\\s)(?=\\S)|(?<=\\S)(?=\\s)"), lambda w: F.when(one(w), F.replace(w, F.lit("'"), F.lit("’"))).otherwise(w)), "")


def dedent(text: Column) -> Column:
    rows = lines(text)
    full = F.filter(rows, lambda x: F.trim(x) != "")
    depth = F.coalesce(F.array_min(F.transform(full, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    return F.array_join(F.transform(rows, lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(x, depth + 1, F.length(x)))), "\n")


def split_frontmatter(text: Column) -> Column:
    """struct(frontmatter, content)."""
    rows = lines(F.regexp_replace(text, r"\r\n?", "\n"))
    blank = F.transform(rows, lambda x: trimmed(x) != "")
    start = F.array_position(blank, True).cast("int")
    marks = F.transform(rows, lambda x, i: (trimmed(x) == "---") & (i >= start))
    end = F.array_position(marks, True).cast("int")
    opened = (start > 0) & (trimmed(F.get(rows, start - 1)) == "---")
    # A final line end makes no line.
    body = F.when(F.try_element_at(rows, F.lit(-1)) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    front = F.when(~opened, "").when(end == 0, text).otherwise(F.concat(F.array_join(F.slice(rows, start, end - start + 1), "\n"), F.lit("\n")))
    content = F.when(~opened, text).when(end == 0, "").otherwise(F.array_join(F.slice(body, end + 1, F.greatest(F.size(body) - end, F.lit(0))), "\n"))
    return F.struct(front.alias("frontmatter"), content.alias("content"))
