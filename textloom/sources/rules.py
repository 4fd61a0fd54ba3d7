"""Rules over paths and small texts as columns: include, exclude, size, versions and stamps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.ignore import parsed_line

#: What is included, and the folders that a walk doesn't enter.
INCLUDE = ("*.md",)
EXCLUDE = (
    ".git", ".hg", ".svn", ".bzr", "_darcs",
    ".venv", "venv", "__pycache__", ".tox", ".nox", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".eggs", "*.egg-info",
    "build", "dist",
    "node_modules", ".next", ".nuxt", ".output", ".cache", ".parcel-cache", ".turbo",
    ".idea", ".vscode", ".vs", ".fleet",
    "coverage", "htmlcov", ".coverage",
    "vendor", "third_party", "Pods", "target", ".terraform",
)
MAX_SIZE = 1 << 20


def glob_pattern(glob: str) -> str:
    """A name's glob as a regular expression."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inner = glob[k + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            k = close
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def _any(name: Column, globs) -> Column:
    return name.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def included(path: Column, globs=INCLUDE) -> Column:
    """By the last part of the path."""
    return _any(F.element_at(F.split(path, "/"), -1), globs)


def pruned(path: Column, globs=EXCLUDE) -> Column:
    """Whether a folder on the way is excluded."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: _any(p, globs))


def matches_any(path: Column, globs) -> Column:
    """Whether any part of the path matches."""
    return F.exists(F.split(path, "/"), lambda p: _any(p, globs))


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last of an ignore file's lines that matches excludes. path is a file's, relative to the ignore file's folder; an ignore file is short, so its lines are a chain of conditions."""
    parent = F.regexp_replace(path, "/?[^/]*$", "")
    rules = [r for r in map(parsed_line, lines) if r]
    hits = [F.when((parent if folders else path).rlike("^(?:" + pattern.pattern + ")"), F.lit(excludes)) for excludes, folders, pattern in reversed(rules)]
    return F.coalesce(*hits, F.lit(False))


def small_enough(size: Column, most: int = MAX_SIZE) -> Column:
    return (size <= most) | F.lit(most == 0)


def resolve(paths: DataFrame) -> DataFrame:
    """Each path once, in order."""
    return paths.select("path").distinct().orderBy("path")


def fill_placeholders(text: Column, values: dict[str, str]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def is_release(version: Column) -> Column:
    return version.rlike(r"^[0-9]+(\.[0-9]+)*(\.post[0-9]+)?$")


def format_stamp(text: Column) -> Column:
    """Null without a text, 0 without a stamp, else its number."""
    n = F.regexp_extract(text, r"format=f([0-9]+)", 1)
    return F.when(text.isNull(), F.lit(None).cast("int")).when(n == "", 0).otherwise(F.when(n != "", n).cast("int"))


def insert_marker(text: Column, marker: str) -> Column:
    """text with a marker paragraph after its frontmatter, or in front where there is none."""
    close = F.locate("\n---\n", text, 5)
    head = F.when(text.startswith("---\n") & (close > 0), close + 4).otherwise(0)
    return F.concat(F.substring(text, F.lit(1), head), F.lit(marker + "\n\n"), F.substring(text, head + 1, F.length(text)))


def replace_blocks(text: Column, begin: str, end: str, block: str) -> Column:
    """text with one block where its first from begin to end was; further ones go. Without any, text stays."""
    around = F.split(text, rf"(?s)\Q{begin}\E.*?\Q{end}\E", -1)
    rest = F.array_join(F.slice(around, 2, F.greatest(F.size(around) - 1, F.lit(0))), "")
    return F.when(F.size(around) > 1, F.concat(around[0], F.lit(block), rest)).otherwise(text)


def upsert_block(text: Column, begin: str, end: str, block: str, own: int) -> Column:
    """struct<action, text>: block put in place of those that text has, or after it.

    A null text is a file that isn't there. A begin marker that is never closed stays as it is; one stamped newer
    than own blocks the change.
    """
    stamp = F.ltrim(F.regexp_extract(text, rf"\Q{begin}\E\s+format=f([0-9]+)", 1), F.lit("0"))
    newer = F.when(F.length(stamp) > 18, True).otherwise(stamp.try_cast("long") > own)
    gap = F.when(text.endswith("\n"), "\n").otherwise("\n\n")
    appended = F.when(F.coalesce(text, F.lit("")) == "", F.lit(block + "\n")).otherwise(F.concat(text, gap, F.lit(block + "\n")))
    new = F.when(F.coalesce(F.contains(text, F.lit(begin)), F.lit(False)), replace_blocks(text, begin, end, block)).otherwise(appended)
    action = F.when(newer, "blocked-newer").when(text.isNull(), "installed").when(text == new, "unchanged").otherwise("updated")
    return F.struct(action.alias("action"), F.when(newer, text).otherwise(new).alias("text"))


def write_decision(found: Column, own: Column, same: Column) -> Column:
    """What happens to an installed file: found is its stamp, own the one to write."""
    return F.when(found.isNull(), "installed").when(found > own, "blocked-newer").when(same, "unchanged").otherwise("updated")


def chosen(asked: Column, known: list[str]) -> Column:
    return F.array_intersect(F.array(*map(F.lit, known)), asked)


def unknown(asked: Column, known: list[str]) -> Column:
    return F.array_except(asked, F.array(*map(F.lit, known)))
