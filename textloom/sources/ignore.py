"""Ignore files by the gitignore rules: later lines win, ! takes back, / anchors, a final / means folders, ** spans folders."""

from __future__ import annotations

import re
from functools import lru_cache


@lru_cache(maxsize=4096)
def parsed_line(line: str) -> tuple[bool, bool, re.Pattern[str]] | None:
    """(excludes, folders only, pattern over the relative path)."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    excludes = not line.startswith("!")
    line = line[0 if excludes else 1 :].removeprefix("\\")
    folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, k = "", 0
    line = line.lstrip("/")
    while k < len(line):
        close = line.find("]", k + 2) if line[k] == "[" else -1
        if line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if line.startswith("/**", k) and k + 3 == len(line):
            out, k = out + "/.*", k + 3
            continue
        if line[k] == "*":
            out += "[^/]*"
            while line[k + 1 : k + 2] == "*":
                k += 1
        elif line[k] == "?":
            out += "[^/]"
        elif close > 0:
            inner = line[k + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            k = close
        elif line[k] == "\\" and k + 1 < len(line):
            k += 1
            out += re.escape(line[k])
        else:
            out += re.escape(line[k])
        k += 1
    return excludes, folders, re.compile(("" if anchored else "(?:.*/)?") + out + "(?:/.*)?$")


class Rules:
    def __init__(self, lines: list[str]):
        self.rules = [r for r in map(parsed_line, lines) if r]

    def matches(self, path: str) -> bool:
        """path is relative, with / between parts; a folder's ends in /."""
        folder, plain = path.endswith("/"), path.rstrip("/")
        out = False
        for excludes, folders_only, pattern in self.rules:
            parent = plain.rpartition("/")[0]
            hit = pattern.match(plain) if folder or not folders_only else parent and pattern.match(parent)
            if hit:
                out = excludes
        return out
