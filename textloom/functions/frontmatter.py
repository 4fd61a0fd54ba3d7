"""YAML frontmatter between two --- lines at the start of a text."""

from __future__ import annotations


def split_frontmatter(text: str) -> tuple[str, str]:
    """(frontmatter, content). Blank lines before it are dropped; one that isn't closed is all of the text."""
    if "---" not in text:
        return "", text
    lines = text.splitlines()
    start = next((k for k, x in enumerate(lines) if x.strip()), len(lines))
    if start == len(lines) or lines[start].strip() != "---":
        return "", text
    end = next((k for k in range(start + 1, len(lines)) if lines[k].strip() == "---"), None)
    if end is None:
        return text, ""
    return "\n".join(lines[start : end + 1]) + "\n", "\n".join(lines[end + 1 :])


def has_frontmatter(text: str) -> bool:
    return split_frontmatter(text)[0] != ""
