"""The tree: a node has a kind, children or text, attributes and (blocks only) its span in the LF-normalised source."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple


@dataclass
class Node:
    kind: str
    children: list[Node] = field(default_factory=list)
    text: str = ""
    attrs: dict[str, Any] = field(default_factory=dict)
    start: int = -1
    end: int = -1

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["attrs"][name]
        except KeyError:
            raise AttributeError(name) from None


class Link(NamedTuple):
    text: str
    url: str
    title: str | None
