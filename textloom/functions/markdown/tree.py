"""Walks, tables and rewrites of the tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from textloom.functions.markdown.inline import normal_label
from textloom.functions.markdown.nodes import Link, Node

SCOPES = ("paragraph", "heading", "cell")


def walk(node: Node) -> Iterator[Node]:
    """Every node below, in document order."""
    todo = node.children[::-1]
    while todo:
        n = todo.pop()
        yield n
        todo += n.children[::-1]


#: Nodes that hold others.
CONTAINERS = {"document", "quote", "alert", "list", "item", "footnote", "table", "row", "cell", "paragraph", "heading", "emphasis", "strong", "strike", "link", "image"}


def transform_tree(node: Node, fn: Callable[[Node], None]) -> None:
    """fn on node and on every container below, each before what it holds; fn may change the node it gets."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.kind in CONTAINERS or n.children:
            fn(n)
            todo += n.children[::-1]


def inline_text(node: Node) -> str:
    return node.text if not node.children else "".join(map(inline_text, node.children))


def extract_links(doc: Node, include_autolinks: bool = True, include_images: bool = False) -> list[Link]:
    kinds = {"link", *(("autolink", "url") if include_autolinks else ()), *(("image",) if include_images else ())}
    return [Link(inline_text(n), n.dest, n.attrs.get("title")) for n in walk(doc) if n.kind in kinds]


def reference_table(doc: Node) -> list[dict]:
    """Rows (kind, ord, label, dest, title, text, inside) of definitions, links, images, notes and their marks, in document order.

    label: normalised, of what is defined or referred to. A link or image by reference has no destination here: the definition has it. inside: the ord of the link around.
    """
    out: list[dict] = []
    todo: list[tuple[Node, int | None]] = [(doc, None)]
    while todo:
        n, inside = todo.pop()
        row = {"kind": n.kind, "ord": len(out), "label": None, "dest": None, "title": None, "text": None, "inside": inside}
        if n.kind == "link_ref":
            out.append(row | {"kind": "definition", "label": normal_label(n.label), "dest": n.dest, "title": n.title})
        elif n.kind in ("link", "image"):
            own = {"label": n.key} if n.key is not None else {"dest": n.dest, "title": n.title}
            out.append(row | own | {"text": inline_text(n)})
            inside = row["ord"] if n.kind == "link" else inside
        elif n.kind in ("autolink", "url"):
            out.append(row | {"kind": "link", "dest": n.dest, "text": n.dest})
        elif n.kind in ("footnote", "footnote_ref"):
            text = " ".join("".join(" " if x.kind == "break" else x.text for x in walk(p) if not x.children) for p in walk(n) if p.kind in SCOPES) if n.kind == "footnote" else None
            out.append(row | {"kind": "note" if n.kind == "footnote" else "note_ref", "label": normal_label(n.label), "text": text})
        todo += [(c, inside) for c in n.children[::-1]]
    return out


BLOCKS = {"paragraph", "heading", "thematic_break", "code_block", "fenced_code", "quote", "alert", "list", "item", "footnote", "table", "link_ref", "blank"}


def block_table(doc: Node) -> list[dict]:
    """Rows (node_id, parent_id, ord, depth, type, start, end) in pre-order; the document is node 0."""
    out = [{"node_id": 0, "parent_id": None, "ord": 0, "depth": 0, "type": "document", "start": doc.start, "end": doc.end}]

    def add(n: Node, parent: int, depth: int) -> None:
        for k, c in enumerate(x for x in n.children if x.kind in BLOCKS):
            own = len(out)
            out.append({"node_id": own, "parent_id": parent, "ord": k, "depth": depth, "type": c.kind, "start": c.start, "end": c.end})
            if c.kind not in SCOPES:
                add(c, own, depth + 1)

    add(doc, 0, 1)
    return out


def coalesce_lines(doc: Node) -> None:
    """Texts with nothing but soft breaks between them become one text with line ends."""
    for n in [doc, *walk(doc)]:
        if len(n.children) < 3:
            continue
        out: list[Node] = []
        for c in n.children:
            if c.kind == "raw" and len(out) > 1 and out[-1].kind == "break" and out[-1].soft and out[-2].kind == "raw":
                out.pop()
                out[-1].text += "\n" + c.text
            else:
                out.append(c)
        n.children = out


def rewrite_texts(doc: Node, fn: Callable[[str], str], coalesce: bool = False) -> None:
    """fn on each text by itself."""
    if coalesce:
        coalesce_lines(doc)
    for n in walk(doc):
        if n.kind == "raw":
            n.text = fn(n.text)


def segments(node: Node) -> list[tuple[str, Node | None]]:
    """The texts of an inline scope in order; those that may change come with their node."""
    out: list[tuple[str, Node | None]] = []
    for c in node.children:
        if c.kind == "raw":
            out.append((c.text, c))
        elif c.kind == "break":
            out.append(("\n", None))
        elif c.children:
            out += [(t, None if c.kind in ("autolink", "url") else n) for t, n in segments(c)]
        else:
            out.append((c.text, None))
    return out


def segment_table(doc: Node) -> list[dict]:
    """Rows (scope, ord, text, fixed) of the segments of all paragraphs, headings and cells."""
    coalesce_lines(doc)
    scopes = [segments(n) for n in walk(doc) if n.kind in SCOPES]
    return [{"scope": k, "ord": j, "text": t, "fixed": node is None} for k, own in enumerate(scopes) for j, (t, node) in enumerate(own)]


def rewrite_across(doc: Node, fn: Callable[[str], str]) -> None:
    """fn, which keeps the length, on the whole text of each paragraph, heading and cell; only plain texts change."""
    coalesce_lines(doc)
    for n in walk(doc):
        if n.kind in SCOPES:
            own = segments(n)
            new, at = fn("".join(t for t, _ in own)), 0
            for t, node in own:
                if node is not None:
                    node.text = new[at : at + len(t)]
                at += len(t)


def unbold_headings(doc: Node) -> None:
    """A heading that is bold as a whole isn't; bold and emphasised stays emphasised."""
    for n in walk(doc):
        if n.kind == "heading" and len(n.children) == 1:
            only = n.children[0]
            if only.kind == "strong":
                n.children = only.children
            elif only.kind == "emphasis" and len(only.children) == 1 and only.children[0].kind == "strong":
                only.children = only.children[0].children
