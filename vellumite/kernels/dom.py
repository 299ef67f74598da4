"""Element trees of one HTML document, from the parser's rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

from vellumite.sources.html import parse


class Node:
    """An element, or a text (tag #text) or comment (#comment)."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag[0] != "#"]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; a deep tree needs no deep stack."""
        todo = self.elements[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.elements[::-1]

    def content(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.tag == "#text":
                out.append(node.text)
            todo += node.children[::-1]
        return "".join(out)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def classes(self) -> list[str]:
        return self.get("class").split()

    def siblings(self) -> list[Node]:
        return self.parent.elements if self.parent else [self]

    def before(self) -> Node | None:
        own = self.siblings()
        at = next(i for i, x in enumerate(own) if x is self)
        return own[at - 1] if at else None


def document(html: str | None, bare: bool = True) -> Node:
    """The root above html (or above the topmost nodes, where there is no html)."""
    root, made = Node("#document"), {}
    for row in parse(html, bare):
        node = Node(row["tag"], row["attrs"], row["text"] or "")
        made[row["node_id"]] = node
        made.get(row["parent_id"], root).add(node)
    return root


def body(root: Node) -> Node:
    """The body; made, with what is not head matter, where there is none."""
    for node in root.walk():
        if node.tag == "body":
            return node
    made = Node("body")
    at = next((n for n in root.elements if n.tag == "html"), root)
    for child in [c for c in at.children if c.tag not in ("head", "title", "meta", "link", "base")]:
        at.children.remove(child)
        made.add(child)
    at.add(made)
    return made


def title(root: Node) -> str | None:
    for node in root.walk():
        if node.tag == "title":
            return re.sub(r"[ \t\n\r\f]+", " ", node.content()).strip() or None
    return None


def sheets(root: Node) -> list[str]:
    """The text of style elements that hold for every medium or for print."""
    return [n.content() for n in root.walk() if n.tag == "style" and (not n.get("media").strip() or re.search(r"\b(all|print)\b", n.get("media"), re.I))]


def fragment(node: Node) -> str | None:
    href = node.get("href").strip()
    return (unquote(href[1:]) or None) if href.startswith("#") else None


def fragments(root: Node) -> set[str]:
    """Ids that links of the document lead to."""
    return {f for n in root.walk() if n.tag == "a" and (f := fragment(n))}


def unwrapped_tables(root: Node) -> None:
    """Tables alone in a figure of an editor take the figure's place and its width."""
    for figure in [n for n in root.walk() if n.tag == "figure" and {"table", "se-flex-component"} & set(n.classes())]:
        inside = figure.elements
        if len(inside) != 1 or inside[0].tag != "table" or figure.parent is None:
            continue
        table = inside[0]
        found = re.search(r"(?:^|;)\s*width\s*:\s*([^;]+)", figure.get("style"), re.I)
        width = found[1].strip() if found else "auto" if "se-flex-component" in figure.classes() else None
        own = [d.strip() for d in table.get("style").split(";") if d.strip() and not re.fullmatch(r"width\s*:\s*100%", d.strip(), re.I)]
        if width and not any(re.match(r"width\s*:", d, re.I) for d in own):
            own.insert(0, f"width: {width}")
        if own or "style" in table.attrs:
            table.attrs["style"] = "; ".join(own)
        if "table" in figure.classes():
            table.attrs["class"] = f"{table.get('class')} {figure.get('class')}".strip()
        at = figure.parent.children.index(figure)
        figure.parent.children[at] = table
        table.parent = figure.parent
