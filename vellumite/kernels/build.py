"""An HTML document as a model: paragraphs, tables, lists, notes, comments, page furniture.

One walk over the tree. An element's style follows from its parent's; blocks hand their indents, borders, shading
and list down as a context; text goes to the flow of the nearest block, which becomes a paragraph at the next
block boundary.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from urllib.parse import quote, unquote

from vellumite.functions.text import UNSAFE_SCHEMES
from vellumite.kernels import dom, grid, images, lists
from vellumite.kernels.comments import balance
from vellumite.kernels.dom import Node
from vellumite.kernels.flow import Flow, Link
from vellumite.kernels.metrics import line_units
from vellumite.kernels.styles import Sheets, Style, computed, edge_of, run_of
from vellumite.kernels.units import EMU_PER_PIXEL, rounded, twips
from vellumite.sources.html import IGNORED

SIDES = ("top", "left", "bottom", "right")
LEAST_WIDTH = 1440  # twips that indents leave for text
# Elements shown as a link to their source; styles by element; fields that are kept.
MEDIA = ("iframe", "video", "audio", "embed", "object")
STYLE_IDS = {**{f"h{k}": f"Heading{k}" for k in range(1, 7)}, "figcaption": "Caption"}
FIELDS = ("PAGE", "NUMPAGES")
EMPTY_PARAGRAPH = {"before": 0, "after": 0, "line": 240, "rule": "auto"}


@dataclass(frozen=True)
class Context:
    """What a block hands down."""

    width: int
    left: int = 0
    right: int = 0
    borders: tuple = (None, None, None, None)
    shading: str | None = None
    style: str | None = None
    counter: lists.Counter | None = None
    depth: int = 0
    marker: dict | None = None


class Line:
    """A block's flow of inlines and the link that it is in."""

    def __init__(self, style: Style, context: Context):
        self.style, self.context = style, context
        self.flow: Flow | None = None
        self.link: Link | None = None
        self.align: str | None = None

    def open(self) -> Flow:
        if self.flow is None:
            self.flow = Flow()
        return self.flow


def safe_target(href: str) -> str | None:
    """A link's address, percent-encoded where it must be; None where it is empty or its scheme is unsafe."""
    bare = re.sub(r"[\x00-\x20]+", "", href)
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", bare)
    if not bare or (scheme and scheme[1].lower() in UNSAFE_SCHEMES):
        return None
    return re.sub(r"[^\x21-\x7e]|[\"<>\\^`{|}]", lambda m: quote(m[0], safe=""), href.strip())


def paragraph(props: dict, inlines: list[dict]) -> dict:
    return {"kind": "paragraph", "props": props, "inlines": inlines}


def normalised(blocks: list[dict], mark: dict | None = None) -> list[dict]:
    """A paragraph between tables and after the last; tables' margins go to the neighbours; never without a block."""
    out: list[dict] = []
    for block in blocks:
        last = out[-1] if out else None
        if block["kind"] == "table" and last and last["kind"] == "table":
            out.append(paragraph({**EMPTY_PARAGRAPH, "before": max(last["bottom"], block["top"]), "mark": {"size": 2}}, []))
        elif block["kind"] == "table" and last and block["top"] > 0:
            last["props"]["after"] = max(last["props"].get("after") or 0, block["top"])
        elif block["kind"] == "paragraph" and last and last["kind"] == "table" and last["bottom"] > 0:
            block["props"]["before"] = max(block["props"].get("before") or 0, last["bottom"])
        out.append(block)
    if not out:
        return [paragraph({"mark": mark} if mark else {**EMPTY_PARAGRAPH, "mark": {"size": 2}}, [])]
    if out[-1]["kind"] == "table":
        out.append(paragraph({**EMPTY_PARAGRAPH, "before": out[-1]["bottom"], "mark": {"size": 2}}, []))
    return out


def fitted(left: int, right: int, width: int) -> tuple[int, int]:
    """Indents, made smaller in proportion where they would leave less than LEAST_WIDTH."""
    room = max(0, width - LEAST_WIDTH)
    if left + right <= room:
        return left, right
    left = left * room // (left + right)
    return left, room - left


def latex_of(node: Node) -> tuple[str, bool] | None:
    """(LaTeX, whether displayed) of the ways in which editors mark a formula."""
    classes, kind, shown = node.classes(), node.get("data-type"), node.content().strip()
    if "data-se-value" in node.attrs and "se-math" in classes:
        text = node.get("data-se-value")
    elif "data-exp" in node.attrs and any("katex" in c for c in classes):
        text = node.get("data-exp")
    elif node.tag == "math":
        text = next((n.content() for n in node.walk() if n.tag == "annotation" and n.get("encoding") == "application/x-tex"), "")
    elif kind in ("inline-math", "block-math"):
        text = node.get("data-latex")
    elif "math-tex" in classes:
        text = re.sub(r"\A\\[(\[]|\\[)\]]\Z", "", shown)
    else:
        return None
    display = node.get("display") == "block" if node.tag == "math" else kind == "block-math" if kind else shown.startswith("\\[")
    return text.strip(), display


def timestamp(value: str) -> str | None:
    """An ISO date in UTC, or None."""
    try:
        found = datetime.fromisoformat(value.strip())
    except ValueError:
        return None
    found = found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    return found.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Builder:
    """options: base (Style), sheet and base_sheet (CSS), page_width (twips of the text), picture (images.Resolver), title, author, language, created, bare_references (see sources.html.parse)."""

    def __init__(self, html: str | None, options: dict):
        self.options = options
        self.root = dom.document(html, options.get("bare_references", True))
        self.body = dom.body(self.root)
        self.sheets = Sheets(options["sheet"], options.get("base_sheet", ""), dom.sheets(self.root))
        self.made: dict[tuple, tuple[Style, Style]] = {}  # by parent (kept, so that its id stays its own) and winning declarations
        self.lists = lists.Definitions()
        self.links = dom.fragments(self.root)
        self.names: dict[str, str] = {}
        self.placed: set[str] = set()
        self.waiting: list[dict] = []  # bookmarks for the next paragraph
        self.page_break = False
        self.pictures: dict[str, dict | None] = {}
        self.notes: list[dict] = []
        self.comments: list[dict] = []
        self.furniture: list[dict] = []
        dom.unwrapped_tables(self.root)
        self._find_notes()
        self._find_furniture()
        self._find_comments()

    # What is set apart: notes, furniture, comments.

    def _find_notes(self) -> None:
        """Lists of notes by class, section or the items' ids; their items by id; marks that only lead back."""
        self.note_lists: dict[int, str] = {}
        self.note_items: dict[str, tuple[str, int]] = {}
        self.note_numbers: dict[int, int] = {}
        self.dropped: set[int] = set()
        by_id = {n.get("id"): n for n in reversed([*self.body.walk()]) if n.get("id")}
        for kind in ("footnote", "endnote"):
            for node in [n for n in self.body.walk() if n.tag == "ol"]:
                first = node.elements[0] if node.elements else None
                named = f"se-{kind}s" in node.classes() or (node.parent is not None and node.parent.tag == "section" and f"{kind}s" in node.parent.classes())
                numbered = first is not None and first.tag == "li" and re.search(rf"(^|[-_]){kind}-\d+\Z", first.get("id"))
                if id(node) in self.note_lists or not (named or numbered):
                    continue
                self.note_lists[id(node)] = kind
                rule = node.before()
                if rule is not None and rule.tag == "hr":
                    self.dropped.add(id(rule))
                number = 1
                for item in [x for x in node.elements if x.tag == "li"]:
                    value = re.match(r"\s*(\d+)", item.get("value"))
                    number = int(value[1]) if value and int(value[1]) > 0 else number
                    self.note_numbers[id(item)] = number
                    own = item.get("id")
                    if own:
                        self.note_items[own] = (kind, number)
                        self.links.discard(own)
                        for back in [a for a in item.walk() if a.tag == "a" and dom.fragment(a)]:
                            to = by_id.get(dom.fragment(back))
                            if (to is not None and to.tag == "a" and dom.fragment(to) == own) or (to is None and dom.fragment(back) == re.sub(r"-(\d+)\Z", r"-ref-\1", own)):
                                self.dropped.add(id(back))
                                self.links.discard(dom.fragment(back))
                    number += 1

    def _find_furniture(self) -> None:
        self.furniture_of: dict[int, tuple[str, str]] = {}
        for node in self.body.walk():
            for kind in ("header", "footer"):
                if node.tag == "div" and f"se-{kind}" in node.classes():
                    place = node.get("data-type").lower()
                    self.furniture_of[id(node)] = (kind, place if place in ("first", "even") else "default")
        self.last_furniture: Node | None = None

    @staticmethod
    def _comment_ids(node: Node) -> list[int]:
        return [int(x) for x in node.get("data-comment").split() if re.fullmatch(r"[0-9]+", x) and int(x) > 0]

    def _find_comments(self) -> None:
        self.comment_lists = {id(n) for n in self.body.walk() if n.tag == "ol" and "se-comments" in n.classes()}
        self.comment_first: dict[int, Node] = {}
        self.comment_last: dict[int, Node] = {}
        for node in self.body.walk():
            if node.tag == "span" and "se-comment" in node.classes():
                for one in self._comment_ids(node):
                    self.comment_first.setdefault(one, node)
                    self.comment_last[one] = node

    def _apart(self, node: Node, style: Style, context: Context | None = None) -> list[dict]:
        out: list[dict] = []
        self.children(node, style, context or Context(self.options["page_width"]), out)
        return normalised(out)

    def _render_notes(self, node: Node, kind: str, style: Style, context: Context) -> None:
        for item in node.elements:
            if id(item) in self.note_numbers:
                blocks = self._apart(item, self.style(item, style), Context(context.width))
                self.notes.append({"type": kind, "number": self.note_numbers[id(item)], "blocks": blocks})

    def _render_furniture(self, node: Node, style: Style) -> bool:
        """One part for each kind and type; lines that follow each other are one part."""
        kind, place = self.furniture_of[id(node)]
        known = any((f["kind"], f["type"]) == (kind, place) for f in self.furniture)
        before = node.before()
        goes_on = known and before is not None and before is self.last_furniture and self.furniture_of[id(before)] == (kind, place)
        if known and not goes_on:
            return False
        out: list[dict] = []
        line = Line(style, Context(self.options["page_width"]))
        self.block(node, style, line, out)
        self.flush(line, out)
        if goes_on:
            self.furniture[-1]["blocks"] += normalised(out)
        else:
            self.furniture.append({"kind": kind, "type": place, "blocks": normalised(out)})
        self.last_furniture = node
        return True

    def _render_comments(self, node: Node, style: Style) -> None:
        seen = {c["id"] for c in self.comments}
        for item in [x for x in node.elements if x.tag == "li"]:
            ids = self._comment_ids(item)
            if not ids or ids[0] in seen:
                continue
            seen.add(ids[0])
            parent = re.match(r"\s*(\d+)", item.get("data-parent"))
            parent = int(parent[1]) if parent else 0
            self.comments.append({
                "id": ids[0], "author": item.get("data-author").strip() or None, "initials": item.get("data-initials").strip() or None, "date": timestamp(item.get("data-date")),
                "parent": parent if parent > 0 and parent != ids[0] else None, "resolved": item.get("data-resolved") == "true", "blocks": self._apart(item, self.style(item, style)),
            })

    # The walk.

    def style(self, node: Node, parent: Style) -> Style:
        own = self.sheets.winners(node)
        key = (id(parent), *own.items())
        if key not in self.made:
            self.made[key] = parent, computed(own, parent)
        return self.made[key][1]

    def children(self, node: Node, style: Style, context: Context, out: list[dict]) -> None:
        line = Line(style, context)
        for child in node.children:
            self.node(child, style, line, out)
        self.flush(line, out)

    def node(self, node: Node, parent: Style, line: Line, out: list[dict]) -> None:
        if node.tag == "#text":
            if line.flow is not None or node.text.strip(" \t\n\r\f") or parent.keeps_space:
                line.open().text(node.text, run_of(parent), parent, line.link)
            return
        if node.tag == "#comment" or node.tag in IGNORED or id(node) in self.dropped:
            return
        style = self.style(node, parent)
        if style.display == "none":
            return
        if id(node) in self.note_lists:
            self.flush(line, out)
            return self._render_notes(node, self.note_lists[id(node)], style, line.context)
        if id(node) in self.furniture_of:
            self.flush(line, out)
            if self._render_furniture(node, style):
                return None
        if id(node) in self.comment_lists:
            self.flush(line, out)
            return self._render_comments(node, style)
        if node.tag == "a" and dom.fragment(node) in self.note_items:
            kind, number = self.note_items[dom.fragment(node)]
            return line.open().put("note", run_of(parent), line.link, text=kind, ref=number)
        self._bookmarks(node)
        if node.tag == "br":
            line.open().line_break(run_of(style), line.link)
        elif node.tag == "img":
            self._image(node, style, line)
        elif node.tag == "table":
            self.table(node, style, line, out)
        elif node.tag == "hr":
            self._rule(style, line, out)
        elif node.tag == "input":
            self._input(node, style, line)
        elif node.tag in MEDIA:
            self._media(node, style, line)
        elif style.block:
            self.block(node, style, line, out)
        else:
            self.inline(node, style, line, out)
        return None

    def inline(self, node: Node, style: Style, line: Line, out: list[dict]) -> None:
        run = run_of(style)
        formula = latex_of(node)
        if formula is not None:
            if formula[0]:
                line.open().put("formula", run, line.link, text=formula[0], display=formula[1])
            return
        if node.get("data-field").upper() in FIELDS:
            line.open().put("field", run, line.link, field=node.get("data-field").upper(), text=node.content().strip())
            return
        marks = self._comment_ids(node) if node.tag == "span" else []
        for one in marks:
            if self.comment_first.get(one) is node:
                line.open().mark("comment_start", one)
        before = line.link
        if node.tag == "a" and "href" in node.attrs:
            line.link = self.target(node.get("href")) or before
        if node.tag == "q":
            line.open().text("“", run, style, line.link)
        for child in node.children:
            self.node(child, style, line, out)
        if node.tag == "q":
            line.open().text("”", run, style, line.link)
        for one in marks:
            if self.comment_last.get(one) is node:
                line.open().mark("comment_end", one)
        line.link = before

    def block(self, node: Node, style: Style, line: Line, out: list[dict]) -> None:
        self.flush(line, out)
        outer = line.context
        whole = outer.width / 20
        positive = lambda name: max(0.0, style.length(name, whole) or 0.0)
        media = any(n.tag in MEDIA for n in node.walk())
        padding = {s: 0.0 if media and s in ("top", "bottom") and (style.value(f"padding-{s}") or "").endswith("%") else positive(f"padding-{s}") for s in SIDES}
        drawn = {s: style.border(s) for s in SIDES}
        indent = [twips(positive(f"margin-{s}") + padding[s] + (drawn[s][1] if drawn[s] else 0)) for s in ("left", "right")]
        left, right = fitted(*indent, outer.width)
        width = outer.width - left - right
        asked = [w for name in ("width", "max-width") if (w := style.length(name, whole)) and w > 0]
        if asked:
            width = min(width, twips(max(min(asked), style.length("min-width", whole) or 0.0)))
        edges = [edge_of(drawn[s], padding[s]) for s in SIDES]
        context = replace(
            outer,
            width=max(20, width),
            left=outer.left + left,
            right=outer.right + right,
            borders=tuple(own or old for own, old in zip(edges, outer.borders)),
            shading=style.background() or outer.shading,
            style=STYLE_IDS.get(node.tag, outer.style),
        )
        if node.tag in ("ul", "ol"):
            self._pending_marker(line, out)
            counter = lists.Counter(node, self.lists, min(8, outer.depth), context.left, style.value("list-style-position") == "inside")
            context = replace(context, counter=counter, depth=outer.depth + 1, marker=None)
        elif style.display == "list-item" and outer.counter is not None:
            context = replace(context, marker=outer.counter.marker(node, style.marker, style))
        if style.breaks("before") in ("always", "page", "left", "right"):
            self.page_break = True
        first = len(out)
        self.children(node, style, context, out)
        if context.marker is not None and context.marker is not outer.marker:
            self._pending_marker(Line(style, context), out)
        top = twips(positive("margin-top") + (0 if edges[0] else padding["top"]))
        bottom = twips(positive("margin-bottom") + (0 if edges[2] else padding["bottom"]))
        self._margins(out, first, top, bottom, (style.value("overflow") or "visible") != "visible")
        if style.breaks("after") in ("always", "page", "left", "right"):
            self.page_break = True

    @staticmethod
    def _margins(out: list[dict], first: int, top: int, bottom: int, kept: bool) -> None:
        """A box's vertical margins meet those of its first and last block: the larger counts, or their sum where the box keeps them in."""
        joined = lambda a, b: a + b if kept else max(a, b)
        if len(out) <= first:
            return
        for block, side, own in ((out[first], "before", top), (out[-1], "after", bottom)):
            if own > 0 and block["kind"] == "paragraph":
                block["props"][side] = joined(block["props"].get(side) or 0, own)
            elif own > 0:
                side = {"before": "top", "after": "bottom"}[side]
                block[side] = joined(block[side], own)

    def _pending_marker(self, line: Line, out: list[dict]) -> None:
        """A list item whose marker nothing took gets an empty paragraph for it."""
        if line.context.marker is not None and not line.context.marker["taken"]:
            out.append(self._paragraph(Line(line.style, line.context), []))

    def flush(self, line: Line, out: list[dict]) -> None:
        flow, line.flow = line.flow, None
        inlines = flow.finish() if flow else None
        if inlines is not None:
            made = self._paragraph(line, inlines)
            if line.align:
                made["props"]["align"] = line.align
            line.align = None
            out.append(made)

    def _paragraph(self, line: Line, inlines: list[dict], props: dict | None = None) -> dict:
        style, context = line.style, line.context
        if len(inlines) == 1 and inlines[0]["kind"] == "text" and inlines[0]["text"] == " ":
            inlines = []
        if props is None:
            rule = {"multiple": "auto", "points": "atLeast"}.get(style.line[0]) if style.line else None
            height = (line_units(style.line[1], style.family) if rule == "auto" else max(1, twips(style.line[1]))) if style.line else None
            props = {
                "style": context.style, "align": {"center": "center", "right": "right", "justify": "both", "left": "left"}.get(style.align), "left": context.left, "right": context.right,
                "first": 0 if style.indent is None else twips(style.indent), "line": height, "rule": rule, "keep_next": style.breaks("after") in ("avoid", "avoid-page"),
                "keep_lines": style.breaks("inside") in ("avoid", "avoid-page"), "shading": context.shading, "borders": dict(zip(SIDES, context.borders)) if any(context.borders) else None,
                "bidi": style.direction == "rtl", "mark": run_of(style),
            }
            marker = context.marker
            if marker is not None and not marker["taken"]:
                marker["taken"] = True
                props["num_id"], props["level"], hanging = marker["counter"].reference(marker["value"], marker["kind"], marker["style"])
                props["ordinal"] = marker["value"]
                props["first"] = -hanging
        if self.page_break:
            props["page_break"], self.page_break = True, False
        waiting, self.waiting = self.waiting, []
        return paragraph(props, [*waiting, *inlines])

    # Single elements.

    def target(self, href: str) -> Link | None:
        href = href.strip()
        if href.startswith("#"):
            return (None, self.bookmark_name(unquote(href[1:]))) if href[1:] else None
        url = safe_target(href)
        return (url, None) if url else None

    def bookmark_name(self, name: str) -> str:
        """`_` and up to 32 letters, digits and underscores, made unique by a number."""
        if name not in self.names:
            base = "_" + re.sub(r"[^A-Za-z0-9_]", "_", name)[:32]
            made, k, taken = base, 1, set(self.names.values())
            while made in taken:
                k += 1
                made = f"{base}_{k}"
            self.names[name] = made
        return self.names[name]

    def _bookmarks(self, node: Node) -> None:
        """The first element with an id (or anchor name) that some link leads to is a bookmark of the next paragraph."""
        for one in (node.get("id"), node.get("name") if node.tag == "a" else ""):
            if one in self.links and one not in self.placed:
                self.placed.add(one)
                self.waiting.append({"kind": "bookmark", "ref": len(self.placed), "text": self.bookmark_name(one)})

    def _image(self, node: Node, style: Style, line: Line) -> None:
        source = node.get("src").strip()
        if source and source not in self.pictures:
            self.pictures[source] = images.inspect(self.options["picture"](source))
        image = self.pictures.get(source)
        if image is None:
            if node.get("alt").strip():
                line.open().text(node.get("alt").strip(), run_of(style), style, line.link)
            return
        room = max(1.0, line.context.width / 15)
        asked = [None if (pt := style.length(name, whole)) is None or pt <= 0 else pt / 0.75 for name, whole in (("width", room * 0.75), ("height", None))]
        width, height = images.shown_size(image, *asked, room)
        side = next((s for s in (style.value("float"), line.style.value("float")) if s in ("left", "right")), None)
        line.open().put("image", run_of(style), line.link, media=image["hash"], width=rounded(width * EMU_PER_PIXEL), height=rounded(height * EMU_PER_PIXEL), text=node.get("alt").strip(), side=side)
        if side is None and line.align is None:
            line.align = next((a for s in (line.style, style if style.block else None) if s and (a := self._auto_margins(s))), None)

    @staticmethod
    def _auto_margins(style: Style) -> str | None:
        return ("center" if style.auto("margin-right") else "right") if style.auto("margin-left") else None

    def _rule(self, style: Style, line: Line, out: list[dict]) -> None:
        """A horizontal rule is an empty paragraph with a border below."""
        self.flush(line, out)
        self._pending_marker(line, out)
        whole, context = line.context.width / 20, line.context
        edge = edge_of(style.border("top") or style.border("bottom")) or {"style": "single", "size": 6, "color": "999999", "space": 0}
        gap = lambda name, base=whole: max(0.0, style.length(name, base) or 0.0)
        props = {"left": context.left, "right": context.right, "first": 0, "before": twips(gap("margin-top")), "after": twips(gap("margin-bottom")) + twips(gap("height", None)), "line": 1, "rule": "exact", "borders": {"bottom": edge}, "mark": {"size": 2}}
        out.append(self._paragraph(Line(style, context), [], props))

    def _input(self, node: Node, style: Style, line: Line) -> None:
        kind = node.get("type").lower()
        text = "" if kind == "hidden" else ("☑ " if "checked" in node.attrs else "☐ ") if kind in ("checkbox", "radio") else node.get("value")
        if text:
            line.open().text(text, run_of(style), style, line.link)

    def _media(self, node: Node, style: Style, line: Line) -> None:
        source = (node.get("src") or node.get("data")).strip() or next((n.get("src").strip() for n in node.walk() if n.tag == "source" and "src" in n.attrs), "")
        link = self.target(source) if source else None
        if link:
            line.open().text(source, {**run_of(style), "color": "0056B3", "underline": "single"}, style, link)

    # Tables.

    def table(self, node: Node, style: Style, line: Line, out: list[dict]) -> None:
        self.flush(line, out)
        if self.page_break or style.breaks("before") in ("always", "page", "left", "right"):
            self.page_break = True
            out.append(self._paragraph(Line(style, replace(line.context, style=None)), []))
        self._pending_marker(line, out)
        out += self._table(node, style, line.context)
        if style.breaks("after") in ("always", "page", "left", "right"):
            self.page_break = True

    def _table(self, node: Node, style: Style, context: Context) -> list[dict]:
        """Captions, then the table: head rows, body rows, foot rows; hidden rows are left out."""
        blocks: list[dict] = []
        groups: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
        columns: list[Style] = []
        for child in node.elements:
            own = self.style(child, style)
            if child.tag == "caption" and own.display != "none":
                self.children(child, own, replace(context, style="Caption"), blocks)
            elif child.tag in ("colgroup", "col"):
                cols = [c for c in child.elements if c.tag == "col"] if child.tag == "colgroup" else []
                for c, s in [(c, self.style(c, own)) for c in cols] or [(child, own)]:
                    span = re.match(r"\s*(\d+)", c.get("span"))
                    columns += [s] * max(1, min(1000, int(span[1]) if span else 1))
            elif child.tag in groups and own.display != "none":
                groups[child.tag] += [(r, self.style(r, own), own, child.tag == "thead") for r in child.elements if r.tag == "tr"]
            elif child.tag == "tr":
                groups["tbody"].append((child, own, style, False))
        rows = [r for g in groups.values() for r in g if r[1].display != "none"]
        whole = context.width / 20
        found = []
        for tr, row_style, _, _ in rows:
            line = []
            for cell in [c for c in tr.elements if c.tag in ("td", "th")]:
                own = self.style(cell, row_style)
                spans = [int(m[1]) if (m := re.match(r"\s*(\d+)", cell.get(a))) else 1 for a in ("colspan", "rowspan")]
                line.append({"node": cell, "style": own, "colspan": max(1, spans[0]), "rowspan": spans[1] if cell.get("rowspan").strip() == "0" else max(1, spans[1]), "natural": self._natural(cell, own)})
            found.append(line)
        cells, count = grid.place(found)
        if not count:
            return blocks
        gap = lambda name: twips(max(0.0, style.length(name, whole) or 0.0))
        caption = bool(blocks) and blocks[0]["kind"] == "paragraph"
        if caption and gap("margin-top"):
            blocks[0]["props"]["before"] = max(blocks[0]["props"].get("before") or 0, gap("margin-top"))
        wanted = grid.natural(cells, count)
        asked = style.length("width", whole)
        if asked and asked > 0:
            width = min(context.width, twips(asked))
        else:
            sized = bool(columns) or any((c["style"].length("width", 100) or 0) > 0 for c in cells)
            width = context.width if sized else min(context.width, sum(wanted))
        own_width = lambda s: twips(w) if (w := s.length("width", width / 20)) and w > 0 else None
        for c in cells:
            c["width"] = own_width(c["style"])
        widths = grid.column_widths(width, [own_width(s) for s in columns], cells, wanted)
        made = []
        for (_, row_style, group, head), placed in zip(rows, grid.rows_of(cells, len(rows), count)):
            line, at = [], 0
            ground = row_style.background() or group.background()
            for cell, span, begins in placed:
                size = sum(widths[at : at + span])
                at += span
                if cell is None:
                    line.append({"props": {"width": size, "span": 1}, "blocks": [paragraph({}, [])]})
                else:
                    line.append({"props": self._cell(cell, row_style, ground, size, span, begins), "blocks": self._content(cell, size) if begins else [paragraph({}, [])]})
            height = row_style.length("height")
            made.append({"header": head, "height": twips(height) if height and height > 0 else None, "cells": line})
        props = {
            "width": width, "align": self._auto_margins(style), "indent": context.left + twips(max(0.0, style.length("margin-left") or 0.0)),
            "borders": {s: edge_of(style.border(s)) for s in SIDES}, "shading": style.background(), "bidi": style.direction == "rtl",
        }
        blocks.append({"kind": "table", "props": props, "grid": widths, "rows": made, "top": 0 if caption else gap("margin-top"), "bottom": gap("margin-bottom")})
        return blocks

    @staticmethod
    def _natural(cell: Node, style: Style) -> int:
        """Twips of the longest line of a cell's text with its padding and borders."""
        parts: list[str] = []

        def read(node: Node) -> None:
            for c in node.children:
                if c.tag == "#text":
                    parts.append(c.text)
                elif c.tag == "br":
                    parts.append("\n")
                elif c.tag[0] != "#":
                    read(c)
                    if c.tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
                        parts.append("\n")

        read(cell)
        longest = max((grid.ems(x.strip()) for x in "".join(parts).splitlines()), default=0.0) * (1.05 if style.bold else 1.0)
        frame = sum(max(0.0, style.length(f"padding-{s}") or 0.0) + (b[1] if (b := style.border(s)) else 0) for s in ("left", "right"))
        return twips(longest * style.size + frame)

    @staticmethod
    def _cell(cell: dict, row: Style, ground: str | None, width: int, span: int, begins: bool) -> dict:
        style = cell["style"]
        named = [v for s in (style, row) if (v := s.value("vertical-align")) and v != "inherit"]
        return {
            "width": width, "span": span, "merge": ("restart" if cell["rowspan"] > 1 else None) if begins else "continue", "shading": style.background() or ground,
            "valign": {"top": "top", "middle": "center", "bottom": "bottom"}.get(named[0] if named else ""), "borders": {s: edge_of(style.border(s)) for s in SIDES},
            "margins": {s: twips(max(0.0, style.length(f"padding-{s}", width / 20) or 0.0)) for s in SIDES}, "no_wrap": style.space == "nowrap", "header": cell["node"].tag == "th",
        }

    def _content(self, cell: dict, width: int) -> list[dict]:
        style, out = cell["style"], []
        sides = sum(max(0.0, style.length(f"padding-{s}", width / 20) or 0.0) for s in ("left", "right"))
        self.children(cell["node"], style, Context(max(20, width - twips(sides))), out)
        return normalised(out, run_of(style))

    # The whole.

    def catalogue(self, root: Style) -> list[dict]:
        """Styles Normal, Heading1 to 6 and Caption, from the sheets without the author's."""
        sheets = self.sheets.without_author()
        page = Node("#document").add(Node("html")).add(Node("body"))
        base = computed(sheets.winners(page), root)
        out = [{"id": "Normal", "name": "Normal", "based_on": None, "default": True, "props": {}, "run": run_of(root)}]
        for tag, name in STYLE_IDS.items():
            s = computed(sheets.winners(page.add(Node(tag))), base)
            if tag == "figcaption":
                props, label = {"align": {"center": "center", "right": "right", "justify": "both", "left": "left"}.get(s.align)}, "caption"
            else:
                props = {"before": twips(max(0.0, s.length("margin-top") or 0)), "after": twips(max(0.0, s.length("margin-bottom") or 0)), "keep_next": True, "keep_lines": True, "outline": int(tag[1]) - 1}
                label = f"heading {tag[1]}"
            out.append({"id": name, "name": label, "based_on": "Normal", "default": False, "props": props, "run": run_of(s)})
        return out

    def styles(self, root: Style) -> list[dict]:
        """The catalogue, which all pages of the same options share."""
        if "catalogue" not in self.options:
            self.options["catalogue"] = self.catalogue(root)
        return [{**s, "props": dict(s["props"]), "run": dict(s["run"])} for s in self.options["catalogue"]]

    def build(self) -> dict:
        root: Style = self.options["base"]
        base = self.style(self.body, root)
        out: list[dict] = []
        self.children(self.body, base, Context(self.options["page_width"]), out)
        blocks = normalised(out)
        comments = balance([blocks, *(n["blocks"] for n in self.notes)], self.comments)
        media = {p["hash"]: p for p in self.pictures.values() if p}
        meta = {"title": self.options.get("title") or dom.title(self.root), "author": self.options.get("author"), "language": self.options.get("language"), "created": self.options.get("created")}
        return {"blocks": blocks, "default_run": run_of(base), "styles": self.styles(root), "lists": self.lists.made, "notes": self.notes, "comments": comments, "furniture": self.furniture, "media": list(media.values()), "meta": meta, "warnings": []}
