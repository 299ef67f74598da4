"""A model as HTML: only what differs from the look that the elements have anyway is written."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from vellumite.functions.formulas import mathml
from vellumite.kernels.build import safe_target
from vellumite.kernels.comments import paragraphs
from vellumite.kernels.dom import Node
from vellumite.kernels.metrics import line_multiple
from vellumite.kernels.styles import Sheets, Style, computed
from vellumite.kernels.units import EMU_PER_PIXEL, numbered
from vellumite.sources.html import VOID

SIDES = ("top", "right", "bottom", "left")
TAB = 720
# CSS names of the word processor's styles and formats.
EDGES = {"single": "solid", "double": "double", "dotted": "dotted", "dashed": "dashed", "dashSmallGap": "dashed", "threeDEngrave": "groove", "threeDEmboss": "ridge", "inset": "inset", "outset": "outset", "thick": "solid", "triple": "double"}
WAVES = {"double": "double", "dotted": "dotted", "dottedHeavy": "dotted", **dict.fromkeys(("dash", "dashLong", "dashedHeavy", "dashLongHeavy", "dotDash", "dotDotDash"), "dashed"), **dict.fromkeys(("wave", "wavyHeavy", "wavyDouble"), "wavy")}
BULLETS = {"": "none", "•": "disc", "◦": "circle", "o": "circle", "▪": "square", "■": "square"}
COUNTERS = {"decimal": "decimal", "decimalZero": "decimal-leading-zero", "lowerLetter": "lower-alpha", "upperLetter": "upper-alpha", "lowerRoman": "lower-roman", "upperRoman": "upper-roman"}
GENERIC = {"Courier New": "monospace", "Arial": "sans-serif", "Times New Roman": "serif"}


def number(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".") if round(x, 2) else "0"


def pt(twips: float) -> str:
    return "0" if not round(twips / 20, 2) else number(twips / 20) + "pt"


def css_string(text: str) -> str:
    return '"' + re.sub(r'[\\"]', lambda m: "\\" + m[0], text).replace("\n", "\\a ") + '"'


def font_stack(family: str) -> str:
    own = family if re.fullmatch(r"[A-Za-z][A-Za-z0-9 -]*", family) else css_string(family)
    return f"{own}, {GENERIC[family]}" if family in GENERIC else own


def declared(css: dict[str, str | None]) -> str:
    """`a: x; b: y;` of what is set; values that could end a declaration are left out."""
    return " ".join(f"{k}: {v};" for k, v in css.items() if v is not None and not re.search(r"[;{}<>]", v))


def border(edge: dict | None) -> str | None:
    return f"{number(edge['size'] / 8)}pt {EDGES.get(edge['style'], 'solid')} #{edge['color']}" if edge else None


def serialised(node: Node) -> str:
    out: list[str] = []

    def write(n: Node) -> None:
        if n.tag == "#text":
            out.append(n.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace(" ", "&nbsp;"))
        elif n.tag == "#raw":
            out.append(n.text)
        else:
            attributes = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;").replace(chr(0xA0), "&nbsp;")}"' for k, v in n.attrs.items())
            out.append(f"<{n.tag}{attributes}>")
            for c in n.children:
                write(c)
            if n.tag not in VOID:
                out.append(f"</{n.tag}>")

    write(node)
    return "".join(out)


class Frame:
    """An open list."""

    def __init__(self, level: int, num_id: int, marker: tuple[str, str | None], node: Node, style: Style, indent: int, next_: int):
        self.level, self.num_id, self.marker, self.node, self.style, self.indent, self.next = level, num_id, marker, node, style, indent, next_
        self.item: Node | None = None
        self.item_style: Style | None = None


def marker_of(level: dict | None) -> tuple[str, str | None]:
    """(element, list-style-type; None where the label must be spelled out)."""
    if level is None:
        return "ul", "disc"
    if level["text"] == "" or level["format"] == "bullet":
        return "ul", BULLETS.get(level["text"])
    return "ol", COUNTERS.get(level["format"]) if level["text"] == f"%{level['level'] + 1}." else None


def label_of(level: dict, ordinal: int) -> str:
    if level["format"] in ("bullet", "none"):
        return level["text"]
    return re.sub(r"%([1-9])", lambda m: numbered(ordinal, level["format"]) if int(m[1]) - 1 == level["level"] else "", level["text"])


class Writer:
    """options: base (Style), sheet (CSS), plain (no editor's markup), picture (callable on image and description, or None for data URIs), prefix (of ids)."""

    def __init__(self, model: dict, options: dict):
        self.model, self.options, self.plain = model, options, options["plain"]
        self.sheets = Sheets(options["sheet"])
        self.levels = {d["num_id"]: d["levels"] for d in model["lists"]}
        self.styles = {s["id"]: s for s in model["styles"]}
        self.media = {m["hash"]: m for m in model["media"]}
        self.prefix = options.get("prefix", "")
        self.warnings: list[str] = list(model["warnings"])
        self.lists: list[Frame] = []
        self.open: list[int] = []  # comments that are open here
        self.covered: set[int] = set()

    def warn(self, message: str) -> None:
        if message not in self.warnings:
            self.warnings.append(message)

    def name(self, bookmark: str) -> str:
        """The id of a bookmark: without the underscore that a word processor wants first."""
        return self.prefix + bookmark.removeprefix("_")

    def element(self, tag: str, parent: Node, style: Style, css: dict | None = None, **attributes: str | None) -> tuple[Node, Style]:
        node = parent.add(Node(tag, {k.replace("_", "-"): v for k, v in attributes.items() if v is not None}))
        if css and (text := declared(css)):
            node.attrs["style"] = text
        return node, computed(self.sheets.winners(node), style)

    # Blocks.

    def blocks(self, blocks: list[dict], parent: Node, style: Style, width: int, tag: str = "p") -> None:
        outer, self.lists = self.lists, []
        for block, then in zip(blocks, [*blocks[1:], None]):
            if block["kind"] == "table":
                self.lists = []
                self.table(block, parent, style, width)
                continue
            props = block["props"]
            if props.get("num_id"):
                frame = self._item(props, parent, style)
                self.paragraph(block, frame.node, frame.style, tag, frame.indent, frame, self._goes_on(props, then))
            elif self.lists and (props.get("left") or 0) >= self.lists[-1].indent and self.lists[-1].item is not None:
                top = self.lists[-1]  # goes on with the item whose text it is indented to
                self.paragraph(block, top.item, top.item_style, tag, top.indent)
            else:
                self.lists = []
                self.paragraph(block, parent, style, tag, 0)
        self.lists = outer

    @staticmethod
    def _goes_on(props: dict, then: dict | None) -> bool:
        """Whether the next block stands in the same list item."""
        if then is None or then["kind"] != "paragraph":
            return False
        p = then["props"]
        return (p.get("level") or 0) > (props.get("level") or 0) if p.get("num_id") else (p.get("left") or 0) >= (props.get("left") or 0)

    def _item(self, props: dict, parent: Node, style: Style) -> Frame:
        """The list that the paragraph is an item of: deeper ones are closed, another list of this level too."""
        num_id, at = props["num_id"], props.get("level") or 0
        levels = self.levels.get(num_id)
        level = levels[at] if levels and at < len(levels) else None
        ordinal = props["ordinal"] if props.get("ordinal") is not None else 1
        marker = marker_of(level)
        while self.lists and (self.lists[-1].level > at or (self.lists[-1].level == at and (self.lists[-1].num_id, self.lists[-1].marker) != (num_id, marker))):
            same = self.lists[-1].level == at and self.lists[-1].marker == marker and marker[1] and self.lists[-1].next == ordinal
            if same:
                break  # another definition that only goes on counting
            self.lists.pop()
        if not self.lists or self.lists[-1].level < at:
            top = self.lists[-1] if self.lists else None
            host, base = (top.item, top.item_style) if top and top.item else (parent, style)
            left = props.get("left") or 0
            css = {"margin": "0", "padding": f"0 0 0 {pt(max(0, left - (top.indent if top else 0)))}"}
            tag, kind = marker
            start = str(ordinal) if tag == "ol" and ordinal != 1 else None
            node, own = self.element(tag, host, base, css, start=start)
            if kind and kind != own.marker:
                node.attrs["style"] = declared({"list-style-type": kind, **css})
                own = computed(self.sheets.winners(node), base)
            self.lists.append(Frame(at, num_id, marker, node, own, left, ordinal))
        frame = self.lists[-1]
        frame.num_id = num_id
        frame.item, frame.item_style = self.element("li", frame.node, frame.style)
        if frame.marker[1] is None and level is not None:
            frame.item.attrs["style"] = declared({"list-style-type": css_string(label_of(level, ordinal) + " ")})
            frame.item_style = computed(self.sheets.winners(frame.item), frame.style)
        elif frame.marker[0] == "ol" and ordinal != frame.next:
            frame.item.attrs["value"] = str(ordinal)
        frame.next = ordinal + 1
        return frame

    def heading(self, props: dict) -> str | None:
        level = props.get("outline")
        if level is None and props.get("style") in self.styles:
            level = self.styles[props["style"]]["props"].get("outline")
        return f"h{level + 1}" if level is not None and 0 <= level <= 5 else None

    def paragraph(self, block: dict, parent: Node, style: Style, tag: str, base: int, frame: Frame | None = None, goes_on: bool = False) -> None:
        props, heading = block["props"], self.heading(block["props"])
        parts: list[list[dict]] = [[]]
        for x in block["inlines"]:
            if x["kind"] == "break" and x["text"] == "page":
                parts.append([])
            else:
                parts[-1].append(x)
        for k, inlines in enumerate(parts):
            # An item holds its first paragraph's text itself, but where that has space below and more follows.
            if frame is not None and k == 0 and heading is None and not (goes_on and props.get("after")):
                node, around = frame.item, frame.style
                own = frame.item_style
            else:
                host, around = (frame.item, frame.item_style) if frame is not None else (parent, style)
                node, own = self.element(heading or tag, host, around)
            css = self._css(props, own, around, base, frame is not None, k == 0, k == len(parts) - 1, inlines)
            if css:
                node.attrs["style"] = " ".join(x for x in (node.attrs.get("style", ""), declared(css)) if x)
            own = computed(self.sheets.winners(node), around)
            if self.plain and inlines and inlines[0]["kind"] == "bookmark" and "id" not in node.attrs:
                node.attrs["id"] = self.name(inlines[0]["text"])
                inlines = inlines[1:]
            self.inlines(inlines, node, own)
            shown = [x for x in inlines if x["kind"] not in ("bookmark", "comment_start", "comment_end")]
            if not shown or shown[-1]["kind"] == "break":
                self.element("br", node, own)

    def _css(self, props: dict, own: Style, around: Style, base: int, item: bool, first: bool, last: bool, inlines: list[dict]) -> dict[str, str | None]:
        css: dict[str, str | None] = {}
        align = {"both": "justify"}.get(props.get("align") or "", props.get("align"))
        if align != own.align and (align or own.align not in (None, "left")):
            css["text-align"] = align or ("right" if props.get("bidi") else "left")
        frame = props.get("borders") or {}
        inset = {s: (e["space"] * 20 + (e["size"] / 8 * 20 if s in ("left", "right") else 0)) if (e := frame.get(s)) else 0 for s in SIDES}
        wanted = {"top": (props.get("before") or 0) if first else 0, "right": (props.get("right") or 0) - inset["right"], "bottom": (props.get("after") or 0) if last else 0, "left": (props.get("left") or 0) - base - inset["left"]}
        if item:
            wanted["left"] = 0
        has = {s: (own.length(f"margin-{s}", 0) or 0) * 20 for s in SIDES}
        if any(abs(wanted[s] - has[s]) > 1 for s in SIDES):
            css["margin"] = " ".join(pt(wanted[s]) for s in SIDES)
        if not item and abs((props.get("first") or 0) - (own.indent or 0) * 20) > 1:
            css["text-indent"] = pt(props.get("first") or 0)
        if props.get("line") is not None:
            family = (props.get("mark") or {}).get("family") or own.family
            css["line-height"] = number(line_multiple(props["line"], family)) if props.get("rule") == "auto" else pt(props["line"])
        if props.get("shading") and props["shading"] != own.background():
            css["background-color"] = "#" + props["shading"]
        for s in SIDES:
            if frame.get(s):
                css[f"border-{s}"] = border(frame[s])
                if frame[s]["space"]:
                    css[f"padding-{s}"] = pt(frame[s]["space"] * 20)
        if bool(props.get("bidi")) != (own.direction == "rtl"):
            css["direction"] = "rtl" if props.get("bidi") else "ltr"
        if props.get("page_break") if first else True:
            css["page-break-before"] = "always"
        if props.get("keep_next") and own.breaks("after") != "avoid":
            css["break-after"] = "avoid"
        if props.get("keep_lines") and own.breaks("inside") != "avoid":
            css["break-inside"] = "avoid"
        text = plain_text(inlines)
        if not own.keeps_space and re.search(r"\t|  |\A | \Z| \n|\n ", text):
            css["white-space"], css["tab-size"] = "pre-wrap", pt(TAB)
        size = (props.get("mark") or {}).get("size")
        if not text and size and abs(size / 2 - own.size) > 0.01:
            css["font-size"] = pt(size * 10)
        return css

    # Inlines.

    def inlines(self, inlines: list[dict], parent: Node, style: Style, inside_link: bool = False) -> None:
        """Neighbours that look alike share their wrappers, neighbours with one link share it."""
        k = 0
        shared: tuple | None = None
        while k < len(inlines):
            x = inlines[k]
            if x["kind"] in ("comment_start", "comment_end"):
                shared = None
                self._comment_mark(x, parent)
                k += 1
                continue
            link = x.get("link")
            if link and not inside_link:
                end = k
                while end < len(inlines) and (inlines[end].get("link") == link or inlines[end]["kind"].startswith("comment")):
                    end += 1
                while inlines[end - 1]["kind"].startswith("comment"):
                    end -= 1
                anchor = "#" + self.name(link[1]) if link[1] else safe_target(link[0] or "")
                host, own = self.element("a", self._commented(parent), style, href=anchor) if anchor else (parent, style)
                self.inlines(inlines[k:end], host, own, True)
                k, shared = end, None
                continue
            host = parent if inside_link else self._commented(parent, shared[0] if shared else None)
            if self.open:
                self.covered |= set(self.open)
            if x["kind"] in ("text", "tab", "break", "field"):
                css, tags = self._look(x.get("run") or {}, style)
                key = (host, str(css), tuple(tags))
                if shared is None or shared[0] is not host or shared[1:3] != key[1:]:
                    shared = (host, str(css), tuple(tags), self._wrapped(host, style, css, tags))
                at = shared[3]
                if x["kind"] == "break":
                    at.add(Node("br"))
                elif x["kind"] == "field" and not self.plain:
                    self.element("span", at, style, **{"class": "se-field", "data_field": x["field"]})[0].add(Node("#text", text=x["text"]))
                else:
                    if x["kind"] == "field":
                        self.warn(f"the {x['field']} field became the text \"{x['text']}\": plain HTML has no pages")
                    at.add(Node("#text", text="\t" if x["kind"] == "tab" else x["text"]))
            else:
                shared = None
                getattr(self, f"_{x['kind']}")(x, host, style)
            k += 1

    def _comment_mark(self, x: dict, parent: Node) -> None:
        if self.plain:
            return
        if x["kind"] == "comment_start":
            self.open.append(x["ref"])
            self.covered.discard(x["ref"])
        elif x["ref"] in self.open:
            if x["ref"] not in self.covered:  # a point: an empty mark
                parent.add(Node("span", {"class": "se-comment", "data-comment": str(x["ref"])}))
            self.open.remove(x["ref"])

    def _commented(self, parent: Node, before: Node | None = None) -> Node:
        if not self.open:
            return parent
        key = " ".join(map(str, self.open))
        last = parent.children[-1] if parent.children else None
        if last is not None and last.tag == "span" and last.get("data-comment") == key and last.get("class") == "se-comment" and last.children:
            return last
        return parent.add(Node("span", {"class": "se-comment", "data-comment": key}))

    def _look(self, run: dict, s: Style) -> tuple[dict[str, str], list[str]]:
        """(declarations, elements) by which a run differs from the text around it."""
        css: dict[str, str] = {}
        tags: list[str] = []
        if run.get("family") and run["family"].lower() != s.family.lower():
            css["font-family"] = font_stack(run["family"])
        position = {"superscript": "super", "subscript": "sub"}.get(run.get("vertical") or "", "baseline")
        if run.get("size") and abs(run["size"] / 2 - s.size) > 0.01:
            css["font-size"] = pt(run["size"] * 10)
        if run.get("color") and run["color"] != s.color:
            css["color"] = "#" + run["color"]
        if run.get("shading") and run["shading"] != s.ground:
            css["background-color"] = "#" + run["shading"]
        if abs((run.get("spacing") or 0) / 20 - s.spacing) > 0.01:
            css["letter-spacing"] = pt(run.get("spacing") or 0)
        for name, now, prop, on_, off in (("caps", s.transform == "uppercase", "text-transform", "uppercase", "none"), ("small_caps", s.small_caps, "font-variant", "small-caps", "normal"), ("shadow", s.shadow, "text-shadow", "1px 1px #C0C0C0", "none")):
            if bool(run.get(name)) != now:
                css[prop] = on_ if run.get(name) else off
        for name, now, tag, prop in (("bold", s.bold, "strong", "font-weight"), ("italic", s.italic, "em", "font-style")):
            if bool(run.get(name)) != now:
                if run.get(name):
                    tags.append(tag)
                else:
                    css[prop] = "normal"
        if (run.get("underline") or "none") != "none" and s.underline is None:
            tags.append("u")
            if run["underline"] in WAVES:
                css["text-decoration-style"] = WAVES[run["underline"]]
        if run.get("strike") and not s.strike:
            tags.append("s")
        if position != s.vertical:
            if position == "baseline":
                css["vertical-align"] = "baseline"
            else:
                tags.append("sup" if position == "super" else "sub")
        return css, tags

    def _wrapped(self, parent: Node, style: Style, css: dict[str, str], tags: list[str]) -> Node:
        own = {k: v for k, v in css.items() if k != "text-decoration-style"}
        node = self.element("span", parent, style, own)[0] if own else parent
        for tag in tags:
            wave = {"text-decoration-style": css["text-decoration-style"]} if tag == "u" and "text-decoration-style" in css else None
            node = self.element(tag, node, style, wave)[0]
        return node

    def _bookmark(self, x: dict, parent: Node, style: Style) -> None:
        parent.add(Node("a", {"id": self.name(x["text"])}))

    def _image(self, x: dict, parent: Node, style: Style) -> None:
        image = self.media.get(x["media"])
        handler: Callable | None = self.options.get("picture")
        source = None if image is None else handler(image, x["text"]) if handler else f"data:{image['type']};base64,{base64.b64encode(image['bytes']).decode()}"
        if source is None:
            return
        size = [x[k] / EMU_PER_PIXEL for k in ("width", "height")]
        css = {"width": number(size[0]) + "px", "height": number(size[1]) + "px", "float": x.get("side")}
        self.element("img", parent, style, css, src=source, alt=x["text"])

    def _note(self, x: dict, parent: Node, style: Style) -> None:
        sup, own = self.element("sup", parent, style)
        role = "doc-noteref" if self.plain else None
        link, _ = self.element("a", sup, own, href=f"#{self.prefix}{x['text']}-{x['ref']}", id=f"{self.prefix}{x['text']}-ref-{x['ref']}", role=role)
        link.add(Node("#text", text=numbered(x["ref"], "lowerRoman") if x["text"] == "endnote" else str(x["ref"])))

    def _formula(self, x: dict, parent: Node, style: Style) -> None:
        editor = self.options["editor"]
        if editor == "plain":
            parent.add(Node("#raw", text=mathml(x["text"], x.get("display") or False)))
        elif editor == "suneditor":
            parent.add(Node("span", {"class": "se-math katex", "contenteditable": "false", "data-se-value": x["text"]})).add(Node("#text", text=x["text"]))
        else:
            span = parent.add(Node("span", {"data-type": "block-math" if x.get("display") else "inline-math", "data-latex": x["text"]} if editor == "tiptap" else {"class": "math-tex"}))
            span.add(Node("#text", text=f"\\[{x['text']}\\]" if x.get("display") else f"\\({x['text']}\\)"))

    # Tables.

    def table(self, block: dict, parent: Node, style: Style, width: int) -> None:
        props, grid = block["props"], block["grid"]
        total = sum(grid) or 1
        css: dict[str, str | None] = {"border-collapse": "collapse", "width": pt(total) if not width or total < width - 20 else "100%"}
        align, indent = props.get("align"), props.get("indent") or 0
        css["margin"] = f"{pt(block['top'])} {'auto' if align == 'center' else 0} {pt(block['bottom'])} {'auto' if align in ('center', 'right') else pt(indent)}"
        css["background-color"] = "#" + props["shading"] if props.get("shading") else None
        css |= {f"border-{s}": border((props.get("borders") or {}).get(s)) for s in SIDES}
        css["direction"] = "rtl" if props.get("bidi") else None
        host = self.element("figure", parent, style, **{"class": "table"})[0] if self.options["editor"] == "ckeditor" else parent
        node, own = self.element("table", host, style, css)
        columns, _ = self.element("colgroup", node, own)
        for w in grid:
            columns.add(Node("col", {"style": f"width: {number(100 * w / total)}%;"}))
        spans = row_spans(block["rows"])
        group: Node | None = None
        for r, row in enumerate(block["rows"]):
            tag = "thead" if row["header"] else "tbody"
            if group is None or group.tag != tag:
                group, group_style = self.element(tag, node, own)
            line, line_style = self.element("tr", group, group_style, {"height": pt(row["height"])} if row.get("height") else None)
            at = 0
            for cell in row["cells"]:
                p = cell["props"]
                span = p.get("span") or 1
                if p.get("merge") != "continue":
                    self._cell(cell, "th" if row["header"] or p.get("header") else "td", line, line_style, sum(grid[at : at + span]), spans.get((r, at), 1))
                at += span

    def _cell(self, cell: dict, tag: str, line: Node, style: Style, width: int, rows: int) -> None:
        p = cell["props"]
        margins, borders = p.get("margins") or {}, p.get("borders") or {}
        css: dict[str, str | None] = {f"border-{s}": border(borders.get(s)) for s in SIDES}
        css["padding"] = " ".join(pt(margins.get(s, 0)) for s in SIDES) if margins else None
        css["background-color"] = "#" + p["shading"] if p.get("shading") else None
        css["vertical-align"] = {"top": "top", "center": "middle", "bottom": "bottom"}.get(p.get("valign") or "", "top")
        css["white-space"] = "nowrap" if p.get("no_wrap") else None
        span = p.get("span") or 1
        node, own = self.element(tag, line, style, css, colspan=str(span) if span > 1 else None, rowspan=str(rows) if rows > 1 else None)
        blocks = cell["blocks"]
        if len(blocks) == 1 and blocks[0]["kind"] == "paragraph" and not blocks[0]["props"].get("num_id") and not self._css(blocks[0]["props"], own, own, 0, False, True, True, blocks[0]["inlines"]) and not self.heading(blocks[0]["props"]):
            self.inlines(blocks[0]["inlines"], node, own)
        else:
            self.blocks(blocks, node, own, width)

    # The parts around.

    def notes(self, parent: Node, style: Style, width: int) -> None:
        for kind, marker in (("footnote", "decimal"), ("endnote", "lower-roman")):
            own_notes = [n for n in self.model["notes"] if n["type"] == kind]
            if not own_notes:
                continue
            host, own = self.element("section", parent, style, **{"class": f"{kind}s", "role": "doc-endnotes"}) if self.plain else (parent, style)
            self.element("hr", host, own, {"width": "30%", "margin-left": "0"})
            list_, list_style = self.element("ol", host, own, {"list-style-type": marker}, **{"class": None if self.plain else f"se-{kind}s"})
            expected = 1
            for note in own_notes:
                item, item_style = self.element("li", list_, list_style, id=f"{self.prefix}{kind}-{note['number']}", value=str(note["number"]) if note["number"] != expected else None, role="doc-endnote" if self.plain else None)
                expected = note["number"] + 1
                self.blocks(note["blocks"], item, item_style, width)
                last = item.elements[-1] if item.elements else item
                back, _ = self.element("a", last, item_style, href=f"#{self.prefix}{kind}-ref-{note['number']}", role="doc-backlink" if self.plain else None)
                back.add(Node("#text", text=" ↩"))

    def furniture(self, kind: str, parent: Node, style: Style, width: int) -> None:
        for f in self.model["furniture"]:
            if f["kind"] == kind:
                node, own = self.element("div", parent, style, **{"class": f"se-{kind}", "data_type": f["type"] if f["type"] != "default" else None})
                self.blocks(f["blocks"], node, own, width, "div")

    def comments(self, parent: Node, style: Style, width: int) -> None:
        if not self.model["comments"]:
            return
        list_, own = self.element("ol", parent, style, **{"class": "se-comments"})
        for c in self.model["comments"]:
            item, item_style = self.element(
                "li", list_, own, id=f"{self.prefix}comment-{c['id']}", data_comment=str(c["id"]), data_author=c["author"], data_initials=c["initials"], data_date=c["date"],
                data_parent=str(c["parent"]) if c["parent"] else None, data_resolved="true" if c["resolved"] else None,
            )
            self.blocks(c["blocks"], item, item_style, width)

    def write(self) -> tuple[str, list[str]]:
        """(the body's markup, warnings)."""
        body, style = Node("body"), self.options["base"]
        page = Node("#document").add(Node("html"))
        page.add(body)
        style = computed(self.sheets.winners(body), style)
        width = self.options["page_width"]
        if not self.plain:
            self.furniture("header", body, style, width)
        self.blocks(self.model["blocks"], body, style, width)
        self.notes(body, style, width)
        if self.plain:
            for n, what in ((len(self.model["furniture"]), "page headers and footers were left out: plain HTML has no pages"), (len(self.model["comments"]), "comments were left out: plain HTML has no place for them")):
                if n:
                    self.warn(f"{n} {what}")
        else:
            self.comments(body, style, width)
            self.furniture("footer", body, style, width)
        return "\n".join(serialised(c) for c in body.children), self.warnings


def plain_text(inlines: list[dict]) -> str:
    signs = {"tab": "\t", "break": "\n", "bookmark": "", "comment_start": "", "comment_end": ""}
    return "".join(x["text"] if x["kind"] == "text" else signs.get(x["kind"], "￼") for x in inlines)


def document_text(blocks: list[dict]) -> list[str]:
    return [plain_text(p["inlines"]) for p in paragraphs(blocks)]


def row_spans(rows: list[dict]) -> dict[tuple[int, int], int]:
    """(row, grid column) of each cell that begins a vertical merge -> rows that it takes."""
    at: dict[tuple[int, int], str | None] = {}
    for r, row in enumerate(rows):
        column = 0
        for cell in row["cells"]:
            at[r, column] = cell["props"].get("merge")
            column += cell["props"].get("span") or 1
    out = {}
    for (r, c), merge in at.items():
        if merge == "restart":
            n = 1
            while at.get((r + n, c)) == "continue":
                n += 1
            out[r, c] = n
    return out


def full_page(body: str, meta: dict, sheet: str = "") -> str:
    """A whole document around the markup: title, author, language, style sheet."""
    escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    head = ['<meta charset="utf-8">', '<meta name="viewport" content="width=device-width, initial-scale=1">']
    head += [f"<title>{escape(meta['title'])}</title>"] if meta.get("title") else []
    head += [f'<meta name="author" content="{escape(meta["author"])}">'] if meta.get("author") else []
    head += [f"<style>\n{sheet.replace('</style', '<' + chr(92) + '/style')}\n</style>"] if sheet.strip() else []
    lang = f' lang="{escape(meta["language"])}"' if meta.get("language") else ""
    joined = "\n".join(head)
    return f"<!DOCTYPE html>\n<html{lang}>\n<head>\n{joined}\n</head>\n<body>\n{body}\n</body>\n</html>\n"
