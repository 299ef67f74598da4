"""The cascade and computed styles of one document's elements.

Layers, weakest first: default sheet, presentational attributes, base sheet, author sheets, the style attribute;
then the important declarations of the sheets in the same order, then those of the style attribute. Inside a
layer the more specific rule wins, then the later.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field, replace

from vellumite.kernels.dom import Node
from vellumite.kernels.selectors import Test, matcher, specificity
from vellumite.kernels.units import colour, points, rounded, twips
from vellumite.operators.css import declarations, split_top_level, style_rules, unquoted

DEFAULT, BASE, AUTHOR = 0, 1, 2
# Display types that make blocks.
BLOCKS = {"block", "list-item", "table", "flex", "grid", "flow-root", "table-caption", "table-row-group", "table-header-group", "table-footer-group", "table-row", "table-cell"}
# Points of the font size keywords; fonts that generic names stand for; names that only a system knows.
SIZES = {"xx-small": 6.75, "x-small": 7.5, "small": 9.75, "medium": 12.0, "large": 13.5, "x-large": 18.0, "xx-large": 24.0, "xxx-large": 36.0}
GENERIC = {"serif": "Times New Roman", "sans-serif": "Arial", "monospace": "Courier New", "cursive": "Comic Sans MS", "fantasy": "Impact", "system-ui": "Segoe UI", "ui-monospace": "Courier New", "ui-sans-serif": "Arial", "ui-serif": "Times New Roman"}
SYSTEM = {"-apple-system", "blinkmacsystemfont", "-webkit-system-font", "ui-rounded"}
# Keywords of inherited properties, as they are computed.
KEYWORDS = {
    "font-style": {"italic": True, "oblique": True, "normal": False},
    "text-align": {"left": "left", "start": "left", "-webkit-left": "left", "right": "right", "end": "right", "-webkit-right": "right", "center": "center", "-webkit-center": "center", "justify": "justify"},
    "text-transform": {k: k for k in ("none", "uppercase", "lowercase", "capitalize")},
    "white-space": {k: k for k in ("normal", "nowrap", "pre", "pre-wrap", "pre-line", "break-spaces")},
    "direction": {"ltr": "ltr", "rtl": "rtl"},
    "font-variant": {"small-caps": True, "all-small-caps": True, "normal": False},
    "font-kerning": {"none": False, "normal": True, "auto": True},
    "font-weight": {"bold": True, "bolder": True, "normal": False, "lighter": False},
}
# Attributes that once styled elements.
FONT_SIZES = {"1": "x-small", "2": "small", "3": "medium", "4": "large", "5": "x-large", "6": "xx-large", "7": "xxx-large"}
LIST_TYPES = {"ol": {"1": "decimal", "a": "lower-alpha", "A": "upper-alpha", "i": "lower-roman", "I": "upper-roman"}, "ul": {"disc": "disc", "circle": "circle", "square": "square"}}
SIZED = {"table", "td", "th", "tr", "col", "colgroup", "img", "hr"}


def _keyword(value: str | None) -> str:
    return (value or "").strip().lower()


def hints(node: Node) -> dict[str, str]:
    """Declarations that attributes such as align, bgcolor, width and type stand for."""
    out: dict[str, str] = {}
    tag, align, valign, direction = node.tag, _keyword(node.get("align")), _keyword(node.get("valign")), _keyword(node.get("dir"))
    if tag == "table" and align == "center":
        out |= {"margin-left": "auto", "margin-right": "auto"}
    elif tag not in ("table", "img") and align in ("left", "right", "center", "justify"):
        out["text-align"] = align
    if valign in ("top", "middle", "bottom"):
        out["vertical-align"] = valign
    if "bgcolor" in node.attrs:
        out["background-color"] = node.get("bgcolor")
    for side in ("width", "height"):
        if tag in SIZED and (value := node.get(side).strip()):
            out[side] = value + "px" if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", value) else value
    if tag == "font":
        out |= {p: node.get(a) for a, p in (("color", "color"), ("face", "font-family")) if a in node.attrs}
        if node.get("size").strip() in FONT_SIZES:
            out["font-size"] = FONT_SIZES[node.get("size").strip()]
    if tag in ("ol", "ul", "li") and "type" in node.attrs:
        kind = tag if tag != "li" else "ol" if node.parent is not None and node.parent.tag == "ol" else "ul"
        named = node.get("type").strip()
        found = LIST_TYPES[kind].get(named if kind == "ol" else named.lower())
        if found:
            out["list-style-type"] = found
    if direction in ("ltr", "rtl"):
        out["direction"] = direction
    return out


@dataclass(frozen=True)
class Rule:
    test: Test
    declared: dict[str, tuple[str, bool]]
    origin: int
    spec: tuple[int, int, int]
    order: int
    tag: str | None  # the only tag that it can match, where that is plain to see


_LAST_TAG = re.compile(r"(?:[\w\s>+~.#-]+[\s>+~])?([A-Za-z][\w-]*)(?:[.#][\w-]+)*")


@functools.lru_cache(64)
def _parsed(css: str, origin: int) -> tuple[Rule, ...]:
    found = ((matcher(s), s, d) for s, d in style_rules(css))
    return tuple(Rule(t, d, origin, specificity(s), i, m[1].lower() if (m := _LAST_TAG.fullmatch(s.strip())) else None) for i, (t, s, d) in enumerate(found) if t)


class Sheets:
    """All rules of a document in the order of the cascade."""

    def __init__(self, default: str, base: str = "", author: list[str] | tuple[str, ...] = ()):
        layers = [_parsed(default, DEFAULT), _parsed(base, BASE), *(_parsed(css, AUTHOR) for css in author)]
        numbered = [(r.origin, r.spec, k, r.order, r) for k, rules in enumerate(layers) for r in rules]
        self._use([x[-1] for x in sorted(numbered, key=lambda x: x[:4])])

    def _use(self, rules: list[Rule]) -> None:
        self.rules, self._by_tag = rules, {}

    def _of(self, tag: str) -> list[Rule]:
        if tag not in self._by_tag:
            self._by_tag[tag] = [r for r in self.rules if r.tag in (None, tag)]
        return self._by_tag[tag]

    def without_author(self) -> Sheets:
        out = Sheets("")
        out._use([r for r in self.rules if r.origin != AUTHOR])
        return out

    def winners(self, node: Node) -> dict[str, str]:
        """Property -> value of the declarations that win on an element."""
        layers: list[dict[str, str]] = [{}, hints(node), {}, {}]  # default, attributes, base and author, inline
        important: list[dict[str, str]] = [{}, {}]  # sheets, inline
        for rule in self._of(node.tag):
            if rule.test(node):
                for name, (value, strong) in rule.declared.items():
                    (important[0] if strong else layers[0 if rule.origin == DEFAULT else 2])[name] = value
        if node.get("style").strip():
            for name, (value, strong) in declarations(node.get("style")).items():
                (important[1] if strong else layers[3])[name] = value
        return {k: v for layer in (*layers, *important) for k, v in layer.items()}


@dataclass(frozen=True)
class Style:
    """Computed values: text properties that children take over, and the element's own declarations."""

    display: str = "block"
    family: str = "Times New Roman"
    size: float = 12.0
    root_size: float = 12.0
    bold: bool = False
    italic: bool = False
    underline: str | None = None
    strike: bool = False
    color: str = "000000"
    ground: str | None = None
    vertical: str = "baseline"
    align: str | None = None
    line: tuple[str, float] | None = None
    indent: float | None = None
    transform: str = "none"
    small_caps: bool = False
    spacing: float = 0.0
    shadow: bool = False
    space: str = "normal"
    direction: str = "ltr"
    marker: str = "disc"
    kerning: bool = True
    own: dict[str, str] = field(default_factory=dict)

    @property
    def block(self) -> bool:
        return self.display in BLOCKS

    @property
    def keeps_space(self) -> bool:
        return self.space in ("pre", "pre-wrap", "break-spaces")

    def value(self, name: str) -> str | None:
        return _keyword(self.own[name]) if name in self.own else None

    def length(self, name: str, whole: float | None = None) -> float | None:
        return points(self.own.get(name), self.size, self.root_size, whole)

    def auto(self, name: str) -> bool:
        return self.value(name) == "auto"

    def background(self) -> str | None:
        return colour(self.own.get("background-color"))

    def border(self, side: str) -> tuple[str, float, str] | None:
        """(style, points, colour) of a border that is drawn."""
        kind = self.value(f"border-{side}-style") or "none"
        width = self.value(f"border-{side}-width") or "medium"
        pt = {"thin": 0.75, "medium": 2.25, "thick": 3.75}.get(width)
        pt = points(width, self.size, self.root_size) if pt is None else pt
        named = self.own.get(f"border-{side}-color", "currentcolor")
        tint = self.color if _keyword(named) == "currentcolor" else colour(named)
        return (kind, pt, tint) if kind not in ("none", "hidden") and pt and pt > 0 and tint else None

    def breaks(self, where: str) -> str | None:
        return self.value(f"page-break-{where}") or self.value(f"break-{where}")


def _size(value: str | None, parent: Style) -> float:
    low = _keyword(value)
    if low in SIZES:
        found = SIZES[low]
    elif low in ("smaller", "larger"):
        found = parent.size / 1.2 if low == "smaller" else parent.size * 1.2
    else:
        found = points(low, parent.size, parent.root_size, parent.size) or 0
    return found if found > 0 else parent.size


def _family(value: str | None) -> str | None:
    for name in split_top_level(value or "", ","):
        name = unquoted(name)
        if name.lower() in ("inherit", "initial", "unset"):
            return None
        if name and name.lower() not in SYSTEM:
            return GENERIC.get(name.lower(), name)
    return None


def _line(value: str | None, size: float, parent: Style) -> tuple[str, float] | None:
    low = _keyword(value)
    if low == "normal":
        return None
    if re.fullmatch(r"\+?(\d+\.?\d*|\.\d+)%?", low):
        n = float(low.rstrip("%")) / (100 if low.endswith("%") else 1)
        return ("multiple", n) if n > 0 else parent.line
    pt = points(low, size, parent.root_size)
    return ("points", pt) if pt and pt > 0 else parent.line


def _marker(value: str | None) -> str | None:
    text = (value or "").strip()
    if text[:1] in ("'", '"'):
        return text
    return None if text.lower() in ("", "inherit", "initial", "unset") else text.lower()


def computed(own: dict[str, str], parent: Style) -> Style:
    """An element's style from its winning declarations and its parent's style."""
    kept = lambda name, old, source=None: old if (v := KEYWORDS[name].get(_keyword(own.get(source or name)))) is None else v
    display = _keyword(own.get("display")) or "inline"
    inline = display not in BLOCKS
    vertical, lines = _keyword(own.get("vertical-align")), _keyword(own.get("text-decoration-line"))
    # Raised and lowered text is made small by its position already.
    shrunk = vertical in ("sub", "super") and re.fullmatch(r"smaller|[\d.]+\s*(%|em)", _keyword(own.get("font-size")))
    size = parent.size if shrunk else _size(own.get("font-size"), parent)
    weight = _keyword(own.get("font-weight"))
    bold = float(weight) >= 600 if re.fullmatch(r"\d+(\.\d+)?", weight) else kept("font-weight", parent.bold)
    wave = _keyword(own.get("text-decoration-style"))
    spacing = _keyword(own.get("letter-spacing"))
    shadow = _keyword(own.get("text-shadow"))
    indent = points(own["text-indent"], size, parent.root_size) if "text-indent" in own else None
    gap = 0.0 if spacing == "normal" else points(spacing, size, parent.root_size)
    return replace(
        parent,
        display=display,
        family=_family(own.get("font-family")) or parent.family,
        size=size,
        bold=bold,
        italic=kept("font-style", parent.italic),
        underline=(wave if wave in ("double", "dotted", "dashed", "wavy") else "solid") if "underline" in lines else parent.underline,
        strike=parent.strike or "line-through" in lines,
        color=colour(own.get("color")) or parent.color,
        ground=(colour(own.get("background-color")) or parent.ground) if inline else None,
        vertical=vertical if vertical in ("sub", "super") else parent.vertical if inline and vertical != "baseline" else "baseline",
        align=kept("text-align", parent.align),
        line=parent.line if _keyword(own.get("line-height")) in ("", "inherit") else _line(own.get("line-height"), size, parent),
        indent=parent.indent if indent is None else indent,
        transform=kept("text-transform", parent.transform),
        small_caps=kept("font-variant", parent.small_caps, "font-variant-caps" if "font-variant-caps" in own else None),
        spacing=parent.spacing if gap is None else gap,
        shadow=parent.shadow if shadow in ("", "inherit") else shadow != "none",
        space=kept("white-space", parent.space),
        direction=kept("direction", parent.direction),
        marker=_marker(own.get("list-style-type")) or parent.marker,
        kerning=kept("font-kerning", parent.kerning),
        own=own,
    )


# Names of the word processor for CSS line styles.
UNDERLINES = {None: "none", "double": "double", "dotted": "dotted", "dashed": "dash", "wavy": "wave"}
EDGES = {"dotted": "dotted", "dashed": "dashed", "double": "double", "groove": "threeDEngrave", "ridge": "threeDEmboss", "inset": "inset", "outset": "outset"}
RUN_FIELDS = ("family", "size", "bold", "italic", "underline", "strike", "color", "shading", "vertical", "caps", "small_caps", "spacing", "shadow", "rtl", "kerning")


def run_of(s: Style) -> dict:
    """Run properties (sizes in half-points, spacing in twips)."""
    vertical = {"super": "superscript", "sub": "subscript"}.get(s.vertical, "baseline")
    values = (s.family, max(2, rounded(s.size * 2)), s.bold, s.italic, UNDERLINES.get(s.underline, "single"), s.strike, s.color, s.ground, vertical, s.transform == "uppercase", s.small_caps, twips(s.spacing), s.shadow, s.direction == "rtl", s.kerning)
    return dict(zip(RUN_FIELDS, values))


def edge_of(border: tuple[str, float, str] | None, padding: float = 0.0) -> dict | None:
    """A border in eighths of a point, its distance in points."""
    if border is None:
        return None
    kind, pt, tint = border
    return {"style": EDGES.get(kind, "single"), "size": max(2, min(96, rounded(pt * 8))), "color": tint, "space": max(0, min(31, rounded(padding)))}
