"""Numbering of one HTML document's lists, as a word processor wants it: definitions with nine levels."""

from __future__ import annotations

import re

from vellumite.functions.numbers import GREEK
from vellumite.kernels.dom import Node
from vellumite.kernels.metrics import marker_distance
from vellumite.kernels.styles import Style
from vellumite.kernels.units import alphabetic, twips
from vellumite.operators.css import unquoted

# Fixed values: (format, text) of list-style-type; {} is the place of the number.
FORMATS = {
    "disc": ("bullet", "•"), "circle": ("bullet", "◦"), "square": ("bullet", "▪"), "none": ("none", ""),
    "decimal-leading-zero": ("decimalZero", "{}."), "lower-alpha": ("lowerLetter", "{}."), "lower-latin": ("lowerLetter", "{}."),
    "upper-alpha": ("upperLetter", "{}."), "upper-latin": ("upperLetter", "{}."), "lower-roman": ("lowerRoman", "{}."), "upper-roman": ("upperRoman", "{}."),
}


def literal(kind: str) -> str | None:
    """The marker that a quoted list-style-type spells out."""
    return unquoted(kind).rstrip(" ") if kind[:1] in ("'", '"') else None


def level_format(kind: str, level: int, value: int) -> tuple[str, str]:
    """(number format, level text). Greek letters and quoted markers are spelled out, as no format has them."""
    spelled = literal(kind)
    if spelled is not None:
        return "none", spelled
    if kind == "lower-greek" and value >= 1:
        return "none", alphabetic(value, GREEK) + "."
    form, text = FORMATS.get(kind, ("decimal", "{}."))
    return form, text.replace("{}", f"%{level + 1}")


def spelled_out(kind: str) -> bool:
    return kind == "lower-greek" or literal(kind) is not None


def _integer(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"\s*[+-]?\d+\s*", value) else None


class Definitions:
    """Numbered from 1; each with nine levels of which one is used."""

    def __init__(self) -> None:
        self.made: list[dict] = []

    def add(self, kind: str, level: int, start: int, indent: int, hanging: int, suffix: str, align: str) -> int:
        levels = []
        for k in range(9):
            form, text = level_format(kind, k, start) if k == level else ("decimal", f"%{k + 1}.")
            own = (max(0, start), indent, hanging, suffix, align) if k == level else (1, 720 * (k + 1), 360, "tab", "left")
            levels.append(dict(zip(("level", "format", "text", "start", "indent", "hanging", "suffix", "align"), (k, form, text, *own))))
        self.made.append({"num_id": len(self.made) + 1, "levels": levels})
        return len(self.made)


class Counter:
    """Ordinals of one list's items; a new definition where the sequence or the marker changes."""

    def __init__(self, node: Node, made: Definitions, level: int, indent: int, inside: bool):
        ordered = node.tag == "ol"
        down = ordered and "reversed" in node.attrs
        items = sum(c.tag == "li" for c in node.elements)
        start = _integer(node.attrs.get("start")) if ordered else None
        self.made, self.level, self.indent, self.ordered = made, level, indent, ordered
        self.step = -1 if down else 1
        self.next = start if start is not None else items if down else 1
        self.hanging, self.suffix = (0, "space") if inside else (min(360, indent), "tab")
        self.state: tuple | None = None  # what the current definition would give the next item
        self.num_id = 0

    def marker(self, item: Node, kind: str, style: Style) -> dict:
        """Takes the item's number; the reference is made when a paragraph takes the marker."""
        own = _integer(item.attrs.get("value")) if self.ordered and item.tag == "li" else None
        value = self.next if own is None else own
        self.next = value + self.step
        return {"counter": self, "value": value, "kind": kind, "style": style, "taken": False}

    def place(self, kind: str, style: Style) -> tuple[int, str]:
        """(twips that the marker hangs, its side there): as far as the font asks for, 360 where that is not known."""
        found = marker_distance(kind, style.family, style.size) if self.hanging and kind != "none" else None
        return (max(1, twips(found[0])), found[1]) if found else (self.hanging, "left")

    def reference(self, value: int, kind: str, style: Style) -> tuple[int, int, int]:
        """(definition, level, twips that the marker hangs)."""
        hanging, align = self.place(kind, style)
        if self.state != (value, kind, hanging) or self.step < 0 or spelled_out(kind):
            self.num_id = self.made.add(kind, self.level, value, self.indent, hanging, self.suffix, align)
        self.state = (value + self.step, kind, hanging)
        return self.num_id, self.level, hanging
