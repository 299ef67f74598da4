"""Reading of word-processor XML: names, attributes, formats, theme. A format is a dict of what is set."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree.ElementTree import Element

from vellumite.kernels.units import measure, rounded, whole
from vellumite.sources.docx import R, W

# Namespaces of the format.
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
PIC = "http://schemas.openxmlformats.org/drawingml/2006/picture"
WPS = "http://schemas.microsoft.com/office/word/2010/wordprocessingShape"
WPG = "http://schemas.microsoft.com/office/word/2010/wordprocessingGroup"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
V = "urn:schemas-microsoft-com:vml"
O = "urn:schemas-microsoft-com:office:office"  # noqa: E741
W14 = "http://schemas.microsoft.com/office/word/2010/wordml"
W15 = "http://schemas.microsoft.com/office/word/2012/wordml"
DC, DCTERMS = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/"
# Highlight colours.
HIGHLIGHTS = {"black": "000000", "blue": "0000FF", "cyan": "00FFFF", "green": "00FF00", "magenta": "FF00FF", "red": "FF0000", "yellow": "FFFF00", "white": "FFFFFF", "darkBlue": "000080", "darkCyan": "008080", "darkGreen": "008000", "darkMagenta": "800080", "darkRed": "800000", "darkYellow": "808000", "darkGray": "808080", "lightGray": "C0C0C0"}


def q(name: str, ns: str = W) -> str:
    return f"{{{ns}}}{name}"


def local(e: Element) -> str:
    """The name of an element of the main namespace; of another one with the braces."""
    return e.tag.removeprefix(f"{{{W}}}") if isinstance(e.tag, str) else ""


def child(e: Element | None, *names: str, ns: str = W) -> Element | None:
    for name in names:
        e = e.find(q(name, ns)) if e is not None else None
    return e


def attr(e: Element | None, name: str, ns: str = W) -> str | None:
    return None if e is None else e.get(q(name, ns), e.get(name) if ns == W else None)


def val(e: Element | None, *names: str) -> str | None:
    return attr(child(e, *names), "val")


def on(e: Element | None, name: str) -> bool | None:
    found = child(e, name)
    return None if found is None else (attr(found, "val") or "true").lower() not in ("0", "false", "off", "none")


def flag(value: str | None) -> bool | None:
    return None if value is None else value.lower() not in ("0", "false", "off")


def below(e: Element | None, name: str, ns: str = W) -> Iterator[Element]:
    return iter(()) if e is None else e.iter(q(name, ns))


def set_only(**values) -> dict:
    return {k: v for k, v in values.items() if v is not None}


class Theme:
    """Fonts and colours by slot."""

    # Other names of colour slots, and what system colours usually are.
    SLOTS = {"text1": "dk1", "dark1": "dk1", "background1": "lt1", "light1": "lt1", "text2": "dk2", "dark2": "dk2", "background2": "lt2", "light2": "lt2", "hyperlink": "hlink", "followedHyperlink": "folHlink"}
    SYSTEM = {"windowText": "000000", "window": "FFFFFF"}

    def __init__(self, root: Element | None = None):
        parts = child(root, "themeElements", ns=A)
        self.fonts: dict[str, str] = {}
        self.colours: dict[str, str] = {}
        for role in ("major", "minor"):
            font = child(parts, "fontScheme", f"{role}Font", ns=A)
            face = {k: (e.get("typeface") or "").strip() if (e := child(font, k, ns=A)) is not None else "" for k in ("latin", "ea", "cs")}
            slots = {"HAnsi": face["latin"], "Ascii": face["latin"], "EastAsia": face["ea"] or face["latin"], "Bidi": face["cs"] or face["latin"]}
            self.fonts |= {role + k: v for k, v in slots.items() if v}
        scheme = child(parts, "clrScheme", ns=A)
        for slot in scheme if scheme is not None else ():
            for one in list(slot)[:1]:
                found = one.get("val") if one.tag == q("srgbClr", A) else (one.get("lastClr") or self.SYSTEM.get(one.get("val", ""))) if one.tag == q("sysClr", A) else None
                if found and re.fullmatch(r"[0-9A-Fa-f]{6}", found):
                    self.colours[slot.tag.rpartition("}")[2]] = found.upper()

    def colour(self, name: str | None, tint: str | None, shade: str | None) -> str | None:
        base = self.colours.get(self.SLOTS.get(name or "", name or ""))
        if base is None:
            return None
        channels = [float(int(base[i : i + 2], 16)) for i in (0, 2, 4)]
        for byte, ground in ((tint, 255.0), (shade, 0.0)):
            if byte and re.fullmatch(r"[0-9A-Fa-f]{2}", byte):
                share = int(byte, 16) / 255
                channels = [c * share + ground * (1 - share) for c in channels]
        return "".join(f"{rounded(c):02X}" for c in channels)


class Formats:
    """What properties elements set, as dicts."""

    def __init__(self, theme: Theme):
        self.theme = theme

    def colour(self, e: Element | None, name: str = "val", theme: str = "theme") -> str | None:
        """`auto` or RRGGBB; theme colours first. `theme` is the stem of the theme attributes."""
        if e is None:
            return None
        stem = "themeColor" if theme == "theme" else theme
        found = self.theme.colour(attr(e, stem), attr(e, f"{theme}Tint"), attr(e, f"{theme}Shade"))
        plain = attr(e, name) or ""
        return found or (plain.upper() if re.fullmatch(r"[0-9A-Fa-f]{6}", plain) else "auto" if plain.lower() == "auto" else None)

    def shading(self, e: Element | None) -> str | None:
        if e is None:
            return None
        pattern = attr(e, "val")
        if pattern == "nil":
            return "auto"
        if pattern == "solid":
            return next((c for c in (self.colour(e, "color"),) if c and c != "auto"), "000000")
        return next((c for c in (self.colour(e, "fill", "themeFill"),) if c), "auto")

    def font(self, e: Element | None) -> str | None:
        for slot in ("hAnsi", "ascii") if e is not None else ():
            name = re.sub(r"[\x00-\x1f\x7f;{}()<>]", "", self.theme.fonts.get(attr(e, f"{slot}Theme") or "") or attr(e, slot) or "").strip()
            if name:
                return name
        return None

    def run(self, e: Element | None) -> dict:
        if e is None:
            return {}
        struck = [x for x in (on(e, "strike"), on(e, "dstrike")) if x is not None]
        mark, line, size = val(e, "highlight"), child(e, "u"), val(e, "sz")
        return set_only(
            family=self.font(child(e, "rFonts")), size=None if (pt := measure(size, 10)) is None else rounded(pt / 10), bold=on(e, "b"), italic=on(e, "i"),
            underline=None if line is None else attr(line, "val") or "single", strike=any(struck) if struck else None, color=self.colour(child(e, "color")),
            highlight="none" if mark == "none" else HIGHLIGHTS.get(mark or ""), shading=self.shading(child(e, "shd")),
            vertical=v if (v := val(e, "vertAlign")) in ("superscript", "subscript", "baseline") else None, caps=on(e, "caps"), small_caps=on(e, "smallCaps"),
            spacing=measure(val(e, "spacing")), shadow=on(e, "shadow"), rtl=on(e, "rtl"), hidden=on(e, "vanish"), kern=whole(val(e, "kern")),
        )

    # Alignments of the format by what they amount to.
    ALIGN = {"left": "left", "start": "left", "right": "right", "end": "right", "center": "center", **dict.fromkeys(("both", "distribute", "lowKashida", "mediumKashida", "highKashida", "thaiDistribute"), "both")}

    def paragraph(self, e: Element | None) -> dict:
        if e is None:
            return {}
        ind, gap, num = child(e, "ind"), child(e, "spacing"), child(e, "numPr")
        twips = lambda x, *names: next((measure(v) for n in names if (v := attr(x, n)) is not None), None)
        lines = lambda n: None if (v := whole(attr(gap, n))) is None else rounded(v * 2.4)
        hanging, outline, line = twips(ind, "hanging"), whole(val(e, "outlineLvl")), twips(gap, "line")
        return set_only(
            align=self.ALIGN.get(val(e, "jc") or ""), left=twips(ind, "left", "start"), right=twips(ind, "right", "end"), first=twips(ind, "firstLine") if hanging is None else -hanging,
            before=lines("beforeLines") if (v := twips(gap, "before")) is None else v, after=lines("afterLines") if (v := twips(gap, "after")) is None else v,
            auto_before=flag(attr(gap, "beforeAutospacing")), auto_after=flag(attr(gap, "afterAutospacing")), line=line, rule=None if line is None else attr(gap, "lineRule") or "auto",
            contextual=on(e, "contextualSpacing"), keep_next=on(e, "keepNext"), keep_lines=on(e, "keepLines"), page_break=on(e, "pageBreakBefore"), shading=self.shading(child(e, "shd")),
            borders=self.borders(child(e, "pBdr"), ("top", "left", "bottom", "right")) or None, num_id=val(num, "numId"), level=whole(val(num, "ilvl")),
            outline=outline if outline is not None and 0 <= outline <= 8 else None, bidi=on(e, "bidi"), mark=self.run(child(e, "rPr")) or None,
        )

    def borders(self, e: Element | None, sides: tuple[str, ...]) -> dict:
        out = {}
        for side in sides:
            one = child(e, side)
            one = child(e, {"left": "start", "right": "end"}.get(side, side)) if one is None else one
            if one is None:
                continue
            kind = attr(one, "val") or "none"
            size = measure(attr(one, "sz"), 1)
            out[side] = {"style": "none", "size": 0, "color": "auto", "space": 0} if kind in ("nil", "none") else {"style": kind, "size": max(2, 2 if size is None else size), "color": self.colour(one, "color") or "auto", "space": max(0, whole(attr(one, "space")) or 0)}
        return out

    @staticmethod
    def width(e: Element | None) -> tuple[int, str] | None:
        """(amount, dxa, pct, auto or nil); fiftieths of a percent."""
        if e is None:
            return None
        raw, kind = attr(e, "w") or "", attr(e, "type") or "dxa"
        if re.fullmatch(r"\d+(\.\d+)?%", raw):
            return rounded(float(raw[:-1]) * 50), "pct"
        return (whole(raw) if kind == "pct" else measure(raw)) or 0, kind

    def margins(self, e: Element | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for name, side in (("top", "top"), ("left", "left"), ("bottom", "bottom"), ("right", "right"), ("start", "left"), ("end", "right")):
            w = self.width(child(e, name))
            if w and w[1] != "pct":
                out.setdefault(side, w[0])
        return out

    def table(self, e: Element | None) -> dict:
        if e is None:
            return {}
        align = self.ALIGN.get(val(e, "jc") or "")
        indent = self.width(child(e, "tblInd"))
        return set_only(
            style=val(e, "tblStyle"), width=self.width(child(e, "tblW")), align=align if align != "both" else None, indent=indent[0] if indent else None,
            borders=self.borders(child(e, "tblBorders"), ("top", "left", "bottom", "right", "insideH", "insideV")) or None, margins=self.margins(child(e, "tblCellMar")) or None,
            shading=self.shading(child(e, "shd")), bidi=on(e, "bidiVisual"), row_band=whole(val(e, "tblStyleRowBandSize")), column_band=whole(val(e, "tblStyleColBandSize")),
        )

    def cell(self, e: Element | None) -> dict:
        if e is None:
            return {}
        merged = lambda name: None if (m := child(e, name)) is None else "restart" if attr(m, "val") == "restart" else "continue"
        place = val(e, "vAlign")
        return set_only(
            width=self.width(child(e, "tcW")), span=whole(val(e, "gridSpan")), merge=merged("vMerge"), across=merged("hMerge"), shading=self.shading(child(e, "shd")),
            borders=self.borders(child(e, "tcBorders"), ("top", "left", "bottom", "right", "insideH", "insideV")) or None, valign=place if place in ("top", "center", "bottom") else None,
            margins=self.margins(child(e, "tcMar")) or None, no_wrap=on(e, "noWrap"),
        )

    def row(self, e: Element | None) -> dict:
        height = child(e, "trHeight")
        return set_only(
            height=measure(attr(height, "val")), height_rule=None if height is None else attr(height, "hRule") or "atLeast", header=on(e, "tblHeader"), before=whole(val(e, "gridBefore")), after=whole(val(e, "gridAfter")),
            deleted=True if child(e, "del") is not None else None,
        )


NESTED = ("borders", "margins", "mark")


def over(base: dict, top: dict) -> dict:
    """The upper layer where it sets something; borders and margins side by side."""
    out = {**base, **top}
    for name in NESTED:
        if name in base and name in top:
            out[name] = {**base[name], **top[name]}
    return out


TOGGLES = ("bold", "italic", "strike", "caps", "small_caps", "hidden", "shadow")


def layered(defaults: dict, styles: list[dict], direct: dict) -> dict:
    """Run formats of several styles: a toggle set by two of them is off again; direct formatting stands as it is."""
    out = dict(defaults)
    for style in styles:
        for k, v in style.items():
            out[k] = bool(out.get(k, False)) != v if k in TOGGLES else v
    return {**out, **direct}


def run_properties(f: dict) -> dict:
    """A run format with the word processor's defaults filled in."""
    ground = None if f.get("highlight") == "none" else f.get("highlight")
    shade = None if f.get("shading") == "auto" else f.get("shading")
    size, kern = f.get("size", 20), f.get("kern", 0)
    return {
        "family": f.get("family") or "Times New Roman", "size": size, "bold": f.get("bold", False), "italic": f.get("italic", False), "underline": f.get("underline", "none"), "strike": f.get("strike", False),
        "color": "000000" if f.get("color", "auto") == "auto" else f["color"], "shading": ground or shade, "vertical": f.get("vertical", "baseline"), "caps": f.get("caps", False), "small_caps": f.get("small_caps", False),
        "spacing": f.get("spacing", 0), "shadow": f.get("shadow", False), "rtl": f.get("rtl", False), "kerning": kern > 0 and size >= kern,
    }


CONDITIONS = ("band1Vert", "band2Vert", "band1Horz", "band2Horz", "firstCol", "lastCol", "firstRow", "lastRow", "nwCell", "neCell", "swCell", "seCell")


class Styles:
    """The style table: the first of several of one id counts; formats along `basedOn`, cycles and unknown parents ignored."""

    def __init__(self, formats: Formats, root: Element | None):
        self.formats = formats
        self.table: dict[str, Element] = {}
        self.defaults: dict[str, str] = {}
        self.run_default = formats.run(child(root, "docDefaults", "rPrDefault", "rPr"))
        self.paragraph_default = formats.paragraph(child(root, "docDefaults", "pPrDefault", "pPr"))
        for e in root.findall(q("style")) if root is not None else ():
            name = attr(e, "styleId")
            if name is None or name in self.table:
                continue
            self.table[name] = e
            if (attr(e, "default") or "").lower() in ("1", "true", "on"):
                self.defaults.setdefault(self.kind(name), name)
        self._made: dict[tuple, dict] = {}

    def kind(self, name: str | None) -> str | None:
        return attr(self.table[name], "type") or "paragraph" if name in self.table else None

    def name(self, name: str | None) -> str | None:
        return val(self.table[name], "name") if name in self.table else None

    def effective(self, name: str | None, kind: str) -> str | None:
        return name if name is not None and self.kind(name) == kind else self.defaults.get(kind)

    def chain(self, name: str | None) -> list[Element]:
        """From the root of `basedOn` to the style itself."""
        seen: dict[str, Element] = {}
        while name in self.table and name not in seen:
            seen[name] = self.table[name]
            name = val(self.table[name], "basedOn")
        return [*seen.values()][::-1]

    def _along(self, what: str, name: str | None, kind: str, read) -> dict:
        name = self.effective(name, kind)
        key = (what, kind, name)
        if key not in self._made:
            out: dict = {}
            for e in self.chain(name):
                out = over(out, read(e))
            self._made[key] = out
        return self._made[key]

    def paragraph(self, name: str | None) -> dict:
        return self._along("p", name, "paragraph", lambda e: self.formats.paragraph(child(e, "pPr")))

    def run(self, name: str | None, kind: str) -> dict:
        return self._along("r", name, kind, lambda e: self.formats.run(child(e, "rPr")))

    def numbering(self, name: str) -> str | None:
        """The numbering that a numbering style names."""
        if self.kind(name) != "numbering":
            return None
        found = [n for e in self.chain(name) if (n := val(e, "pPr", "numPr", "numId"))]
        return found[-1] if found else None

    def _condition(self, e: Element) -> dict:
        f = self.formats
        return {"table": f.table(child(e, "tblPr")), "cell": f.cell(child(e, "tcPr")), "paragraph": f.paragraph(child(e, "pPr")), "run": f.run(child(e, "rPr"))}

    def table_style(self, name: str | None) -> dict:
        """{table, whole, and a condition by region}: regions of derived styles lie over those of their bases."""
        name = self.effective(name, "table")
        if ("t", name) not in self._made:
            out: dict = {"table": {}, "whole": {}, "regions": {}}
            for e in self.chain(name):
                out["table"] = over(out["table"], self.formats.table(child(e, "tblPr")))
                out["whole"] = joined(out["whole"], self._condition(e))
                for one in e.findall(q("tblStylePr")):
                    region = attr(one, "type")
                    if region == "wholeTable" or region in CONDITIONS:
                        out["regions"][region] = joined(out["regions"].get(region, {}), self._condition(one))
            self._made["t", name] = out
        return self._made["t", name]


def joined(base: dict, top: dict) -> dict:
    """Table conditions, part by part."""
    return {k: over(base.get(k, {}), top.get(k, {})) for k in ("table", "cell", "paragraph", "run")}
