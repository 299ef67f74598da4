"""Numbering of one Word package: levels, counters and labels."""

from __future__ import annotations

import re
from xml.etree.ElementTree import Element

from vellumite.kernels.units import numbered, whole
from vellumite.kernels.symbols import symbol
from vellumite.kernels.word_xml import Formats, Styles, attr, child, on, q, val


class Numbering:
    def __init__(self, formats: Formats, styles: Styles, root: Element | None):
        self.formats, self.styles = formats, styles
        self.abstract: dict[str, dict] = {}
        self.instances: dict[str, dict] = {}
        self.counters: dict[tuple[str, str], dict[int, int | None]] = {}
        self._levels: dict[str, dict[int, dict]] = {}
        for e in root.findall(q("abstractNum")) if root is not None else ():
            levels: dict[int, dict] = {}
            for lvl in e.findall(q("lvl")):
                one = self._level(lvl)
                levels.setdefault(one["level"], one)
            self.abstract.setdefault(attr(e, "abstractNumId") or "", {"levels": levels, "link": val(e, "numStyleLink")})
        for e in root.findall(q("num")) if root is not None else ():
            starts, levels = {}, {}
            for o in e.findall(q("lvlOverride")):
                at = whole(attr(o, "ilvl")) or 0
                start = whole(val(o, "startOverride"))
                if start is not None:
                    starts[at] = start
                if child(o, "lvl") is not None:
                    levels[at] = {**self._level(child(o, "lvl")), "level": at}
            self.instances.setdefault(attr(e, "numId") or "", {"abstract": val(e, "abstractNumId"), "starts": starts, "levels": levels})

    def _level(self, e: Element) -> dict:
        fonts = child(e, "rPr", "rFonts")
        font = attr(fonts, "ascii") or attr(fonts, "hAnsi")
        text, kind = attr(child(e, "lvlText"), "val"), val(e, "numFmt") or "decimal"
        if text is not None and kind == "bullet":
            text = "".join(symbol(font, ord(c)) or (symbol("symbol", ord(c)) if ord(c) >= 0xF020 else None) or c for c in text)
        tabs = [whole(attr(t, "pos")) for t in e.iterfind(f"{q('pPr')}/{q('tabs')}/{q('tab')}") if attr(t, "val") == "num"]
        return {
            "level": whole(attr(e, "ilvl")) or 0, "start": whole(val(e, "start")) or 0, "format": kind, "text": text, "restart": whole(val(e, "lvlRestart")), "legal": bool(on(e, "isLgl")), "style": val(e, "pStyle"),
            "suffix": val(e, "suff") or "tab", "tab": tabs[0] if tabs else None, "align": {"right": "right", "end": "right", "center": "center"}.get(val(e, "lvlJc") or "", "left"), "symbol": (font or "").lower() == "symbol",
            "paragraph": self.formats.paragraph(child(e, "pPr")),
        }

    def _abstract(self, num_id: str, depth: int = 0) -> str | None:
        """The abstract definition of an instance, through links to numbering styles."""
        name = self.instances.get(num_id, {}).get("abstract")
        link = self.abstract.get(name or "", {}).get("link")
        if link is None or depth > 8:
            return name if name in self.abstract else None
        other = self.styles.numbering(link)
        return None if other in (None, num_id) else self._abstract(other, depth + 1)

    def levels(self, num_id: str) -> dict[int, dict]:
        if num_id not in self._levels:
            base = self.abstract.get(self._abstract(num_id) or "", {"levels": {}})["levels"]
            self._levels[num_id] = dict(sorted({**base, **self.instances.get(num_id, {"levels": {}})["levels"]}.items()))
        return self._levels[num_id]

    def level_of_style(self, num_id: str, style: str | None) -> int | None:
        return next((k for k, x in self.levels(num_id).items() if style is not None and x["style"] == style), None)

    def start(self, num_id: str, level: int) -> int:
        own = self.instances.get(num_id, {"starts": {}})["starts"]
        return own.get(level, self.levels(num_id).get(level, {"start": 0})["start"])

    def next(self, num_id: str, level: int) -> dict | None:
        """Counts a paragraph: {num_id, level, ordinal, label}.

        Instances of one abstract definition count together, unless they set a start of their own. Deeper levels begin
        anew, but those that say otherwise (lvlRestart).
        """
        levels = self.levels(num_id)
        if level not in levels:
            return None
        alone = bool(self.instances[num_id]["starts"])
        count = self.counters.setdefault(("num", num_id) if alone else ("abstract", self._abstract(num_id) or ""), {})
        for deeper, x in levels.items():
            if deeper > level and (x["restart"] is None or level < x["restart"]):
                count[deeper] = None
        count[level] = self.start(num_id, level) if count.get(level) is None else count[level] + 1
        own = levels[level]

        def number(m: re.Match) -> str:
            at = int(m[1]) - 1
            kind = "decimal" if own["legal"] else levels.get(at, {"format": "decimal"})["format"]
            return numbered(self.start(num_id, at) if count.get(at) is None else count[at], kind)

        label = "" if own["text"] is None else own["text"] if own["format"] == "bullet" else re.sub(r"%([1-9])", number, own["text"])
        return {"num_id": whole(num_id) or 0, "level": level, "ordinal": count[level], "label": label}

    def definitions(self) -> list[dict]:
        out = []
        for name in self.instances:
            levels = self.levels(name)
            if not levels or whole(name) is None:
                continue
            made = []
            for k in range(9):
                x = levels.get(k)
                p = x["paragraph"] if x else {}
                made.append({"level": k, "format": x["format"] if x else "decimal", "text": (x["text"] or "") if x else "", "start": self.start(name, k), "indent": p.get("left", 0), "hanging": max(0, -p.get("first", 0)), "suffix": x["suffix"] if x else "tab", "align": x["align"] if x else "left"})
            out.append({"num_id": whole(name), "levels": made})
        return out
