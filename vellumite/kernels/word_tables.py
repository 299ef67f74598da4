"""Tables of one Word package: rows, grid, and cell formats from styles by region."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree.ElementTree import Element

from vellumite.kernels.units import measure, rounded
from vellumite.kernels.word_xml import CONDITIONS, MC, Formats, Styles, attr, child, joined, over, q

SIDES = ("top", "left", "bottom", "right")
INSIDE = {"top": "insideH", "bottom": "insideH", "left": "insideV", "right": "insideV"}
# Bits of the table look and its value where none is given.
LOOK, USUAL_LOOK = {"firstRow": 0x20, "lastRow": 0x40, "firstColumn": 0x80, "lastColumn": 0x100, "noHBand": 0x200, "noVBand": 0x400}, "04A0"


def look(e: Element | None) -> dict[str, bool]:
    try:
        bits = int(attr(e, "val") or USUAL_LOOK, 16)
    except ValueError:
        bits = 0
    return {name: bool(bits & bit) if (v := attr(e, name)) is None else v.lower() in ("1", "true", "on") for name, bit in LOOK.items()}


def inner(e: Element, name: str) -> list[Element]:
    """Children of a name, seen through content controls, insertions and alternatives; not those of nested tables."""
    out = []
    for c in e:
        if c.tag == q(name):
            out.append(c)
        elif c.tag == q("sdt"):
            content = child(c, "sdtContent")
            out += inner(c if content is None else content, name)
        elif c.tag in (q("customXml"), q("ins"), q("moveTo"), q("AlternateContent", MC), q("Choice", MC), q("Fallback", MC)):
            out += inner(c, name)
    return out


def table_rows(e: Element, formats: Formats) -> list[dict]:
    """Rows with their cells; deleted rows go, cells merged to the left widen the one before."""
    out = []
    for tr in inner(e, "tr"):
        row = formats.row(child(tr, "trPr"))
        if row.get("deleted"):
            continue
        cells: list[dict] = []
        for tc in inner(tr, "tc"):
            cell = formats.cell(child(tc, "tcPr"))
            span = max(1, cell.get("span", 1))
            if cell.get("across") == "continue" and cells:
                cells[-1]["span"] += span
            else:
                cells.append({"e": tc, "format": cell, "span": span})
        exceptions = child(tr, "tblPrEx")
        out.append({"format": row, "cells": cells, "columns": row.get("before", 0) + sum(c["span"] for c in cells) + row.get("after", 0), "table": formats.table(exceptions)})
    return out


def _amount(width: tuple[int, str] | None, room: int) -> int:
    if width is None:
        return 0
    return width[0] if width[1] == "dxa" else rounded(room * width[0] / 5000) if width[1] == "pct" else 0


def grid_widths(grid: list[int], rows: list[dict], table: dict, room: int) -> list[int]:
    """Declared columns, then cells of one column, then the mean of what is known; scaled where the table's width is another."""
    count = max([len(grid), *(r["columns"] for r in rows)])
    grid = [*grid, *[0] * (count - len(grid))]
    for row in rows:
        at = row["format"].get("before", 0)
        for c in row["cells"]:
            if c["span"] == 1 and at < count and not grid[at]:
                grid[at] = max(0, _amount(c["format"].get("width"), room))
            at += c["span"]
    known = [w for w in grid if w]
    usual = sum(known) // len(known) if known else room // max(1, count)
    grid = [w or usual for w in grid]
    wanted, total = _amount(table.get("width"), room), sum(grid)
    return [max(1, rounded(w * wanted / total)) for w in grid] if wanted > 0 and total > 0 and abs(wanted - total) > 20 else grid


def regions(shown: dict[str, bool], row: int, rows: int, first: int, last: int, columns: int, heads: int, table: dict) -> list[str]:
    """Regions that a cell is in, the weakest first."""
    top, bottom = shown["firstRow"] and row < max(1, heads), shown["lastRow"] and row == rows - 1
    left, right = shown["firstColumn"] and first == 0, shown["lastColumn"] and last == columns - 1
    band = lambda at, size: at // max(1, size or 1) % 2 if at >= 0 else None
    across = None if shown["noHBand"] or top or bottom else band(row - (max(1, heads) if shown["firstRow"] else 0), table.get("row_band"))
    down = None if shown["noVBand"] or left or right else band(first - (1 if shown["firstColumn"] else 0), table.get("column_band"))
    holds = {
        "band1Vert": down == 0, "band2Vert": down == 1, "band1Horz": across == 0, "band2Horz": across == 1, "firstCol": left, "lastCol": right, "firstRow": top, "lastRow": bottom,
        "nwCell": top and left, "neCell": top and right, "swCell": bottom and left, "seCell": bottom and right,
    }
    return [name for name in CONDITIONS if holds[name]]


def _edges(borders: dict, outer: dict[str, bool]) -> dict:
    """Of a region's borders those that a cell shows: outer ones at the region's edge, inside ones elsewhere."""
    named = {s: borders.get(s if outer[s] else INSIDE[s]) for s in SIDES}
    return {s: b for s, b in named.items() if b is not None}


def visible(border: dict | None) -> dict | None:
    if border is None or border["style"] == "none":
        return None
    return {**border, "color": "000000"} if border["color"] == "auto" else border


def read_table(e: Element, formats: Formats, styles: Styles, room: int, content: Callable[[Element, dict, int], list[dict]]) -> dict | None:
    """A table block; `content` reads the blocks of a cell under a table style's condition."""
    direct = formats.table(child(e, "tblPr"))
    style = styles.table_style(direct.get("style"))
    table, shown, rows = over(style["table"], direct), look(child(e, "tblPr", "tblLook")), table_rows(e, formats)
    if not rows:
        return None
    grid = grid_widths([max(0, measure(attr(c, "w")) or 0) for c in e.iterfind(f"{q('tblGrid')}/{q('gridCol')}")], rows, table, room)
    heads = next((i for i, r in enumerate(rows) if not r["format"].get("header")), len(rows))
    made, columns = [], len(grid)
    for r, row in enumerate(rows):
        cells: list[dict] = []
        at = 0

        def pad(span: int) -> None:
            nonlocal at
            if span > 0:
                cells.append({"props": {"width": sum(grid[at : at + span]), "span": span}, "blocks": [{"kind": "paragraph", "props": {}, "inlines": []}]})
                at += span

        pad(row["format"].get("before", 0))
        own_table = over(table, row["table"])
        for c in row["cells"]:
            span = min(c["span"], columns - at)
            if span < 1:
                break
            last = at + span - 1
            outer = {"top": r == 0, "bottom": r == len(rows) - 1, "left": at == 0, "right": last == columns - 1}
            borders, merged = _edges(own_table.get("borders", {}), outer), joined(style["whole"], style["regions"].get("wholeTable", {}))
            borders |= _edges(merged["cell"].get("borders", {}), outer)
            cell = merged["cell"]
            for name in regions(shown, r, len(rows), at, last, columns, heads, table):
                if name not in style["regions"]:
                    continue
                one = style["regions"][name]
                edge = {s: True for s in SIDES}
                if name in ("firstRow", "lastRow", "band1Horz", "band2Horz"):
                    edge |= {"left": outer["left"], "right": outer["right"]}
                elif name in ("firstCol", "lastCol", "band1Vert", "band2Vert"):
                    edge |= {"top": outer["top"], "bottom": outer["bottom"]}
                borders |= _edges(one["table"].get("borders", {}), edge) | _edges(one["cell"].get("borders", {}), edge)
                cell, merged = over(cell, one["cell"]), joined(merged, one)
            borders |= {s: b for s, b in c["format"].get("borders", {}).items() if s in SIDES}
            final = over(cell, c["format"])
            margins = {"top": 0, "left": 108, "bottom": 0, "right": 108, **own_table.get("margins", {}), **final.get("margins", {})}
            width, shade = sum(grid[at : at + span]), final.get("shading", own_table.get("shading"))
            blocks = content(c["e"], merged, max(360, width - margins["left"] - margins["right"]))
            if not blocks or blocks[-1]["kind"] != "paragraph":
                blocks.append({"kind": "paragraph", "props": {}, "inlines": []})
            props = {"width": width, "span": span, "merge": c["format"].get("merge"), "shading": None if shade == "auto" else shade, "valign": final.get("valign"), "borders": {s: visible(borders.get(s)) for s in SIDES}, "margins": margins, "no_wrap": final.get("no_wrap", False)}
            cells.append({"props": props, "blocks": blocks})
            at += span
        pad(columns - at)
        height = row["format"].get("height", 0)
        made.append({"header": r < heads, "height": height if height > 0 and row["format"].get("height_rule") != "auto" else None, "cells": cells})
    align, shade = table.get("align"), table.get("shading")
    props = {"width": sum(grid), "align": None if align == "left" else align, "indent": table.get("indent", 0), "borders": None, "shading": None if shade == "auto" else shade, "bidi": table.get("bidi", False)}
    return {"kind": "table", "props": props, "grid": grid, "rows": made, "top": 0, "bottom": 0}
