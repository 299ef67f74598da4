"""Tables of one document: slots, widths and cells."""

from __future__ import annotations

from vellumite.operators.tables import allocate

LEAST_COLUMN = 360
# Widths of characters in ems by class.
NARROW, SLIM, WIDE = " .,:;'!|il ", "fjrt()[]-/", "mwMW"


def ems(line: str) -> float:
    return sum(0.25 if c in NARROW else 0.33 if c in SLIM else 0.8 if c in WIDE else 0.6 if c.isupper() else 0.5 for c in line)


def place(rows: list[list[dict]]) -> tuple[list[dict], int]:
    """Cells (with colspan and rowspan; 0 reaches the end) with `row`, `col` and clamped spans, and the number of columns."""
    cells, columns = [], 0
    for r, (row, spans) in enumerate(zip(rows, allocate([[(c["colspan"], c["rowspan"]) for c in row] for row in rows]))):
        for cell, (col, colspan, rowspan) in zip(row, spans):
            cells.append({**cell, "row": r, "col": col, "colspan": colspan, "rowspan": rowspan})
            columns = max(columns, col + colspan)
    return cells, columns


def natural(cells: list[dict], columns: int) -> list[int]:
    """Twips that each column's content wants; what a spanning cell lacks is shared among its columns in proportion."""
    widths = [LEAST_COLUMN] * columns
    for c in cells:
        if c["colspan"] == 1:
            widths[c["col"]] = max(widths[c["col"]], c["natural"])
    for c in cells:
        span = range(c["col"], c["col"] + c["colspan"])
        have = sum(widths[k] for k in span)
        lack = c["natural"] - have
        if c["colspan"] > 1 and lack > 0:
            before = [widths[k] for k in span]
            for k, w in zip(span, before):
                widths[k] += lack * w // max(1, have)
    return widths


def column_widths(total: int, declared: list[int | None], cells: list[dict], wanted: list[int]) -> list[int]:
    """Declared by columns, then by cells of one column; the others share what is left as they want; all scaled to `total`."""
    widths: list[int | None] = [declared[k] if k < len(declared) else None for k in range(len(wanted))]
    for c in cells:
        if c["colspan"] == 1 and widths[c["col"]] is None:
            widths[c["col"]] = c["width"]
    left = max(0, total - sum(w for w in widths if w))
    open_ = sum(n for w, n in zip(widths, wanted) if w is None)
    sized = [w if w is not None else max(LEAST_COLUMN, left * n // max(1, open_)) for w, n in zip(widths, wanted)]
    whole, out = sum(sized), []
    for w in sized[:-1]:
        out.append(max(1, w * total // whole))
    return [*out, max(1, total - sum(out))]


def rows_of(cells: list[dict], height: int, columns: int) -> list[list[tuple[dict | None, int, bool]]]:
    """Per row, from left to right: (cell or None for padding, columns it takes there, whether it begins there)."""
    at: dict[tuple[int, int], dict] = {}
    for c in cells:
        for r in range(c["row"], c["row"] + c["rowspan"]):
            for k in range(c["col"], c["col"] + c["colspan"]):
                at[r, k] = c
    out = []
    for r in range(height):
        line, k = [], 0
        while k < columns:
            cell = at.get((r, k))
            if cell is None or cell["col"] != k:
                line.append((None, 1, True))
                k += 1
                continue
            span = 1
            while span < cell["colspan"] and at.get((r, k + span)) is cell:
                span += 1
            line.append((cell, span, cell["row"] == r))
            k += span
        out.append(line)
    return out
