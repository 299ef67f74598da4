"""The document model as rows: one row a document, with arrays of blocks, tables, lists, notes and the like.

Nothing recurs: a block names the place it stands in (body, cell, note, comment, header or footer) and that place's
number. So a corpus of models is filtered and counted with column functions, a document never needs a shuffle, and
table() lays any of the arrays out as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUN = "struct<family: string, size: int, bold: boolean, italic: boolean, underline: string, strike: boolean, color: string, shading: string, vertical: string, caps: boolean, small_caps: boolean, spacing: int, shadow: boolean, rtl: boolean, kerning: boolean>"
EDGE = "struct<style: string, size: int, color: string, space: int>"
BORDERS = f"struct<top: {EDGE}, left: {EDGE}, bottom: {EDGE}, right: {EDGE}>"
MARGINS = "struct<top: int, left: int, bottom: int, right: int>"
PARAGRAPH = f"struct<style: string, align: string, left: int, right: int, first: int, before: int, after: int, line: int, rule: string, keep_next: boolean, keep_lines: boolean, page_break: boolean, shading: string, borders: {BORDERS}, num_id: int, level: int, ordinal: int, label: string, bidi: boolean, outline: int, mark: {RUN}>"
INLINE = f"struct<kind: string, text: string, run: {RUN}, url: string, anchor: string, ref: int, media: string, width: bigint, height: bigint, side: string, field: string, display: boolean>"
BLOCK = f"struct<place: string, place_id: int, ord: int, kind: string, props: {PARAGRAPH}, inlines: array<{INLINE}>, table_id: int>"
CELL = f"struct<width: int, span: int, merge: string, shading: string, valign: string, borders: {BORDERS}, margins: {MARGINS}, no_wrap: boolean, header: boolean>"
TABLE = f"struct<table_id: int, props: struct<width: int, align: string, indent: int, borders: {BORDERS}, shading: string, bidi: boolean>, grid: array<int>, top: int, bottom: int, rows: array<struct<header: boolean, height: int, cells: array<struct<cell_id: int, props: {CELL}>>>>>"
LIST = "struct<num_id: int, levels: array<struct<level: int, format: string, text: string, start: int, indent: int, hanging: int, suffix: string, align: string>>>"
STYLE = f"struct<id: string, name: string, based_on: string, default: boolean, props: {PARAGRAPH}, run: {RUN}>"
SCHEMA = f"""
  doc_id long, blocks array<{BLOCK}>, tables array<{TABLE}>, lists array<{LIST}>, styles array<{STYLE}>, notes array<struct<place_id: int, type: string, number: int>>,
  comments array<struct<place_id: int, id: int, author: string, initials: string, date: string, parent: int, resolved: boolean>>, furniture array<struct<place_id: int, kind: string, type: string>>,
  media array<struct<hash: string, kind: string, type: string, width: int, height: int, bytes: binary>>, meta struct<title: string, author: string, language: string, created: string>,
  layout struct<width: int, height: int, top: int, right: int, bottom: int, left: int>, default_run {RUN}, default_paragraph {PARAGRAPH}, warnings array<string>, error struct<kind: string, message: string>"""


def arrow_schema():
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(SCHEMA))


def _inline(x: dict) -> dict:
    link = x.get("link") or (None, None)
    return {**{k: v for k, v in x.items() if k != "link"}, "url": link[0], "anchor": link[1]}


def to_row(doc_id: int | None, model: dict) -> dict:
    """A kernel's nested model as a row of SCHEMA."""
    blocks: list[dict] = []
    tables: list[dict] = []
    cells = 0

    def lay(content: list[dict], place: str, place_id: int) -> None:
        nonlocal cells
        for k, b in enumerate(content):
            row = {"place": place, "place_id": place_id, "ord": k, "kind": b["kind"]}
            blocks.append(row)
            if b["kind"] == "paragraph":
                row |= {"props": b["props"], "inlines": [_inline(x) for x in b["inlines"]]}
                continue
            row["table_id"] = len(tables)
            rows: list[dict] = []
            tables.append({"table_id": len(tables), "props": b["props"], "grid": b["grid"], "top": b["top"], "bottom": b["bottom"], "rows": rows})
            for r in b["rows"]:
                line: list[dict] = []
                rows.append({"header": r["header"], "height": r["height"], "cells": line})
                for c in r["cells"]:
                    number = cells
                    cells += 1
                    line.append({"cell_id": number, "props": c["props"]})
                    lay(c["blocks"], "cell", number)

    lay(model["blocks"], "body", 0)
    out = {"doc_id": doc_id, "blocks": blocks, "tables": tables, **{k: model.get(k) for k in ("lists", "styles", "meta", "layout", "default_run", "default_paragraph", "media", "warnings")}}
    for name, place in (("notes", "note"), ("comments", "comment"), ("furniture", None)):
        found = []
        for k, x in enumerate(model[name]):
            found.append({**{n: v for n, v in x.items() if n != "blocks"}, "place_id": k})
            lay(x["blocks"], place or x["kind"], k)
        out[name] = found
    return out


def whole_rows(schema) -> Callable[[dict], dict]:
    """What makes a row of to_row the one that from_row gets from a table: every field is there, null where it was not, and no others."""
    import pyarrow as pa

    def of(kind) -> Callable | None:
        if pa.types.is_struct(kind):
            return struct(kind)
        inner = of(kind.value_type) if pa.types.is_list(kind) else None
        return inner and (lambda x: [None if y is None else inner(y) for y in x])

    def struct(fields) -> Callable[[dict], dict]:
        none = dict.fromkeys(f.name for f in fields)
        nested = {f.name: made for f in fields if (made := of(f.type))}
        return lambda x: none | {k: nested[k](v) if k in nested and v is not None else v for k, v in x.items() if k in none}

    return struct(schema)


def _set(x: dict | None) -> dict:
    """What is set of a struct, its structs too."""
    return {k: _set(v) if isinstance(v, dict) else v for k, v in (x or {}).items() if v is not None}


def from_row(row: dict) -> dict:
    """The nested model of a row. A cell without a paragraph at its end gets one."""
    by_place: dict[tuple[str, int], list[dict]] = {}
    for b in row["blocks"] or []:
        by_place.setdefault((b["place"], b["place_id"]), []).append(b)
    tables = {t["table_id"]: t for t in row["tables"] or []}

    def made(place: str, place_id: int) -> list[dict]:
        out = []
        for b in sorted(by_place.get((place, place_id), []), key=lambda x: x["ord"]):
            if b["kind"] == "paragraph":
                inlines = [{**{k: v for k, v in x.items() if v is not None and k not in ("url", "anchor")}, "run": _set(x["run"]), "text": x["text"] or "", "link": (x["url"], x["anchor"]) if x["url"] or x["anchor"] else None} for x in b["inlines"] or []]
                out.append({"kind": "paragraph", "props": _set(b["props"]), "inlines": inlines})
            elif b["table_id"] in tables:
                t = tables[b["table_id"]]
                rows = [{"header": bool(r["header"]), "height": r["height"], "cells": [{"props": _set(c["props"]), "blocks": made("cell", c["cell_id"])} for c in r["cells"]]} for r in t["rows"]]
                out.append({"kind": "table", "props": _set(t["props"]), "grid": t["grid"], "rows": rows, "top": t["top"] or 0, "bottom": t["bottom"] or 0})
        if place == "cell" and (not out or out[-1]["kind"] != "paragraph"):
            out.append({"kind": "paragraph", "props": {}, "inlines": []})
        return out

    model = {k: row[k] or [] for k in ("lists", "media", "warnings")}
    model |= {"blocks": made("body", 0), "meta": row["meta"] or {}, "layout": row["layout"], "default_run": _set(row["default_run"]), "default_paragraph": _set(row["default_paragraph"]), "styles": [{**s, "props": _set(s["props"]), "run": _set(s["run"])} for s in row["styles"] or []]}
    for name, place in (("notes", "note"), ("comments", "comment"), ("furniture", None)):
        model[name] = [{**{k: v for k, v in x.items() if k != "place_id"}, "blocks": made(place or x["kind"], x["place_id"])} for x in row[name] or []]
    return model


def batches(rows: Iterator[dict], schema, most: int = 64, blocks: int = 4096):
    """Record batches of a few documents each, of a single one where it is large (`blocks` and more)."""
    import pyarrow as pa

    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("blocks") or ())
        del row
        if len(held) == most or size >= blocks:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def table(models: DataFrame, name: str) -> DataFrame:
    """One of the arrays as rows, with doc_id; structs' fields are columns. Also inlines, rows and cells, which stand inside others."""
    if name == "inlines":
        blocks = models.select("doc_id", F.explode("blocks").alias("b"))
        return blocks.select("doc_id", "b.place", "b.place_id", F.col("b.ord").alias("block"), F.posexplode("b.inlines").alias("ord", "i")).select("doc_id", "place", "place_id", "block", "ord", "i.*")
    if name in ("rows", "cells"):
        rows = models.select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.table_id", F.posexplode("t.rows").alias("r", "x"))
        if name == "rows":
            return rows.select("doc_id", "table_id", "r", "x.header", "x.height", F.size("x.cells").alias("n_cells"))
        cells = rows.select("doc_id", "table_id", "r", F.posexplode("x.cells").alias("c", "y"))
        return cells.select("doc_id", "table_id", "r", "c", "y.cell_id", "y.props.*")
    if name == "warnings":
        return models.select("doc_id", F.explode("warnings").alias("message")).distinct()
    return models.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")


# What each sign of the text is that is none itself.
_SIGNS = {"tab": "\t", "break": "\n", "bookmark": "", "comment_start": "", "comment_end": ""}


def inline_text(inlines: Column) -> Column:
    """The plain text of inlines: tabs, line feeds, and U+FFFC for what is no text."""

    def one(x: Column) -> Column:
        out = F.when(x["kind"] == "text", x["text"])
        for kind, sign in _SIGNS.items():
            out = out.when(x["kind"] == kind, F.lit(sign))
        return out.otherwise(F.lit("￼"))

    return F.array_join(F.transform(inlines, one), "")


def plain_text(row: dict) -> str:
    """inline_text of all a row's blocks, joined by line feeds."""
    sign = lambda x: (x.get("text") or "") if x["kind"] == "text" else _SIGNS.get(x["kind"], "￼")
    return "\n".join("".join(map(sign, b.get("inlines") or ())) for b in row["blocks"])


def texts(models: DataFrame) -> DataFrame:
    """(doc_id, place, place_id, ord, style, num_id, level, text) of every paragraph."""
    return table(models, "blocks").where("kind = 'paragraph'").select("doc_id", "place", "place_id", "ord", "props.style", "props.num_id", "props.level", inline_text(F.col("inlines")).alias("text"))


def filtered(models: DataFrame, off: set[str]) -> DataFrame:
    """The feature filter: tables, lists, images, links, formulas, notes, comments or furniture left out; the same DataFrame where nothing is off.

    A paragraph that loses something and keeps nothing but bookmarks goes; one that was empty before stays. Links go
    with what they hold. Without lists their paragraphs go, without tables their cells.
    """
    if not off:
        return models
    kinds = {"images": ("image",), "formulas": ("formula",), "notes": ("note",), "comments": ("comment_start", "comment_end")}
    gone = [k for name, several in kinds.items() if name in off for k in several]

    def stays(x: Column) -> Column:
        out = ~x["kind"].isin(*gone) if gone else F.lit(True)
        return out & x["url"].isNull() & x["anchor"].isNull() if "links" in off else out

    def block(b: Column) -> Column:
        return F.when(b["kind"] == "paragraph", b.withField("inlines", F.filter(b["inlines"], stays))).otherwise(b)

    def kept(b: Column) -> Column:
        left = F.filter(b["inlines"], stays)
        emptied = (F.size(left) < F.size(b["inlines"])) & F.forall(left, lambda x: x["kind"] == "bookmark")
        out = ~F.coalesce((b["kind"] == "paragraph") & emptied, F.lit(False))
        if "lists" in off:
            out &= ~F.coalesce(b["props"]["num_id"].isNotNull(), F.lit(False))
        if "tables" in off:
            out &= (b["kind"] != "table") & (b["place"] != "cell")
        for name, places in (("notes", ("note",)), ("comments", ("comment",)), ("furniture", ("header", "footer"))):
            if name in off:
                out &= ~b["place"].isin(*places)
        return out

    out = models.withColumn("blocks", F.transform(F.filter("blocks", kept), block))
    for name in ("tables", "lists", "notes", "comments", "furniture"):
        if name in off:
            out = out.withColumn(name, F.filter(name, lambda x: F.lit(False)))
    if "images" in off:
        out = out.withColumn("media", F.filter("media", lambda x: F.lit(False)))
    return out
