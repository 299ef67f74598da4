"""Word packages: reading parts and paragraphs out of bytes, and writing bytes.

ZIP and XML work runs in kernels, a package at a time, under limits; a package that cannot be read gives a
row with an error, never a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Namespaces of the format (transitional; strict ones are mapped to them).
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"
STRICT = {"http://purl.oclc.org/ooxml/wordprocessingml/main": W, "http://purl.oclc.org/ooxml/officeDocument/relationships": R}
MOST_ENTRY, MOST_TOTAL, MOST_ENTRIES = 128 << 20, 512 << 20, 10_000

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


class PackageError(ValueError):
    """kind: malformed or too large."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def read_entries(data: bytes, most_entry: int = MOST_ENTRY, most_total: int = MOST_TOTAL, most_entries: int = MOST_ENTRIES) -> dict[str, bytes]:
    """Parts by lower-case name; refuses what is encrypted, broken or beyond the limits."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > most_entries:
                raise PackageError("too_large", f"{len(infos)} entries")
            out, total = {}, 0
            for i in infos:
                if i.flag_bits & 1:
                    raise PackageError("malformed", "encrypted entry")
                parts, size = [], 0
                with z.open(i) as f:
                    while piece := f.read(1 << 16):
                        size += len(piece)
                        total += len(piece)
                        if size > most_entry or total > most_total:
                            raise PackageError("too_large", i.filename)
                        parts.append(piece)
                out.setdefault(i.filename.lower().lstrip("/"), b"".join(parts))
            return out
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError) as e:
        raise PackageError("malformed", str(e)) from e


def parse_xml(data: bytes) -> ElementTree.Element:
    """Refuses document types and NUL; strict namespaces are read as transitional ones."""
    text = data.decode("utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data.decode("utf-8-sig")
    if "\0" in text or "<!DOCTYPE" in text:
        raise PackageError("malformed", "document type or NUL in a part")
    for strict, plain in STRICT.items():
        text = text.replace(strict, plain)
    try:
        return ElementTree.fromstring(re.sub(r"\A\s*<\?xml[^>]*\?>", "", text))
    except ElementTree.ParseError as e:
        raise PackageError("malformed", str(e)) from e


def resolve(folder: str, target: str) -> str | None:
    """A relationship's target as a part name; null where it leaves the package."""
    target = unquote(re.split(r"[#?]", target.replace("\\", "/"))[0])
    out = [] if target.startswith("/") else [x for x in folder.split("/") if x]
    for step in target.split("/"):
        if step == "..":
            if not out:
                return None
            out.pop()
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out) or None


def relationships(parts: dict[str, bytes], part: str) -> list[dict]:
    folder, _, name = part.rpartition("/")
    data = parts.get(f"{folder}/_rels/{name}.rels".lstrip("/").lower())
    if data is None:
        return []
    out = []
    for e in parse_xml(data).iter(f"{{{P}}}Relationship"):
        external = e.get("TargetMode") == "External"
        out.append({"id": e.get("Id"), "type": e.get("Type"), "target": e.get("Target") if external else resolve(folder, e.get("Target", "")), "external": external})
    return out


def _on(e: ElementTree.Element | None) -> bool | None:
    return None if e is None else e.get(f"{{{W}}}val", "true").lower() not in ("0", "false", "off", "none")


def _whole(value: str | None) -> int | None:
    """An attribute's number, null where it is none or beyond 32 bits."""
    n = int(value) if value is not None and re.fullmatch(r"\s*[+-]?[0-9]{1,10}\s*", value) else None
    return n if n is not None and -(1 << 31) <= n < 1 << 31 else None


def _paragraph(p: ElementTree.Element, links: dict[str, str]) -> dict:
    w = f"{{{W}}}"
    style, level, num = p.find(f"{w}pPr/{w}pStyle"), p.find(f"{w}pPr/{w}numPr/{w}ilvl"), p.find(f"{w}pPr/{w}numPr/{w}numId")
    runs: list[dict] = []

    def walk(e: ElementTree.Element, href: str | None) -> None:
        for c in e:
            tag = c.tag.removeprefix(w)
            if tag == "r":
                pr = c.find(f"{w}rPr")
                get = lambda n: _on(pr.find(w + n)) if pr is not None else None  # noqa: B023, E731
                if get("vanish"):
                    continue
                text = "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "­"}.get(x.tag.removeprefix(w), "") for x in c)
                if text:
                    runs.append({"text": text, "bold": bool(get("b")), "italic": bool(get("i")), "underline": bool(get("u")), "strike": bool(get("strike")), "href": href})
            elif tag == "hyperlink":
                walk(c, links.get(c.get(f"{{{R}}}id", ""), href))
            elif tag in ("ins", "moveTo", "smartTag", "sdt", "sdtContent", "customXml", "fldSimple"):
                walk(c, href)

    walk(p, None)
    val = lambda e: e.get(f"{w}val") if e is not None else None
    return {"style": val(style), "num_id": _whole(val(num)), "level": _whole(val(level)), "runs": runs}


def read_docx(data: bytes) -> tuple[list[dict], dict]:
    """(paragraphs in reading order, through tables and content controls; metadata). Rows of a nested table are its own."""
    from vellumite.kernels.word_tables import inner

    parts = read_entries(data)
    main = next((r["target"] for r in relationships(parts, "") if (r["type"] or "").endswith("/officeDocument")), "word/document.xml")
    if (main or "").lower() not in parts:
        raise PackageError("malformed", "no main part")
    links = {r["id"]: r["target"] for r in relationships(parts, main) if r["external"]}
    body = parse_xml(parts[main.lower()]).find(f"{{{W}}}body")
    out: list[dict] = []

    def walk(e: ElementTree.Element, cell: tuple | None) -> None:
        tables = 0
        for c in e:
            tag = c.tag.removeprefix(f"{{{W}}}")
            if tag == "p":
                out.append(_paragraph(c, links) | {"cell": cell})
            elif tag == "tbl":
                tables += 1
                for r, row in enumerate(inner(c, "tr")):
                    for k, one in enumerate(inner(row, "tc")):
                        walk(one, (tables, r, k))
            elif tag not in ("del", "moveFrom", "sectPr", "tcPr"):
                walk(c, cell)

    walk(body if body is not None else ElementTree.Element("none"), None)
    meta = {"title": None, "author": None, "created": None}
    if "docprops/core.xml" in parts:
        for e in parse_xml(parts["docprops/core.xml"]):
            key = {"title": "title", "creator": "author", "created": "created"}.get(e.tag.rpartition("}")[2])
            if key:
                meta[key] = (e.text or "").strip() or None
    return out, meta


def _xml(text: str) -> str:
    return _ILLEGAL.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attribute(text: str) -> str:
    return _xml(text).replace('"', "&quot;")


def _run(run: dict) -> str:
    flags = "".join(f"<w:{tag}{value}/>" for key, tag, value in (("bold", "b", ""), ("italic", "i", ""), ("strike", "strike", ""), ("underline", "u", ' w:val="single"')) if run.get(key))
    pieces = re.split(r"([\t\n])", run["text"])
    body = "".join("<w:tab/>" if x == "\t" else "<w:br/>" if x == "\n" else f'<w:t xml:space="preserve">{_xml(x)}</w:t>' for x in pieces if x)
    return f"<w:r>{f'<w:rPr>{flags}</w:rPr>' if flags else ''}{body}</w:r>"


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def write_docx(paragraphs: list[dict], title: str | None = None, created: str = "1980-01-01T00:00:00Z") -> bytes:
    """A package of paragraphs ({style, num_id, level, runs}) and tables ({rows: [[text]]}); equal input gives equal bytes."""
    links: dict[str, str] = {}
    lists = sorted({p["num_id"] for p in paragraphs if p.get("num_id")})

    def paragraph(p: dict) -> str:
        props = (f'<w:pStyle w:val="{_attribute(p["style"])}"/>' if p.get("style") else "") + (f'<w:numPr><w:ilvl w:val="{p.get("level") or 0}"/><w:numId w:val="{p["num_id"]}"/></w:numPr>' if p.get("num_id") else "")
        runs = []
        for r in p.get("runs", []):
            if r.get("href"):
                rid = links.setdefault(r["href"], f"rIdL{len(links) + 1}")
                runs.append(f'<w:hyperlink r:id="{rid}">{_run(r)}</w:hyperlink>')
            else:
                runs.append(_run(r))
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(runs)}</w:p>"

    def table(t: dict) -> str:
        width = max((len(r) for r in t["rows"]), default=1)
        grid = "".join(f'<w:gridCol w:w="{9000 // max(width, 1)}"/>' for _ in range(width))
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph({'runs': [{'text': str(c)}] if c not in (None, '') else []})}</w:tc>" for c in [*r, *[""] * (width - len(r))]) + "</w:tr>" for r in t["rows"])
        return f"<w:tbl><w:tblPr/><w:tblGrid>{grid}</w:tblGrid>{rows}</w:tbl>"

    body = "".join(table(p) if "rows" in p else paragraph(p) for p in paragraphs)
    if not paragraphs or "rows" in paragraphs[-1]:
        body += "<w:p/>"
    document = f'{_HEAD}<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{body}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>'
    headings = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr><w:rPr><w:b/></w:rPr></w:style>' for i in range(1, 7))
    styles = f'{_HEAD}<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>{headings}</w:styles>'
    main = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = [("styles", "styles.xml", "styles"), *([("numbering", "numbering.xml", "numbering")] if lists else [])]
    rels = "".join(f'<Relationship Id="rId{i + 1}" Type="{main}/{kind}" Target="{target}"/>' for i, (kind, target, _) in enumerate(kinds))
    rels += "".join(f'<Relationship Id="{rid}" Type="{main}/hyperlink" Target="{_attribute(url)}" TargetMode="External"/>' for url, rid in links.items())
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    types = "".join(f'<Override PartName="/word/{target}" ContentType="{word}.{name}+xml"/>' for _, target, name in kinds)
    parts = [
        ("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{word}.document.main+xml"/>{types}<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>'),
        ("_rels/.rels", f'{_HEAD}<Relationships xmlns="{P}"><Relationship Id="rId1" Type="{main}/officeDocument" Target="word/document.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>'),
        ("word/document.xml", document),
        ("word/_rels/document.xml.rels", f'{_HEAD}<Relationships xmlns="{P}">{rels}</Relationships>'),
        ("word/styles.xml", styles),
    ]
    if lists:
        levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%{i + 1}."/></w:lvl>' for i in range(9))
        nums = "".join(f'<w:abstractNum w:abstractNumId="{n}">{levels}</w:abstractNum>' for n in lists) + "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n in lists)
        parts.append(("word/numbering.xml", f'{_HEAD}<w:numbering xmlns:w="{W}">{nums}</w:numbering>'))
    parts.append(("docProps/core.xml", f'{_HEAD}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><dc:title>{_xml(title or "")}</dc:title><dcterms:created xsi:type="dcterms:W3CDTF">{created}</dcterms:created></cp:coreProperties>'))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts:
            data = text.encode()
            info = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
            packed = zlib.compressobj(6, zlib.DEFLATED, -15)
            info.compress_type = zipfile.ZIP_DEFLATED if len(packed.compress(data) + packed.flush()) < len(data) else zipfile.ZIP_STORED
            z.writestr(info, data, compresslevel=6)
    return out.getvalue()


#: What a package can do to a reader; it is that package's row, not the job's end.
FAILURES = (ValueError, LookupError, TypeError, AttributeError, RecursionError, OSError)


def told(e: BaseException) -> str:
    kind = "too_deep" if isinstance(e, RecursionError) else getattr(e, "kind", "malformed")
    return f"{kind}: {e}"


PARAGRAPH_SCHEMA = "doc_id long, ord int, style string, num_id int, level int, text string, error string"


def docx_paragraphs(packages: DataFrame, doc_id: str = "doc_id", data: str = "docx") -> DataFrame:
    """One row per paragraph of each package; a package that cannot be read gives one row with `error` (kind: message)."""

    def run(batches):
        for b in batches:
            rows = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    found, _ = read_docx(value.as_py() or b"")
                    rows += [{"doc_id": key, "ord": i + 1, "style": p["style"], "num_id": p["num_id"], "level": p["level"], "text": "".join(r["text"] for r in p["runs"]), "error": None} for i, p in enumerate(found)]
                except FAILURES as e:
                    rows.append({"doc_id": key, "ord": 0, "style": None, "num_id": None, "level": None, "text": None, "error": told(e)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("ord", pa.int32()), ("style", pa.string()), ("num_id", pa.int32()), ("level", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    return packages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(data).alias("docx")).mapInArrow(run, PARAGRAPH_SCHEMA)


def package_parts(packages: DataFrame, doc_id: str = "doc_id", data: str = "docx") -> DataFrame:
    """One row per part: doc_id, part, bytes, crc32, error."""

    def run(batches):
        for b in batches:
            rows = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rows += [{"doc_id": key, "part": n, "bytes": len(d), "crc32": zlib.crc32(d), "error": None} for n, d in read_entries(value.as_py() or b"").items()]
                except FAILURES as e:
                    rows.append({"doc_id": key, "part": None, "bytes": None, "crc32": None, "error": told(e)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("error", pa.string())]))

    return packages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(data).alias("docx")).mapInArrow(run, "doc_id long, part string, bytes long, crc32 long, error string")


def to_docx(blocks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, docx) from rows (doc_id, blocks array<struct<style, text>>): one package a document."""

    def run(batches):
        for b in batches:
            made = [write_docx([{"style": x["style"], "runs": [{"text": x["text"]}] if x["text"] else []} for x in (row.as_py() or [])]) for row in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc_id", "docx"])

    return blocks.select(F.col(doc_id).cast("long").alias("doc_id"), "blocks").mapInArrow(run, "doc_id long, docx binary")


def read_docx_files(spark, path: str) -> DataFrame:
    """(doc_id, docx, path) of a folder of packages; ids are a hash of the path."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), F.col("content").alias("docx"), "path")
