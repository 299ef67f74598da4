"""A model as a Word package: parts, relationships, and properties in the order of the schema."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

from vellumite.functions.formulas import omml
from vellumite.kernels.word_xml import M, PIC, W14, W15, WP, A
from vellumite.sources.docx import P, R, W, _attribute, _xml

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NAMES = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:wp="{WP}" xmlns:a="{A}" xmlns:pic="{PIC}" xmlns:m="{M}" xmlns:w14="{W14}" xmlns:w15="{W15}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14 w15"'
# Content types and relationship types of the format.
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_EXTENDED = "http://schemas.microsoft.com/office/2011/relationships/commentsExtended"
KINDS = {"styles": f"{_WORD}.styles+xml", "numbering": f"{_WORD}.numbering+xml", "settings": f"{_WORD}.settings+xml", "footnotes": f"{_WORD}.footnotes+xml", "endnotes": f"{_WORD}.endnotes+xml", "comments": f"{_WORD}.comments+xml", "commentsExtended": f"{_WORD}.commentsExtended+xml", "header": f"{_WORD}.header+xml", "footer": f"{_WORD}.footer+xml"}
EXTENSIONS = {"png": ("png", "image/png"), "jpeg": ("jpg", "image/jpeg"), "gif": ("gif", "image/gif"), "bmp": ("bmp", "image/bmp"), "tiff": ("tif", "image/tiff")}


def _flag(name: str, value: bool | None, base: bool = False) -> str:
    """A switch, where it differs from what would hold without it."""
    return "" if value is None or bool(value) == base else f"<w:{name}/>" if value else f'<w:{name} w:val="0"/>'


def _val(name: str, value) -> str:
    return "" if value is None else f'<w:{name} w:val="{_attribute(str(value))}"/>'


def _edge(name: str, edge: dict | None) -> str:
    return "" if not edge else f'<w:{name} w:val="{_attribute(edge["style"])}" w:sz="{edge["size"]}" w:space="{edge["space"]}" w:color="{_attribute(edge["color"])}"/>'


def _edges(tag: str, borders: dict | None) -> str:
    inner = "".join(_edge(s, (borders or {}).get(s)) for s in ("top", "left", "bottom", "right"))
    return f"<w:{tag}>{inner}</w:{tag}>" if inner else ""


def _shade(colour: str | None) -> str:
    return "" if colour is None else f'<w:shd w:val="clear" w:color="auto" w:fill="{_attribute(colour)}"/>'


def run_xml(run: dict, base: dict | None = None) -> str:
    """rPr of what differs from the base."""
    base = base or {}
    own = {k: v for k, v in run.items() if v is not None and v != base.get(k, {"underline": "none", "vertical": "baseline", "spacing": 0}.get(k, False if isinstance(v, bool) else None))}
    fonts = "" if "family" not in own else '<w:rFonts w:ascii="{0}" w:hAnsi="{0}" w:eastAsia="{0}" w:cs="{0}"/>'.format(_attribute(own["family"]))
    size = own.get("size")
    return "".join((
        fonts, _flag("b", own.get("bold"), base.get("bold") or False), _flag("i", own.get("italic"), base.get("italic") or False), _flag("caps", own.get("caps"), base.get("caps") or False),
        _flag("smallCaps", own.get("small_caps"), base.get("small_caps") or False), _flag("strike", own.get("strike"), base.get("strike") or False), _flag("shadow", own.get("shadow"), base.get("shadow") or False),
        _val("color", own.get("color")), _val("spacing", own.get("spacing")), "" if "kerning" not in own else _val("kern", 1 if own["kerning"] else 0), _val("sz", size), _val("szCs", size), _val("u", own.get("underline")), _shade(own.get("shading")),
        _val("vertAlign", own.get("vertical")), _flag("rtl", own.get("rtl"), base.get("rtl") or False),
    ))


def paragraph_xml(p: dict, mark: str = "", section: str = "") -> str:
    """pPr in the order of the schema."""
    gap = "".join(f' w:{n}="{p[k]}"' for k, n in (("before", "before"), ("after", "after"), ("line", "line")) if p.get(k) is not None) + (f' w:lineRule="{p["rule"]}"' if p.get("line") is not None and p.get("rule") else "")
    first = p.get("first") or 0
    indent = "".join(f' w:{n}="{p[k]}"' for k, n in (("left", "left"), ("right", "right")) if p.get(k) or (k == "left" and p.get("num_id"))) + (f' w:hanging="{-first}"' if first < 0 else f' w:firstLine="{first}"' if first or p.get("num_id") else "")
    inner = "".join((
        _val("pStyle", p.get("style")), _flag("keepNext", p.get("keep_next")), _flag("keepLines", p.get("keep_lines")), _flag("pageBreakBefore", p.get("page_break")),
        f'<w:numPr><w:ilvl w:val="{p.get("level") or 0}"/><w:numId w:val="{p["num_id"]}"/></w:numPr>' if p.get("num_id") else "", _edges("pBdr", p.get("borders")), _shade(p.get("shading")), _flag("bidi", p.get("bidi")),
        f"<w:spacing{gap}/>" if gap else "", f"<w:ind{indent}/>" if indent else "", _val("jc", p.get("align")), _val("outlineLvl", p.get("outline")), f"<w:rPr>{mark}</w:rPr>" if mark else "", section,
    ))
    return f"<w:pPr>{inner}</w:pPr>" if inner else ""


class Part:
    """A part and its relationships; equal targets share one."""

    def __init__(self, name: str):
        self.name, self.rels = name, {}

    def rel(self, kind: str, target: str, external: bool = False) -> str:
        return self.rels.setdefault((kind, target, external), f"rId{len(self.rels) + 1}")

    def rels_xml(self) -> str:
        inner = "".join(f'<Relationship Id="{i}" Type="{k if ":" in k else f"{_REL}/{k}"}" Target="{_attribute(t)}"{' TargetMode="External"' if x else ""}/>' for (k, t, x), i in self.rels.items())
        return f'{_HEAD}<Relationships xmlns="{P}">{inner}</Relationships>'


class Writer:
    """options: layout (twips), created, keep_defaults."""

    def __init__(self, model: dict, options: dict):
        self.model, self.options = model, options
        self.styles = {s["id"]: s for s in model["styles"]}
        self.default_run = model["default_run"] or {}
        self.media = {m["hash"]: m for m in model["media"]}
        self.media_names: dict[str, str] = {}
        self.parts: list[tuple[str, str | bytes]] = []
        self.drawings = 0
        self.made: dict[tuple, str] = {}
        self.known_lists = {d["num_id"] for d in model["lists"]}

    # Content.

    def blocks(self, blocks: list[dict], part: Part, lead: str = "") -> str:
        """Blocks end in a paragraph; `lead` goes to the first one."""
        out = []
        for b in blocks:
            out.append(self.table(b, part) if b["kind"] == "table" else self.paragraph(b, part, lead))
            lead = "" if b["kind"] == "paragraph" else lead
        if not blocks or blocks[-1]["kind"] == "table":
            out.append(f"<w:p>{lead}</w:p>")
        return "".join(out)

    def paragraph(self, block: dict, part: Part, lead: str = "", comment: int | None = None) -> str:
        props = dict(block["props"])
        if props.get("num_id") not in self.known_lists:
            props.pop("num_id", None)
        if props.get("style") not in self.styles:
            props.pop("style", None)
        base = self.base(block["props"])
        if props.get("style") in self.styles:
            own = self.styles[props["style"]]["props"]
            props = {k: v for k, v in props.items() if k in ("style", "num_id", "level", "left", "first") or v != own.get(k)}
        identity = "" if comment is None else f' w14:paraId="{comment:08X}"'
        mark = self.run_xml(props.get("mark") or {}, base)
        return f"<w:p{identity}>{paragraph_xml(props, mark)}{lead}{self.inlines(block['inlines'], part, base)}</w:p>"

    def base(self, props: dict) -> dict:
        """The run properties that a paragraph's style gives."""
        style = self.styles.get(props.get("style") or "Normal")
        return style["run"] if style and style["run"] else self.default_run

    def inlines(self, inlines: list[dict], part: Part, base: dict) -> str:
        out, k = [], 0
        while k < len(inlines):
            link = inlines[k].get("link")
            end = k + 1
            while link and end < len(inlines) and inlines[end].get("link") == link:
                end += 1
            inner = "".join(self.inline(x, part, base) for x in inlines[k:end])
            if link and link[1]:
                inner = f'<w:hyperlink w:anchor="{_attribute(link[1])}">{inner}</w:hyperlink>'
            elif link and link[0]:
                inner = f'<w:hyperlink r:id="{part.rel("hyperlink", link[0], True)}">{inner}</w:hyperlink>'
            out.append(inner)
            k = end
        return "".join(out)

    def run_xml(self, run: dict, base: dict) -> str:
        """run_xml, once for equal runs over one base: a style's or the model's, which stay."""
        key = (id(base), *run.items())
        if key not in self.made:
            self.made[key] = run_xml(run, base)
        return self.made[key]

    def run(self, x: dict, base: dict, content: str) -> str:
        props = self.run_xml(x.get("run") or {}, base)
        return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{content}</w:r>"

    def inline(self, x: dict, part: Part, base: dict) -> str:
        kind = x["kind"]
        if kind == "text":
            pieces = re.split(r"([\t\n])", x["text"])
            return self.run(x, base, "".join("<w:tab/>" if t == "\t" else "<w:br/>" if t == "\n" else f'<w:t xml:space="preserve">{_xml(t)}</w:t>' for t in pieces if t))
        if kind == "tab":
            return self.run(x, base, "<w:tab/>")
        if kind == "break":
            return self.run(x, base, '<w:br w:type="page"/>' if x["text"] == "page" else "<w:br/>")
        if kind == "bookmark":
            return f'<w:bookmarkStart w:id="{x["ref"]}" w:name="{_attribute(x["text"])}"/><w:bookmarkEnd w:id="{x["ref"]}"/>'
        if kind == "comment_start":
            return f'<w:commentRangeStart w:id="{x["ref"]}"/>'
        if kind == "comment_end":
            return f'<w:commentRangeEnd w:id="{x["ref"]}"/><w:r><w:commentReference w:id="{x["ref"]}"/></w:r>'
        if kind == "note":
            return self.run({**x, "run": {**(x.get("run") or {}), "vertical": "superscript"}}, base, f'<w:{x["text"]}Reference w:id="{x["ref"]}"/>')
        if kind == "field":
            return f'<w:fldSimple w:instr=" {x["field"]} ">{self.run(x, base, f"<w:t>{_xml(x["text"])}</w:t>")}</w:fldSimple>'
        if kind == "formula":
            math = omml(x["text"])
            return f"<m:oMathPara>{math}</m:oMathPara>" if x.get("display") else math
        return self.run(x, base, self.picture(x, part)) if kind == "image" and x["media"] in self.media else ""

    def picture(self, x: dict, part: Part) -> str:
        image = self.media[x["media"]]
        if x["media"] not in self.media_names:
            self.media_names[x["media"]] = f"media/image{len(self.media_names) + 1}.{EXTENSIONS[image['kind']][0]}"
        target = part.rel("image", self.media_names[x["media"]])
        self.drawings += 1
        words = _attribute(x["text"])
        graphic = (
            f'<a:graphic><a:graphicData uri="{PIC}"><pic:pic><pic:nvPicPr><pic:cNvPr id="{self.drawings}" name="Picture {self.drawings}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{target}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
            f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{x["width"]}" cy="{x["height"]}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>'
        )
        extent = f'<wp:extent cx="{x["width"]}" cy="{x["height"]}"/>'
        about = f'<wp:docPr id="{self.drawings}" name="Picture {self.drawings}" descr="{words}"/>'
        if not x.get("side"):
            return f'<w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0">{extent}{about}{graphic}</wp:inline></w:drawing>'
        return (
            '<w:drawing><wp:anchor distT="0" distB="0" distL="114300" distR="114300" simplePos="0" relativeHeight="1" behindDoc="0" locked="0" layoutInCell="1" allowOverlap="1"><wp:simplePos x="0" y="0"/>'
            f'<wp:positionH relativeFrom="column"><wp:align>{x["side"]}</wp:align></wp:positionH><wp:positionV relativeFrom="paragraph"><wp:posOffset>0</wp:posOffset></wp:positionV>{extent}<wp:wrapSquare wrapText="bothSides"/>{about}{graphic}</wp:anchor></w:drawing>'
        )

    def table(self, block: dict, part: Part) -> str:
        p, rows = block["props"], []
        for row in block["rows"]:
            head = (f'<w:trHeight w:val="{row["height"]}" w:hRule="atLeast"/>' if row.get("height") else "") + ("<w:tblHeader/>" if row["header"] else "")
            cells = []
            for cell in row["cells"]:
                c = cell["props"]
                margins = "".join(f'<w:{s} w:w="{c["margins"][s]}" w:type="dxa"/>' for s in ("top", "left", "bottom", "right") if s in (c.get("margins") or {}))
                merge = {"restart": '<w:vMerge w:val="restart"/>', "continue": "<w:vMerge/>"}.get(c.get("merge") or "", "")
                span = f'<w:gridSpan w:val="{c["span"]}"/>' if (c.get("span") or 1) > 1 else ""
                props = f'<w:tcW w:w="{c.get("width") or 0}" w:type="dxa"/>{span}{merge}{_edges("tcBorders", c.get("borders"))}{_shade(c.get("shading"))}{_flag("noWrap", c.get("no_wrap"))}{f"<w:tcMar>{margins}</w:tcMar>" if margins else ""}{_val("vAlign", c.get("valign"))}'
                cells.append(f"<w:tc><w:tcPr>{props}</w:tcPr>{self.blocks(cell['blocks'], part)}</w:tc>")
            rows.append(f"<w:tr>{f'<w:trPr>{head}</w:trPr>' if head else ''}{''.join(cells)}</w:tr>")
        indent = f'<w:tblInd w:w="{p["indent"]}" w:type="dxa"/>' if p.get("indent") else ""
        props = f'{_flag("bidiVisual", p.get("bidi"))}<w:tblW w:w="{p.get("width") or sum(block["grid"])}" w:type="dxa"/>{_val("jc", p.get("align"))}{indent}{_edges("tblBorders", p.get("borders"))}{_shade(p.get("shading"))}<w:tblLayout w:type="fixed"/><w:tblLook w:val="0000"/>'
        grid = "".join(f'<w:gridCol w:w="{w}"/>' for w in block["grid"])
        return f"<w:tbl><w:tblPr>{props}</w:tblPr><w:tblGrid>{grid}</w:tblGrid>{''.join(rows)}</w:tbl>"

    # Parts.

    def styles_xml(self) -> str:
        default = run_xml(self.default_run)
        base = self.model.get("default_paragraph") or {}
        made = []
        for s in self.model["styles"] or [{"id": "Normal", "name": "Normal", "based_on": None, "default": True, "props": {k: v for k, v in base.items() if k != "style"}, "run": {}}]:
            under = (self.styles.get(s["based_on"]) or {}).get("run") if s.get("based_on") else self.default_run
            run = run_xml(s["run"] or {}, under or self.default_run)
            made.append(f'<w:style w:type="paragraph"{' w:default="1"' if s["default"] else ""} w:styleId="{_attribute(s["id"])}">{_val("name", s["name"])}{_val("basedOn", s.get("based_on"))}{paragraph_xml({k: v for k, v in s["props"].items() if k != "style"})}{f"<w:rPr>{run}</w:rPr>" if run else ""}</w:style>')
        return f"{_HEAD}<w:styles {_NAMES}><w:docDefaults><w:rPrDefault><w:rPr>{default}</w:rPr></w:rPrDefault><w:pPrDefault/></w:docDefaults>{''.join(made)}</w:styles>"

    def numbering_xml(self) -> str:
        abstract, nums = [], []
        for d in self.model["lists"]:
            levels = "".join(
                f'<w:lvl w:ilvl="{x["level"]}"><w:start w:val="{x["start"]}"/><w:numFmt w:val="{_attribute(x["format"])}"/>{_val("suff", x["suffix"] if x["suffix"] != "tab" else None)}<w:lvlText w:val="{_attribute(x["text"])}"/><w:lvlJc w:val="{x.get("align") or "left"}"/><w:pPr><w:ind w:left="{x["indent"]}" w:hanging="{x["hanging"]}"/></w:pPr></w:lvl>'
                for x in d["levels"]
            )
            abstract.append(f'<w:abstractNum w:abstractNumId="{d["num_id"]}"><w:multiLevelType w:val="multilevel"/>{levels}</w:abstractNum>')
            nums.append(f'<w:num w:numId="{d["num_id"]}"><w:abstractNumId w:val="{d["num_id"]}"/></w:num>')
        return f"{_HEAD}<w:numbering {_NAMES}>{''.join(abstract)}{''.join(nums)}</w:numbering>"

    def notes_xml(self, kind: str, part: Part) -> str:
        marks = "".join(f'<w:{kind} w:type="{t}" w:id="{i}"><w:p><w:r><w:{e}/></w:r></w:p></w:{kind}>' for t, i, e in (("separator", -1, "separator"), ("continuationSeparator", 0, "continuationSeparator")))
        lead = f'<w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:{kind}Ref/></w:r><w:r><w:t xml:space="preserve"> </w:t></w:r>'
        notes = "".join(f'<w:{kind} w:id="{n["number"]}">{self.blocks(n["blocks"], part, lead)}</w:{kind}>' for n in self.model["notes"] if n["type"] == kind)
        return f"{_HEAD}<w:{kind}s {_NAMES}>{marks}{notes}</w:{kind}s>"

    def comments_xml(self, part: Part) -> tuple[str, str]:
        """(comments, what threads them): a comment is known by its last paragraph."""
        made, extended = [], []
        for c in self.model["comments"]:
            blocks = c["blocks"] if c["blocks"] and c["blocks"][-1]["kind"] == "paragraph" else [*c["blocks"], {"kind": "paragraph", "props": {}, "inlines": []}]
            body = "".join(self.table(b, part) if b["kind"] == "table" else self.paragraph(b, part) for b in blocks[:-1]) + self.paragraph(blocks[-1], part, comment=c["id"])
            about = "".join(f' w:{n}="{_attribute(c[k])}"' for k, n in (("author", "author"), ("date", "date"), ("initials", "initials")) if c.get(k))
            made.append(f'<w:comment w:id="{c["id"]}"{about if c.get("author") else f' w:author=""{about}'}>{body}</w:comment>')
            extended.append(f'<w15:commentEx w15:paraId="{c["id"]:08X}"{f' w15:paraIdParent="{c["parent"]:08X}"' if c.get("parent") else ""} w15:done="{int(bool(c["resolved"]))}"/>')
        return f"{_HEAD}<w:comments {_NAMES}>{''.join(made)}</w:comments>", f"{_HEAD}<w15:commentsEx {_NAMES}>{''.join(extended)}</w15:commentsEx>"

    def write(self) -> bytes:
        main = Part("word/document.xml")
        own: list[tuple[Part, str, str]] = []  # part, kind, content

        def add(name: str, kind: str, make) -> str:
            part = Part(f"word/{name}")
            own.append((part, kind, make(part)))
            return main.rel(_EXTENDED if kind == "commentsExtended" else kind, name)

        add("styles.xml", "styles", lambda _: self.styles_xml())
        if self.model["lists"]:
            add("numbering.xml", "numbering", lambda _: self.numbering_xml())
        body = self.blocks(self.model["blocks"], main)
        for kind in ("footnote", "endnote"):
            if any(n["type"] == kind for n in self.model["notes"]):
                add(f"{kind}s.xml", f"{kind}s", lambda part, kind=kind: self.notes_xml(kind, part))
        if self.model["comments"]:
            extended = []

            def comments(part: Part) -> str:
                made, threads = self.comments_xml(part)
                extended.append(threads)
                return made

            add("comments.xml", "comments", comments)
            add("commentsExtended.xml", "commentsExtended", lambda _: extended[0])
        references, types = [], {f["type"] for f in self.model["furniture"]}
        for k, f in enumerate(self.model["furniture"]):
            tag = "hdr" if f["kind"] == "header" else "ftr"
            rid = add(f"{f['kind']}{k + 1}.xml", f["kind"], lambda part, f=f, tag=tag: f"{_HEAD}<w:{tag} {_NAMES}>{self.blocks(f['blocks'], part)}</w:{tag}>")
            references.append(f'<w:{f["kind"]}Reference w:type="{f["type"]}" r:id="{rid}"/>')
        add("settings.xml", "settings", lambda _: f"{_HEAD}<w:settings {_NAMES}>{'<w:evenAndOddHeaders/>' if 'even' in types else ''}</w:settings>")
        page = self.model.get("layout") or self.options["layout"]
        wide = ' w:orient="landscape"' if page["width"] > page["height"] else ""
        section = f'<w:sectPr>{"".join(references)}<w:pgSz w:w="{page["width"]}" w:h="{page["height"]}"{wide}/><w:pgMar w:top="{page["top"]}" w:right="{page["right"]}" w:bottom="{page["bottom"]}" w:left="{page["left"]}" w:header="708" w:footer="708" w:gutter="0"/>{"<w:titlePg/>" if "first" in types else ""}</w:sectPr>'
        parts: list[tuple[str, str | bytes]] = []
        overrides = [("word/document.xml", f"{_WORD}.document.main+xml"), *((p.name, KINDS[k]) for p, k, _ in own), ("docProps/core.xml", "application/vnd.openxmlformats-package.core-properties+xml")]
        kinds = {EXTENSIONS[self.media[h]["kind"]] for h in self.media_names}
        defaults = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in sorted({("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), *kinds}))
        parts.append(("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{defaults}{"".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, t in overrides)}</Types>'))
        top = Part("")
        top.rel("officeDocument", "word/document.xml")
        top.rel("http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties", "docProps/core.xml")
        parts += [("_rels/.rels", top.rels_xml()), ("word/document.xml", f"{_HEAD}<w:document {_NAMES}><w:body>{body}{section}</w:body></w:document>"), ("word/_rels/document.xml.rels", main.rels_xml())]
        for part, _, content in own:
            parts.append((part.name, content))
            if part.rels:
                parts.append((part.name.replace("word/", "word/_rels/") + ".rels", part.rels_xml()))
        parts += [(f"word/{name}", self.media[h]["bytes"]) for h, name in self.media_names.items()]
        meta = self.model["meta"]
        created = meta.get("created") or self.options["created"]
        core = "".join(f"<dc:{n}>{_xml(meta[k])}</dc:{n}>" for k, n in (("title", "title"), ("author", "creator"), ("language", "language")) if meta.get(k))
        parts.append(("docProps/core.xml", f'{_HEAD}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">{core}<dcterms:created xsi:type="dcterms:W3CDTF">{created}</dcterms:created></cp:coreProperties>'))
        return zipped(parts, created)


def zipped(parts: list[tuple[str, str | bytes]], created: str) -> bytes:
    """An archive whose bytes follow from its parts and the date; deflated where that is smaller."""
    year, month, day, hour, minute, second = (int(x) for x in re.match(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)", created).groups())
    when = (year, month, day, hour, minute, second) if 1980 <= year <= 2107 else (1980, 1, 1, 0, 0, 0) if year < 1980 else (2107, 12, 31, 23, 59, 58)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts:
            data = content.encode() if isinstance(content, str) else content
            info = zipfile.ZipInfo(name, date_time=when)
            packed = zlib.compressobj(6, zlib.DEFLATED, -15)
            info.compress_type = zipfile.ZIP_DEFLATED if len(packed.compress(data) + packed.flush()) < len(data) else zipfile.ZIP_STORED
            z.writestr(info, data, compresslevel=6)
    return out.getvalue()
