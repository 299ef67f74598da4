"""A Word package as a model, with all formatting resolved: styles, numbering, theme, fields, notes, comments, furniture."""

from __future__ import annotations

import re
from xml.etree.ElementTree import Element

from vellumite.kernels import images, word_tables
from vellumite.kernels.build import timestamp
from vellumite.kernels.comments import balance
from vellumite.kernels.units import EMU_PER_PIXEL, measure, points, rounded, whole
from vellumite.kernels.symbols import symbol
from vellumite.kernels.word_lists import Numbering
from vellumite.kernels.word_xml import A, DC, DCTERMS, M, MC, O, PIC, V, W14, W15, WP, WPG, WPS, Formats, Styles, Theme, attr, below, child, flag, layered, local, on, over, q, run_properties, val
from vellumite.sources.docx import PackageError, R, W, parse_xml, read_entries, relationships

LETTER = {"width": 12240, "height": 15840, "top": 1440, "right": 1440, "bottom": 1440, "left": 1440}
# Containers that are looked through, and content that a revision has taken away.
THROUGH, GONE = {"customXml", "ins", "moveTo", "smartTag"}, {"del", "moveFrom"}
CHECKED, UNCHECKED = "☒", "☐"


def field_target(instruction: str) -> tuple[str | None, str | None]:
    """(url, anchor) of HYPERLINK and of the REF family with \\h."""
    tokens = [(m[1] is not None, re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2]) for m in re.finditer(r'"((?:[^"\\]|\\.)*)"|(\S+)', instruction)]
    name, rest = (tokens[0][1].upper() if tokens else ""), tokens[1:]
    url = anchor = None
    if name == "HYPERLINK":
        words = iter(rest)
        for quoted, text in words:
            switch = text[1:2].lower() if text.startswith("\\") and not quoted else None
            if switch is None:
                url = url or text
            elif switch == "l":
                anchor = next(words, (False, None))[1]
            elif switch in ("o", "t", "m"):
                next(words, None)
    elif name in ("REF", "PAGEREF", "NOTEREF") and rest and any(t.lower() == "\\h" for _, t in rest[1:]):
        anchor = rest[0][1]
    url, anchor = url or None, anchor or None
    return (f"{url.partition('#')[0]}#{anchor}", None) if url and anchor else (url, anchor)


def page_field(instruction: str) -> str | None:
    m = re.match(r"\s*(PAGE|NUMPAGES)\b", instruction, re.I)
    return m[1].upper() if m else None


class Package:
    """Parts of a package and their relationships; what cannot be read gives a warning and no part."""

    def __init__(self, data: bytes, limits: dict):
        self.parts = read_entries(data, **limits)
        self.warnings: list[str] = []
        self._rels: dict[str, list[dict]] = {}
        self.main = next((r["target"] for r in self.rels("") if (r["type"] or "").endswith("/officeDocument") and r["target"]), "word/document.xml")
        if self.main.lower() not in self.parts:
            raise PackageError("malformed", "no main part")
        types = parse_xml(self.parts["[content_types].xml"]) if "[content_types].xml" in self.parts else ()
        self.types = {(e.get("PartName") or "." + (e.get("Extension") or "")).lower().lstrip("/"): e.get("ContentType") for e in types}

    def warn(self, message: str) -> None:
        if message not in self.warnings:
            self.warnings.append(message)

    def rels(self, part: str) -> list[dict]:
        if part not in self._rels:
            self._rels[part] = relationships(self.parts, part)
        return self._rels[part]

    def rel(self, part: str, rel_id: str | None) -> dict | None:
        return next((r for r in self.rels(part) if rel_id and r["id"] == rel_id), None)

    def has(self, name: str | None) -> bool:
        return name is not None and name.lower() in self.parts

    def content_type(self, name: str) -> str:
        return self.types.get(name.lower()) or self.types.get("." + name.lower().rpartition(".")[2]) or "application/octet-stream"

    def related(self, kind: str, source: str | None = None) -> tuple[str | None, Element | None]:
        """The first part of a kind that a part names, parsed."""
        r = next((r for r in self.rels(self.main if source is None else source) if (r["type"] or "").endswith("/" + kind)), None)
        if r is None or r["external"] or not self.has(r["target"]):
            return None, None
        try:
            return r["target"], parse_xml(self.parts[r["target"].lower()])
        except (PackageError, UnicodeDecodeError) as e:
            self.warn(f"{r['target']} was ignored: {e}")
            return None, None


class Context:
    """What the readers of all parts share."""

    def __init__(self, package: Package, body: Element, options: dict):
        self.package, self.options = package, options
        self.formats = Formats(Theme(package.related("theme")[1]))
        self.styles = Styles(self.formats, package.related("styles")[1])
        self.numbering = Numbering(self.formats, self.styles, package.related("numbering")[1])
        self.layout = page_layout(child(body, "sectPr"))
        self.width = self.layout["width"] - self.layout["left"] - self.layout["right"]
        self.media: dict[str, dict] = {}
        self.notes: list[dict] = []
        self.bookmarks = 0
        self.note_parts = {kind: package.related(f"{kind}s") for kind in ("footnote", "endnote")}
        # Separators have a type; a note of none is a note.
        self.note_elements = {k: {attr(e, "id"): e for e in (root if root is not None else ()) if local(e) == k and (attr(e, "type") or "normal") == "normal"} for k, (_, root) in self.note_parts.items()}
        self.sources = [body, *(root for _, root in self.note_parts.values() if root is not None)]
        self.linked = linked_bookmarks(self.sources)
        self._find_comments()

    def _find_comments(self) -> None:
        """Comments in the order of their first mark, those without one last, numbered from 1."""
        self.comment_part, root = self.package.related("comments") if self.options["comments"] else (None, None)
        place: dict[str, int] = {}
        self.ranged: set[str] = set()
        for source in self.sources:
            for e in source.iter():
                if e.tag in (q("commentRangeStart"), q("commentReference")):
                    place.setdefault(attr(e, "id") or "", len(place))
                    if e.tag == q("commentRangeStart"):
                        self.ranged.add(attr(e, "id") or "")
        found = {attr(e, "id") or "": e for e in (root if root is not None else ()) if local(e) == "comment"}
        order = sorted(found, key=lambda k: place.get(k, len(place)))  # a stable sort keeps the rest in their order
        self.comment_elements = {k: found[k] for k in order}
        self.comment_ids = {k: i + 1 for i, k in enumerate(order)}


def linked_bookmarks(sources: list[Element]) -> set[str]:
    """Bookmarks that hyperlinks, REF fields or \\l switches lead to."""
    names: set[str] = set()
    for source in sources:
        names |= {a for e in below(source, "hyperlink") if (a := attr(e, "anchor"))}
        texts = ["".join(t.text or "" for t in below(p, "instrText")) for p in below(source, "p")] + [attr(e, "instr") or "" for e in below(source, "fldSimple")]
        for text in texts:
            names |= {m[1] or m[2] for m in re.finditer(r'\\l\s+"([^"]+)"|\b(?:REF|PAGEREF|NOTEREF)\s+(\S+)', text, re.I)}
    return names


def page_layout(section: Element | None) -> dict[str, int]:
    """Size and margins of the last section in twips; Letter where they leave no room."""
    size, margin = child(section, "pgSz"), child(section, "pgMar")
    own = {k: measure(attr(e, n)) for e, n, k in ((size, "w", "width"), (size, "h", "height"), *((margin, s, s) for s in ("top", "right", "bottom", "left")))}
    out = {k: LETTER[k] if v is None else abs(v) for k, v in own.items()}
    if out["width"] <= out["left"] + out["right"] + 360 or out["height"] <= 720:
        return dict(LETTER)
    return out | {s: max(0, min(out["height"] - 360, out[s])) for s in ("top", "bottom")}


def merged_inlines(inlines: list[dict]) -> list[dict]:
    """Neighbouring texts with equal properties and link become one."""
    out: list[dict] = []
    for x in inlines:
        last = out[-1] if out else None
        if last and x["kind"] == last["kind"] == "text" and x["run"] == last["run"] and x.get("link") == last.get("link"):
            out[-1] = {**last, "text": last["text"] + x["text"]}
        else:
            out.append(x)
    return out


class Reader:
    """Blocks of one part; fields, marks and lifted text boxes are its state."""

    def __init__(self, context: Context, part: str):
        self.c, self.part = context, part
        self.fields: list[dict] = []
        self.marks: list[dict] = []
        self.lifted: list[dict] = []
        self.page_break = False

    # Blocks.

    @staticmethod
    def _alternative(e: Element) -> Element | None:
        fallback = child(e, "Fallback", ns=MC)
        return child(e, "Choice", ns=MC) if fallback is None else fallback

    def _flat(self, e: Element):
        for c in e:
            name = local(c)
            if name == "sdt":
                content = child(c, "sdtContent")
                yield from self._flat(content) if content is not None else ()
            elif name in THROUGH:
                yield from self._flat(c)
            elif c.tag == q("AlternateContent", MC):
                chosen = self._alternative(c)
                yield from self._flat(chosen) if chosen is not None else ()
            elif name == "altChunk":
                self.c.package.warn("embedded content of another format (altChunk) was skipped")
            elif name not in GONE:
                yield c

    def blocks(self, e: Element, condition: dict | None = None, room: int | None = None) -> list[dict]:
        out: list[dict] = []
        spaced: list[tuple] = []  # (style, contextual) of each block
        for c in self._flat(e):
            name = local(c)
            if name == "p":
                for block, style, contextual in self.paragraph(c, condition):
                    out.append(block)
                    spaced.append((style, contextual))
            elif name == "tbl":
                table = word_tables.read_table(c, self.c.formats, self.c.styles, room or self.c.width, self.blocks)
                if table:
                    out.append(table)
                    spaced.append((None, False))
            elif name == "bookmarkStart":
                self._bookmark(c)
            elif name in ("commentRangeStart", "commentRangeEnd"):
                found = self._comment_marks(c)
                if name == "commentRangeEnd" and out and out[-1]["kind"] == "paragraph":
                    out[-1]["inlines"] += found
                else:
                    self.marks += found
        # Neighbours of one style lose the spacing between them where the style says so.
        for (a, (style, drop_a)), (b, (other, drop_b)) in zip(zip(out, spaced), list(zip(out, spaced))[1:]):
            if a["kind"] == b["kind"] == "paragraph" and style == other:
                if drop_a:
                    a["props"]["after"] = 0
                if drop_b:
                    b["props"]["before"] = 0
        return out

    def paragraph(self, e: Element, condition: dict | None) -> list[tuple[dict, str | None, bool]]:
        """Layers, weakest first: defaults, table style and paragraph style (a style of its own goes before the table's), numbering level, direct."""
        c = self.c
        properties = child(e, "pPr")
        direct = c.formats.paragraph(properties)
        style_id = c.styles.effective(val(properties, "pStyle"), "paragraph")
        usual = style_id is None or style_id == c.styles.defaults.get("paragraph")
        style, in_table = c.styles.paragraph(style_id), (condition or {}).get("paragraph", {})
        number, level = self._numbering(direct, style, style_id)
        layers = [style, in_table] if usual else [in_table, style]
        f = c.styles.paragraph_default
        for layer in (*layers, level["paragraph"] if level else {}, direct):
            f = over(f, layer)
        runs = [c.styles.run(style_id, "paragraph"), (condition or {}).get("run", {})]
        runs = runs if usual else runs[::-1]
        inlines = self.inlines(e, runs, None)
        lifted, self.lifted = self.lifted, []
        mark = layered(c.styles.run_default, runs, f.get("mark", {}))
        if number and level and number["label"] == "" and level["text"] is None:
            number = None
        out = []
        if not (mark.get("hidden") and not c.options["hidden_text"] and not inlines):
            marks, self.marks = self.marks, []
            props = self._properties(f, style_id, number, run_properties(mark))
            out.append(({"kind": "paragraph", "props": props, "inlines": [*marks, *merged_inlines(inlines)]}, style_id, f.get("contextual", False)))
        out += [(block, None, False) for block in lifted]
        section = child(properties, "sectPr")
        if section is not None and (val(section, "type") or "nextPage") in ("nextPage", "oddPage", "evenPage"):
            self.page_break = True
        return out

    def _numbering(self, direct: dict, style: dict, style_id: str | None) -> tuple[dict | None, dict | None]:
        n = self.c.numbering
        num_id = direct.get("num_id", style.get("num_id"))
        if num_id in (None, "0") or not n.levels(num_id):
            return None, None
        level = direct.get("level")
        if level is None and "num_id" not in direct:
            level = style.get("level")
        if level is None:
            level = n.level_of_style(num_id, style_id)
        level = max(0, min(8, level or 0))
        return n.next(num_id, level), n.levels(num_id).get(level)

    def _properties(self, f: dict, style_id: str | None, number: dict | None, mark: dict) -> dict:
        borders = {s: word_tables.visible(f.get("borders", {}).get(s)) for s in word_tables.SIDES}
        outline = f.get("outline")
        named = re.fullmatch(r"heading\s*([1-9])", self.c.styles.name(style_id) or "", re.I)
        breaks, self.page_break = f.get("page_break", False) or self.page_break, False
        return {
            "style": style_id, "align": f.get("align"), "left": f.get("left", 0), "right": f.get("right", 0), "first": f.get("first", 0), "before": 280 if f.get("auto_before") else f.get("before", 0),
            "after": 280 if f.get("auto_after") else f.get("after", 0), "line": f.get("line"), "rule": None if f.get("line") is None else f.get("rule", "auto"), "keep_next": f.get("keep_next", False),
            "keep_lines": f.get("keep_lines", False), "page_break": breaks, "shading": None if f.get("shading") == "auto" else f.get("shading"), "borders": borders if any(borders.values()) else None,
            "bidi": f.get("bidi", False), "outline": int(named[1]) - 1 if outline is None and named else outline, "mark": mark, **(number or {}),
        }

    # Inlines.

    def inlines(self, e: Element, layers: list[dict], link: tuple | None) -> list[dict]:
        out: list[dict] = []
        for c in e:
            name = local(c)
            if c.tag in (q("oMath", M), q("oMathPara", M)):
                if not self._suppressed():
                    from vellumite.functions.formulas import from_omml

                    own = next(below(c, "r", M), None)
                    run = run_properties(layered(self.c.styles.run_default, layers, self.c.formats.run(child(own, "rPr"))))
                    out.append(self._wrapped({"kind": "formula", "run": run, "text": from_omml(c), "display": c.tag == q("oMathPara", M)}, link))
            elif c.tag == q("AlternateContent", MC):
                chosen = self._alternative(c)
                out += self.inlines(chosen, layers, link) if chosen is not None else []
            elif name == "r":
                out += self.run(c, layers, link)
            elif name == "hyperlink":
                out += self.inlines(c, layers, self._hyperlink(c) or link)
            elif name == "fldSimple":
                out += self._simple_field(c, layers, link)
            elif name == "sdt":
                content = child(c, "sdtContent")
                out += self.inlines(c if content is None else content, layers, link)
            elif name in THROUGH | {"dir", "bdo", "sdtContent"}:
                out += self.inlines(c, layers, link)
            elif name == "bookmarkStart":
                self._bookmark(c)
                if out:
                    marks, self.marks = self.marks, []
                    out += marks
            elif name in ("commentRangeStart", "commentRangeEnd"):
                out += self._comment_marks(c)
        return out

    # Elements of a run that are single characters.
    CHARACTERS = {"noBreakHyphen": "‑", "softHyphen": "\u00ad"}

    def run(self, e: Element, layers: list[dict], link: tuple | None) -> list[dict]:
        pr = child(e, "rPr")
        f = layered(self.c.styles.run_default, [*layers, self.c.styles.run(val(pr, "rStyle"), "character")], self.c.formats.run(pr))
        hidden = bool(f.get("hidden")) and not self.c.options["hidden_text"]
        props = run_properties(f)
        out: list[dict] = []
        text = ""

        def flush() -> None:
            nonlocal text
            if text:
                self._emit(out, {"kind": "text", "run": props, "text": text}, link, hidden)
            text = ""

        for c in e:
            name = local(c)
            if name == "t":
                text += c.text or ""
                continue
            if name == "sym":
                try:
                    code = int(attr(c, "char") or "", 16)
                except ValueError:
                    code = 0
                text += (symbol(attr(c, "font"), code) or chr(code - 0xF000 if code >= 0xF000 else code)) if 0 < code < 0x110000 else ""
                continue
            if name in self.CHARACTERS:
                text += self.CHARACTERS[name]
                continue
            flush()
            if name in ("tab", "ptab"):
                self._emit(out, {"kind": "tab", "run": props}, link, hidden)
            elif name in ("br", "cr"):
                self._emit(out, {"kind": "break", "run": props, "text": "page" if attr(c, "type") == "page" else "line"}, link, hidden)
            elif name in ("drawing", "pict", "object"):
                out += self._drawing(c, props, link, hidden)
            elif c.tag == q("AlternateContent", MC):
                chosen = self._alternative(c)
                for one in chosen if chosen is not None else ():
                    if local(one) in ("drawing", "pict"):
                        out += self._drawing(one, props, link, hidden)
            elif name == "fldChar":
                out += self._field(c, props, link)
            elif name == "instrText" and self.fields and not self.fields[-1]["result"]:
                self.fields[-1]["instruction"] += c.text or ""
            elif name in ("footnoteReference", "endnoteReference"):
                reference = self._note(c, props)
                if reference:
                    self._emit(out, reference, link, hidden)
            elif name == "commentReference":
                word_id = attr(c, "id") or ""
                if word_id in self.c.comment_ids and word_id not in self.c.ranged:
                    out += [{"kind": kind, "ref": self.c.comment_ids[word_id]} for kind in ("comment_start", "comment_end")]
            elif name == "ruby":
                base = child(c, "rubyBase")
                out += self.inlines(c if base is None else base, layers, link)
        flush()
        return out

    def _emit(self, out: list[dict], x: dict, link: tuple | None, hidden: bool) -> None:
        field = self.fields[-1] if self.fields else None
        if field and field["page"] and field["result"]:
            if not hidden and x["kind"] == "text":
                field["shown"] += x["text"]
                field["run"] = field["run"] or x["run"]
        elif not hidden and not self._suppressed():
            out.append(self._wrapped(x, link))

    def _suppressed(self) -> bool:
        """Inside the instruction of some open field."""
        return any(not f["result"] for f in self.fields)

    def _wrapped(self, x: dict, link: tuple | None) -> dict:
        own = next((f["target"] for f in reversed(self.fields) if f["result"] and f["target"] != (None, None)), link)
        return x if own is None or "link" in x else {**x, "link": own}

    def _field(self, e: Element, props: dict, link: tuple | None) -> list[dict]:
        kind = attr(e, "fldCharType")
        if kind == "begin":
            box = child(e, "ffData", "checkBox")
            state = next((s for s in (child(box, "checked"), child(box, "default")) if s is not None), None)
            ticked = None if box is None else state is not None and flag(attr(state, "val") or "1")
            self.fields.append({"instruction": "", "result": False, "target": (None, None), "box": ticked, "page": None, "shown": "", "run": None})
        elif kind == "separate" and self.fields and not self.fields[-1]["result"]:
            f = self.fields[-1]
            f |= {"result": True, "page": page_field(f["instruction"]), "target": field_target(f["instruction"])}
        elif kind == "end" and self.fields:
            f = self.fields.pop()
            if f["page"] and not self._suppressed():
                return [self._wrapped({"kind": "field", "run": f["run"] or props, "field": f["page"], "text": f["shown"]}, link)]
            if f["box"] is not None and not self._suppressed() and re.match(r"\s*FORMCHECKBOX", f["instruction"], re.I):
                return [self._wrapped({"kind": "text", "run": props, "text": CHECKED if f["box"] else UNCHECKED}, link)]
        return []

    def _simple_field(self, e: Element, layers: list[dict], link: tuple | None) -> list[dict]:
        instruction = attr(e, "instr") or ""
        page = page_field(instruction)
        if page:
            shown = [x for x in self.inlines(e, layers, None) if x["kind"] == "text"]
            run = shown[0]["run"] if shown else run_properties(layered(self.c.styles.run_default, layers, {}))
            return [self._wrapped({"kind": "field", "run": run, "field": page, "text": "".join(x["text"] for x in shown)}, link)]
        target = field_target(instruction)
        return self.inlines(e, layers, link if target == (None, None) else target)

    def _hyperlink(self, e: Element) -> tuple | None:
        r = self.c.package.rel(self.part, e.get(q("id", R)))
        url, anchor = r["target"] if r and r["external"] else None, attr(e, "anchor")
        if url and anchor:
            return f"{url.partition('#')[0]}#{anchor}", None
        return (url, anchor) if url or anchor else None

    def _bookmark(self, e: Element) -> None:
        if attr(e, "name") in self.c.linked:
            self.c.bookmarks += 1
            self.marks.append({"kind": "bookmark", "ref": self.c.bookmarks, "text": attr(e, "name")})

    def _comment_marks(self, e: Element) -> list[dict]:
        one = self.c.comment_ids.get(attr(e, "id") or "")
        return [{"kind": "comment_start" if local(e) == "commentRangeStart" else "comment_end", "ref": one}] if one else []

    def _note(self, e: Element, props: dict) -> dict | None:
        """A reference to a known note, numbered in the order of references; its body is read once it is met."""
        kind = local(e).removesuffix("Reference")
        body = self.c.note_elements[kind].get(attr(e, "id"))
        if body is None or flag(attr(e, "customMarkFollows") or "0"):
            return None
        number = 1 + sum(n["type"] == kind for n in self.c.notes)
        note = {"type": kind, "number": number, "blocks": []}
        self.c.notes.append(note)
        note["blocks"] = without_lead(Reader(self.c, self.c.note_parts[kind][0]).blocks(body))
        return {"kind": "note", "run": props, "text": kind, "ref": number}

    # Drawings.

    def _drawing(self, e: Element, props: dict, link: tuple | None, hidden: bool) -> list[dict]:
        if hidden or self._suppressed():
            return []
        out: list[dict] = []
        if local(e) == "drawing":
            for holder in e:
                if holder.tag in (q("inline", WP), q("anchor", WP)):
                    out += self._object(holder, props)
        else:
            out += self._vml(e, props)
        return [x if "link" in x else self._wrapped(x, link) for x in out]

    def _object(self, e: Element, props: dict) -> list[dict]:
        about, extent = child(e, "docPr", ns=WP), child(e, "extent", ns=WP)
        if about is not None and (about.get("hidden") or "").lower() in ("1", "true"):
            return []
        size = [max(1, whole(extent.get(k)) or 0) if extent is not None else 1 for k in ("cx", "cy")]
        words = ((about.get("descr") or about.get("title") or "") if about is not None else "").strip()
        side = self._side(e) if e.tag == q("anchor", WP) else None
        data = child(e, "graphic", "graphicData", ns=A)
        click = child(about, "hlinkClick", ns=A)
        target = self.c.package.rel(self.part, click.get(q("id", R))) if click is not None else None
        out, lifted = [], len(self.lifted)
        for g in self._graphics(data):
            if g.tag == q("pic", PIC):
                blip = child(child(g, "blipFill", ns=PIC), "blip", ns=A)
                if blip is None:
                    continue
                if blip.get(q("embed", R)) is None and blip.get(q("link", R)) is not None:
                    self.c.package.warn("a linked picture was not loaded: external pictures are never fetched")
                    continue
                image = self._media(blip.get(q("embed", R)))
                if image:
                    x = {"kind": "image", "run": props, "media": image["hash"], "width": size[0], "height": size[1], "text": words, "side": side}
                    out.append({**x, "link": (target["target"], None)} if target and target["external"] else x)
            else:
                box = child(child(g, "txbx", ns=WPS), "txbxContent")
                if box is not None:
                    self.lifted += Reader(self.c, self.part).blocks(box)
        if data is not None and not out and len(self.lifted) == lifted and not (data.get("uri") or "").endswith("/wordprocessingShape"):
            self.c.package.warn("a drawing without a picture (chart, diagram or ink) was skipped")
        return out

    def _graphics(self, e: Element | None):
        for c in e if e is not None else ():
            if c.tag in (q("pic", PIC), q("wsp", WPS)):
                yield c
            elif c.tag in (q("wgp", WPG), q("grpSp", WPG)):
                yield from self._graphics(c)

    @staticmethod
    def _side(e: Element) -> str | None:
        if not any(child(e, w, ns=WP) is not None for w in ("wrapSquare", "wrapTight", "wrapThrough")):
            return None
        place = child(e, "positionH", "align", ns=WP)
        return {"left": "left", "inside": "left", "right": "right", "outside": "right"}.get(((place.text if place is not None else "") or "").strip())

    def _vml(self, e: Element, props: dict) -> list[dict]:
        """Pictures and text boxes of the older drawing language, in groups too."""
        out: list[dict] = []
        for shape in e:
            if not shape.tag.startswith(f"{{{V}}}"):
                continue
            style = {k.strip().lower(): v.strip() for k, _, v in (d.partition(":") for d in (shape.get("style") or "").split(";"))}
            if style.get("visibility") == "hidden":
                continue
            data, box = child(shape, "imagedata", ns=V), child(child(shape, "textbox", ns=V), "txbxContent")
            image = self._media(data.get(q("id", R)) or data.get(q("relid", O))) if data is not None else None
            if image:
                emu = lambda k, own: rounded(own * EMU_PER_PIXEL) if (pt := points(style.get(k, "") + ("px" if re.fullmatch(r"[\d.]+", style.get(k, "")) else ""))) is None else rounded(pt * 12700)  # noqa: E731, B023
                place = style.get("mso-position-horizontal")
                words = (shape.get("alt") or data.get(q("title", O)) or "").strip()
                out.append({"kind": "image", "run": props, "media": image["hash"], "width": max(1, emu("width", image["width"])), "height": max(1, emu("height", image["height"])), "text": words, "side": place if place in ("left", "right") and style.get("position") == "absolute" else None})
            if box is not None:
                self.lifted += Reader(self.c, self.part).blocks(box)
            if shape.tag == q("group", V):
                out += self._vml(shape, props)
        return out

    def _media(self, rel_id: str | None) -> dict | None:
        package = self.c.package
        r = package.rel(self.part, rel_id)
        if r is None or r["external"]:
            package.warn("a picture was not loaded: " + ("its part is missing" if r is None else "external pictures are never fetched"))
            return None
        if not package.has(r["target"]):
            package.warn(f"a picture was not loaded: {r['target']} is missing from the package")
            return None
        image = images.inspect(package.parts[r["target"].lower()])
        if image:
            self.c.media.setdefault(image["hash"], image)
            return image
        end, kind = r["target"].lower().rpartition(".")[2], package.content_type(r["target"])
        if end in ("emf", "wmf", "emz", "wmz") or "emf" in kind or "wmf" in kind:
            package.warn(f"a {end} picture was skipped: browsers do not show metafiles")
        elif end == "svg" or "svg" in kind:
            package.warn("an SVG picture was skipped: it can carry scripts")
        else:
            package.warn(f"a picture of type {kind} was skipped: its format is not known")
        return None


def without_lead(blocks: list[dict]) -> list[dict]:
    """A note's first text without the space that follows its mark."""
    first = blocks[0] if blocks else None
    if first and first["kind"] == "paragraph" and first["inlines"] and first["inlines"][0]["kind"] == "text":
        text = first["inlines"][0]["text"].lstrip()
        first["inlines"] = [*([{**first["inlines"][0], "text": text}] if text else []), *first["inlines"][1:]]
    return blocks


def blank(blocks: list[dict]) -> bool:
    return all(b["kind"] == "paragraph" and all(x["kind"] == "bookmark" for x in b["inlines"]) for b in blocks)


def furniture(c: Context, body: Element) -> list[dict]:
    """Headers and footers of the last section, inherited from those before; first and even ones only where they are switched on.

    A blank one is dropped, unless it is what switches its layout on.
    """
    package, targets, last = c.package, {}, None
    parents = {id(s): p for p in body.iter() for s in p if s.tag == q("sectPr")}
    for section in below(body, "sectPr"):
        if local(parents.get(id(section), section)) == "sectPrChange":
            continue
        for kind in ("header", "footer"):
            for e in section.findall(q(f"{kind}Reference")):
                r = package.rel(package.main, e.get(q("id", R)))
                if r and not r["external"] and package.has(r["target"]):
                    targets[kind, attr(e, "type") or "default"] = r["target"]
        last = section
    settings = package.related("settings")[1]
    shown = {"default": True, "first": bool(on(last, "titlePg")), "even": bool(on(settings, "evenAndOddHeaders"))}
    out = []
    for kind in ("header", "footer"):
        for place in ("default", "first", "even"):
            target = targets.get((kind, place))
            if not shown[place] or target is None:
                continue
            try:
                root = parse_xml(package.parts[target.lower()])
            except (PackageError, UnicodeDecodeError) as e:
                package.warn(f"{target} was ignored: {e}")
                continue
            out.append({"kind": kind, "type": place, "blocks": Reader(c, target).blocks(root)})
    used = {f["type"] for f in out if not blank(f["blocks"])}
    kept = []
    for f in out:
        if blank(f["blocks"]):
            if f["type"] == "default" or f["type"] in used:
                continue
            used.add(f["type"])
        kept.append(f)
    return kept


def read_comments(c: Context) -> list[dict]:
    """Comments with their bodies and threads: a reply names its parent's last paragraph."""
    extended = {e.get(q("paraId", W15)): e for e in below(c.package.related("commentsExtended")[1], "commentEx", W15)}
    last = {k: ps[-1].get(q("paraId", W14)) if (ps := list(below(e, "p"))) else None for k, e in c.comment_elements.items()}
    by_paragraph = {p: c.comment_ids[k] for k, p in last.items() if p}
    out = []
    for k, e in c.comment_elements.items():
        thread = extended.get(last[k]) if last[k] else None
        up = thread.get(q("paraIdParent", W15)) if thread is not None else None
        out.append({
            "id": c.comment_ids[k], "author": attr(e, "author") or None, "initials": attr(e, "initials") or None, "date": timestamp(attr(e, "date") or ""), "parent": by_paragraph.get(up) if up else None,
            "resolved": thread is not None and thread.get(q("done", W15)) in ("1", "true", "on"), "blocks": Reader(c, c.comment_part or "").blocks(e),
        })
    return out


def metadata(package: Package) -> dict:
    _, core = package.related("core-properties", "")
    text = lambda name, ns: ((e.text or "").strip() or None) if (e := child(core, name, ns=ns)) is not None else None
    return {"title": text("title", DC), "author": text("creator", DC), "language": text("language", DC), "created": timestamp(text("created", DCTERMS) or "") or "1970-01-01T00:00:00Z"}


def read_package(data: bytes, options: dict | None = None) -> dict:
    """The model of a package. options: hidden_text, furniture, comments, limits."""
    options = {"hidden_text": False, "furniture": True, "comments": True, "limits": {}} | (options or {})
    package = Package(data, options["limits"])
    root = parse_xml(package.parts[package.main.lower()])
    body = child(root, "body")
    if root.tag != q("document", W) or body is None:
        raise PackageError("malformed", "the main part is no word-processor document")
    c = Context(package, body, options)
    blocks = Reader(c, package.main).blocks(body)
    around = furniture(c, body) if options["furniture"] else []
    comments = balance([blocks, *(n["blocks"] for n in c.notes)], read_comments(c))
    normal = c.styles.defaults.get("paragraph")
    base = over(c.styles.paragraph_default, c.styles.paragraph(normal))
    default = {"style": normal, "align": base.get("align"), "left": base.get("left", 0), "right": base.get("right", 0), "first": base.get("first", 0), "before": base.get("before", 0), "after": base.get("after", 0), "line": base.get("line"), "rule": None if base.get("line") is None else base.get("rule", "auto")}
    return {
        "blocks": blocks, "default_run": run_properties(layered(c.styles.run_default, [c.styles.run(normal, "paragraph")], {})), "default_paragraph": default, "styles": [], "lists": c.numbering.definitions(), "notes": c.notes,
        "comments": comments, "furniture": around, "media": list(c.media.values()), "meta": metadata(package), "layout": c.layout, "warnings": package.warnings,
    }
