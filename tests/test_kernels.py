"""Single documents: HTML to models, Word packages to models, and both ways out."""

import base64
import zipfile
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumite.kernels import dom, images, metrics, symbols, units, user_agent, word_tables
from vellumite.kernels.build import Builder
from vellumite.kernels.html_write import Writer as HtmlWriter
from vellumite.kernels.html_write import document_text
from vellumite.kernels.selectors import matcher, specificity
from vellumite.kernels.styles import Sheets, Style, computed
from vellumite.kernels.word_read import field_target, read_package
from vellumite.kernels.word_write import Writer as WordWriter
from vellumite.sources.docx import PackageError, R, W

PAGE = {"width": 11906, "height": 16838, "top": 1440, "right": 1440, "bottom": 1440, "left": 1440}


def options(editor="plain", **more):
    return {"base": Style(family="Calibri", size=11.0, root_size=11.0), "sheet": user_agent.sheet(editor), "page_width": 9026, "picture": images.resolver(), "editor": editor, "plain": editor == "plain", **more}


def model(html, editor="plain", **more):
    return Builder(html, options(editor, **more)).build()


def to_html(m, editor="plain"):
    return HtmlWriter(m, {**options(editor), "picture": None}).write()


def to_word(m):
    return WordWriter(m, {"layout": PAGE, "created": "2024-05-06T07:08:10Z"}).write()


def paragraph(m, text):
    return next(b for b in m["blocks"] if b["kind"] == "paragraph" and document_text([b]) == [text])


def run(m, text):
    return next(x["run"] for b in m["blocks"] if b["kind"] == "paragraph" for x in b["inlines"] if x["kind"] == "text" and x["text"] == text)


def texts(html, **more):
    return document_text(model(html, **more)["blocks"])


# White space and paragraphs.


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>  x \n\n  y\t z  </p>", ["x y z"]),
        ("<p>x <b> y </b> <i> z</i></p>", ["x y z"]),
        ("<section>\n  <p>1</p>\n  <p>2</p>\n</section>", ["1", "2"]),
        ("<p>x   <br>   y</p>", ["x\ny"]),
        ("<p>x&nbsp;&nbsp;y</p>", ["x  y"]),
        ("free <em>text</em>", ["free text"]),
        ("<p><b>P</b> <i>Q</i></p>", ["P Q"]),
        ("<p>1<br>2<br><br>4</p>", ["1\n2\n\n4"]),
        ("<p>t<br></p>", ["t"]),
        ("<p>1</p><p><br></p><p>3</p>", ["1", "", "3"]),
        ("<p>x</p><p></p><div> </div><p>y</p>", ["x", "y"]),
        ("<pre>l 1\n    in\tafter</pre>", ["l 1\n    in\tafter"]),
        ("<p style='white-space: pre-line'>x   y\nz</p>", ["x y\nz"]),
        ("<p>&lt;a&gt; &amp; &quot;q&quot; &copy; &#8212; &#x1F600;</p>", ['<a> & "q" © — 😀']),
        ("<p>x<q>y</q></p>", ["x“y”"]),
        ("<div style='display:none'>no</div><p hidden>no</p><p>yes</p>", ["yes"]),
        ("<p>x<span style='display:block'>y</span>z</p><div style='display:inline'>u</div><div style='display:inline'>v</div>", ["x", "y", "z", "uv"]),
        ("<p style='text-transform:lowercase'>ÀB</p><p style='text-transform:capitalize'>ab c-d (e</p>", ["àb", "Ab C-D (E"]),
        ("<input type=checkbox checked>on<input type=hidden value=h><input value=v>", ["☑ onv"]),
        ("", [""]),
    ],
)
def test_text(html, want):
    assert texts(html) == want


def test_breaks_and_tabs_are_items():
    m = model("<pre>a\tb\nc</pre>")
    assert [x["kind"] for x in m["blocks"][0]["inlines"]] == ["text", "tab", "text", "break", "text"]


# The cascade.

SHEET = "<style>#i { color: #0000ff } .c { color: #00ff00 } p { color: #ff0000 } p.c { color: #ff00ff } .d { color: #111111 } .e { color: #222222 } .n { color: #00ff00 !important }</style>"


@pytest.mark.parametrize(
    ("html", "colour"),
    [
        ("<p id=i class=c>t</p>", "0000FF"),
        ("<p class=c>t</p>", "FF00FF"),
        ("<div class='d e'>t</div>", "222222"),
        ("<p class=c style='color: #0000fe'>t</p>", "0000FE"),
        ("<p class=n style='color: #0000fe'>t</p>", "00FF00"),
        ("<p class=n style='color: #0000fe !important'>t</p>", "0000FE"),
        ("<font color=teal>t</font>", "008080"),
        ("<div style='color: #123456'><p style='color: inherit'>t</p></div>", "123456"),
    ],
)
def test_cascade(html, colour):
    assert run(model(SHEET + html), "t")["color"] == colour


@pytest.mark.parametrize(
    ("selector", "html"),
    [("div > span", "<div><span>t</span></div>"), ("h1 + p", "<h1>h</h1><p>t</p>"), ("h1 ~ p", "<h1>h</h1><div></div><p>t</p>"), ('[data-k="x"]', "<p data-k=x>t</p>"), ('a[href^="https"]', "<p><a href='https://x'>t</a></p>"), ("li:nth-child(2)", "<ul><li>1</li><li>t</li></ul>"), ("p:not(.s)", "<p class=s>s</p><p>t</p>"), (":is(h2, h3) span", "<h3><span>t</span></h3>"), ("* .x", "<div><b class=x>t</b></div>"), ("p:has(> i) b", "<p><i>i</i><b>t</b></p>"), ("p:lang(de) b", "<p lang=de-AT><b>t</b></p>"), ("[title~=two i]", "<p title='One TWO'>t</p>"), ("p:only-of-type", "<div><p>t</p><i>u</i></div>")],
)
def test_selectors(selector, html):
    assert run(model(f"<style>{selector} {{ color: #abcdef }}</style>{html}"), "t")["color"] == "ABCDEF"


def test_selectors_that_cannot_apply():
    m = model("<style>p::before { color: red } a:hover { color: lime } @media screen { p { color: blue } } @font-face { font-family: x } p[ { broken } @media print { i { color: #123456 } }</style><p>t<i>u</i></p>")
    assert run(m, "t")["color"] == "000000" and run(m, "u")["color"] == "123456"
    assert matcher("p >") is None and matcher("a::after") is None and matcher(":frob") is None and matcher("") is None


def test_specificity():
    want = {"*": (0, 0, 0), "p": (0, 0, 1), "div p": (0, 0, 2), ".a": (0, 1, 0), "p.a.b": (0, 2, 1), "#x": (1, 0, 0), "#x .y p": (1, 1, 1), ":where(#a, .b) p": (0, 0, 1), "p:not(.a, #b)": (1, 1, 1), "a[href]:first-child": (0, 2, 1)}
    assert {k: specificity(k) for k in want} == want


def test_hints_lie_below_the_base_sheet():
    html = "<p align=center>t</p>"
    assert paragraph(model(html), "t")["props"]["align"] == "center"
    assert paragraph(model(html, base_sheet="p { text-align: right }"), "t")["props"]["align"] == "right"


def test_computed_values():
    root = Style()
    style = lambda css, parent=root: computed(Sheets("").winners(dom.document(f'<p style="{css}">').children[0]), parent)
    assert style("font-size: larger").size == pytest.approx(14.4) and style("font-size: 150%").size == 18 and style("font-size: -1px").size == 12 and style("font-size: xx-large").size == 24
    assert style("vertical-align: super; font-size: smaller").size == 12 and style("vertical-align: super; font-size: 8pt").size == 8
    assert style("font-family: -apple-system, monospace").family == "Courier New" and style("font-family: 'A B', serif").family == "A B"
    assert style("font-weight: 600").bold and not style("font-weight: 599").bold
    assert style("line-height: 150%").line == ("multiple", 1.5) and style("line-height: 20pt").line == ("points", 20) and style("line-height: 0").line is None
    child = style("text-decoration: none", style("text-decoration: line-through underline wavy"))
    assert child.strike and child.underline == "wavy" and style("letter-spacing: 0.1em").spacing == pytest.approx(1.2)
    assert style("border-top: thin dashed").border("top") == ("dashed", 0.75, "000000") and style("border-top: 0 solid").border("top") is None


def test_units():
    got = [units.points(x) for x in ("12pt", "16px", "1in", "2.54cm", "25.4mm", "1pc", "101.6q", "0", "-4pt", ".5in", "1e1pt", " 10PX ")]
    assert got == pytest.approx([12, 12, 72, 72, 72, 12, 72, 0, -4, 36, 10, 7.5])
    assert [units.points(x, 10, 11, 300) for x in ("2em", "2rem", "2ex", "50%")] == [20, 22, 10, 150] and units.points("50%") is None
    assert all(units.points(x) is None for x in (None, "", "auto", "12", "px", "12 px", "1vw", "calc(1px)"))
    want = {"rebeccapurple": "663399", "#f0a": "FF00AA", "#00000080": "7F7F7F", "#0000": None, "rgb(300, -5, 0)": "FF0000", "rgba(0, 0, 255, 0.5)": "8080FF", "hsl(120, 100%, 50%)": "00FF00", "currentColor": None}
    assert {k: units.colour(k) for k in want} == want
    assert [units.numbered(n, k) for n, k in ((4, "lowerRoman"), (28, "lowerLetter"), (12, "ordinal"), (121, "ordinalText"), (1234, "cardinalText"), (7, "decimalZero"), (6, "chicago"), (3, "none"), (255, "hex"))] == ["iv", "bb", "12th", "One hundred twenty-first", "One thousand two hundred thirty-four", "07", "††", "", "FF"]


# Blocks.


def test_boxes_add_up():
    m = model("<div style='margin-left: 10pt'><div style='padding-left: 10pt; border-left: 2pt solid red'><p style='margin: 5pt 0 7pt 10pt'>d</p></div></div>")
    p = m["blocks"][0]["props"]
    assert (p["left"], p["before"], p["after"]) == (640, 100, 140) and p["borders"]["left"] == {"style": "single", "size": 16, "color": "FF0000", "space": 10}
    wide = model("<div style='margin-left: 2000pt; margin-right: 1000pt'>x</div>")["blocks"][0]["props"]
    assert wide["left"] + wide["right"] == 9026 - 1440
    joined = model("<div style='margin-top: 30pt'><p style='margin-top: 10pt'>x</p></div><div style='margin-top: 30pt; overflow: hidden'><p style='margin-top: 10pt'>y</p></div>")["blocks"]
    assert [b["props"]["before"] for b in joined] == [600, 800]


def test_line_heights():
    line = lambda css: [model(f"<p style='{css}'>x</p>")["blocks"][0]["props"][k] for k in ("line", "rule")]
    assert line("line-height: 2") == [393, "auto"] and line("line-height: 150%") == [295, "auto"] and line("font-family: Fancy; line-height: 2") == [480, "auto"] and line("line-height: 20pt") == [400, "atLeast"]
    assert metrics.single_line("Calibri") == pytest.approx(1.2207) and metrics.single_line("Fancy") is None and metrics.line_multiple(393, "Calibri") == pytest.approx(2, abs=0.01)


def test_page_breaks_rules_and_media():
    m = model("<p style='page-break-after: always'>x</p><p>y</p><hr><iframe src='http://v/'></iframe><video><source src='http://w/'></video>")
    assert paragraph(m, "y")["props"]["page_break"] and not paragraph(m, "x")["props"].get("page_break")
    rule = m["blocks"][2]
    assert rule["inlines"] == [] and rule["props"]["borders"]["bottom"]["style"] == "single" and rule["props"]["rule"] == "exact"
    assert [x["link"] for x in m["blocks"][3]["inlines"]] == [("http://v/", None), ("http://w/", None)]


def test_styles_of_headings():
    m = model("<style>h2 { color: navy }</style><h1>a</h1><h2>b</h2><figure><figcaption>c</figcaption></figure>")
    assert [b["props"]["style"] for b in m["blocks"]] == ["Heading1", "Heading2", "Caption"] and run(m, "b")["color"] == "000080"
    by_id = {s["id"]: s for s in m["styles"]}
    assert by_id["Heading1"]["run"]["size"] == 44 and by_id["Heading2"]["run"]["color"] == "000000" and by_id["Heading1"]["props"]["outline"] == 0 and len(by_id) == 8


# Lists.


def numbers(html):
    return [(document_text([b])[0], b["props"].get("ordinal"), b["props"].get("level")) for b in model(html)["blocks"] if b["props"].get("num_id")]


def test_lists():
    assert numbers("<ol reversed><li>a<li>b<li>c</ol>") == [("a", 3, 0), ("b", 2, 0), ("c", 1, 0)]
    assert numbers("<ol reversed start=10><li>a<li>b</ol>") == [("a", 10, 0), ("b", 9, 0)]
    assert numbers("<ol><li>a<li value=7>b<li>c<ul><li>d</ul></ol>") == [("a", 1, 0), ("b", 7, 0), ("c", 8, 0), ("d", 1, 1)]
    assert numbers("<ul><li><ul><li>x</ul></ul>") == [("", 1, 0), ("x", 1, 1)]  # a marker that no text took
    m = model("<ol type=a><li>x</ol><ul style='list-style-type: \"- \"'><li>y</ul><ol style='list-style: lower-greek'><li>z<li value=25>w</ol>")
    shown = [(d["levels"][0]["format"], d["levels"][0]["text"]) for d in m["lists"]]
    assert shown == [("lowerLetter", "%1."), ("none", "-"), ("none", "α."), ("none", "αα.")]
    deep = model("<ul><li>" * 12 + "x")
    assert max(b["props"]["level"] for b in deep["blocks"]) == 8


def test_a_second_paragraph_stays_in_its_item():
    m = model("<ol><li><p>a</p><p>b</p></li><li>c</li></ol>")
    assert [b["props"].get("num_id") for b in m["blocks"]] == [1, None, 1] and m["blocks"][1]["props"]["left"] == m["blocks"][0]["props"]["left"]
    html, _ = to_html(m)
    assert html.count("<li") == 2 and html.index("b</p>") < html.index("c</li>")


# Tables.


def grid(html):
    t = next(b for b in model(html)["blocks"] if b["kind"] == "table")
    return [[(document_text(c["blocks"])[0], c["props"].get("span"), c["props"].get("merge")) for c in r["cells"]] for r in t["rows"]], t


def test_tables():
    rows, t = grid("<table><tr><td rowspan=2 colspan=2>A<td>B<td rowspan=3>C<tr><td>D<tr><td colspan=2>E<td>F<tr><td colspan=4>G</table>")
    assert [[x[0] for x in r] for r in rows] == [["A", "B", "C"], ["", "D", ""], ["E", "F", ""], ["G"]] and len(t["grid"]) == 4
    assert rows[1][0] == ("", 2, "continue") and rows[0][2] == ("C", 1, "restart")
    rows, t = grid("<table><tr><td rowspan=9>x<td>y<tr><td>z</table>")
    assert rows == [[("x", 1, "restart"), ("y", 1, None)], [("", 1, "continue"), ("z", 1, None)]]
    rows, t = grid("<table><tfoot><tr><td>f</tfoot><thead><tr><th>h</thead><tr><td>b<tr style='display:none'><td>no</table>")
    assert [r[0][0] for r in rows] == ["h", "b", "f"] and [r["header"] for r in t["rows"]] == [True, False, False]
    rows, t = grid("<table><tr><td>1<td>2<td>3<tr><td>only</table>")
    assert [x[0] for x in rows[1]] == ["only", "", ""]


def test_column_widths():
    _, t = grid("<table style='width: 300pt'><colgroup><col style='width: 100pt'><col span=2></colgroup><tr><td>a<td style='width: 50pt'>b<td>c</table>")
    assert t["grid"] == [2000, 1000, 3000] and t["props"]["width"] == 6000
    _, t = grid("<table width='100%'><tr><td>a<td>a</table>")
    assert sum(t["grid"]) == 9026
    assert [b["kind"] for b in model("<table><tr><td>a</table><table><tr><td>b</table>")["blocks"]] == ["table", "paragraph", "table", "paragraph"]
    nested = model("<table><tr><td><table><tr><td>in</table></table>")["blocks"][0]["rows"][0]["cells"][0]["blocks"]
    assert [b["kind"] for b in nested] == ["table", "paragraph"]


def test_figures_of_editors():
    t = next(b for b in model('<figure class="table" style="width: 50%"><table style="width:100%"><tr><td>x</table></figure>')["blocks"] if b["kind"] == "table")
    assert t["props"]["width"] == 4513


# Links, notes, comments, furniture.


def test_links():
    m = model("<p id='a b'>x</p><a href='#a%20b'>in</a><a href=' java\nscript:x'>bad</a><a href='/ä b'>out</a><a href='#gone'>lost</a><p id=unused>y")
    links = {x["text"]: x.get("link") for b in m["blocks"] for x in b["inlines"] if x["kind"] == "text"}
    assert links["in"] == (None, "_a_b") and links["out"] == ("/%C3%A4%20b", None) and links["bad"] is None
    marks = [x["text"] for b in m["blocks"] for x in b["inlines"] if x["kind"] == "bookmark"]
    assert marks == ["_a_b"]
    two = model("<p id='x.y'>1<p id='x-y'>2<a href='#x.y'>a</a><a href='#x-y'>b</a>")
    assert [x["text"] for b in two["blocks"] for x in b["inlines"] if x["kind"] == "bookmark"] == ["_x_y", "_x_y_2"]


NOTES = '<p>x<a href="#footnote-1" id="footnote-ref-1">1</a>y<a href="#endnote-1">i</a></p><ol class="se-footnotes"><li id="footnote-1"><p>f <a href="#footnote-ref-1">back</a></p></li></ol><section class="endnotes"><hr><ol><li id="endnote-1" value=4>e</li></ol></section>'


def test_notes():
    m = model(NOTES)
    assert document_text(m["blocks"])[0] == "x￼y￼" and [(n["type"], n["number"], document_text(n["blocks"])) for n in m["notes"]] == [("footnote", 1, ["f"]), ("endnote", 4, ["e"])]
    back = read_package(to_word(m))
    assert [(n["type"], document_text(n["blocks"])) for n in back["notes"]] == [("footnote", ["f"]), ("endnote", ["e"])]
    html, _ = to_html(back)
    assert 'class="footnotes"' in html and document_text(model(html)["blocks"])[0] == "x￼y￼"


COMMENTS = '<p>Plain <span class="se-comment" data-comment="1">first <span class="se-comment" data-comment="2">second</span></span></p><p><span class="se-comment" data-comment="1 3">end</span> after</p><ol class="se-comments"><li data-comment=1 data-author=A data-resolved=true>one<li data-comment=2 data-date=2024-01-01T00:00:00Z>two<li data-comment=3 data-parent=1>three<li data-comment=4 data-parent=5>four<li data-comment=5 data-parent=4>five</ol>'


def test_comments():
    m = model(COMMENTS, "suneditor")
    marks = [(x["kind"][8:], x["ref"]) if x["kind"].startswith("comment") else x.get("text") for b in m["blocks"] for x in b["inlines"]]
    assert [x for x in marks if isinstance(x, tuple) and x[1] <= 3] == [("start", 1), ("start", 2), ("end", 2), ("start", 3), ("end", 1), ("end", 3)] or {x for x in marks if isinstance(x, tuple)} >= {("start", 1), ("end", 3)}
    for one in range(1, 6):
        assert marks.count(("start", one)) == marks.count(("end", one)) == 1
    assert {c["id"]: (c["parent"], c["resolved"]) for c in m["comments"]} == {1: (None, True), 2: (None, False), 3: (1, True), 4: (None, False), 5: (None, False)}
    back = read_package(to_word(m))
    assert {document_text(c["blocks"])[0]: c["author"] for c in back["comments"]}["one"] == "A" and len(back["comments"]) == 5
    assert to_html(m)[1] == ["5 comments were left out: plain HTML has no place for them"]


def test_furniture():
    m = model('<div class="se-header">a</div><div class="se-header">b</div><p>x</p><div class="se-footer" data-type="first">f <span data-field="page">3</span></div>', "suneditor")
    assert [(f["kind"], f["type"], document_text(f["blocks"])) for f in m["furniture"]] == [("header", "default", ["a", "b"]), ("footer", "first", ["f ￼"])]
    back = read_package(to_word(m))
    assert [(f["kind"], f["type"]) for f in back["furniture"]] == [("header", "default"), ("footer", "first")]
    assert 'data-field="PAGE"' in to_html(back, "suneditor")[0]


def test_formulas_by_editor():
    for source, display in (('<span class="math-tex">\\(x^{2}\\)</span>', False), ('<span data-type="block-math" data-latex="x^{2}"></span>', True), ('<span class="se-math" data-se-value="x^{2}">q</span>', False), ('<math display="block"><semantics><mi>x</mi><annotation encoding="application/x-tex">x^{2}</annotation></semantics></math>', True)):
        x = next(x for b in model(source)["blocks"] for x in b["inlines"])
        assert (x["kind"], x["text"], x["display"]) == ("formula", "x^{2}", display)
        back = read_package(to_word(model(source)))
        assert next(x for b in back["blocks"] for x in b["inlines"])["text"] == "x^{2}"
    assert "<math" in to_html(model('<span class="math-tex">\\(x\\)</span>'))[0]


GIF = b"GIF89a\x04\x00\x02\x00" + b"\0" * 20


def test_pictures():
    source = "data:image/gif;base64," + base64.b64encode(GIF).decode()
    m = model(f"<p><img src='{source}' alt=one><img src='{source}' width=2><img src='{source}' height=50% style='float:right'></p><img src=x.png alt=words><img src='{source}' style='width:99999px'>")
    x = [x for b in m["blocks"] for x in b["inlines"] if x["kind"] == "image"]
    assert len(m["media"]) == 1 and [(i["width"] // 9525, i["height"] // 9525, i["side"]) for i in x[:3]] == [(4, 2, None), (2, 1, None), (4, 2, "right")]
    assert "words" in document_text(m["blocks"])[1] and abs(x[3]["width"] / 9525 - 9026 / 15) < 0.01
    back = read_package(to_word(m))
    y = [x for b in back["blocks"] for x in b["inlines"] if x["kind"] == "image"]
    assert [(i["width"], i["height"], i["side"], i["text"]) for i in y] == [(i["width"], i["height"], i["side"], i["text"]) for i in x]
    assert images.inspect(b"GIF89a") is None and images.inspect(b"\x89PNG\r\n\x1a\n" + b"\0" * 20) is None and images.data_uri("data:,a%20b") == b"a b" and images.data_uri("data:;base64,%%") is None


# Word packages.


def package(body, **parts):
    """A package of fragments: styles, numbering, theme, comments, footnotes and more by relationship type; `rels` are more relationships."""
    rels = parts.pop("rels", "")
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = {"theme": "theme/theme1.xml", **{k: f"{k}.xml" for k in parts if k != "theme"}}
        base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        links = "".join(f'<Relationship Id="p{i}" Type="{base}/{"header" if k.startswith("header") else k}" Target="{names[k]}"/>' for i, k in enumerate(parts))
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}{rels}</Relationships>')
        spaces = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml" xmlns:v="urn:schemas-microsoft-com:vml"'
        z.writestr("word/document.xml", f"<w:document {spaces}><w:body>{body}</w:body></w:document>")
        roots = {"theme": "a:theme", "commentsExtended": "w15:commentsEx", **{k: "w:hdr" for k in parts if k.startswith("header")}}
        for k, content in parts.items():
            root = roots.get(k, f"w:{k}")
            z.writestr(f"word/{names[k]}", f"<{root} {spaces}>{content}</{root}>")
    return out.getvalue()


def p(text="", props="", run=""):
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r>{f'<w:rPr>{run}</w:rPr>' if run else ''}<w:t xml:space=\"preserve\">{text}</w:t></w:r></w:p>"


def read(body, **parts):
    more = parts.pop("options", None)
    return read_package(package(body, **parts), more)


def test_style_chains_and_toggles():
    styles = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Cambria"/><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="B"><w:name w:val="B"/><w:rPr><w:sz w:val="24"/><w:color w:val="112233"/><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="D"><w:name w:val="heading 3"/><w:basedOn w:val="B"/><w:rPr><w:i/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="D"><w:rPr><w:sz w:val="99"/></w:rPr></w:style><w:style w:type="character" w:styleId="C"><w:rPr><w:b/></w:rPr></w:style>'
    m = read(p("x", '<w:pStyle w:val="D"/>', '<w:color w:val="00ff00"/>') + p("y", '<w:pStyle w:val="D"/>', '<w:rStyle w:val="C"/>') + p("z", '<w:pStyle w:val="D"/>', '<w:i w:val="0"/>'), styles=styles)
    x, y, z = (run(m, t) for t in "xyz")
    assert (x["family"], x["size"], x["bold"], x["italic"], x["color"]) == ("Cambria", 24, True, True, "00FF00")
    assert y["bold"] is False and z["italic"] is False and m["blocks"][0]["props"]["outline"] == 2


def test_theme():
    theme = '<a:themeElements><a:clrScheme name="T"><a:dk1><a:sysClr val="windowText" lastClr="010203"/></a:dk1><a:accent1><a:srgbClr val="4472c4"/></a:accent1></a:clrScheme><a:fontScheme name="T"><a:majorFont><a:latin typeface="Georgia"/></a:majorFont><a:minorFont><a:latin typeface="Verdana"/></a:minorFont></a:fontScheme></a:themeElements>'
    m = read(p("a", run='<w:rFonts w:asciiTheme="minorHAnsi"/><w:color w:themeColor="accent1"/>') + p("b", run='<w:rFonts w:hAnsiTheme="majorAscii"/><w:color w:themeColor="text1"/>') + p("c", run='<w:color w:themeColor="accent1" w:themeTint="99"/>'), theme=theme)
    assert [(run(m, t)["family"], run(m, t)["color"]) for t in "ab"] == [("Verdana", "4472C4"), ("Georgia", "010203")] and run(m, "c")["color"] == "8FAADC"


LEVELS = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/>{x}<w:pPr><w:ind w:left="{720 * (i + 1)}" w:hanging="360"/></w:pPr></w:lvl>' for i, (f, t, x) in enumerate((("upperRoman", "%1.", ""), ("decimal", "%1.%2.", ""), ("decimal", "%1.%2.%3", '<w:isLgl/><w:lvlRestart w:val="1"/>'))))
NUMBERING = f'<w:abstractNum w:abstractNumId="0">{LEVELS}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num><w:num w:numId="3"><w:abstractNumId w:val="0"/></w:num>'


def numbered(level, num=1, text="x"):
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def test_numbering():
    labels = lambda body: [b["props"].get("label") for b in read(body, numbering=NUMBERING)["blocks"]]
    assert labels("".join(numbered(i) for i in (0, 1, 1, 0, 1))) == ["I.", "I.1.", "I.2.", "II.", "II.1."]
    assert labels(numbered(0) + numbered(0, 2) + numbered(0, 3) + numbered(0, 2)) == ["I.", "III.", "II.", "IV."]  # instances share, but for an own start
    assert labels("".join(numbered(i) for i in (0, 1, 2, 1, 2, 0, 2))) == ["I.", "I.1.", "1.1.1", "I.2.", "1.2.2", "II.", "2.1.1"]  # legal; begins anew after level 0 only
    assert labels(numbered(0, 9) + numbered(0, 0)) == [None, None]
    assert read(numbered(1), numbering=NUMBERING)["blocks"][0]["props"]["left"] == 1440


def test_fields_and_revisions():
    char = lambda t: f'<w:r><w:fldChar w:fldCharType="{t}"/></w:r>'
    field = lambda i, r: char("begin") + f'<w:r><w:instrText xml:space="preserve">{i}</w:instrText></w:r>' + char("separate") + r + char("end")
    r = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    nested = field(' HYPERLINK "http://h/" \\l "sec" ', r("go") + field(" PAGE ", r("7")))
    m = read(f"<w:p><w:ins>{r('in')}</w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>{nested}</w:p><w:p><w:fldSimple w:instr=\" NUMPAGES \">{r('9')}</w:fldSimple></w:p><w:p>{field(' REF mark \\h ', r('to'))}<w:bookmarkStart w:id=\"1\" w:name=\"mark\"/><w:bookmarkStart w:id=\"2\" w:name=\"no\"/></w:p>")
    first = m["blocks"][0]["inlines"]
    assert [(x["kind"], x.get("text"), x.get("link")) for x in first] == [("text", "in", None), ("text", "go", ("http://h/#sec", None)), ("field", "7", ("http://h/#sec", None))]
    assert m["blocks"][1]["inlines"][0]["field"] == "NUMPAGES" and [x["kind"] for x in m["blocks"][2]["inlines"]] == ["text", "bookmark"] and m["blocks"][2]["inlines"][0]["link"] == (None, "mark")
    assert field_target('HYPERLINK \\o "tip" "http://a b/"') == ("http://a b/", None) and field_target("REF x") == (None, None)
    box = '<w:p><w:r><w:fldChar w:fldCharType="begin"><w:ffData><w:checkBox><w:default w:val="1"/></w:checkBox></w:ffData></w:fldChar></w:r><w:r><w:instrText> FORMCHECKBOX </w:instrText></w:r>' + char("separate") + char("end") + "</w:p>"
    assert document_text(read(box)["blocks"]) == ["☒"]


def test_hidden_text_symbols_and_marks():
    body = '<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>hid</w:t></w:r><w:r><w:sym w:font="Wingdings" w:char="F0FC"/><w:sym w:font="Symbol" w:char="0061"/><w:noBreakHyphen/><w:tab/><w:br/><w:t>x</w:t></w:r></w:p><w:altChunk/>'
    m = read(body)
    assert document_text(m["blocks"]) == ["✓α‑\t\nx"] and len(m["warnings"]) == 1
    assert document_text(read(body, options={"hidden_text": True})["blocks"]) == ["hid✓α‑\t\nx"]


def test_paragraph_layers():
    styles = '<w:docDefaults><w:pPrDefault><w:pPr><w:spacing w:after="160"/></w:pPr></w:pPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="L"><w:pPr><w:contextualSpacing/><w:spacing w:before="80"/><w:ind w:left="500"/></w:pPr></w:style>'
    m = read(p("a", '<w:pStyle w:val="L"/>') + p("b", '<w:pStyle w:val="L"/><w:ind w:firstLine="1cm"/>') + p("c", '<w:spacing w:beforeAutospacing="1" w:beforeLines="50"/><w:jc w:val="distribute"/>'), styles=styles)
    a, b, c = (x["props"] for x in m["blocks"])
    assert (a["before"], a["after"], b["before"], b["after"]) == (80, 0, 0, 160) and (b["left"], b["first"]) == (500, 567) and (c["before"], c["align"], c["style"]) == (280, "both", "N")


def test_comments_of_packages():
    body = '<w:p><w:commentRangeStart w:id="7"/><w:r><w:t>x</w:t></w:r><w:commentRangeEnd w:id="7"/><w:r><w:commentReference w:id="7"/></w:r><w:r><w:commentReference w:id="5"/></w:r></w:p>'
    comment = lambda i, t, para: f'<w:comment w:id="{i}" w:author="A{i}" w:date="2024-01-02T03:04:05Z"><w:p w14:paraId="{para}"><w:r><w:t>{t}</w:t></w:r></w:p></w:comment>'
    comments = comment(3, "lost", "000000C3") + comment(5, "reply", "000000C5") + comment(7, "first", "000000C7")
    extended = '<w15:commentEx w15:paraId="000000C7" w15:done="1"/><w15:commentEx w15:paraId="000000C5" w15:paraIdParent="000000C7" w15:done="0"/>'
    m = read(body, comments=comments, commentsExtended=extended)
    assert [(c["id"], c["author"], c["parent"], c["resolved"], document_text(c["blocks"])) for c in m["comments"]] == [(1, "A7", None, True, ["first"]), (2, "A5", 1, True, ["reply"]), (3, "A3", None, False, ["lost"])]
    assert [(x["kind"][8:], x["ref"]) for x in m["blocks"][0]["inlines"] if x["kind"] != "text"] == [("start", 3), ("end", 3), ("start", 1), ("end", 1), ("start", 2), ("end", 2)]


def test_furniture_of_sections():
    body = '<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="p0"/><w:headerReference w:type="first" r:id="p1"/></w:sectPr></w:pPr></w:p><w:p/><w:sectPr><w:pgSz w:w="20000" w:h="10000"/><w:pgMar w:top="-700" w:left="1000" w:right="1000" w:bottom="9990"/></w:sectPr>'
    m = read(body, header1=p("one"), header2=p("first"))
    assert [(f["kind"], f["type"], document_text(f["blocks"])) for f in m["furniture"]] == [("header", "default", ["one"])]
    assert m["blocks"][1]["props"]["page_break"] and m["layout"] == {"width": 20000, "height": 10000, "top": 700, "right": 1000, "bottom": 9640, "left": 1000}
    m = read(body.replace("<w:pgSz", "<w:titlePg/><w:pgSz"), header1=p("one"), header2="<w:p/>")
    assert [f["type"] for f in m["furniture"]] == ["default", "first"]  # blank, but it hides the other on the first page
    assert read(body.replace("<w:pgSz", "<w:titlePg/><w:pgSz"), header1="<w:p/>", header2=p("one"))["furniture"][0]["type"] == "first"


def tc(text="", props="", more=""):
    return f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{p(text)}{more}</w:tc>"


def tbl(rows, props="", columns=(2500, 2500)):
    return f"<w:tbl><w:tblPr>{props}</w:tblPr><w:tblGrid>{''.join(f'<w:gridCol w:w="{c}"/>' for c in columns)}</w:tblGrid>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"


def cells(m):
    t = next(b for b in m["blocks"] if b["kind"] == "table")
    return [[("".join(document_text(c["blocks"])), c["props"].get("span"), c["props"].get("merge")) for c in r["cells"]] for r in t["rows"]], t


def test_word_tables():
    rows, t = cells(read(tbl([tc("wide", '<w:gridSpan w:val="2"/>'), tc("tall", '<w:vMerge w:val="restart"/>') + tc("r"), tc("", "<w:vMerge/>") + tc("s")])))
    assert rows == [[("wide", 2, None)], [("tall", 1, "restart"), ("r", 1, None)], [("", 1, "continue"), ("s", 1, None)]]
    rows, t = cells(read(tbl(["<w:trPr><w:del/></w:trPr>" + tc("gone"), '<w:trPr><w:gridBefore w:val="1"/></w:trPr>' + tc("b"), tc("x", '<w:hMerge w:val="restart"/>') + tc("y", "<w:hMerge/>"), f"<w:sdt><w:sdtContent>{tc('in')}</w:sdtContent></w:sdt>"])))
    assert rows == [[("", 1, None), ("b", 1, None)], [("x", 2, None)], [("in", 1, None), ("", 1, None)]]
    inner = tbl([tc("deep")], columns=(1000,))
    rows, t = cells(read(tbl([tc("a", more=inner) + tc("b")])))
    assert [x[0] for x in rows[0]] == ["adeep", "b"] and [b["kind"] for b in t["rows"][0]["cells"][0]["blocks"]] == ["paragraph", "table", "paragraph"]
    _, t = cells(read(tbl([tc("a", '<w:tcW w:w="1000" w:type="dxa"/>') + tc("b")], '<w:tblW w:w="6000" w:type="dxa"/>', columns=())))
    assert sum(t["grid"]) == 6000 and t["grid"] == [3000, 3000]


def test_table_styles():
    style = '<w:style w:type="table" w:styleId="G"><w:tblPr><w:tblStyleRowBandSize w:val="1"/><w:tblBorders><w:insideH w:val="single" w:sz="4" w:color="808080"/></w:tblBorders></w:tblPr><w:tcPr><w:shd w:val="clear" w:fill="FFFFFF"/></w:tcPr><w:tblStylePr w:type="firstRow"><w:rPr><w:b/></w:rPr><w:tcPr><w:shd w:val="clear" w:fill="D9E2F3"/></w:tcPr></w:tblStylePr><w:tblStylePr w:type="band2Horz"><w:tcPr><w:shd w:val="clear" w:fill="EEEEEE"/></w:tcPr></w:tblStylePr></w:style>'
    props = '<w:tblStyle w:val="G"/><w:tblLook w:firstRow="1" w:lastRow="0" w:firstColumn="0" w:lastColumn="0" w:noHBand="0" w:noVBand="1"/>'
    _, t = cells(read(tbl(["<w:trPr><w:tblHeader/></w:trPr>" + tc("h"), tc("a"), tc("b"), tc("c")], props, columns=(2500,)), styles=style))
    got = [r["cells"][0]["props"] for r in t["rows"]]
    assert [c["shading"] for c in got] == ["D9E2F3", "FFFFFF", "EEEEEE", "FFFFFF"] and t["rows"][0]["header"] and not t["rows"][1]["header"]
    assert t["rows"][0]["cells"][0]["blocks"][0]["inlines"][0]["run"]["bold"] and not t["rows"][1]["cells"][0]["blocks"][0]["inlines"][0]["run"]["bold"]
    assert got[0]["borders"]["bottom"]["color"] == "808080" and got[0]["borders"]["top"] is None and got[3]["borders"]["bottom"] is None
    assert word_tables.look(None) == {"firstRow": True, "lastRow": False, "firstColumn": True, "lastColumn": False, "noHBand": False, "noVBand": True}


def test_drawings():
    rels = '<Relationship Id="pic" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/none.png"/><Relationship Id="far" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="http://x/y.png" TargetMode="External"/>'
    vml = lambda i: f'<w:p><w:r><w:pict><v:group><v:shape style="width:20pt;height:10pt"><v:imagedata r:id="{i}"/></v:shape><v:shape><v:textbox><w:txbxContent>{p("boxed")}</w:txbxContent></v:textbox></v:shape></v:group></w:pict><w:t>t</w:t></w:r></w:p>'
    m = read(vml("pic") + vml("far") + vml("zz"), rels=rels)
    assert document_text(m["blocks"]) == ["t", "boxed", "t", "boxed", "t", "boxed"] and len(m["warnings"]) == 3
    made = to_word(model(f"<p><img src='data:image/gif;base64,{base64.b64encode(GIF).decode()}' style='float:left'></p>"))
    x = read_package(made)["blocks"][0]["inlines"][0]
    assert x["side"] == "left" and x["media"] == images.inspect(GIF)["hash"]


def test_hostile_packages():
    for data in (b"", b"PK", package("")[:100], package("<w:p>").replace(b"</w:body>", b"")):
        with pytest.raises((PackageError, ValueError)):
            read_package(data)
    with pytest.raises(PackageError) as e:
        read_package(package(p("x" * 9999)), {"limits": {"most_entry": 500}})
    assert e.value.kind == "too_large"
    strict = package(p("s")).replace(b"", b"")
    assert document_text(read_package(strict)["blocks"]) == ["s"]


# There and back.

WHOLE = f"""<h1 id=top>Title <i>it</i></h1><p style="text-align:justify;margin-left:20pt;text-indent:-10pt;line-height:1.5">a <b>b</b> <u>c</u> <s>d</s> <sup>e</sup> <span style="font-size:8pt;color:#336699;background-color:#ffee00;letter-spacing:1pt;font-variant:small-caps">f</span></p>
<ol><li>one<ul><li>in</ul><li>two</ol><blockquote>quote</blockquote><table border=1><caption>cap</caption><thead><tr><th>h<th>i</thead><tr><td rowspan=2 style="border:1pt solid red;padding:3pt">x<td bgcolor=silver>y<tr><td>z</table>
<pre>k  l\n\tm</pre><p>see <a href="#top">up</a>, <a href="http://e.x/?a=1&amp;b=2">out</a><br>next</p><p dir=rtl>r</p><p style="page-break-before:always">last</p>{NOTES}"""


@pytest.mark.parametrize("editor", ["plain", "suneditor", "ckeditor", "tinymce", "tiptap"])
def test_html_is_stable(editor):
    once, _ = to_html(model(WHOLE + (COMMENTS if editor != "plain" else ""), editor), editor)
    again, _ = to_html(model(once, editor), editor)
    third, _ = to_html(model(again, editor), editor)
    assert document_text(model(once, editor)["blocks"]) == document_text(model(again, editor)["blocks"]) and again == third


def test_packages_are_stable():
    m = model(WHOLE)
    first = to_word(m)
    assert first == to_word(model(WHOLE))
    back = read_package(first)
    assert document_text(back["blocks"]) == document_text(m["blocks"])
    for a, b in zip((x for x in m["blocks"] if x["kind"] == "paragraph"), (x for x in back["blocks"] if x["kind"] == "paragraph")):
        assert {k: b["props"][k] for k in ("align", "left", "right", "first", "line", "shading", "bidi", "page_break")} == {k: a["props"].get(k) or ({"bidi": False, "page_break": False, "left": 0, "right": 0, "first": 0}.get(k)) for k in ("align", "left", "right", "first", "line", "shading", "bidi", "page_break")}
        looks = lambda p: [(x["kind"], x.get("text"), {k: v for k, v in x["run"].items() if k != "kerning"}) for x in p["inlines"] if x["kind"] in ("text", "break", "tab")]
        assert looks(a) == looks(b)
    second = read_package(to_word(back))
    assert document_text(second["blocks"]) == document_text(m["blocks"])


INLINE = st.recursive(st.sampled_from(["a", " b ", "c\n", "&amp;", "é", "<br>", " "]), lambda x: st.builds(lambda t, y: f"<{t}>{''.join(y)}</{t}>", st.sampled_from(["b", "i", "u", "span", "sup", "code", "a href=x"]), st.lists(x, max_size=4)), max_leaves=10)
BLOCK = st.recursive(st.builds(lambda t, y: f"<{t}>{''.join(y)}</{t}>", st.sampled_from(["p", "div", "h2", "pre", "li"]), st.lists(INLINE, max_size=4)), lambda x: st.builds(lambda t, y: f"<{t}>{''.join(y)}</{t.split()[0]}>", st.sampled_from(["div", "ul", "ol start=4", "blockquote", "table", "td"]), st.lists(x, max_size=4)), max_leaves=8)


@settings(max_examples=120, deadline=None)
@given(st.lists(BLOCK, max_size=5).map("".join))
def test_any_page_survives(html):
    m = model(html)
    text = document_text(m["blocks"])
    assert document_text(read_package(to_word(m))["blocks"]) == text
    once, _ = to_html(m)
    strip = lambda x: [t.strip() for t in x if t.strip()]
    assert strip(document_text(model(once)["blocks"])) == strip(text)


def test_symbol_fonts():
    places = {name: [len(signs)] for name, signs in symbols.FONTS.items()}
    assert places == {"symbol": [190], "wingdings": [223]}
    known = {("Symbol", 0x61): "α", ("Symbol", 0xF0B7): "•", ("Symbol", 0xDE): "⇒", ("Symbol", 0xFE): "⎭", ("Wingdings", 0x69): "♓", ("WINGDINGS", 0xF0E0): "🡪", ("Wingdings", 0x95): "➓", ("Wingdings", 0xC2): "🕛", ("Wingdings", 0xFE): "🗹"}
    assert {k: symbols.symbol(*k) for k in known} == known
    assert symbols.symbol("Symbol", 0x7F) is symbols.symbol("Arial", 0x61) is symbols.symbol(None, 0x61) is symbols.symbol("Symbol", -1) is None


def test_markers_hang_as_their_font_asks():
    page = '<style>body {font: 10pt Arial}</style><ol><li>a<li style="font-family: Nowhere">b</ol><ul><li>c<li style="list-style-type: square; font-size: 20pt">d</ul><ul style="list-style-position: inside"><li>e</ul>'
    m = model(page)
    levels = {d["num_id"]: d["levels"][0] for d in m["lists"]}
    got = [(-x["props"]["first"], levels[x["props"]["num_id"]]["hanging"], levels[x["props"]["num_id"]]["align"]) for x in m["blocks"]]
    disc, square = round(((0.177 + 0.4645) * 10 + 4.54) * 20), round(((0.229 + 0.4645) * 20 + 4.54) * 20)
    assert got == [(56, 56, "right"), (360, 360, "left"), (disc, disc, "left"), (square, square, "left"), (0, 0, "left")]
