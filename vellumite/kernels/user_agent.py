"""Default style sheets: how elements look before any author speaks, after the HTML standard's rendering section."""

# What browsers give to elements (HTML standard, section "Rendering").
DISPLAY = """
html, body, address, article, aside, blockquote, center, dd, details, dialog, div, dl, dt, fieldset, figcaption, figure,
footer, form, h1, h2, h3, h4, h5, h6, header, hgroup, hr, legend, listing, main, menu, nav, ol, p, plaintext, pre,
search, section, summary, ul, xmp { display: block }
li { display: list-item }
table { display: table } caption { display: table-caption } thead { display: table-header-group } tbody { display: table-row-group }
tfoot { display: table-footer-group } tr { display: table-row } td, th { display: table-cell }
[hidden], area, base, datalist, head, link, meta, noembed, noframes, param, rp, script, style, template, title { display: none }
"""
LOOKS = """
b, strong { font-weight: bold } i, em, cite, dfn, var, address { font-style: italic }
u, ins { text-decoration: underline } s, strike, del { text-decoration: line-through }
code, kbd, samp, tt, pre { font-family: monospace } big { font-size: larger } small { font-size: smaller }
sub { vertical-align: sub; font-size: smaller } sup { vertical-align: super; font-size: smaller }
mark { background-color: yellow; color: black } a[href] { color: #0000EE; text-decoration: underline }
center { text-align: center } pre, textarea { white-space: pre } nobr { white-space: nowrap }
h1 { font-size: 2em; margin: 0.67em 0; font-weight: bold } h2 { font-size: 1.5em; margin: 0.83em 0; font-weight: bold }
h3 { font-size: 1.17em; margin: 1em 0; font-weight: bold } h4 { margin: 1.33em 0; font-weight: bold }
h5 { font-size: 0.83em; margin: 1.67em 0; font-weight: bold } h6 { font-size: 0.67em; margin: 2.33em 0; font-weight: bold }
p, dl, menu, ol, ul { margin-top: 1em; margin-bottom: 1em } blockquote, figure { margin: 1em 40px } dd { margin-left: 40px }
ol, ul, menu { padding-left: 40px } ol { list-style-type: decimal } ul, menu { list-style-type: disc }
ul ul, ol ul, menu ul { list-style-type: circle } ul ul ul, ol ul ul, ul ol ul, ol ol ul { list-style-type: square }
ul ul, ul ol, ol ul, ol ol, li > menu { margin-top: 0; margin-bottom: 0 } pre { margin: 1em 0 }
th { font-weight: bold; text-align: center } td, th { padding: 1px; vertical-align: middle } caption { text-align: center }
hr { border-top: 1px solid gray; margin: 0.5em 0 } fieldset { border: 2px solid silver; padding: 0.35em 0.75em 0.625em }
bdo[dir=rtl] { direction: rtl } bdo[dir=ltr] { direction: ltr }
"""
# What the editors' own content sheets change, by profile; the plain profile is the browser's.
PROFILES = {
    "plain": "",
    "suneditor": """
p { margin: 0 0 10px 0 } li { margin-bottom: 5px } dl { margin: 0 0 10px } a { color: #0056b3; text-decoration: none } a[href] { color: #0056b3; text-decoration: none }
pre { white-space: pre-wrap; color: #666; line-height: 1.45; margin: 0 0 10px; padding: 8px; background-color: #f9f9f9; border: 1px solid #e1e1e1 }
blockquote { color: #999; margin: 1em 0; padding: 0 5px 0 20px; border-left: 5px solid #b1b1b1 }
ol ol, ul ol { list-style-type: lower-alpha } ol ol ol, ul ol ol, ul ul ol { list-style-type: upper-roman }
hr { border: 0; border-top: 1px solid #333; height: 20px; margin: 20px 0 0 0 } hr.__se__dotted { border-top-style: dotted } hr.__se__dashed { border-top-style: dashed }
table { width: 100%; margin: 0 0 10px; border: 1px solid #cecece } td, th { border: 1px solid #cecece; padding: 0.4em }
figure { margin: 0 } figcaption { text-align: center; padding: 1em 0.5em; background-color: #f9f9f9 } .se-component { margin: 0 0 10px } .se-inline-component { display: inline-block; margin: 0 }
.__se__float-left { text-align: left } .__se__float-center { text-align: center } .__se__float-right { text-align: right }
.__se__p-spaced { letter-spacing: 1px } .__se__p-bordered { border-top: 1px solid #b1b1b1; border-bottom: 1px solid #b1b1b1; padding: 4px 0 }
.__se__p-neon { font-weight: 200; font-style: italic; color: #fff; background-color: #000; border: 2px solid #fff; padding: 6px 4px; text-transform: uppercase }
.__se__t-shadow { text-shadow: 0 0 0.2rem #999 } .__se__t-code { font-family: monospace; color: #666; background-color: rgba(27, 31, 35, 0.05) }""",
    "ckeditor": """
table { border: 1px double #b3b3b3 } td, th { border: 1px solid #bfbfbf; padding: 0.4em } th { background-color: #f2f2f2 } table.table { margin: 0.9em auto }
blockquote { margin-left: 0; margin-right: 0; padding-left: 1.5em; padding-right: 1.5em; font-style: italic; border-left: 5px solid #cccccc; overflow: hidden }
pre { color: #353535; white-space: pre-wrap; background-color: #dddddd; border: 1px solid #c4c4c4; margin: 0.9em 0; padding: 1em } code { background-color: #dddddd }
.image { text-align: center; margin: 0.9em auto } .image > figcaption { padding: 0.6em; font-size: 0.75em; text-align: center }
.image-style-align-left { float: left; margin-right: 1.5em } .image-style-align-right, .image-style-side { float: right; margin-left: 1.5em }
.text-tiny { font-size: 0.7em } .text-small { font-size: 0.85em } .text-big { font-size: 1.4em } .text-huge { font-size: 1.8em }
.marker-yellow { background-color: #fdfd77 } .marker-green { background-color: #62f962 } .marker-pink { background-color: #fc7899 } .marker-blue { background-color: #72ccfd }
.pen-red { color: #e71313 } .pen-green { color: #128a00 }""",
    "tinymce": """
table:not([cellpadding]) th, table:not([cellpadding]) td { padding: 0.4rem } table[border]:not([border="0"]) th, table[border]:not([border="0"]) td { border: 1px solid #cccccc }
figure { margin: 1rem auto } figure figcaption { margin-top: 0.25rem; text-align: center }""",
    "tiptap": "",
}


def sheet(editor: str = "plain") -> str:
    return DISPLAY + LOOKS + PROFILES[editor]
