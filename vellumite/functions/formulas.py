"""Formulas: LaTeX to a tree, and the tree to OMML, MathML and LaTeX.

A tree node is a tuple: ("run", text), ("upright", text), ("row", nodes), ("frac", a, b), ("rad", degree or
None, a), ("scripts", base, sub or None, sup or None), ("nary", sign, sub, sup), ("func", name),
("delim", left, right, a), ("matrix", rows, left, right), ("eqarr", rows), ("accent", char, a), ("bar", place, a),
("box", a), ("limit", low or upp, a, limit), ("group", sign, place, a).
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Commands and their characters.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π",
    "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "ϕ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ",
    "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω", "infty": "∞", "partial": "∂", "nabla": "∇", "pm": "±", "mp": "∓", "times": "×", "div": "÷", "cdot": "⋅", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡",
    "sim": "∼", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "cup": "∪", "cap": "∩", "forall": "∀", "exists": "∃", "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftrightarrow": "⇔", "ldots": "…", "cdots": "⋯", "emptyset": "∅", "propto": "∝", "angle": "∠", "perp": "⊥", "degree": "°",
}
BIG = {"sum": "∑", "prod": "∏", "int": "∫", "iint": "∬", "iiint": "∭", "oint": "∮", "bigcup": "⋃", "bigcap": "⋂"}
FUNCTIONS = ("arccos", "arcsin", "arctan", "cos", "cosh", "cot", "csc", "det", "exp", "gcd", "lim", "ln", "log", "max", "min", "sec", "sin", "sinh", "sup", "inf", "tan", "tanh")
ACCENTS = {"hat": "̂", "tilde": "̃", "vec": "⃗", "dot": "̇", "ddot": "̈", "bar": "̅"}
BLACKBOARD = {"R": "ℝ", "N": "ℕ", "Z": "ℤ", "Q": "ℚ", "C": "ℂ"}
MATRICES = {"matrix": ("", ""), "pmatrix": ("(", ")"), "bmatrix": ("[", "]"), "vmatrix": ("|", "|"), "Bmatrix": ("{", "}"), "cases": ("{", "")}
GROUPS = {"underbrace": ("⏟", "bot"), "overbrace": ("⏞", "top"), "underbracket": ("⎵", "bot"), "overbracket": ("⎴", "top")}
LIMITS = {"underset": "low", "overset": "upp", "stackrel": "upp"}
_BACK = {v: k for k, v in SYMBOLS.items()}

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[{}^_&]|\s+|[0-9]+(?:\.[0-9]+)?|.", re.S)


def tokenise(latex: str) -> list[str]:
    return [t if not t.isspace() else " " for t in _TOKEN.findall(latex)]


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        while self.at < len(self.tokens) and self.tokens[self.at] == " ":
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def next(self) -> str | None:
        t = self.peek()
        self.at += t is not None
        return t

    def row(self, stop: tuple[str, ...] = ()) -> tuple:
        out = []
        while (t := self.peek()) is not None and t not in stop:
            out.append(self.scripted())
        return out[0] if len(out) == 1 else ("row", out)

    def argument(self) -> tuple:
        if self.peek() == "{":
            self.next()
            got = self.row(("}",))
            self.next()
            return got
        return self.atom()

    def raw(self) -> str:
        """The text of a braced argument as it stands."""
        if self.peek() != "{":
            return self.next() or ""
        self.next()
        depth, out = 1, []
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            self.at += 1
            depth += {"{": 1, "}": -1}.get(t, 0)
            if not depth:
                break
            out.append(t)
        return "".join(out)

    def scripted(self) -> tuple:
        base, sub, sup = self.atom(), None, None
        while self.peek() in ("^", "_"):
            mark = self.next()
            value = self.argument()
            sub, sup = (value, sup) if mark == "_" else (sub, value)
        if base[0] == "nary":
            return ("nary", base[1], sub, sup)
        return base if sub is None and sup is None else ("scripts", base, sub, sup)

    def delimiter(self) -> str:
        t = self.next() or ""
        return {"\\{": "{", "\\}": "}", "\\|": "‖", ".": "", "\\langle": "⟨", "\\rangle": "⟩"}.get(t, t)

    def atom(self) -> tuple:
        t = self.next()
        if t is None or t in ("}", "&", "^", "_"):
            return ("run", "")
        if t == "{":
            self.at -= 1
            return self.argument()
        if not t.startswith("\\"):
            return ("run", t)
        name = t[1:]
        if name in ("frac", "dfrac", "tfrac"):
            return ("frac", self.argument(), self.argument())
        if name == "sqrt":
            degree = None
            if self.peek() == "[":
                self.next()
                degree = self.row(("]",))
                self.next()
            return ("rad", degree, self.argument())
        if name == "left":
            left = self.delimiter()
            inner = self.row(("\\right",))
            self.next()
            return ("delim", left, self.delimiter(), inner)
        if name == "begin":
            return self.environment(self.raw())
        if name in BIG:
            return ("nary", BIG[name], None, None)
        if name in FUNCTIONS:
            return ("func", name)
        if name in ("overline", "underline"):
            return ("bar", "top" if name == "overline" else "bot", self.argument())
        if name == "boxed":
            return ("box", self.argument())
        if name in LIMITS:
            limit = self.argument()
            return ("limit", LIMITS[name], self.argument(), limit)
        if name in GROUPS:
            return ("group", *GROUPS[name], self.argument())
        if name in ACCENTS:
            return ("accent", ACCENTS[name], self.argument())
        if name == "mathbb":
            letter = self.raw()
            return ("run", BLACKBOARD.get(letter, letter))
        if name in ("text", "mathrm", "operatorname"):
            return ("upright", self.raw())
        if name in SYMBOLS:
            return ("run", SYMBOLS[name])
        return ("run", {",": " ", ";": " ", "!": "", "quad": " ", "qquad": "  "}.get(name, name if len(name) == 1 else ""))

    def environment(self, name: str) -> tuple:
        rows: list[list[tuple]] = [[]]
        while True:
            rows[-1].append(self.row(("&", "\\\\", "\\end")))
            t = self.next()
            if t == "\\\\":
                rows.append([])
            elif t != "&":
                break
        self.raw()
        if rows[-1] == [("row", [])]:
            rows.pop()
        if name.rstrip("*") in ("aligned", "align", "gathered"):
            return ("eqarr", rows)
        return ("matrix", rows, *MATRICES.get(name, ("", "")))


def parse_latex(latex: str) -> tuple:
    return _Reader(tokenise(latex)).row()


def _esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


M = "http://schemas.openxmlformats.org/officeDocument/2006/math"


def _gathered(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring runs as one, and scripts of an empty base as scripts before what follows."""
    out: list[tuple] = []
    for node in nodes:
        last = out[-1] if out else None
        if last and last[0] == "scripts" and last[1] in (("row", []), ("run", "")):
            out[-1] = ("pre", last[2], last[3], node)
        elif last and node[0] == last[0] == "run" and "&" not in (node[1], last[1]):
            out[-1] = ("run", last[1] + node[1])
        else:
            out.append(node)
    return out


def to_omml(node: tuple) -> str:
    """The OMML children of a tree; m:oMath is left to the caller."""
    kind, *x = node
    part = lambda tag, n: f"<m:{tag}>{to_omml(n) if n is not None else ''}</m:{tag}>"
    if kind == "row":
        return "".join(map(to_omml, _gathered(x[0])))
    if kind == "pre":
        return f"<m:sPre>{part('sub', x[0])}{part('sup', x[1])}{part('e', x[2])}</m:sPre>"
    if kind == "box":
        return f"<m:borderBox>{part('e', x[0])}</m:borderBox>"
    if kind == "limit":
        tag = "limLow" if x[0] == "low" else "limUpp"
        return f"<m:{tag}>{part('e', x[1])}{part('lim', x[2])}</m:{tag}>"
    if kind == "group":
        return f'<m:groupChr><m:groupChrPr><m:chr m:val="{x[0]}"/><m:pos m:val="{x[1]}"/></m:groupChrPr>{part("e", x[2])}</m:groupChr>'
    if kind == "run":
        return f"<m:r><m:t>{_esc(x[0])}</m:t></m:r>" if x[0] else ""
    if kind == "upright":
        return f'<m:r><m:rPr><m:sty m:val="p"/></m:rPr><m:t>{_esc(x[0])}</m:t></m:r>'
    if kind == "func":
        return f'<m:r><m:rPr><m:sty m:val="p"/></m:rPr><m:t>{x[0]}</m:t></m:r>'
    if kind == "frac":
        return f"<m:f>{part('num', x[0])}{part('den', x[1])}</m:f>"
    if kind == "rad":
        hide = "" if x[0] is not None else '<m:radPr><m:degHide m:val="1"/></m:radPr>'
        return f"<m:rad>{hide}{part('deg', x[0])}{part('e', x[1])}</m:rad>"
    if kind == "scripts":
        tag = "sSubSup" if x[1] is not None and x[2] is not None else "sSub" if x[1] is not None else "sSup"
        return f"<m:{tag}>{part('e', x[0])}{part('sub', x[1]) if x[1] is not None else ''}{part('sup', x[2]) if x[2] is not None else ''}</m:{tag}>"
    if kind == "nary":
        hide = ('<m:subHide m:val="1"/>' if x[1] is None else "") + ('<m:supHide m:val="1"/>' if x[2] is None else "")
        return f'<m:nary><m:naryPr><m:chr m:val="{x[0]}"/>{hide}</m:naryPr>{part("sub", x[1])}{part("sup", x[2])}<m:e/></m:nary>'
    if kind == "delim":
        return f'<m:d><m:dPr><m:begChr m:val="{_esc(x[0])}"/><m:endChr m:val="{_esc(x[1])}"/></m:dPr>{part("e", x[2])}</m:d>'
    if kind == "matrix":
        inner = "<m:m>" + "".join("<m:mr>" + "".join(part("e", c) for c in r) + "</m:mr>" for r in x[0]) + "</m:m>"
        return f'<m:d><m:dPr><m:begChr m:val="{_esc(x[1])}"/><m:endChr m:val="{_esc(x[2])}"/></m:dPr><m:e>{inner}</m:e></m:d>' if x[1] or x[2] else inner
    if kind == "eqarr":
        return "<m:eqArr>" + "".join("<m:e>" + "<m:r><m:t>&amp;</m:t></m:r>".join(map(to_omml, r)) + "</m:e>" for r in x[0]) + "</m:eqArr>"
    if kind == "accent":
        return f'<m:acc><m:accPr><m:chr m:val="{x[0]}"/></m:accPr>{part("e", x[1])}</m:acc>'
    return f'<m:bar><m:barPr><m:pos m:val="{x[0]}"/></m:barPr>{part("e", x[1])}</m:bar>'


def omml(latex: str) -> str:
    return f'<m:oMath xmlns:m="{M}">{to_omml(parse_latex(latex))}</m:oMath>'


def _text_latex(text: str) -> str:
    back = {v: f"\\mathbb{{{k}}}" for k, v in BLACKBOARD.items()}
    out = ""
    for c in text:
        new = back.get(c) or ("\\" + _BACK[c] if c in _BACK else "\\" + c if c in "{}%$#" else c)
        out += (" " if re.search(r"\\[A-Za-z]+\Z", out) and new[0].isalpha() else "") + new
    return out


def _joined(parts: list[str]) -> str:
    out = ""
    for p in parts:
        out += (" " if p and re.search(r"\\[A-Za-z]+\Z", out) and p[0].isalpha() else "") + p
    return out


def from_omml(e: ElementTree.Element) -> str:
    """LaTeX of an OMML element's children."""
    m = f"{{{M}}}"
    get = lambda x, path: x.find("/".join(m + p for p in path.split("/")))
    val = lambda x, path, other="": (got.get(m + "val", other) if (got := get(x, path)) is not None else other)
    inner = lambda x, tag: from_omml(get(x, tag)) if get(x, tag) is not None else ""
    back = {**{v: "\\" + k for k, v in BIG.items()}}
    out = []
    for c in e:
        tag = c.tag.removeprefix(m)
        if c.tag.endswith("}r"):
            text = "".join(t.text or "" for t in c.iter() if t.tag.endswith("}t"))
            plain = val(c, "rPr/sty") == "p" or get(c, "rPr/nor") is not None
            out.append("&" if text == "&" else "\\" + text if plain and text in FUNCTIONS else f"\\text{{{text}}}" if plain else _text_latex(text))
        elif tag == "f":
            out.append(f"\\frac{{{inner(c, 'num')}}}{{{inner(c, 'den')}}}")
        elif tag == "rad":
            degree = inner(c, "deg")
            out.append(f"\\sqrt{f'[{degree}]' if degree else ''}{{{inner(c, 'e')}}}")
        elif tag in ("sSub", "sSup", "sSubSup"):
            base = inner(c, "e")
            out.append((base if len(base) == 1 or re.fullmatch(r"\\[A-Za-z]+", base) else f"{{{base}}}") + (f"_{{{inner(c, 'sub')}}}" if tag != "sSup" else "") + (f"^{{{inner(c, 'sup')}}}" if tag != "sSub" else ""))
        elif tag == "nary":
            sub, sup = inner(c, "sub"), inner(c, "sup")
            out.append(back.get(val(c, "naryPr/chr", "∫"), "\\int") + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + (" " + inner(c, "e") if inner(c, "e") else ""))
        elif tag == "d":
            left, right = val(c, "dPr/begChr", "("), val(c, "dPr/endChr", ")")
            matrix = get(c, "e/m")
            name = next((n for n, pair in MATRICES.items() if pair == (left, right)), None)
            if matrix is not None and name:
                out.append(_matrix(matrix, name, m))
            else:
                show = lambda s: {"": ".", "{": "\\{", "}": "\\}"}.get(s, s)
                out.append(f"\\left{show(left)}{inner(c, 'e')}\\right{show(right)}")
        elif tag == "m":
            out.append(_matrix(c, "matrix", m))
        elif tag == "eqArr":
            out.append("\\begin{aligned}" + "\\\\".join(from_omml(r) for r in c.findall(m + "e")) + "\\end{aligned}")
        elif tag == "acc":
            sign = val(c, "accPr/chr", "̂")
            out.append(f"\\{next((k for k, v in ACCENTS.items() if v == sign), 'hat')}{{{inner(c, 'e')}}}")
        elif tag == "bar":
            out.append(f"\\{'underline' if val(c, 'barPr/pos') == 'bot' else 'overline'}{{{inner(c, 'e')}}}")
        elif tag == "func":
            name = inner(c, "fName")
            out.append(f"{chr(92) + name if name in FUNCTIONS else name} {inner(c, 'e')}")
        elif tag == "sPre":
            out.append(f"{{}}_{{{inner(c, 'sub')}}}^{{{inner(c, 'sup')}}}{inner(c, 'e')}")
        elif tag in ("limLow", "limUpp"):
            base, limit = inner(c, "e"), inner(c, "lim")
            base = "\\" + base if base in FUNCTIONS else base
            if base.removeprefix("\\") in FUNCTIONS:
                out.append(f"{base}{'_' if tag == 'limLow' else '^'}{{{limit}}}")
            else:
                out.append(f"\\{'underset' if tag == 'limLow' else 'overset'}{{{limit}}}{{{base}}}")
        elif tag == "groupChr":
            found = (val(c, "groupChrPr/chr", "⏟"), val(c, "groupChrPr/pos", "bot"))
            name = next((k for k, v in GROUPS.items() if v == found), None)
            out.append(f"\\{name}{{{inner(c, 'e')}}}" if name else f"\\{'underset' if found[1] == 'bot' else 'overset'}{{{_text_latex(found[0])}}}{{{inner(c, 'e')}}}")
        elif tag == "borderBox":
            out.append(f"\\boxed{{{inner(c, 'e')}}}")
        elif not c.tag.endswith("Pr"):
            out.append(from_omml(c))
    return _joined(out)


def _matrix(e: ElementTree.Element, name: str, m: str) -> str:
    rows = ["&".join(from_omml(x) for x in r.findall(m + "e")) for r in e.findall(m + "mr")]
    return f"\\begin{{{name}}}" + "\\\\".join(rows) + f"\\end{{{name}}}"


def latex_of(omml_xml: str) -> str:
    return from_omml(ElementTree.fromstring(omml_xml))


def to_mathml(node: tuple) -> str:
    kind, *x = node
    one = to_mathml
    if kind == "row":
        return "<mrow>" + "".join(map(one, x[0])) + "</mrow>"
    if kind == "run":
        t = x[0]
        return "" if not t else f"<mn>{t}</mn>" if t[0].isdigit() else f"<mi>{_esc(t)}</mi>" if t.isalpha() else f"<mo>{_esc(t)}</mo>"
    if kind == "upright":
        return f"<mtext>{_esc(x[0])}</mtext>"
    if kind == "func":
        return f"<mi>{x[0]}</mi>"
    if kind == "frac":
        return f"<mfrac>{one(x[0])}{one(x[1])}</mfrac>"
    if kind == "rad":
        return f"<msqrt>{one(x[1])}</msqrt>" if x[0] is None else f"<mroot>{one(x[1])}{one(x[0])}</mroot>"
    if kind in ("scripts", "nary"):
        base = one(x[0]) if kind == "scripts" else f"<mo>{x[0]}</mo>"
        over = kind == "nary" and x[0] not in "∫∬∭∮"
        tags = ("munder", "mover", "munderover") if over else ("msub", "msup", "msubsup")
        if x[1] is None and x[2] is None:
            return base
        tag = tags[2] if x[1] is not None and x[2] is not None else tags[0] if x[1] is not None else tags[1]
        return f"<{tag}>{base}{''.join(one(n) for n in x[1:] if n is not None)}</{tag}>"
    if kind == "delim":
        return f"<mrow><mo>{_esc(x[0])}</mo>{one(x[2])}<mo>{_esc(x[1])}</mo></mrow>"
    if kind in ("matrix", "eqarr"):
        table = "<mtable>" + "".join("<mtr>" + "".join(f"<mtd>{one(c)}</mtd>" for c in r) + "</mtr>" for r in x[0]) + "</mtable>"
        return f"<mrow><mo>{_esc(x[1])}</mo>{table}<mo>{_esc(x[2])}</mo></mrow>" if kind == "matrix" and (x[1] or x[2]) else table
    if kind == "box":
        return f'<menclose notation="box">{one(x[0])}</menclose>'
    if kind == "limit":
        tag = "munder" if x[0] == "low" else "mover"
        return f"<{tag}>{one(x[1])}{one(x[2])}</{tag}>"
    if kind == "group":
        tag = "munder" if x[1] == "bot" else "mover"
        return f"<{tag}>{one(x[2])}<mo>{x[0]}</mo></{tag}>"
    if kind == "accent":
        return f'<mover accent="true">{one(x[1])}<mo>{x[0]}</mo></mover>'
    return f"<{'munder' if x[0] == 'bot' else 'mover'}>{one(x[1])}<mo>{'_' if x[0] == 'bot' else '¯'}</mo></{'munder' if x[0] == 'bot' else 'mover'}>"


def mathml(latex: str, display: bool = False) -> str:
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML"{" display=\"block\"" if display else ""}><semantics>{to_mathml(("row", [parse_latex(latex)]))}<annotation encoding="application/x-tex">{_esc(latex)}</annotation></semantics></math>'


def convert_formulas(formulas: DataFrame, latex: str = "latex") -> DataFrame:
    """formulas with `omml`, `mathml` and `back` (LaTeX read back from the OMML); nulls stay null."""
    names = [*formulas.columns, "omml", "mathml", "back"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in formulas.dtypes), "omml string, mathml string, back string"])
    at = formulas.columns.index(latex)

    def run(batches):
        for b in batches:
            source = b.column(at).to_pylist()
            made = [omml(x) if x is not None else None for x in source]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string()), pa.array([mathml(x) if x is not None else None for x in source], pa.string()), pa.array([latex_of(x) if x is not None else None for x in made], pa.string())], names=names)

    return formulas.select(*[F.col(c) for c in formulas.columns]).mapInArrow(run, schema)
