"""CSS selectors of one document: compiled to predicates on elements.

A selector is a list of alternatives; an alternative is compounds joined by combinators and is matched from
the right. What is not understood makes the selector invalid, so its rule never applies.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from vellumite.kernels.dom import Node

Test = Callable[[Node], bool]
Counts = tuple[int, int, int]
_NAME = r"-?(?:[A-Za-z_\u0080-￿]|\\.)(?:[\w\u0080-￿-]|\\.)*"
_ATTRIBUTE = re.compile(rf"\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*([is])?)?\s*\]", re.I)
# Pseudo-elements in the old writing.
_PSEUDO_ELEMENTS = {"before", "after", "first-line", "first-letter"}


class Invalid(ValueError):
    pass


def _sum(a: Counts, b: Counts) -> Counts:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _inside(text: str, at: int) -> tuple[str, int]:
    """What stands in the brackets opened before `at`, and the place after them."""
    depth, quote, i = 1, "", at
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at:i], i + 1
        i += 1
    raise Invalid(text)


def _nth(formula: str) -> Callable[[int], bool]:
    """an+b, odd, even or a number: whether a place (from 1) is one of them."""
    low = re.sub(r"\s+", "", formula.lower())
    low = {"odd": "2n+1", "even": "2n"}.get(low, low)
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", low):
        a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
        b = int(m[2] or 0)
    elif re.fullmatch(r"[+-]?\d+", low):
        a, b = 0, int(low)
    else:
        raise Invalid(formula)
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _place(node: Node, of_type: bool, last: bool, among: Test | None = None) -> int:
    own = [x for x in node.siblings() if (not of_type or x.tag == node.tag) and (among is None or among(x))]
    at = next((i for i, x in enumerate(own) if x is node), -1)
    return 0 if at < 0 else len(own) - at if last else at + 1


_CONTROLS = {"input", "button", "select", "textarea", "option", "optgroup", "fieldset"}
# Pseudo-classes without arguments that a still document can answer; those of a reader's actions never hold.
_SIMPLE: dict[str, Test] = {
    "root": lambda n: n.parent is None or n.parent.tag == "#document",
    "empty": lambda n: not any(c.tag[0] != "#" or (c.tag == "#text" and c.text) for c in n.children),
    "first-child": lambda n: _place(n, False, False) == 1,
    "last-child": lambda n: _place(n, False, True) == 1,
    "only-child": lambda n: len(n.siblings()) == 1,
    "first-of-type": lambda n: _place(n, True, False) == 1,
    "last-of-type": lambda n: _place(n, True, True) == 1,
    "only-of-type": lambda n: _place(n, True, False) == 1 == _place(n, True, True),
    "link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
    "any-link": lambda n: n.tag in ("a", "area") and "href" in n.attrs,
    "checked": lambda n: "checked" in n.attrs or (n.tag == "option" and "selected" in n.attrs),
    "disabled": lambda n: n.tag in _CONTROLS and "disabled" in n.attrs,
    "enabled": lambda n: n.tag in _CONTROLS and "disabled" not in n.attrs,
    "required": lambda n: "required" in n.attrs,
    "optional": lambda n: n.tag in ("input", "select", "textarea") and "required" not in n.attrs,
    **{k: lambda n: False for k in ("hover", "active", "focus", "focus-within", "focus-visible", "visited", "target")},
}


def _pseudo(name: str, argument: str | None) -> tuple[Test, Counts]:
    if name in _PSEUDO_ELEMENTS:
        raise Invalid(name)
    if argument is None:
        if name not in _SIMPLE:
            raise Invalid(name)
        return _SIMPLE[name], (0, 1, 0)
    if name in ("is", "where", "not"):
        inner, counts = _selector(argument)
        return (lambda n: not inner(n)) if name == "not" else inner, (0, 0, 0) if name == "where" else counts
    if name == "has":
        return _has(argument)
    if m := re.fullmatch(r"nth-(last-)?(child|of-type)", name):
        formula, of, among = argument.partition(" of ")
        holds, last, kind = _nth(formula), bool(m[1]), m[2] == "of-type"
        test = compiled(among) if of else None
        return (lambda n: (place := _place(n, kind, last, test)) > 0 and holds(place)), (0, 1, 0)
    if name == "lang":
        wanted = [x.strip().strip("\"'").lower() for x in argument.split(",")]

        def speaks(n: Node | None) -> bool:
            while n is not None and "lang" not in n.attrs:
                n = n.parent
            return n is not None and any(n.get("lang").lower() == w or n.get("lang").lower().startswith(w + "-") for w in wanted)

        return speaks, (0, 1, 0)
    raise Invalid(name)


def _has(argument: str) -> tuple[Test, Counts]:
    """Relative alternatives: below (or, with a combinator first, beside) the element."""
    tests, counts = [], (0, 0, 0)
    for one in _alternatives(argument):
        lead, rest = (one[0], one[1:].strip()) if one[:1] in (">", "+", "~") else (" ", one)
        test, own = _selector(rest)
        tests.append((lead, test))
        counts = _sum(counts, own)

    def found(n: Node) -> bool:
        for lead, test in tests:
            if lead in " >":
                near = n.elements if lead == ">" else n.walk()
            else:
                own = n.siblings()
                at = next(i for i, x in enumerate(own) if x is n)
                near = own[at + 1 : at + 2] if lead == "+" else own[at + 1 :]
            if any(test(x) for x in near):
                return True
        return False

    return found, counts


def _attribute(m: re.Match) -> Test:
    name, sign, value = m[1].lower(), m[2], m[3]
    if sign is None:
        return lambda n: name in n.attrs
    wanted = value[1:-1] if value[0] in "\"'" else _plain(value)
    fold = (m[4] or "").lower() == "i"
    wanted = wanted.lower() if fold else wanted
    signs = {
        "=": lambda v: v == wanted,
        "~=": lambda v: bool(wanted) and wanted in v.split(),
        "|=": lambda v: v == wanted or v.startswith(wanted + "-"),
        "^=": lambda v: bool(wanted) and v.startswith(wanted),
        "$=": lambda v: bool(wanted) and v.endswith(wanted),
        "*=": lambda v: bool(wanted) and wanted in v,
    }
    holds = signs[sign]
    return lambda n: name in n.attrs and holds(n.attrs[name].lower() if fold else n.attrs[name])


def _compound(text: str, at: int) -> tuple[list[Test], Counts, int]:
    tests: list[Test] = []
    counts = (0, 0, 0)
    if m := re.compile(rf"(\*|{_NAME})").match(text, at):
        if m[1] != "*":
            tag = _plain(m[1]).lower()
            tests.append(lambda n: n.tag == tag)
            counts = (0, 0, 1)
        else:
            tests.append(lambda n: True)
        at = m.end()
    while at < len(text):
        if text[at] in "#." and (m := re.compile(rf"[#.]({_NAME}|[\w-]+)").match(text, at)):
            name, by_id = _plain(m[1]), text[at] == "#"
            tests.append((lambda n, name=name: n.get("id") == name) if by_id else (lambda n, name=name: name in n.classes()))
            counts = _sum(counts, (1, 0, 0) if by_id else (0, 1, 0))
            at = m.end()
        elif text[at] == "[" and (m := _ATTRIBUTE.match(text, at)):
            tests.append(_attribute(m))
            counts = _sum(counts, (0, 1, 0))
            at = m.end()
        elif text[at] == ":" and (m := re.compile(r":([A-Za-z-]+)(\()?").match(text, at)):
            argument, at = _inside(text, m.end()) if m[2] else (None, m.end())
            test, own = _pseudo(m[1].lower(), argument)
            tests.append(test)
            counts = _sum(counts, own)
        else:
            break
    if not tests:
        raise Invalid(text)
    return tests, counts, at


def _chain(text: str) -> tuple[Test, Counts]:
    parts: list[tuple[str, list[Test]]] = []
    at, combinator, counts = 0, "", (0, 0, 0)
    text = text.strip()
    while at < len(text):
        tests, own, at = _compound(text, at)
        counts = _sum(counts, own)
        parts.append((combinator, tests))
        m = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
        if m:
            combinator, at = m[1] or " ", m.end()
            if at == len(text):
                raise Invalid(text)
        elif at < len(text):
            raise Invalid(text)

    def fits(node: Node, k: int) -> bool:
        combinator, tests = parts[k]
        if not all(t(node) for t in tests):
            return False
        if k == 0:
            return True
        if combinator == ">":
            return node.parent is not None and node.parent.tag != "#document" and fits(node.parent, k - 1)
        if combinator == " ":
            up = node.parent
            while up is not None and up.tag != "#document":
                if fits(up, k - 1):
                    return True
                up = up.parent
            return False
        own = node.siblings()
        place = next(i for i, x in enumerate(own) if x is node)
        near = own[max(0, place - 1) : place] if combinator == "+" else own[:place][::-1]
        return any(fits(x, k - 1) for x in near)

    if not parts:
        raise Invalid(text)
    return (lambda n: fits(n, len(parts) - 1)), counts


def _alternatives(text: str) -> list[str]:
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


@functools.lru_cache(4096)
def _selector(text: str) -> tuple[Test, Counts]:
    """(whether an element matches a selector list, what all of the list counts); raises Invalid."""
    found = [_chain(x) for x in _alternatives(text)]
    tests = [t for t, _ in found]
    return tests[0] if len(tests) == 1 else lambda n: any(t(n) for t in tests), functools.reduce(_sum, [c for _, c in found])


def compiled(text: str) -> Test:
    return _selector(text)[0]


def matcher(text: str) -> Test | None:
    """compiled(), or None for what is no selector (pseudo-elements included)."""
    try:
        return compiled(text) if "::" not in text else None
    except (Invalid, IndexError, re.error):
        return None


def specificity(text: str) -> tuple[int, int, int]:
    """(ids; classes, attributes and pseudo-classes; types). :where() counts nothing; :is, :not and :has count all they hold."""
    return _selector(text)[1]
