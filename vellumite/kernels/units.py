"""Lengths, colours and numbers of one value; the column forms of the same rules are in vellumite.functions."""

from __future__ import annotations

import math
import re

from vellumite.functions.colours import NAMED
from vellumite.functions.lengths import EMU_PER_PIXEL, POINTS
from vellumite.functions.numbers import CHICAGO, IRREGULAR, LATIN, ONES, ROMAN, RUSSIAN, TENS

TWIPS = 20
_LENGTH = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)([a-z%]*)\s*", re.I)
_MEASURE = re.compile(r"\s*(-?\d+(?:\.\d+)?)(mm|cm|in|pt|pc|pi)?\s*")
_PER_UNIT = {"mm": 1440 / 25.4, "cm": 1440 / 2.54, "in": 1440.0, "pt": 20.0, "pc": 240.0, "pi": 240.0}


def rounded(x: float) -> int:
    """Halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def points(value: str | None, em: float | None = None, rem: float | None = None, whole: float | None = None) -> float | None:
    """Points of a CSS length; `whole` is what percentages refer to. Without a unit only 0 is one."""
    m = _LENGTH.fullmatch(value or "")
    if not m:
        return None
    n, unit = float(m[1]), m[2].lower()
    if unit == "":
        return 0.0 if n == 0 else None
    base = {"em": em, "rem": rem, "%": None if whole is None else whole / 100, "ex": None if em is None else em / 2, "ch": None if em is None else em / 2}.get(unit, POINTS.get(unit))
    return None if base is None else n * base


def twips(pt: float) -> int:
    return rounded(pt * TWIPS)


def measure(value: str | None, per_plain: float = 1.0) -> int | None:
    """Twips of a word processor's measure: a plain number counts `per_plain` twips."""
    m = _MEASURE.fullmatch(value or "")
    return rounded(float(m[1]) * (_PER_UNIT[m[2]] if m[2] else per_plain)) if m else None


def whole(value: str | None) -> int | None:
    m = re.fullmatch(r"\s*([+-]?\d+)(?:\.\d+)?\s*", value or "")
    return int(m[1]) if m else None


def pixels(emu: int) -> float:
    return emu / EMU_PER_PIXEL


def _byte(x: float) -> int:
    return max(0, min(255, int(x + 0.5)))


def colour(value: str | None) -> str | None:
    """RRGGBB of a CSS colour, alpha laid over white; null for none."""
    low = (value or "").strip().lower()
    if low in NAMED:
        return NAMED[low]
    if m := re.fullmatch(r"#([0-9a-f]+)", low):
        d = m[1] if len(m[1]) in (6, 8) else "".join(c * 2 for c in m[1]) if len(m[1]) in (3, 4) else ""
        channels = [int(d[i : i + 2], 16) for i in range(0, len(d), 2)]
        return _over(channels[:3], channels[3] / 255 if len(channels) == 4 else 1.0) if channels else None
    m = re.fullmatch(r"(rgb|hsl)a?\(([^)]*)\)", low)
    parts = [p for p in re.split(r"[\s,/]+", m[2].replace("deg", "")) if p] if m else []
    if len(parts) not in (3, 4):
        return None
    try:
        number = [float(p.rstrip("%")) for p in parts]
    except ValueError:
        return None
    share = lambda i: min(1.0, max(0.0, number[i] / 100 if parts[i].endswith("%") else number[i]))
    alpha = share(3) if len(parts) == 4 else 1.0
    if m[1] == "rgb":
        return _over([min(255.0, max(0.0, n * 2.55 if p.endswith("%") else n)) for n, p in zip(number[:3], parts)], alpha)
    hue, sat, light = number[0] % 360, share(1), share(2)
    tone = lambda n: 255 * (light - sat * min(light, 1 - light) * max(-1.0, min((n + hue / 30) % 12 - 3, 9 - (n + hue / 30) % 12, 1.0)))
    return _over([tone(0), tone(8), tone(4)], alpha)


def _over(channels: list[float], alpha: float) -> str | None:
    return "".join(f"{_byte(c * alpha + 255 * (1 - alpha)):02X}" for c in channels) if alpha > 0 else None


def _words(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{ONES[n // 100]} hundred" + (f" {_words(n % 100)}" if n % 100 else "")
    return f"{_words(n // 1000)} thousand" + (f" {_words(n % 1000)}" if n % 1000 else "")


def alphabetic(n: int, alphabet: str) -> str:
    """Counting without a zero: the last letter, then aa, ab."""
    out = ""
    while n > 0:
        n, k = divmod(n - 1, len(alphabet))
        out = alphabet[k] + out
    return out


def numbered(n: int, kind: str) -> str:
    """n in a word processor's number format; decimal for unknown names, empty for none and bullet."""
    low = kind.lower()
    if kind in ("none", "bullet"):
        return ""
    if low.endswith("roman") and 1 <= n <= 3999:
        out = ""
        for sign, value in ROMAN:
            out, n = out + sign * (n // value), n % value
        return out.lower() if kind == "lowerRoman" else out
    repeated = {"lowerLetter": LATIN, "upperLetter": LATIN.upper(), "russianLower": RUSSIAN, "russianUpper": RUSSIAN.upper(), "chicago": "".join(CHICAGO)}
    if kind in repeated and n >= 1:
        signs = repeated[kind]
        return signs[(n - 1) % len(signs)] * ((n - 1) // len(signs) + 1)
    if kind == "ordinal":
        return f"{n}{'th' if 11 <= n % 100 <= 13 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"
    if kind in ("cardinalText", "ordinalText") and 0 <= n < 1_000_000:
        text = _words(n)
        if kind == "ordinalText":
            head, last = re.fullmatch(r"(.*?)([a-z]+)", text).groups()
            text = head + IRREGULAR.get(last, f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th")
        return text[:1].upper() + text[1:]
    if kind == "hex":
        return f"{n:X}"
    if kind == "decimalZero" and 0 <= n < 10:
        return f"0{n}"
    first = {"decimalEnclosedCircle": "①", "decimalEnclosedParen": "⑴", "decimalEnclosedFullstop": "⒈"}.get(kind)
    if first and 1 <= n <= 20:
        return chr(ord(first) + n - 1)
    return str(n).translate({48 + i: 0xFF10 + i for i in range(10)}) if kind == "decimalFullWidth" else str(n)
