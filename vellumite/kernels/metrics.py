"""What font files say about a line: heights in multiples of the font size."""

from __future__ import annotations

# Fixed values: (ascent, descent, line gap) of the horizontal headers of common fonts, in ems.
FACES = {
    "arial": (0.905, 0.212, 0.033), "helvetica": (0.905, 0.212, 0.033), "times new roman": (0.891, 0.216, 0.042), "times": (0.891, 0.216, 0.042), "courier new": (0.833, 0.300, 0.0),
    "calibri": (0.750, 0.250, 0.2207), "cambria": (0.950, 0.222, 0.0), "georgia": (0.917, 0.219, 0.0), "verdana": (1.005, 0.210, 0.0), "tahoma": (1.000, 0.207, 0.0), "trebuchet ms": (0.939, 0.222, 0.0),
    "comic sans ms": (1.102, 0.291, 0.0), "impact": (1.009, 0.210, 0.0), "segoe ui": (1.079, 0.251, 0.0), "consolas": (0.743, 0.257, 0.1709), "garamond": (0.862, 0.263, 0.0),
}

# The width of a space in ems, by font.
SPACES = {
    "aptos": 0.2031, "calibri": 0.2261, "cambria": 0.2202, "candara": 0.2168, "consolas": 0.5498, "constantia": 0.251, "corbel": 0.2002, "arial": 0.2778, "liberation sans": 0.2778, "times new roman": 0.25,
    "liberation serif": 0.25, "courier new": 0.6001, "georgia": 0.2412, "verdana": 0.3516, "tahoma": 0.3125, "trebuchet ms": 0.3013, "segoe ui": 0.2744, "garamond": 0.25, "comic sans ms": 0.2988,
    "impact": 0.1763, "helvetica": 0.2778, "roboto": 0.2476, "courier": 0.6001, "times": 0.25,
}
# From a bullet's start to its middle in ems, by font; a circle and a square are drawn in fonts of their own.
BULLETS = {
    "aptos": 0.235, "calibri": 0.249, "cambria": 0.221, "candara": 0.33, "consolas": 0.275, "constantia": 0.132, "corbel": 0.222, "arial": 0.177, "liberation sans": 0.177, "times new roman": 0.177,
    "liberation serif": 0.177, "courier new": 0.3, "georgia": 0.196, "verdana": 0.273, "tahoma": 0.227, "trebuchet ms": 0.265, "garamond": 0.177, "comic sans ms": 0.187, "impact": 0.174,
    "helvetica": 0.181, "roboto": 0.167, "courier": 0.3, "times": 0.172, "circle": 0.3, "square": 0.229,
}


def marker_distance(kind: str, family: str | None, size: float) -> tuple[float, str] | None:
    """(points between a list marker and the text, side of the marker that keeps to them) as a browser sets it; None for unknown fonts.

    Shapes have their middle 0.4645 em and 4.54 pt before the text, which is told by where the glyph starts;
    numbers and letters end a space before it.
    """
    family = (family or "").strip().lower()
    if kind in ("disc", "circle", "square"):
        middle = BULLETS.get(family if kind == "disc" else kind)
        return None if middle is None else ((middle + 0.4645) * size + 4.54, "left")
    space = SPACES.get(family)
    return None if space is None else (space * size, "right")


def single_line(family: str | None) -> float | None:
    """A single-spaced line of a font, as a multiple of its size; None for fonts that are not known."""
    face = FACES.get((family or "").lower())
    return sum(face) if face else None


def ascent(family: str | None) -> float | None:
    face = FACES.get((family or "").lower())
    return face[0] if face else None


def line_units(multiple: float, family: str | None) -> int:
    """240ths of the font's own single line that make `multiple` times its size."""
    return max(1, int(multiple / (single_line(family) or 1.0) * 240 + 0.5))


def line_multiple(units: float, family: str | None) -> float:
    """The reverse of line_units."""
    return units / 240 * (single_line(family) or 1.0)


def below_baseline(family: str | None, size: float, line: float | None = None) -> float | None:
    """Points between the baseline and the bottom of a line of `line` points (a single one, if not given)."""
    face = FACES.get((family or "").lower())
    if not face:
        return None
    height = (face[0] + face[1]) * size
    return face[1] * size + ((sum(face) * size if line is None else line) - height) / 2
