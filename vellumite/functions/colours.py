"""CSS colours to RRGGBB, alpha laid over white."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named colours of CSS Color Module Level 4.
NAMED = {
    "aliceblue": "F0F8FF", "antiquewhite": "FAEBD7", "aqua": "00FFFF", "aquamarine": "7FFFD4", "azure": "F0FFFF", "beige": "F5F5DC", "bisque": "FFE4C4", "black": "000000",
    "blanchedalmond": "FFEBCD", "blue": "0000FF", "blueviolet": "8A2BE2", "brown": "A52A2A", "burlywood": "DEB887", "cadetblue": "5F9EA0", "chartreuse": "7FFF00", "chocolate": "D2691E",
    "coral": "FF7F50", "cornflowerblue": "6495ED", "cornsilk": "FFF8DC", "crimson": "DC143C", "cyan": "00FFFF", "darkblue": "00008B", "darkcyan": "008B8B", "darkgoldenrod": "B8860B",
    "darkgray": "A9A9A9", "darkgreen": "006400", "darkgrey": "A9A9A9", "darkkhaki": "BDB76B", "darkmagenta": "8B008B", "darkolivegreen": "556B2F", "darkorange": "FF8C00", "darkorchid": "9932CC",
    "darkred": "8B0000", "darksalmon": "E9967A", "darkseagreen": "8FBC8F", "darkslateblue": "483D8B", "darkslategray": "2F4F4F", "darkslategrey": "2F4F4F", "darkturquoise": "00CED1", "darkviolet": "9400D3",
    "deeppink": "FF1493", "deepskyblue": "00BFFF", "dimgray": "696969", "dimgrey": "696969", "dodgerblue": "1E90FF", "firebrick": "B22222", "floralwhite": "FFFAF0", "forestgreen": "228B22",
    "fuchsia": "FF00FF", "gainsboro": "DCDCDC", "ghostwhite": "F8F8FF", "gold": "FFD700", "goldenrod": "DAA520", "gray": "808080", "green": "008000", "greenyellow": "ADFF2F",
    "grey": "808080", "honeydew": "F0FFF0", "hotpink": "FF69B4", "indianred": "CD5C5C", "indigo": "4B0082", "ivory": "FFFFF0", "khaki": "F0E68C", "lavender": "E6E6FA",
    "lavenderblush": "FFF0F5", "lawngreen": "7CFC00", "lemonchiffon": "FFFACD", "lightblue": "ADD8E6", "lightcoral": "F08080", "lightcyan": "E0FFFF", "lightgoldenrodyellow": "FAFAD2", "lightgray": "D3D3D3",
    "lightgreen": "90EE90", "lightgrey": "D3D3D3", "lightpink": "FFB6C1", "lightsalmon": "FFA07A", "lightseagreen": "20B2AA", "lightskyblue": "87CEFA", "lightslategray": "778899", "lightslategrey": "778899",
    "lightsteelblue": "B0C4DE", "lightyellow": "FFFFE0", "lime": "00FF00", "limegreen": "32CD32", "linen": "FAF0E6", "magenta": "FF00FF", "maroon": "800000", "mediumaquamarine": "66CDAA",
    "mediumblue": "0000CD", "mediumorchid": "BA55D3", "mediumpurple": "9370DB", "mediumseagreen": "3CB371", "mediumslateblue": "7B68EE", "mediumspringgreen": "00FA9A", "mediumturquoise": "48D1CC", "mediumvioletred": "C71585",
    "midnightblue": "191970", "mintcream": "F5FFFA", "mistyrose": "FFE4E1", "moccasin": "FFE4B5", "navajowhite": "FFDEAD", "navy": "000080", "oldlace": "FDF5E6", "olive": "808000",
    "olivedrab": "6B8E23", "orange": "FFA500", "orangered": "FF4500", "orchid": "DA70D6", "palegoldenrod": "EEE8AA", "palegreen": "98FB98", "paleturquoise": "AFEEEE", "palevioletred": "DB7093",
    "papayawhip": "FFEFD5", "peachpuff": "FFDAB9", "peru": "CD853F", "pink": "FFC0CB", "plum": "DDA0DD", "powderblue": "B0E0E6", "purple": "800080", "rebeccapurple": "663399",
    "red": "FF0000", "rosybrown": "BC8F8F", "royalblue": "4169E1", "saddlebrown": "8B4513", "salmon": "FA8072", "sandybrown": "F4A460", "seagreen": "2E8B57", "seashell": "FFF5EE",
    "sienna": "A0522D", "silver": "C0C0C0", "skyblue": "87CEEB", "slateblue": "6A5ACD", "slategray": "708090", "slategrey": "708090", "snow": "FFFAFA", "springgreen": "00FF7F",
    "steelblue": "4682B4", "tan": "D2B48C", "teal": "008080", "thistle": "D8BFD8", "tomato": "FF6347", "turquoise": "40E0D0", "violet": "EE82EE", "wheat": "F5DEB3",
    "white": "FFFFFF", "whitesmoke": "F5F5F5", "yellow": "FFFF00", "yellowgreen": "9ACD32",
}


def _channel(part: Column) -> Column:
    """0 to 255 of an rgb() argument, a number or a percentage."""
    number = F.regexp_extract(part, r"(-?[0-9.]+)", 1).try_cast("double")
    return F.least(F.greatest(F.when(part.contains("%"), number * 2.55).otherwise(number), F.lit(0.0)), F.lit(255.0))


def _share(part: Column) -> Column:
    """0 to 1 of an alpha, saturation or lightness argument."""
    number = F.regexp_extract(part, r"(-?[0-9.]+)", 1).try_cast("double")
    return F.least(F.greatest(F.when(part.contains("%"), number / 100).otherwise(number), F.lit(0.0)), F.lit(1.0))


def _hex(r: Column, g: Column, b: Column, a: Column) -> Column:
    over = lambda c: F.floor(c * a + 255 * (1 - a) + 0.5).cast("int")
    return F.when(a > 0, F.format_string("%02X%02X%02X", over(r), over(g), over(b)))


def to_hex(value: Column) -> Column:
    """RRGGBB of a CSS colour; null for none, currentColor, transparent and alpha 0."""
    low = F.lower(F.trim(value))
    digits = F.regexp_extract(low, r"\A#([0-9a-f]{3,8})\z", 1)
    wide = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    wide = F.when(F.length(wide) == 6, F.concat(wide, F.lit("ff"))).otherwise(wide)
    byte = lambda i: F.conv(F.substring(wide, i, 2), 16, 10).cast("double")
    by_digits = F.when(F.length(digits).isin(3, 4, 6, 8), _hex(byte(1), byte(3), byte(5), byte(7) / 255))
    inner = F.regexp_extract(low, r"\A(?:rgb|hsl)a?\(([^)]*)\)\z", 1)
    parts = F.filter(F.split(F.regexp_replace(inner, r"deg", ""), r"[\s,/]+"), lambda x: x != "")
    arg = lambda i: F.get(parts, F.lit(i))
    alpha = F.when(F.size(parts) >= 4, _share(arg(3))).otherwise(F.lit(1.0))
    by_rgb = F.when(F.size(parts).isin(3, 4), _hex(_channel(arg(0)), _channel(arg(1)), _channel(arg(2)), alpha))
    hue, sat, light = F.pmod(arg(0).try_cast("double"), F.lit(360.0)), _share(arg(1)), _share(arg(2))

    def tone(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue / 30, F.lit(12.0))
        return 255 * (light - sat * F.least(light, 1 - light) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))

    by_hsl = F.when(F.size(parts).isin(3, 4), _hex(tone(0), tone(8), tone(4), alpha))
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.when(low.startswith("#"), by_digits).when(low.startswith("rgb"), by_rgb).when(low.startswith("hsl"), by_hsl).otherwise(F.try_element_at(names, low))


def tinted(hex_: Column, tint: Column | None = None, shade: Column | None = None) -> Column:
    """A theme colour moved towards white by tint / 255 kept, or towards black by shade / 255 kept."""

    def moved(i: int) -> Column:
        c = F.conv(F.substring(hex_, i, 2), 16, 10).cast("double")
        if shade is not None:
            c = F.when(shade.isNotNull(), c * shade / 255).otherwise(c)
        if tint is not None:
            c = F.when(tint.isNotNull(), c * tint / 255 + 255 - tint).otherwise(c)
        return F.floor(c + 0.5).cast("int")

    return F.format_string("%02X%02X%02X", moved(1), moved(3), moved(5))
