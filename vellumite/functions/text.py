"""White space, case, links and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that are never linked.
UNSAFE_SCHEMES = ("javascript", "vbscript", "data", "file")
# The named entities that are decoded without a parser.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&middot;": "·", "&nbsp;": "\u00a0", "&amp;": "&"}


def collapse(text: Column) -> Column:
    """CSS white-space: normal inside one run: spaces, tabs and line breaks become one space; no-break spaces stay."""
    return F.regexp_replace(text, r"[ \t\n\r\f]+", " ")


def trimmed(text: Column) -> Column:
    return F.btrim(collapse(text), F.lit(" "))


def capitalise(text: Column) -> Column:
    """The first ASCII letter of every word in upper case, the others as they are."""
    parts = F.split(text, r"(?<=[\s(\[{\"'-])(?=[a-z])")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\A[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)), "")


def safe_url(href: Column) -> Column:
    """The link without control characters and spaces; null where it is empty or its scheme is unsafe."""
    bare = F.regexp_replace(href, r"[\x00-\x20]+", "")
    scheme = F.lower(F.regexp_extract(bare, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when((bare != "") & ~scheme.isin(*UNSAFE_SCHEMES), bare)


def percent_encoded(href: Column) -> Column:
    """A link with what no address may hold written as bytes in hexadecimal; what is encoded already stays."""
    plain = r"[\x21-\x7e&&[^\"<>\\^`{|}]]"
    one = lambda c: F.when(c.rlike(plain), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.transform(F.filter(F.split(href, ""), lambda c: c != ""), one), "")


def css_string(text: Column) -> Column:
    """A text as a quoted CSS string."""
    return F.concat(F.lit('"'), F.replace(F.regexp_replace(text, r'([\\"])', r"\\$1"), F.lit("\n"), F.lit(r"\a ")), F.lit('"'))


def link_kind(href: Column) -> Column:
    url = safe_url(href)
    return F.when(url.isNull(), "dropped").when(url.startswith("#"), "bookmark").when(url.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), "absolute").when(url.startswith("//"), "absolute").otherwise("relative")


def bookmark_base(name: Column) -> Column:
    """`_` and up to 32 letters, digits and underscores."""
    return F.concat(F.lit("_"), F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), 1, 32))


def xml_text(text: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def decode_entities(text: Column) -> Column:
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def needs_preserved_space(text: Column) -> Column:
    return text.rlike(r"\t|  |\A | \z")


def without_scripts(html: Column) -> Column:
    """HTML without script and style elements and comments."""
    html = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", "")
    html = F.regexp_replace(html, r"(?is)<style\b.*?</style\s*>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")
