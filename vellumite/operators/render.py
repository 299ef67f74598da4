"""Writing HTML: runs to inline markup, paragraphs to blocks, documents to pages. Rendering is ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumite.functions.text import escape, safe_url

# The element of each run property, outermost last.
RUN_TAGS = (("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strike", "s"))


def run_html(text: Column, flags: dict[str, Column], href: Column | None = None) -> Column:
    """A run's markup; unsafe links keep their text."""
    out = F.replace(escape(text), F.lit("\n"), F.lit("<br>"))
    for name, tag in RUN_TAGS:
        if name in flags:
            out = F.when(F.coalesce(flags[name], F.lit(False)), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    if href is not None:
        url = F.replace(safe_url(href), F.lit('"'), F.lit("%22"))
        out = F.when(url.isNotNull(), F.concat(F.lit('<a href="'), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('">'), out, F.lit("</a>"))).otherwise(out)
    return out


def block_tag(style: Column) -> Column:
    """h1 to h6 for heading styles, p for others."""
    level = F.regexp_extract(F.coalesce(style, F.lit("")), r"(?i)\Aheading ?([1-6])\z", 1)
    return F.when(level != "", F.concat(F.lit("h"), level)).otherwise("p")


def _ordered(keys: list[str], order: list[str], value: Column, df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), "").alias(name))


def paragraphs_html(runs: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """(doc_id, paragraph, html) from runs(doc_id, paragraph, run, text, bold, italic, underline, strike, href); an empty paragraph holds a break."""
    inner = _ordered(["doc_id", "paragraph"], ["run"], run_html(F.col("text"), {n: F.col(n) for n, _ in RUN_TAGS}, F.col("href")), runs, "inner")
    if styles is not None:
        s = styles.select(F.col("doc_id").alias("_d"), F.col("paragraph").alias("_p"), "style")
        inner = inner.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("paragraph") == F.col("_p")), "left")
    tag = block_tag(F.col("style")) if styles is not None else F.lit("p")
    body = F.when(F.col("inner") == "", F.lit("<br>")).otherwise(F.col("inner"))
    return inner.select("doc_id", "paragraph", F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">")).alias("html"))


def documents_html(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, html): a document's paragraphs in order."""
    return _ordered(["doc_id"], ["paragraph"], F.col("html"), paragraphs, "html")


def full_page(body: Column, title: Column, lang: Column) -> Column:
    head = F.concat(F.lit('<!DOCTYPE html><html lang="'), F.coalesce(lang, F.lit("")), F.lit('"><head><meta charset="utf-8"><title>'), escape(F.coalesce(title, F.lit(""))), F.lit("</title></head><body>"))
    return F.concat(head, body, F.lit("</body></html>"))


def css_number(value: Column) -> Column:
    """Two decimals at most, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+\z", ""), r"\.\z", "")


def declarations(values: dict[str, Column]) -> Column:
    """`a: x; b: y` of the values that are not null, in the order given."""
    return F.concat_ws("; ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v)) for name, v in values.items()])


def relative(own: dict[str, Column], base: dict[str, Column]) -> dict[str, Column]:
    """Properties that differ from the base; the others null."""
    return {k: F.when(~v.eqNullSafe(base[k]), v) if k in base else v for k, v in own.items()}
