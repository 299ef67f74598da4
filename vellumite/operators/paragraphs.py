"""Paragraphs and runs from the flow of shown text: islands over each document's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumite.sources.html import RUN_FLAGS

# Signs that no page holds: a line break, and a space and a tab that do not collapse.
_BREAK, _HELD = "\x02", "\x02\x03\x04"


def held_space(text: Column, space: Column) -> Column:
    """A text's white space by its `white-space`: what is kept becomes signs that collapsing leaves alone."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    kept = F.translate(lines, "\n \t", _HELD)
    return F.when(space.isin("pre", "pre-wrap", "break-spaces"), kept).when(space == "pre-line", F.translate(lines, "\n", _BREAK)).otherwise(lines)


def collapsed(raw: Column) -> Column:
    """A paragraph's text: runs of white space are one space, none beside a break or at the ends; one break at the end goes."""
    one = F.regexp_replace(F.regexp_replace(raw, r"[ \t\n\r\f]+", " "), f" ?{_BREAK} ?", _BREAK)
    return F.btrim(F.regexp_replace(F.btrim(one, F.lit(" ")), f"{_BREAK}\\z", ""), F.lit(" "))


def paragraphs(flow: DataFrame) -> DataFrame:
    """doc_id, ord (from 1), text of html_flow: collapsed across elements, with line feeds and tabs where they are kept.

    A paragraph of a line break alone is an empty one; where there is nothing there is none.
    """
    item = F.struct("pos", held_space(F.col("text"), F.col("space")).alias("t"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "")
    joined = flow.groupBy("doc_id", "paragraph").agg(raw.alias("raw"))
    shown = joined.select("doc_id", "paragraph", collapsed(F.col("raw")).alias("text"), F.col("raw").contains(_BREAK).alias("broken")).where("text <> '' or broken")
    order = Window.partitionBy("doc_id").orderBy("paragraph")
    return shown.select("doc_id", F.row_number().over(order).alias("ord"), F.translate("text", _HELD, "\n \t").alias("text"))


def runs(flow: DataFrame) -> DataFrame:
    """Adjacent shown texts of a paragraph with equal properties as one run: doc_id, paragraph, run, text, bold, italic, underline, strike, href."""
    look = F.struct(*RUN_FLAGS, "href")
    return merge_runs(flow.select("doc_id", "paragraph", "pos", "text", look.alias("look")), ["doc_id", "paragraph"], "pos", "look", "text").select("doc_id", "paragraph", "run", "text", "look.*")


def merge_runs(items: DataFrame, keys: list[str], pos: str, look: str, text: str) -> DataFrame:
    """Neighbours (in order of `pos` within `keys`) of null-safe equal `look` become one row: keys, run (from 1), look, text, n_items."""
    order = Window.partitionBy(*keys).orderBy(pos)
    opens = F.when(F.row_number().over(order) == 1, 1).when(F.lag(look).over(order).eqNullSafe(F.col(look)), 0).otherwise(1)
    numbered = items.withColumn("_open", opens).withColumn("run", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.first(look).alias(look), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "").alias(text), F.count(F.lit(1)).alias("n_items"))
