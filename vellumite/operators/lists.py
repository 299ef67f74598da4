"""List counters: HTML items and word-processor levels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def html_ordinals(nodes: DataFrame) -> DataFrame:
    """(doc_id, list_id, node_id, tag, ordinal) of every li: start, value and reversed are heeded.

    A `value` opens an island; inside one the ordinal steps by 1, or by -1 in a reversed list.
    """
    lists = nodes.where(F.col("tag").isin("ol", "ul", "menu")).select(F.col("doc_id").alias("_d"), F.col("node_id").alias("list_id"), F.col("tag").alias("list_tag"), F.col("attrs")["start"].try_cast("int").alias("_start"), F.map_contains_key("attrs", "reversed").alias("_down"))
    items = nodes.where("tag = 'li'").select("doc_id", "node_id", "parent_id", F.col("attrs")["value"].try_cast("int").alias("_value"))
    both = items.join(lists, (F.col("doc_id") == F.col("_d")) & (F.col("parent_id") == F.col("list_id")))
    whole, order = Window.partitionBy("doc_id", "list_id"), Window.partitionBy("doc_id", "list_id").orderBy("node_id")
    both = both.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_k", F.row_number().over(order))
    island = F.sum(F.when(F.col("_value").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_island", island)
    first = Window.partitionBy("doc_id", "list_id", "_island").orderBy("node_id")
    begin = F.coalesce(F.first("_value").over(first), F.col("_start"), F.when(F.col("_down"), F.col("_n")).otherwise(F.lit(1)))
    ordinal = begin + F.when(F.col("_down"), -1).otherwise(1) * (F.row_number().over(first) - 1)
    return both.select("doc_id", "list_id", "node_id", "list_tag", ordinal.cast("int").alias("ordinal"))


def level_counters(items: DataFrame, keys: list[str], pos: str = "pos", level: str = "level") -> DataFrame:
    """items with `counter`, the word-processor number of each, and `counts`, the numbers of all nine levels then (0: none yet).

    An item of a higher level starts deeper levels anew. A level's number is how many rows of it there were so far,
    less how many there were at the last row of a higher level; so two windows over one order do for all levels.
    """
    order = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    every = [F.sum((F.col(level) == k).cast("int")).over(order).alias(f"_c{k}") for k in range(9)]
    counted = items.select("*", *every)
    before = [F.coalesce(F.max(F.when(F.col(level) < k, F.col(f"_c{k}"))).over(order), F.lit(0)).alias(f"_b{k}") for k in range(9)]
    based = counted.select("*", *before)
    counts = F.array(*[(F.col(f"_c{k}") - F.col(f"_b{k}")).cast("int") for k in range(9)])
    out = based.withColumn("counts", counts).withColumn("counter", F.get("counts", F.col(level)))
    return out.drop(*[f"_{x}{k}" for x in "cb" for k in range(9)])


def multi_level_labels(numbered: DataFrame, level: str = "level") -> DataFrame:
    """numbered (by level_counters) with `label`, such as 2.1.3.: the numbers of this and all higher levels; a level without one counts as 1."""
    shown = F.transform(F.slice("counts", F.lit(1), F.col(level) + 1), lambda n: F.concat(F.greatest(n, F.lit(1)).cast("string"), F.lit(".")))
    return numbered.withColumn("label", F.array_join(shown, ""))


def nested_html(items: list[tuple[int, str]]) -> str:
    """Flat (level, text) items as nested ol elements; a skipped level opens the lists between."""
    out, depth = [], 0
    for level, text in items:
        want = level + 1
        if want <= depth:
            while depth > want:
                out.append("</li></ol>")
                depth -= 1
            out.append("</li><li>")
        else:
            while depth < want:
                out.append("<ol><li>")
                depth += 1
        out.append(text)
    return "".join(out) + "</li></ol>" * depth


def lists_to_html(items: DataFrame, key: str, pos: str = "pos", level: str = "level", text: str = "text") -> DataFrame:
    """(key, html): the items of each key as nested lists. The open lists are a stack, so a document is one kernel call."""
    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(level).cast("int").alias("l"), F.col(text).alias("t")))).alias("items"))
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            made = [nested_html([(x["l"], x["t"] or "") for x in row.as_py()]) for row in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=[key, "html"])

    return rows.mapInArrow(run, f"{key} {kind}, html string")
