"""Document tables: slots, widths, and DataFrames written as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumite.functions.text import escape


def allocate(rows: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each row its cells' (column, colspan, rowspan): cells go to the first free slots; rowspan 0 reaches the end, others are clamped."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, cells in enumerate(rows):
        column, placed = 0, []
        for colspan, rowspan in cells:
            colspan = min(max(colspan, 1), 1000)
            rowspan = len(rows) - r if rowspan == 0 else min(max(rowspan, 1), len(rows) - r)
            while (r, column) in taken:
                column += 1
            taken |= {(r + i, column + j) for i in range(rowspan) for j in range(colspan)}
            placed.append((column, colspan, rowspan))
            column += colspan
        out.append(placed)
    return out


def table_slots(cells: DataFrame) -> DataFrame:
    """cells(table_id long, r int, c int, colspan int, rowspan int) with `grid_column`, and the clamped spans.

    Spans make a table's rows depend on those before, so a table is one kernel call; tables are independent.
    """
    grouped = cells.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("r", "c", F.coalesce("colspan", F.lit(1)).alias("colspan"), F.coalesce("rowspan", F.lit(1)).alias("rowspan")))).alias("cells"))

    def run(batches):
        for b in batches:
            out = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                found = value.as_py()
                rows: dict[int, list] = {}
                for x in found:
                    rows.setdefault(x["r"], []).append(x)
                placed = allocate([[(x["colspan"], x["rowspan"]) for x in rows[r]] for r in sorted(rows)])
                for r, spans in zip(sorted(rows), placed):
                    out += [{"table_id": key, "r": r, "c": x["c"], "grid_column": g, "colspan": cs, "rowspan": rs} for x, (g, cs, rs) in zip(rows[r], spans)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("table_id", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("grid_column", pa.int32()), ("colspan", pa.int32()), ("rowspan", pa.int32())]))

    return grouped.mapInArrow(run, "table_id long, r int, c int, grid_column int, colspan int, rowspan int")


def full_grid(slots: DataFrame) -> DataFrame:
    """Every slot of every table: table_id, r, grid_column, and the cell (`c`, null: padding) with vertical_merge restart, continue or null."""
    size = slots.groupBy("table_id").agg(F.max(F.col("r") + F.col("rowspan")).alias("_rows"), F.max(F.col("grid_column") + F.col("colspan")).alias("_columns"))
    every = size.select("table_id", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("r"), "_columns").select("table_id", "r", F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)).alias("grid_column"))
    own = slots.select(F.col("table_id").alias("_t"), "c", F.col("r").alias("_r"), F.col("rowspan").alias("_span"), F.explode(F.sequence("r", F.col("r") + F.col("rowspan") - 1)).alias("_at"), F.col("grid_column").alias("_g"), "colspan")
    own = own.select("_t", "c", "_r", "_span", "_at", F.explode(F.sequence("_g", F.col("_g") + F.col("colspan") - 1)).alias("_col"))
    met = every.join(own, (F.col("table_id") == F.col("_t")) & (F.col("r") == F.col("_at")) & (F.col("grid_column") == F.col("_col")), "left")
    merge = F.when(F.col("_span") > 1, F.when(F.col("r") == F.col("_r"), "restart").otherwise("continue"))
    return met.select("table_id", "r", "grid_column", "c", merge.alias("vertical_merge"))


def row_spans(cells: DataFrame) -> DataFrame:
    """cells(table_id, r, grid_column, vertical_merge) -> restart cells with `rowspan`: the run of `continue` below in the same column."""
    order = Window.partitionBy("table_id", "grid_column").orderBy("r")
    opens = F.sum(F.when(F.coalesce(F.col("vertical_merge"), F.lit("")) == "continue", 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("_run", opens).groupBy("table_id", "grid_column", "_run").agg(F.min("r").alias("r"), F.count(F.lit(1)).cast("int").alias("rowspan")).drop("_run")


def scaled_widths(columns: DataFrame, keys: list[str], order: str, natural: str, total: int) -> DataFrame:
    """columns with `width`: shares of `total` in proportion to `natural`, rounded down, the last column takes what is left."""
    whole, line = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    share = F.floor(F.col(natural) * F.lit(total) / F.sum(natural).over(whole)).cast("long")
    out = columns.withColumn("_share", share).withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) == 1)
    before = F.sum("_share").over(line.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("width", F.when(F.col("_last"), F.lit(total) - F.coalesce(before, F.lit(0))).otherwise(F.col("_share")).cast("long")).drop("_share", "_last")


def natural_ems(text: Column) -> Column:
    """Width of the longest line in ems: narrow characters 0.3, capitals and digits 0.6, others 0.5."""
    line = lambda x: F.size(F.regexp_extract_all(x, F.lit("[iljtf.,:;|' ]"), F.lit(0))) * 0.3 + F.size(F.regexp_extract_all(x, F.lit("[A-Z0-9]"), F.lit(0))) * 0.6 + F.size(F.regexp_extract_all(x, F.lit("[^iljtf.,:;|' A-Z0-9]"), F.lit(0))) * 0.5
    return F.array_max(F.transform(F.split(text, "\n"), line))


def rows_to_table_html(df: DataFrame, columns: list[str], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, html): the rows of each key (or all) as an HTML table with a header row, ordered by `order`."""
    keys = keys or []
    cell = lambda c: F.concat(F.lit("<td>"), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))
    head = "<thead><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr></thead>"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], row.alias("_html")))), lambda x: x["_html"]), "")
    return df.groupBy(*keys).agg(F.concat(F.lit(f"<table>{head}<tbody>"), body, F.lit("</tbody></table>")).alias("html"))
