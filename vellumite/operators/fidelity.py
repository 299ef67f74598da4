"""How much of a document survives a conversation from one form to another: words in order, and markup."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ligatures that fonts put in place of letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Words of one text that are compared side by side, a bit each.
STRETCH = 1 << 14


def words(text: str | None) -> list[str]:
    """Words between white space, ligatures taken apart."""
    text = text or ""
    for sign, letters in LIGATURES.items():
        text = text.replace(sign, letters)
    return re.findall(r"\S+", text)


def common_words(a: list[str], b: list[str], most_cells: int | None = None) -> int:
    """Length of the longest common subsequence, exact whatever the lengths; only where a caller names `most_cells`, and what differs between the equal ends is beyond, do only these count.

    Equal ends are taken off first, and words that the other side lacks. The rest is a row of bits, one for each word of
    the longer side, that every word of the shorter one changes by an addition (Crochemore et al., "A Fast and Practical
    Bit-Vector Algorithm for the Longest Common Subsequence Problem"): time is the product of the lengths over some
    thousands, memory a bit for each word of the shorter side and a stretch of the longer.
    """
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if most_cells is not None and len(a) * len(b) > most_cells:
        return lead + tail
    both = set(a) & set(b)
    a, b = sorted(([x for x in a if x in both], [x for x in b if x in both]), key=len)
    found = lead + tail
    carries = bytearray(len(a))  # into the next stretch, from each word of a
    for at in range(0, len(b), STRETCH):
        part = b[at : at + STRETCH]
        places: dict[str, int] = {}
        for k, x in enumerate(part):
            places[x] = places.get(x, 0) | 1 << k
        size = len(part)
        whole = (1 << size) - 1
        row = whole
        for i, x in enumerate(a):
            here = places.get(x, 0)
            if here or carries[i]:
                met = row & here
                total = row + met + carries[i]
                carries[i] = total >> size
                row = (total & whole) | (row - met)
        found += size - row.bit_count()
    return found


def text_fidelity(pairs: DataFrame, doc_id: str, before: str, after: str) -> DataFrame:
    """(doc_id, words_before, words_after, kept, share): words of `before` found in `after` in their order. Two texts without words are alike."""
    slim = pairs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(before).alias("a"), F.col(after).alias("b"))

    def counts(a: str | None, b: str | None) -> tuple[int, int, int]:
        x, y = words(a), words(b)
        return len(x), len(y), common_words(x, y)

    def run(batches):
        for batch in batches:
            # Words are a text's tenfold in memory: only one document's are held.
            found = [counts(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2))]
            sizes = [[x[k] for x in found] for k in range(3)]
            share = [kept / max(x, y) if max(x, y) else 1.0 for x, y, kept in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in sizes), pa.array(share, pa.float64())], names=["doc_id", "words_before", "words_after", "kept", "share"])

    return slim.mapInArrow(run, "doc_id long, words_before long, words_after long, kept long, share double")


def quantile(values: Column, q: float) -> Column:
    """The value at place floor(q n) of the sorted ones (the last at most), as an aggregate over a group."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.least(F.floor(F.size(ordered) * q).cast("int"), F.size(ordered) - 1))


def page_mean(pages: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys without the last, mean): the mean of `value` over expected and found pages; a page that one side lacks counts 0."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}"))
    both = expected.select(*keys).alias("e").join(pages.select(*keys, value).alias("p"), same, "full_outer")
    found = both.select(*[F.coalesce(f"e.{k}", f"p.{k}").alias(k) for k in keys], F.when(F.col(f"e.{keys[-1]}").isNotNull(), F.coalesce(F.col(f"p.{value}"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("v"))
    return found.groupBy(*keys[:-1]).agg(F.avg("v").alias("mean"))


def markup_counts(nodes: DataFrame) -> DataFrame:
    """(kind, name, n): how often tags, attributes and properties of style attributes occur."""
    elements = nodes.where("tag not like '#%'")
    tags = elements.select(F.lit("tag").alias("kind"), F.col("tag").alias("name"))
    attributes = elements.select(F.lit("attribute").alias("kind"), F.explode(F.map_keys("attrs")).alias("name"))
    declared = elements.where("attrs['style'] is not null").select(F.explode(F.split(F.col("attrs")["style"], ";")).alias("d")).where("d like '%:%'")
    properties = declared.select(F.lit("property").alias("kind"), F.lower(F.trim(F.split_part("d", F.lit(":"), F.lit(1)))).alias("name"))
    return tags.unionByName(attributes).unionByName(properties).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def markup_survival(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, before, after) of two tables of nodes: what went and what came."""
    a, b = markup_counts(before).alias("a"), markup_counts(after).alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.name") == F.col("b.name"))
    return a.join(b, same, "full_outer").select(F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.name", "b.name").alias("name"), F.coalesce("a.n", F.lit(0)).alias("before"), F.coalesce("b.n", F.lit(0)).alias("after"))
