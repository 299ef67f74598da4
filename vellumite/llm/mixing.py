"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled (ordered by a hash of the row) and laid end to end; the line of words
is cut into blocks of equal size. A schedule of slots draws the sources: slot i has the golden-ratio point
frac(i * phi), which the cumulative target shares map to a source, so every stretch of the schedule is close
to the shares. The slots of a source are ranked, and rank k takes block k, wrapping round for a second
epoch. A source has as many slots as its target has blocks; slots beyond that are dropped, and where the
points gave a source a few too few, the missing ones follow at the end.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumite.llm._common import SPACE_RUN, SPACES, distributed_rank, written

BLOCK_WORDS, MOST_EPOCHS = 256, 2.0
#: A source has so many blocks at least (or one a word), so that a small one comes near its target too.
LEAST_BLOCKS = 64
#: Rows that a bucket of a rank is meant to hold; there are 2^20 buckets at most.
BUCKET_ROWS = 1 << 10
#: Sources are a configuration: their table goes to the driver and is broadcast, and more than this are refused.
MOST_SOURCES = 20_000
#: The golden ratio's fraction as a share of 2^40; points are exact integers below 2^40.
_BITS, _HALF = 40, 20
_PHI = round(2**_BITS * (math.sqrt(5) - 1) / 2) | 1


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RUN, -1))).cast("long")


def targets(sizes: dict, weights: dict, total_share: float = 1.5, most: float = MOST_EPOCHS) -> dict:
    """Words to take of each source: shares of total_share * all words by weight, none above `most` times its size.

    What a source cannot take is shared anew by weight among the others, until none is above.
    """
    left, open_, out = total_share * sum(sizes.values()), set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / weight > most * sizes[s]} if weight else set()
        if not full:
            for s in open_:
                out[s] = left * weights[s] / weight if weight else 0.0
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return {s: float(min(out[s], most * sizes[s])) for s in sizes}


def point(i: Column) -> Column:
    """frac(i * phi) * 2^40 for 0 <= i < 2^40, in integers that fit a long."""
    high, low = F.shiftright(i, _HALF), i.bitwiseAND(F.lit((1 << _HALF) - 1))
    folded = F.shiftleft((high * F.lit(_PHI % (1 << _HALF))).bitwiseAND(F.lit((1 << _HALF) - 1)), _HALF)
    # high * PHI mod 2^20 keeps what is left below 2^40 after the shift.
    return (folded + low * F.lit(_PHI)).bitwiseAND(F.lit((1 << _BITS) - 1))


def schedule(spark, quotas: dict, shares: dict) -> DataFrame:
    """(slot, source, rank): quotas[source] slots of every source, in low-discrepancy order; source may be null."""
    total = sum(quotas.values())
    if total >= 1 << _BITS:
        raise ValueError("the schedule has 2^40 slots at most; use larger blocks")
    names, edge, rows = list(quotas), 0.0, []
    whole = sum(shares.values())
    for n, s in enumerate(names):
        first, edge = edge, edge + (shares[s] / whole if whole else 0.0)
        last = 1.0 if n == len(names) - 1 else edge
        rows.append((s, round(first * (1 << _BITS)), round(last * (1 << _BITS)), quotas[s]))
    table = spark.createDataFrame(rows, "source string, lo long, hi long, quota long")
    bounds = [r[2] for r in rows]
    # The place of a point among the cumulative shares: a search over an array of one bound a source.
    at = F.array(*[F.lit(b) for b in bounds[:-1]]) if len(bounds) <= 64 else None
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", point(F.col("slot")))
    numbered = F.broadcast(spark.createDataFrame([(n, r[0], r[1], r[2], r[3]) for n, r in enumerate(rows)], "n int, source string, lo long, hi long, quota long"))
    if at is not None:
        place = F.lit(0)
        for b in bounds[:-1]:
            place = place + (F.col("point") >= b).cast("int")
        drawn = slots.withColumn("n", place).join(numbered.drop("lo", "hi"), "n")
    else:
        cells = 1 << 12
        width = (1 << _BITS) // cells
        spread = table.where("hi > lo").withColumn("cell", F.explode(F.sequence((F.col("lo") / width).cast("long"), ((F.col("hi") - 1) / width).cast("long"))))
        drawn = slots.withColumn("cell", (F.col("point") / width).cast("long")).join(F.broadcast(spread), "cell").where("point >= lo and point < hi")
    drawn = drawn.select("slot", "source", "quota")
    ranked = distributed_rank(drawn, ["source"], F.shiftright("slot", 10), [F.col("slot")], "rank").where("rank < quota").select("slot", "source", "rank")
    ranked = written(ranked, "slots")
    have = {r["source"]: r["n"] for r in ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    missing = [(s, have.get(s, 0), quotas[s] - have.get(s, 0)) for s in names if quotas[s] > have.get(s, 0)]
    if not missing:
        return ranked
    lack = spark.createDataFrame(missing, "source string, first long, n long")
    more = lack.select("source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    return ranked.unionByName(more.select(F.lit(total).alias("slot"), "source", "rank"))


class Mixture:
    """The plan of a mix: sizes and targets by source, the documents' places, and the schedule."""

    def __init__(self, docs: DataFrame, weights: dict | None = None, cycle: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, block_words: int = BLOCK_WORDS, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
        spark = docs.sparkSession
        slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(doc_id, text, source).alias("hash"))
        self.sized = written(slim, "sized")
        by_source = self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
        if len(by_source) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        names = sorted((r["source"] for r in by_source), key=lambda s: (s is None, s or ""))
        found = {r["source"]: r["size"] for r in by_source}
        self.bucket_bits = min(20, max(1, (max([r["rows"] for r in by_source], default=1) // BUCKET_ROWS).bit_length()))
        self.sizes = {s: found[s] for s in names}
        self.weights = weights or {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
        self.targets = targets(self.sizes, self.weights, total_share)
        self.blocks = {s: max(1, math.ceil(self.sizes[s] / block_words), min(LEAST_BLOCKS, self.sizes[s])) for s in names}
        #: Slots: the target in blocks, to the nearest; never beyond the epochs allowed.
        self.quotas = {s: min(round(self.targets[s] * self.blocks[s] / self.sizes[s]), int(MOST_EPOCHS * self.blocks[s])) if self.sizes[s] else 0 for s in names}
        rows = [(s, self.sizes[s], self.targets[s], self.blocks[s], self.quotas[s]) for s in names]
        self.sources = F.broadcast(spark.createDataFrame(rows, "source string, source_size long, target double, blocks long, quota long"))
        self.spark, self.block_words = spark, block_words

    @functools.cached_property
    def placed(self) -> DataFrame:
        """doc rows with `start` and `stop`, their words' places on the source's line, and the source's numbers."""
        at = distributed_rank(self.sized, ["source"], F.shiftrightunsigned("hash", 64 - self.bucket_bits), [F.col("hash"), F.col("doc_id")], "start", F.col("size"))
        s = self.sources.withColumnRenamed("source", "_source")
        return written(at.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("stop", F.col("start") + F.col("size")), "placed")

    def spans(self) -> DataFrame:
        """The placed documents, a row for each block that a document has words in: `block`, and the words from `lo` to `hi` of the line.

        Block k of n holds the words from floor(k W / n) to floor((k + 1) W / n), so blocks differ by one word at most.
        """
        first = F.expr("((cast(start as decimal(38,0)) + 1) * blocks - 1) div source_size").cast("long")
        last = F.expr("(cast(stop as decimal(38,0)) * blocks - 1) div source_size").cast("long")
        out = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        low = F.expr("(cast(block as decimal(38,0)) * source_size) div blocks").cast("long")
        high = F.expr("((cast(block as decimal(38,0)) + 1) * source_size) div blocks").cast("long")
        return out.withColumn("lo", F.greatest(low, "start")).withColumn("hi", F.least(high, "stop")).where("hi > lo")

    def sequence(self) -> DataFrame:
        """The mix itself: slot, source, epoch, block, doc_id, and the words `from_word` to `to_word` of the document."""
        slots = schedule(self.spark, self.quotas, {s: float(self.targets[s]) for s in self.quotas})
        s = self.sources.select(F.col("source").alias("_source"), F.col("blocks").alias("_blocks"))
        slots = slots.join(s, F.col("source").eqNullSafe(F.col("_source"))).select("slot", F.col("source").alias("_s"), F.expr("rank div _blocks").alias("epoch"), F.expr("rank % _blocks").alias("_block"))
        joined = self.spans().join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_block")))
        return joined.select("slot", "source", "epoch", "block", "doc_id", "hash", "size", "start", "stop", (F.col("lo") - F.col("start")).alias("from_word"), (F.col("hi") - F.col("start")).alias("to_word"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    A null source is a source, the last; a null or empty text has size 0 and nothing is taken of it; rows
    equal in doc_id, text and source are different documents that lie side by side. No document is taken more
    than twice. The order is a hash of the rows, so reruns agree. An empty table gives no row.
    """
    m = Mixture(docs, **options)
    taken = m.sequence().groupBy("source", "start", "stop").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # A document with words is the only one at its place on its source's line.
    taken = taken.select(F.col("source").alias("_s"), F.col("start").alias("_a"), F.col("stop").alias("_b"), "taken")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_a")) & (F.col("stop") == F.col("_b"))
    out = m.placed.join(taken, same, "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' columns, one row for each epoch in which words of a document are drawn: the mix as training text.

    A document at the end of a source's share is drawn in part, then `text` holds those words, joined by
    single spaces, and `n_chars` (where docs has it) their length; else the text is as it was. Documents
    without words are never drawn. Rows are in no order; Mixture.sequence has the schedule.
    """
    columns = docs.columns
    m = Mixture(docs, **options)
    draws = m.sequence().groupBy("doc_id", "hash", "source", "start", "stop", "epoch").agg(F.min("from_word").alias("_from"), F.max("to_word").alias("_to"))
    draws = draws.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h"), "_from", "_to", (F.col("stop") - F.col("start")).alias("_size"))
    rows = docs.select(F.struct(*columns).alias("_row"), F.xxhash64("doc_id", "text", "source").alias("_hash"))
    twice = m.placed.groupBy("doc_id", "hash").count().where("count > 1").limit(1)
    if not twice.isEmpty():  # equal rows have a draw each; one of them stands for all
        rows = rows.withColumn("_more", F.xxhash64(F.lit(1), "_row.doc_id", "_row.text", "_row.source")).dropDuplicates(["_hash", "_more"])
    drawn = rows.join(draws, (F.col("_hash") == F.col("_h")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")))
    words = F.split(F.btrim(F.col("_row.text"), F.lit(SPACES)), SPACE_RUN, -1)
    part = F.array_join(F.slice(words, (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")), " ")
    text = F.when(F.col("_to") - F.col("_from") == F.col("_size"), F.col("_row.text")).otherwise(part)
    out = drawn.select("_row", text.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in columns])
