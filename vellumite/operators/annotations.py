"""Notes, comments, bookmarks, furniture, media: the joins of a document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumite.functions.text import bookmark_base


def number_notes(references: DataFrame, notes: DataFrame) -> DataFrame:
    """references(doc_id, type, note_id, pos) that name a known note, with `number` by their order per type."""
    known = references.join(notes.select(F.col("doc_id").alias("_d"), F.col("type").alias("_t"), F.col("note_id").alias("_n")).distinct(), (F.col("doc_id") == F.col("_d")) & (F.col("type") == F.col("_t")) & (F.col("note_id") == F.col("_n")), "left_semi")
    return known.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("pos")))


def balance_comments(events: DataFrame, comments: DataFrame) -> DataFrame:
    """(doc_id, comment_id, start_pos, end_pos) of every comment, from events(doc_id, comment_id, kind, pos).

    The first start and the last end count; a lost end closes at the start, a lost start opens at the end, and
    a comment with neither stands at position 0. Events of unknown comments are dropped.
    """
    sides = events.groupBy("doc_id", "comment_id").agg(F.min(F.when(F.col("kind") == "start", F.col("pos"))).alias("s"), F.max(F.when(F.col("kind") == "end", F.col("pos"))).alias("e"))
    sides = sides.select(F.col("doc_id").alias("_d"), F.col("comment_id").alias("_c"), "s", "e")
    both = comments.select("doc_id", "comment_id").distinct().join(sides, (F.col("doc_id") == F.col("_d")) & (F.col("comment_id") == F.col("_c")), "left")
    start = F.coalesce("s", "e", F.lit(0))
    return both.select("doc_id", "comment_id", start.alias("start_pos"), F.greatest(F.coalesce("e", "s", F.lit(0)), start).alias("end_pos"))


def open_comments(runs: DataFrame, ranges: DataFrame) -> DataFrame:
    """runs(doc_id, pos) with `comments`: the ids open there, in opening order. The interval join is kept inside a document."""
    r = ranges.select(F.col("doc_id").alias("_d"), "comment_id", "start_pos", "end_pos")
    met = runs.join(r, (F.col("doc_id") == F.col("_d")) & F.col("pos").between(F.col("start_pos"), F.col("end_pos")), "left")
    return met.groupBy("doc_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("comment_id").isNotNull(), F.struct("start_pos", "comment_id")))), lambda x: x["comment_id"]).alias("comments"))


def comment_threads(comments: DataFrame) -> DataFrame:
    """comments(doc_id, comment_id, parent_id, and `resolved` if there is one) with `root_id` and `depth`.

    A comment whose parents lead to a comment without one belongs to that root, however deep, and takes over its
    `resolved`; one whose parents end at an unknown comment or in a loop is its own root. The comments of a document
    are one kernel call; documents are independent.
    """
    extra = "resolved" in comments.columns
    fields = [F.col("comment_id").cast("long").alias("c"), F.col("parent_id").cast("long").alias("p"), (F.col("resolved") if extra else F.lit(None)).cast("boolean").alias("r")]
    grouped = comments.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("all"))
    kind = dict(grouped.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            owner, ids, roots, depths, done = [], [], [], [], []
            for i, value in enumerate(b.column(1)):
                rows = value.as_py()
                up = {x["c"]: x["p"] for x in rows}
                resolved = {x["c"]: x["r"] for x in rows}
                found: dict[int, tuple[int | None, int]] = {}  # comment -> (root or None, depth)
                for x in rows:
                    at, path = x["c"], []
                    seen = set()
                    while at not in found and at not in seen and up.get(at) is not None and at in up:
                        seen.add(at)
                        path.append(at)
                        at = up[at]
                    if at not in found and at not in seen:
                        found[at] = (at, 0) if at in up else (None, 0)
                    root, depth = found.get(at, (None, 0)) if at not in seen else (None, 0)
                    for one in reversed(path):
                        depth += 1
                        found[one] = (root, depth)
                for x in rows:
                    root, depth = found[x["c"]]
                    owner.append(i)
                    ids.append(x["c"])
                    roots.append(x["c"] if root is None else root)
                    depths.append(0 if root is None else depth)
                    done.append(resolved[x["c"] if root is None else root])
            keys = b.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), pa.array(roots, pa.int64()), pa.array(depths, pa.int32()), pa.array(done, pa.bool_())], names=["doc_id", "comment_id", "root_id", "depth", "resolved"])

    out = grouped.mapInArrow(run, f"doc_id {kind}, comment_id long, root_id long, depth int, resolved boolean")
    return out if extra else out.drop("resolved")


def spread_rank(df: DataFrame, keys: list[str], order: str, to: str, cuts: int = 200) -> DataFrame:
    """Adds `to`, the place (from 1) of each row within its `keys` by the number `order`, without one task for a hot key.

    The numbers are cut at approximate quantiles; rows are ranked inside their key's cut, and the totals of the cuts
    before are added. Where the cuts fall changes no result. Rows of equal `order` are in any order.
    """
    value = F.col(order).cast("double")
    marks = df.agg(F.percentile_approx(value, [(i + 1) / cuts for i in range(cuts - 1)], 10_000).alias("m")).first()["m"] or []
    marks = F.array(*[F.lit(m) for m in sorted(set(marks))]).cast("array<double>")
    own = df.withColumn("_cut", F.size(F.filter(marks, lambda m: value > m)))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    sums = own.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cut").alias("_c"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_cut") == F.col("_c")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = own.withColumn("_within", F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(order)))
    return ranked.join(starts, same).withColumn(to, (F.col("_start") + F.col("_within")).cast("int")).drop("_cut", "_within", "_c", "_start", *[f"_k{i}" for i in range(len(keys))])


def bookmark_names(targets: DataFrame, keys: list[str], name: str, pos: str) -> DataFrame:
    """targets with `bookmark`: a sanitised name, made unique within keys by _2, _3, ... in order of the number `pos`."""
    out = spread_rank(targets.withColumn("_base", bookmark_base(F.col(name))), [*keys, "_base"], pos, "_n")
    return out.withColumn("bookmark", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_n").cast("string")))).drop("_base", "_n")


def effective_furniture(sections: DataFrame) -> DataFrame:
    """sections(doc_id, section, kind, type, target) -> the last section's headers and footers, earlier references inherited."""
    return sections.where("target is not null").groupBy("doc_id", "kind", "type").agg(F.max_by("target", "section").alias("target"))


def style_chain(styles: DataFrame) -> DataFrame:
    """styles(style_id, based_on, and doc_id if there is one) -> (doc_id, style_id, ancestor_id, distance): the style itself and what it is based on, root last.

    The first of several styles of one id counts where `ord` says which that is, else the least based_on. Cycles and
    unknown parents end a chain, however long it is. A document's styles are folded inside its row.
    """
    owned = "doc_id" in styles.columns
    rows = styles if owned else styles.withColumn("doc_id", F.lit(0))
    place = F.col("ord") if "ord" in styles.columns else F.col("based_on")
    one = rows.groupBy("doc_id", "style_id").agg(F.min(F.struct(place.alias("o"), F.col("based_on").alias("b")))["b"].alias("b"))
    own = one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("style_id", F.coalesce("b", F.lit("")).alias("b")))).alias("up"))

    def longer(chain, up):
        nxt = F.try_element_at(up, F.element_at(chain, -1))
        more = F.map_contains_key(up, F.coalesce(nxt, F.lit(""))) & ~F.array_contains(chain, F.coalesce(nxt, F.lit("")))
        return F.when(more, F.array_append(chain, nxt)).otherwise(chain)

    found = own.select("doc_id", "up", F.explode(F.map_keys("up")).alias("style_id"))
    chain = F.aggregate(F.sequence(F.lit(1), F.size("up")), F.array("style_id"), lambda acc, _: longer(acc, F.col("up")))
    out = found.select("doc_id", "style_id", F.posexplode(chain).alias("distance", "ancestor_id")).select("doc_id", "style_id", "ancestor_id", "distance")
    return out if owned else out.drop("doc_id")


def toggled(layers: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, value): a toggle property is on where an odd number of layers sets it."""
    return layers.groupBy(*keys).agg((F.sum(F.col(flag).cast("int")) % 2 == 1).alias("value"))


def media_registry(media: DataFrame, keys: list[str], data: str, pos: str) -> DataFrame:
    """(keys, hash, number, uses): equal bytes once per document, numbered by first use (`pos` is a number)."""
    hashed = media.withColumn("hash", F.sha1(F.col(data).cast("binary")))
    first = hashed.groupBy(*keys, "hash").agg(F.min(pos).alias("_first"), F.count(F.lit(1)).alias("uses"))
    return spread_rank(first, keys, "_first", "number").drop("_first")


def image_kind(data):
    """png, jpeg, gif, bmp or tiff by signature; null for others and for fewer than 16 bytes."""
    start = F.hex(F.substring(data, 1, 8))
    kind = F.when(start.startswith("89504E470D0A1A0A"), "png").when(start.startswith("FFD8FF"), "jpeg").when(start.startswith("474946383761") | start.startswith("474946383961"), "gif").when(start.startswith("424D"), "bmp").when(start.startswith("49492A00") | start.startswith("4D4D002A"), "tiff")
    return F.when(F.octet_length(data) >= 16, kind)


def feature_filter(inlines: DataFrame, off: set[str]) -> DataFrame:
    """inlines(doc_id, block_id, pos, kind, ...) without the kinds switched off, nor blocks that lost something and have only bookmarks left."""
    order = ["doc_id", "block_id"]
    gone = F.col("kind").isin(*sorted(off)) if off else F.lit(False)
    marked = inlines.withColumn("_gone", gone)
    whole = Window.partitionBy(*order)
    lost = F.max(F.col("_gone").cast("int")).over(whole) == 1
    left = F.sum((~F.col("_gone") & (F.col("kind") != "bookmark")).cast("int")).over(whole)
    return marked.withColumn("_lost", lost).withColumn("_left", left).where(~F.col("_gone") & ~(F.col("_lost") & (F.col("_left") == 0))).drop("_gone", "_lost", "_left")
