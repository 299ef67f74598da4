"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most 4 of 64 bits differ in at most 1 bit in one of 3 segments (21, 21 and
22 bits). So each fingerprint is indexed under every segment with every one bit of it made a wildcard: 64
keys, an equality join on the key, and a check of the whole distance. Equal fingerprints are one class
before that, and a pair is kept only under the first key it shares, so it is met once.

Dense groups are not compared pair by pair. Fingerprints within distance 2 of each other are first linked
through a shared point one flip away (65 points each, a minimum per point), which folds a group of near
copies into few components; the join then only returns links between different components. Keys with more
than `crowd` members leave the join: two members at distance 4 or less have a point at distance 2 or less
from both, so linking every member to the minimum of its 2081 points finds the same components with work
that grows with the members, not with their square. No join is a broadcast: what is small in a compressed file
need not be so in the driver.

keep_one, the pipeline's near-dedup, wants all pairs whose word shingles have a Jaccard similarity of 0.8. Such
sets differ in 15 % of a SimHash's bits, so no few segments of 64 bits would do. Its fingerprints have segments of
some 4 bits more than the logarithm of the number of texts, so that chance meetings stay few at every size, and
as many segments as find such pairs with a probability of 0.975: 24 of 20 bits for 50,000 texts, 32 of 22 for
250,000. A segment's wildcard is put on its 8 weakest bits in turn (those whose votes were closest to even; a bit
that differs between near copies is one of these). A pair meets where in some segment at most one bit differs:
from 0.85 on practically always. What meets is checked by 56 further bits and the sets' sizes, which each key
carries along, then by the shingle sets themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_digest, xxh3_64_intdigest, xxh64_intdigest

from vellumite.llm._common import bucketed, components, fresh_path, give_back, remove_path, written, written_at

DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
CROWD = 4096
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp long): the fingerprint's bits as a signed long. A-Z are lower-cased; words end at ASCII white space."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {dict(slim.dtypes)['key']}, fp long"

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["key", "fp"])
        give_back()

    return slim.mapInArrow(run, schema)


def _bits(n: int) -> int:
    """An unsigned 64-bit pattern as a signed long."""
    return n - (1 << 64) if n >> 63 else n


def _single() -> list[int]:
    return [_bits(1 << i) for i in range(64)]


def _star(points: DataFrame) -> DataFrame:
    """Links every fingerprint at a point to the least fingerprint there: (a, b), without pairs."""
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b <> c")
    return points.join(least.select(F.col("point").alias("_p"), "b").hint("merge"), F.col("point") == F.col("_p")).where("fp <> b").select(F.col("fp").alias("a"), "b")


def _spread(fps: DataFrame) -> DataFrame:
    """Deals fingerprints over all tasks before each becomes many rows; their files are few and small."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _near_points(fps: DataFrame, flips: int) -> DataFrame:
    """(fp, point): the points within `flips` (1 or 2) flipped bits of each fingerprint."""
    one = F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in _single()])
    out = _spread(fps).select("fp", F.posexplode(one).alias("i", "x")).select("fp", "i", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    if flips == 1:
        return out.select("fp", "point")
    more = F.filter(F.transform(one, lambda x, j: F.when((j == 0) | (j > F.col("i")), x)), lambda x: x.isNotNull())
    return out.select("fp", "point", F.explode(F.when(F.col("i") == 0, F.array(F.lit(0).cast("long"))).otherwise(more)).alias("x")).select("fp", F.col("point").bitwiseXOR(F.col("x")).alias("point")).distinct()


def _variants(fps: DataFrame) -> DataFrame:
    """fps with one row per wildcard bit: `slot` (0 to 63) and `rest`, the segment without that bit."""
    keys = []
    for at, size in SEGMENTS:
        whole = ((1 << size) - 1) << at
        keys += [F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_bits(whole & ~(1 << i))).cast("long")).alias("rest")) for i in range(at, at + size)]
    return _spread(fps).select("*", F.explode(F.array(*keys)).alias("k")).select(*fps.columns, "k.slot", "k.rest")


def _first_slot(x: Column) -> Column:
    """The slot under which a pair with difference x is kept: of the first segment with at most one differing bit, that bit, or its first."""
    out = F.lit(None).cast("int")
    for at, size in reversed(SEGMENTS):
        part = x.bitwiseAND(F.lit(_bits(((1 << size) - 1) << at)).cast("long"))
        place = F.bit_count(part - F.lit(1).cast("long"))  # a power of two less one has as many ones as zeros below it
        place = F.when(part == F.lit(-(1 << 63)).cast("long"), F.lit(63)).otherwise(place) if at + size == 64 else place
        out = F.when(part == 0, F.lit(at)).when(F.bit_count(part) == 1, place).otherwise(out)
    return out


def near_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, each at distance at most 4 or joined by such links, enough for all components."""
    fps = written(fps.select("fp").where("fp is not null").distinct(), "fps")
    near = written(_star(_near_points(fps, 1)), "near")
    folded = written(components(near), "folded")
    at = fps.join(folded.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("part"))
    at = written(at, "parts")
    crowded = written(_variants(fps).groupBy("slot", "rest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd), "crowded")
    keyed = _variants(at)
    links = near
    if not crowded.isEmpty():
        hot = crowded.select(F.col("slot").alias("_s"), F.col("rest").alias("_r")).hint("merge")
        members = keyed.join(hot, (F.col("slot") == F.col("_s")) & (F.col("rest") == F.col("_r")), "left_semi").select("fp").distinct()
        links = links.unionAll(_star(_near_points(members, 2)))
        keyed = keyed.join(hot, (F.col("slot") == F.col("_s")) & (F.col("rest") == F.col("_r")), "left_anti")
    x, y = keyed.alias("x"), keyed.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    same = (F.col("x.slot") == F.col("y.slot")) & (F.col("x.rest") == F.col("y.rest"))
    check = (F.col("x.fp") < F.col("y.fp")) & (F.col("x.part") != F.col("y.part")) & (F.bit_count(differ) <= DISTANCE) & (_first_slot(differ) == F.col("x.slot"))
    return links.unionAll(x.join(y.hint("merge"), same & check).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id = smallest doc_id of the near-duplicate component.

    Null and wordless texts have fingerprint 0, which links like any other. A null doc_id belongs to the
    component of its text and is never its id, unless all are null. Repeated rows keep their number.
    """
    prints = written(fingerprints(docs, doc_id, text, shingle).withColumnRenamed("key", "doc_id"), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = components(near_links(classes, crowd))
    placed = classes.join(groups.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    placed = written(placed, "placed")
    ids = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    by_print = written(placed.join(ids.hint("merge"), "group").select(F.col("fp").alias("_fp"), "component_id"), "by_print")
    return prints.join(by_print.hint("merge"), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


#: Texts of this similarity over their shingles are near duplicates.
SIMILARITY = 0.8
#: Bits of a segment that take the wildcard, and the chance that a pair at the similarity is not met.
WEAKEST, MISSED = 8, 0.025
#: Bits that differ between sets of similarity 0.8, as a share (small sets: a little more than 0.1515).
DIFFER = 0.16
#: Such sets differ in some 8 of the check's 56 bits, give or take 3; unlike ones in 28, give or take 4.
CHECK_MOST = 19
#: A set's size is told in steps of 6 %; those of sets of similarity 0.8 are 4 steps apart at most.
STEP, STEPS = math.log(1.06), 4
#: Members of a key up to which its pairs are checked at once; fuller keys are folded first.
FEW = 2
#: Words of 64 bits of a set's parity map: the least, and as many as a set of some thousands fills well.
MAP_WORDS = (8, 128)
_COLUMNS = "node long, shingles binary, parts array<int>, weak array<int>, info long"


def segments(texts: int) -> tuple[int, int]:
    """(number of segments, bits of each) for so many texts."""
    bits = min(30, max(16, math.ceil(math.log2(max(2, texts))) + 4))
    same = 1 - 0.1515
    met = same**bits + 0.8 * bits * 0.1515 * same ** (bits - 1)  # the bit that differs is among the weakest of both in 4 of 5 pairs
    return math.ceil(math.log(MISSED) / math.log(1 - met)), bits


def votes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Ones less zeros at every bit of a fingerprint of `bits` bits (rounded up to 64), over a set of 64-bit hashes."""
    words = -(-bits // 64)
    xor, times = (np.array([xxh64_intdigest(k.to_bytes(2, "little") + bytes([side])) for k in range(words)], np.uint64) for side in (0, 1))
    times |= np.uint64(1)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4080):
        x = (hashes[at : at + 4080, None] ^ xor) * times
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        found = np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(found), 255):
            ones += np.add.reduce(found[k : k + 255], axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def shingle_sketch(text: str | None, shingle: int = 5, shape: tuple[int, int] = (24, 20)) -> tuple:
    """Of the set of word shingles: a 64-bit hash, the set as sorted 32-bit hashes, the segments, masks of their weakest bits, and the check's bits beside the size."""
    parts, size = shape
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    n = max(1, len(words) - shingle + 1) if words else 0
    starts, ends = (ends - sizes + 1)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist() if words else []
    whole = np.unique(np.frombuffer(b"".join([xxh3_64_digest(joined[a:b]) for a, b in zip(starts, ends)]), "<u8"))
    found = votes(whole, parts * size + 56)
    lead, places = found[: parts * size].reshape(parts, size), np.int32(1) << np.arange(size, dtype=np.int32)
    weak = np.argsort(np.abs(lead), axis=1, kind="stable")[:, :WEAKEST]
    check = np.packbits(np.append(found[parts * size :][:56] > 0, np.zeros(8, bool)), bitorder="little").view("<u8")
    info = int(check[0]) << 8 | min(255, int(math.log(max(1, len(whole))) / STEP))
    return _bits(xxh3_64_intdigest(whole.tobytes())), np.unique(whole.astype("<u4")).tobytes(), (lead > 0) @ places, places[weak].sum(1, dtype=np.int32), _bits(info)


def _keys(classes: DataFrame, bits: int) -> DataFrame:
    """(key, node, info): each segment without one of its weakest bits, beside which bit of which segment it is."""
    which = f"filter(sequence(0, {bits - 1}), i -> (shiftright(weak[s], i) & 1) = 1)"
    key = f"shiftleft(cast(s * {bits} + i as bigint), {bits}) | cast(v & ~shiftleft(1, i) as bigint)"
    spread = classes.select("node", "info", "parts", "weak").repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    return spread.select(F.explode(F.expr(f"flatten(transform(parts, (v, s) -> transform({which}, i -> {key})))")).alias("key"), "node", "info")


def _alike(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    sets = [classes.select(F.col("node").alias(f"_{c}"), F.col("shingles").alias(f"s{c}")) for c in "ab"]
    met = pairs.join(sets[0].hint("merge"), F.col("a") == F.col("_a")).join(sets[1].hint("merge"), F.col("b") == F.col("_b")).select("a", "b", "sa", "sb")

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        give_back()

    return met.mapInArrow(check, "a long, b long")


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Of a set of 32-bit hashes: per place (a hash's low bits) whether an odd number falls there, as 64-bit words, a power of two of them by the set's size.

    Two maps of a size differ in at most as many bits as the sets have elements that only one of them holds, and a map
    of half the words is the exclusive or of its halves.
    """
    words = MAP_WORDS[0]
    while words < MAP_WORDS[1] and 32 * words < len(shingles):
        words *= 2
    odd = np.bincount(shingles & np.uint32(64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _mapped(rows: DataFrame) -> DataFrame:
    """rows with the size and the parity map of `shingles`, the last column, in its place."""
    kinds = rows.drop("shingles").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", `size` int, `map` array<bigint>"

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([len(x) for x in sets], pa.int32()), pa.array([parity_map(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "size", "map"])
        give_back()

    return rows.mapInArrow(run, schema)


def _may_reach(similarity: float) -> Column:
    """False for two rows with `size` and `map` whose sets surely have not the similarity: their maps differ in more bits than such sets have elements apart."""
    words = "least(size(map), size(_map))"
    half = lambda m: f"IF(size({m}) = {words}, {m}, transform(sequence(0, {words} - 1), i -> {m}[i] ^ {m}[i + {words}]))"
    apart = f"aggregate(zip_with({half('map')}, {half('_map')}, (a, b) -> bit_count(a ^ b)), 0, (x, y) -> x + y)"
    return F.expr(f"greatest(size(map), size(_map)) > 2 * {words} OR {apart} <= (size + _size) * {(1 - similarity) / (1 + similarity)!r}D + 0.001D")


def _close() -> Column:
    """The check of two rows of _keys, the second's columns with an underscore first."""
    differ = F.shiftrightunsigned(F.col("info").bitwiseXOR(F.col("_info")), 8)
    size = lambda c: F.col(c).bitwiseAND(F.lit(255).cast("long"))
    return (F.bit_count(differ) <= CHECK_MOST) & (F.abs(size("info") - size("_info")) <= STEPS)


def _underscored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in columns])


def _near(bits: int, parts: int) -> Column:
    """Whether two rows with `parts` and `weak` differ as little over all bits as sets of the similarity do, and this key is the first that they share."""
    total = bits * parts
    most = int(total * DIFFER + 2.5 * math.sqrt(total * DIFFER * (1 - DIFFER)))
    far = "aggregate(zip_with(parts, _parts, (a, b) -> bit_count(a ^ b)), 0, (x, y) -> x + y)"
    both = "(weak[t] & _weak[t])"
    shared = f"(CASE bit_count(parts[t] ^ _parts[t]) WHEN 0 THEN {both} <> 0 WHEN 1 THEN ((parts[t] ^ _parts[t]) & {both}) <> 0 ELSE false END)"
    slot = f"cast(shiftright(key, {bits}) as int)"
    earlier = f"exists(filter(sequence(0, {parts - 1}), t -> t < {slot} div {bits}), t -> {shared})"
    # Where a whole segment is equal, several keys are shared: the one of its first common bit counts.
    own = f"{slot} div {bits}"
    first = f"(parts[{own}] <> _parts[{own}] OR shiftleft(1, {slot} % {bits}) = ((weak[{own}] & _weak[{own}]) & -(weak[{own}] & _weak[{own}])))"
    return F.expr(f"{far} <= {most} AND NOT {earlier} AND {first}")


def similar_links(classes: DataFrame, shape: tuple[int, int], similarity: float = SIMILARITY, few: int = FEW, stars: int = 3) -> DataFrame:
    """Links (a, b) between classes (node, shingles, parts, weak, info) that share a key and have the similarity, enough for all components.

    Under keys of up to `few` members, as chance and pairs make them, all pairs are checked. Of fuller keys every
    member is compared with one other of another component: first with the one that shares keys with most others,
    as the original of many copies does, then `stars` - 1 times with any. That folds dense groups without pairs.
    Then members of different components meet, each pair under its first key only, and there the largest component's
    members are compared with the rest only. No pair is left out but those that differ too much over all bits, and those
    whose parity maps prove that they have not the similarity: the copies of a text that are near it but not near each
    other would else leave the join as pairs.
    """
    parts, bits = shape
    keyed = _keys(classes, bits).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    keyed = written(keyed, "keyed")
    loose, full = keyed.where(F.col("n") <= few), keyed.where(F.col("n") > few)
    met = loose.join(_underscored(loose, "key", "node", "info"), (F.col("key") == F.col("_key")) & (F.col("node") > F.col("_node")) & _close())
    links = written(_alike(met.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct(), classes, similarity), "links")
    if full.isEmpty():
        return links
    # A row per class with all its keys: components are put to classes, not to keys.
    company = written(full.groupBy("node").agg(F.first("info").alias("info"), F.sum("n").alias("met"), F.collect_list("key").alias("keys")), "company")
    fields, by_key = ("node", "info", "part"), Window.partitionBy("key")
    for k in range(stars + 1):
        folded = components(links).select(F.col("node").alias("_f"), "component")
        seen = company.join(folded.hint("merge"), F.col("node") == F.col("_f"), "left").select(F.explode("keys").alias("key"), "node", "info", "met", F.coalesce("component", "node").alias("part"))
        if k == stars:
            break
        order = F.struct(F.when(F.lit(k == 0), -F.col("met")).otherwise(F.lit(0)).alias("m"), F.xxhash64("node", F.lit(k)).alias("h")).alias("order")
        headed = seen.select("key", *fields, F.min(F.struct(order, *fields)).over(by_key).alias("head"))
        headed = headed.select(*fields, "head.order", *[F.col(f"head.{c}").alias(f"_{c}") for c in fields])
        met = headed.where((F.col("part") != F.col("_part")) & _close()).groupBy("node").agg(F.min(F.struct("order", "_node")).alias("m"))
        links = links.unionAll(written(_alike(met.select(F.col("node").alias("a"), F.col("m._node").alias("b")), classes, similarity), "star"))
    counted = seen.repartition("key").withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("key", "part")))
    several = F.min("part").over(by_key) < F.max("part").over(by_key)
    mixed = counted.select("key", *fields, F.max(F.struct("alike", "part")).over(by_key)["part"].alias("large"), several.alias("several")).where("several")
    mixed = mixed.groupBy("node").agg(F.first("info").alias("info"), F.first("part").alias("part"), F.collect_list(F.struct("key", "large")).alias("keys"))
    prints = classes.select(F.col("node").alias("_n"), "parts", "weak", "shingles")
    mixed = _mapped(mixed.join(prints.hint("merge"), F.col("node") == F.col("_n")).select("keys", *fields, "parts", "weak", "shingles"))
    sketch = ("parts", "weak", "size", "map")
    mixed = mixed.select(F.explode("keys").alias("k"), *fields, *sketch)
    mixed = written(mixed.select("k.key", "k.large", *fields, *sketch), "mixed")
    rest = _underscored(mixed.where("part <> large"), "key", *fields, *sketch)
    # A pair of which neither is of the largest component is met from both sides.
    once = (F.col("part") == F.col("large")) | (F.col("node") > F.col("_node"))
    other = (F.col("key") == F.col("_key")) & (F.col("part") != F.col("_part"))
    met = mixed.join(rest, other & once & _close() & _near(bits, parts) & _may_reach(similarity)).select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct()
    return links.unionAll(_alike(met, classes, similarity))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near duplicates: of each component the row of the smallest doc_id stays (of several such rows, or where all are null, one).

    Texts link where the sets of their word shingles have this Jaccard similarity and their fingerprints share a
    key; texts with equal sets always do. Null and wordless texts have the empty set, so one of them stays. An
    empty table gives no row.
    """
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(*columns).alias("_hash"), F.xxhash64(F.lit(1), *columns).alias("_more"))
    slim = keyed.select("doc_id", "_hash", "text")
    kind = dict(slim.dtypes)["doc_id"]
    shape = segments(slim.count())

    def sketch(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                nodes, sets, parts, weak, info = zip(*[shingle_sketch(t.as_py(), shingle, shape) for t in part.column(2)])
                several = [pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x).astype(np.int32)), shape[0]).cast(pa.list_(pa.int32())) for x in (parts, weak)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), *several, pa.array(info, pa.int64())], names=["doc_id", "_hash", "node", "shingles", "parts", "weak", "info"])
        give_back()

    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "sketches")
    sketched = written_at(slim.mapInArrow(sketch, f"doc_id {kind}, _hash long, {_COLUMNS}"), path)
    # Rows of a class have equal sets; any of them stands for the others.
    alike = [F.first(c).alias(c) for c in ("shingles", "parts", "weak", "info")]
    classes = bucketed(sketched.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")).alias("first"), *alike), "node", "classes")
    different = sketched.groupBy("doc_id", "_hash").count().where("count > 1").limit(1).isEmpty()
    remove_path(spark, path)
    groups = components(similar_links(classes, shape, similarity)).withColumnRenamed("node", "_node")
    placed = classes.select("node", "first").join(groups, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    first = placed.select(F.col("first.doc_id").alias("_id"), F.col("first._hash").alias("_first"))
    same = (F.col("_hash") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = keyed.join(first, same, "left_semi").select("_row", "_hash", "_more")
    # Rows equal in every column are one document.
    return (kept if different else kept.dropDuplicates(["_hash", "_more"])).select("_row.*")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
